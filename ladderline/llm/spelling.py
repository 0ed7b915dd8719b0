"""Spelling variants: blocks of words, NumPy products of their letter counts, verified edits.

Two words one edit apart have letter counts at squared distance 1 (a letter more or less) or 2 (one
letter for another), and equal or neighbouring lengths. Squared distances between two blocks of words
come from one matrix product, |x|^2 + |y|^2 - 2 xy; pairs at most two apart in equal or adjacent
lengths are compared letter by letter.

Blocks lose no pair: letters are dealt into classes, an edit touches the counts of at most two classes,
so near words agree on all others. A word goes to one block for every two classes left out, a pair
counts in the first such block. Blocks beyond MAX_BLOCK words are cut into parts, and every two parts
meet in a task of their own. A task returns a count and the best partner per word, never pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderline.session import discard, new_path, written

LEAST_LENGTH = 7
LEAST_COUNT = 2
DELETE_ONE_IN = 31
FORM_FACTOR = 10  # a form occurs at least so many times as often as the word
MAX_BLOCK = 32_768  # words of one block that one task compares
BUCKET_ROWS = 65_536
TILE = 512  # rows of one matrix product
_WIDTH = 48  # letters compared as arrays; longer words one by one
_FLUSH = 200_000  # distinct words a counting task holds
_RUNS = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
_LETTERS = np.r_[ord("a"):ord("z") + 1, 0xC0:0x100]
# letters by how often texts use them; dealt in turn, classes come out about even
_ORDER = "entaiohrsulcdfgbmpwyvkzqxj" + "".join(map(chr, range(0xC0, 0x100)))


def classes(n_words: int) -> int:
    """Letter classes for a table of so many words: five, one more for each eightfold beyond 2^22."""
    return 5 + max(0, -(-((max(n_words, 1) - 1) >> 22).bit_length() // 3))


def observed(docs: DataFrame) -> DataFrame:
    """word, n: every result of the deletion rule of LEAST_LENGTH letters and more, with its occurrences.

    Null text has no words. In rows without a doc_id no letter is deleted. Repeated rows count each.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], schema=schema)
            seen.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(*batch.columns):
                runs = Counter(_RUNS.findall((text.as_py() or "").encode().lower().decode()))  # bytes lower only A-Z
                if not doc_id.is_valid:
                    seen.update(runs)
                    continue
                start = zlib.crc32(b"%d:" % doc_id.as_py())
                for run_, count in runs.items():
                    h = zlib.crc32(run_.encode(), start)
                    if h % DELETE_ONE_IN == 0:
                        at = h % len(run_)
                        run_ = run_[:at] + run_[at + 1:]
                        if len(run_) < LEAST_LENGTH:
                            continue
                    seen[run_] += count
                if len(seen) >= _FLUSH:
                    yield flushed()
        if seen:
            yield flushed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_counts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(counts, lengths): one row of counts of the 90 letters for every word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    rows = np.repeat(np.arange(len(words)), lengths)
    counts = np.bincount(rows * 256 + letters, minlength=256 * len(words)).reshape(len(words), 256)
    return counts[:, _LETTERS].astype(np.int32), lengths


def _class_of(k: int) -> np.ndarray:
    place = {ord(c): i for i, c in enumerate(_ORDER)}
    turn = np.array([place[c] for c in _LETTERS.tolist()])
    return np.where(turn // k % 2 == 0, turn % k, k - 1 - turn % k)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def block_keys(counts: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit key per word and pair of classes left out; chance collisions only add comparisons."""
    weights = np.random.default_rng(7).integers(1, 1 << 62, len(_LETTERS), dtype=np.uint64)
    own = _class_of(k)
    with np.errstate(over="ignore"):
        sums = np.stack([_mixed((counts[:, own == c].astype(np.uint64) * weights[own == c]).sum(axis=1, dtype=np.uint64)) for c in range(k)])
        salted = sums * (2 * np.arange(k, dtype=np.uint64) + np.uint64(3))[:, None]
        keys = [_mixed(salted.sum(axis=0, dtype=np.uint64) - salted[x] - salted[y] + np.uint64(i + 1)) for i, (x, y) in enumerate(combinations(range(k), 2))]
    return np.stack(keys, axis=1).view(np.int64)


def _blocked(words: DataFrame, k: int) -> DataFrame:
    """key, pick (which two classes are left out), word, n for every block that a word is in."""
    picks = k * (k - 1) // 2
    schema = pa.schema([("key", pa.int64()), ("pick", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                keys = block_keys(letter_counts(batch.column("word").to_pylist())[0], k)
                for pick in range(picks):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[:, pick]), pa.array(np.full(batch.num_rows, pick, np.int32)), batch.column("word"), batch.column("n")], schema=schema)

    return words.select("word", "n").mapInArrow(run, "key long, pick int, word string, n long")


def _letters(words: list[str]) -> np.ndarray:
    """The first _WIDTH letters of every word, zeros behind its end."""
    return np.array([w.encode("latin-1") for w in words], f"S{_WIDTH}").view(np.uint8).reshape(len(words), _WIDTH)


def _one_edit(a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Whether rows of letters, b a letter longer where not `equal` long, differ by exactly one edit."""
    differ = a != b
    at = differ.argmax(axis=1)
    without = np.where(np.arange(_WIDTH - 1) < at[:, None], b[:, :-1], b[:, 1:])
    return np.where(equal, differ.sum(axis=1) == 1, (without == a[:, :-1]).all(axis=1))


def _one_edit_of_long(a: str, b: str) -> bool:
    at = next((p for p, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + 1:] == b[at + 1:] if len(a) == len(b) else a[at:] == b[at + 1:]


def near_pairs(words: list[str], key: np.ndarray, pick: np.ndarray, part: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j of the near pairs of rows that share a key and a pick. `part` is 0, or 1 and 2 for the two parts
    of a large block that meet here: then only pairs across them count."""
    counts, lengths = letter_counts(words)
    letters = _letters(words)
    order = np.lexsort((lengths, pick, key))
    counts, lengths, key, pick, part = (x[order] for x in (counts, lengths, key, pick, part))
    own, picks = _class_of(k), np.full((k, k), -1)
    for i, (x, y) in enumerate(combinations(range(k), 2)):
        picks[x, y] = picks[y, x] = i
    for x in range(k):
        picks[x, x] = picks[0, max(x, 1)]  # changed in one class: its first pair
    def starts() -> np.ndarray:
        return np.r_[True, (key[1:] != key[:-1]) | (pick[1:] != pick[:-1])] if len(key) else np.zeros(0, bool)

    sizes = np.diff(np.r_[np.flatnonzero(starts()), len(key)])
    shared = np.repeat(sizes > 1, sizes)  # a word alone in its block has nothing to meet
    order, counts, lengths, key, pick, part = (x[shared] for x in (order, counts, lengths, key, pick, part))
    group = np.cumsum(starts()) - 1
    ends = np.r_[np.flatnonzero(starts()), len(key)]
    exact = np.float32 if not len(lengths) or lengths.max() < 2048 else np.float64
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def product(a: slice, b: slice) -> None:
        x, y = counts[a], counts[b]
        used = np.flatnonzero(x.any(axis=0) | y.any(axis=0))
        x, y = x[:, used].astype(exact), y[:, used].astype(exact)
        squared = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T)
        i, j = np.nonzero(squared <= 2)
        i, j = i + a.start, j + b.start
        keep = (i < j) & (group[i] == group[j]) & (abs(lengths[i] - lengths[j]) <= 1) & ((part[i] == 0) | (part[i] != part[j]))
        i, j = i[keep], j[keep]
        if not len(i):
            return
        changed = counts[i] != counts[j]
        touched = np.stack([changed[:, own == c].any(axis=1) for c in range(k)], axis=1)
        low, high = touched.argmax(axis=1), k - 1 - touched[:, ::-1].argmax(axis=1)
        keep = touched.any(axis=1) & (picks[low, high] == pick[i])
        i, j = i[keep], j[keep]
        # rows lie in order of length, so j's word is never the shorter one
        u, v, equal = order[i], order[j], lengths[i] == lengths[j]
        keep = _one_edit(letters[u], letters[v], equal)
        for p in np.flatnonzero(lengths[j] >= _WIDTH).tolist():
            keep[p] = _one_edit_of_long(words[u[p]], words[v[p]])
        if keep.any():
            found.append((u[keep], v[keep]))

    at = 0
    while at < len(ends) - 1:
        # as many whole blocks as fill a tile; a larger block is cut into tiles in order of length
        upto = at + 1
        while upto < len(ends) - 1 and ends[upto + 1] - ends[at] <= TILE:
            upto += 1
        start, end = int(ends[at]), int(ends[upto])
        at = upto
        if end - start <= TILE:
            product(slice(start, end), slice(start, end))
            continue
        for a in range(start, end, TILE):
            first = slice(a, min(a + TILE, end))
            for b in range(a, end, TILE):
                if lengths[b] > lengths[first.stop - 1] + 1:
                    break
                product(first, slice(b, min(b + TILE, end)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: near words, and the most frequent of them (ties: least), for words that have any.

    `words` has distinct word and n.
    """
    spark = words.sparkSession
    k = classes(words.count())
    blocked = written(_blocked(words, k), "spelling-blocks")
    sizes = blocked.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    parts = F.ceil(F.col("rows") / F.lit(MAX_BLOCK // 2)).cast("int")
    large = written(sizes.where(F.col("rows") > MAX_BLOCK).select(F.col("key").alias("_key"), parts.alias("parts")), "spelling-large")
    rows = blocked.join(large, F.col("key") == F.col("_key"), "left").drop("_key")
    mine = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    # a part meets itself (j = own part) and every other part
    meets = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("mine", F.coalesce(mine, F.lit(0))).withColumn("other", F.explode(meets))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    part = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") == low, 1).otherwise(2)
    buckets = max(1, -(-blocked.count() // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("key", low, high), F.lit(buckets))
    rows = rows.select(bucket.alias("bucket"), "key", low.alias("low"), high.alias("high"), "pick", "word", "n", part.cast("int").alias("part"))
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def run(table: pa.Table) -> pa.Table:
        words_, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        key, low_, high_, pick, part_ = (table.column(c).to_numpy() for c in ("key", "low", "high", "pick", "part"))
        # the two parts that meet belong to the block's name
        with np.errstate(over="ignore"):
            key = key ^ (low_.astype(np.int64) * 0x632BE59BD9B4E019) ^ (high_.astype(np.int64) * 0x2545F4914F6CDD1D)
        i, j = near_pairs(words_, key, pick, part_, k)
        names = sorted({words_[p] for p in np.concatenate((i, j)).tolist()})
        place = {w: p for p, w in enumerate(names)}
        left = np.array([place[words_[p]] for p in i.tolist()], np.int64)
        right = np.array([place[words_[p]] for p in j.tolist()], np.int64)
        u, v, m = np.concatenate((left, right)), np.concatenate((right, left)), np.concatenate((n[j], n[i]))
        order = np.lexsort((v, -m, u))
        u, v, m = u[order], v[order], m[order]
        first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, np.int64)
        return pa.table([[names[p] for p in u[first].tolist()], np.diff(np.r_[first, len(u)]), m[first], [names[p] for p in v[first].tolist()]], schema=schema)

    met = rows.groupBy("bucket").applyInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("least"), "best")).alias("top")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("top.least")).alias("best_n"), F.col("top.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for `forms` (word, form): pointers are doubled until none moves. Counts rise tenfold a step, so
    chains are short and have no ring."""
    spark = forms.sparkSession
    path = new_path(spark, "spelling-roots")
    current = written(forms.select("word", F.col("form").alias("root")), "", path)
    while True:
        further = current.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        following = new_path(spark, "spelling-roots")
        moved = written(current.join(further, F.col("root") == F.col("_word"), "left").select(
            "word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "", following)
        again = bool(moved.where("moved").head(1))
        discard(spark, path)
        current, path = moved.drop("moved"), following
        if not again:
            return current


def variants(docs: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n for every distinct word of LEAST_LENGTH letters seen LEAST_COUNT times.

    form is the most frequent near word (ties: least in code point order) if it occurs at least
    `factor` times as often, else null; root follows forms to the last. Null text has no words, rows
    without a doc_id lose no letter, repeated rows count each. Other columns are ignored. An empty
    table gives no rows.
    """
    words = written(observed(docs).where(F.col("n") >= LEAST_COUNT), "spelling-words")
    near = neighbours(words)
    joined = written(words.join(near, "word", "left"), "spelling-near")
    good = F.col("best_n") >= factor * F.col("n")
    formed = joined.select("word", F.when(good, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                           F.when(good, F.col("best_n")).alias("form_n"))
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
