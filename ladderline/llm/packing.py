"""Packing documents into fixed windows, every window at the target token proportions.

Deficit round-robin in closed form. Source queues stand in a fixed order; in each window every queue
is credited its share of the window, spends the whole tokens of its credit, and carries the rest.
With x tokens filled so far and S_j tokens in the first j queues of T, the first j queues have spent
floor(x * S_j / T), so what queue j spends by any window is a difference of two such floors. The
carried deficits are the remainders, exact across windows, tasks and partitions, and all windows but
the last one are full. A document needs only its queue's S_(j-1), S_j and its own place in the queue
to cut itself: only a plan of one row per task and source is joined to the ids.

A queue must be worth a token per window for that; smaller sources share one queue.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline.llm.common import arrow_batches, byte_letters
from ladderline.session import new_path, written

WINDOW = 2048
END_ID = 1
# bytes of words and ids in one generation of a worker's two caches, not a limit of the vocabulary
_WORDS, _PARTS = 56 << 20, 24 << 20
_BATCH = 4 << 20  # characters encoded at a time
# a line of letters, then marks: the vocabulary's own rule cuts there, and sees the letters in lower case
_LETTERS_MARKS = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)|(.*))$", re.MULTILINE)
_WORD_END, _END_BYTE = "</w>", b"\n"  # no word has such a byte
# the same letters and marks by bytes: the first byte of a letter beyond ASCII tells only with the second
_BLANK, _LETTER, _MARK, _OTHER = range(4)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = _MARK
_KINDS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = _LETTER
_KINDS[ord(" ")] = _BLANK
_LOWER = np.frombuffer(bytes(range(256)).lower().replace(b" ", _END_BYTE), np.uint8)
_LATIN, _NO_LETTERS = 0xC3, (0x97, 0xB7)

_TOKENS = pa.schema([("part", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("source", pa.string()),
                     ("before", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([(n, pa.int64()) for n in (
    "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length")])
_encoders: dict[str, "Encoder"] = {}


class Generations:
    """A cache of two generations: entries used again outlive the clearing of the older one."""

    def __init__(self, limit: int):
        self.limit, self.size = limit, 0
        self.young: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def keep(self, words: list[str], ids: list[bytes]) -> None:
        self.young.update(zip(words, ids))
        # about what two small objects and a slot take besides
        self.size += sum(map(len, words)) + sum(map(len, ids)) + 100 * len(words)

    def absent(self, wanted: set[str]) -> list[str]:
        """Those of `wanted` that neither generation holds; the others are in the younger one afterwards."""
        if self.size > self.limit:
            self.older, self.size, self.young = self.young, 0, {"": b""}
        missing, older = wanted.difference(self.young), self.older
        again = [w for w in missing if w in older] if older else []
        self.keep(again, [older[w] for w in again])
        return list(missing.difference(again)) if again else list(missing)


class Encoder:
    """Texts -> little-endian 32-bit ids. Kept per worker.

    The vocabulary drops white space and never joins over it, so text is cut at blanks and every
    distinct word of a batch is encoded once; Arrow numbers the words and puts the ids together.
    A word of letters and marks is one or two pieces of the vocabulary: these go straight to the
    merges, all of a batch in one call over bytes, where a byte that no word has stands for the end
    of a piece. Other words, and all of a vocabulary that is built otherwise, go through the
    tokenizer and are kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # before the import that reads it
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._words, self._parts = Generations(_WORDS), Generations(_PARTS)
        self._merged = _merges(path)

    def _encoded(self, parts: list[str]) -> list[bytes]:
        return [array("I", found.ids).tobytes() for found in self._tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        cut = _LETTERS_MARKS.findall("\n".join(new))
        letters = [a.lower() for a, _, _ in cut]
        simple = self._parts.absent({*letters, *(marks for _, marks, _ in cut)})
        self._parts.keep(simple, self._encoded(simple))
        others = list({other for _, _, other in cut if other})
        whole = dict(zip(others, self._encoded(others)))
        parts = self._parts.young
        self._words.keep(new, [parts[low] + parts[marks] if low else whole[other] for low, (_, marks, other) in zip(letters, cut)])

    def _kept(self, words: pa.Array) -> pa.Array:
        """The ids of words, each with its blank, by the tokenizer."""
        plain = [word[:-1] for word in words.to_pylist()]
        new = self._words.absent(set(plain))
        if new:
            self._learn(new)
        return pa.array(map(self._words.young.__getitem__, plain), pa.large_binary())

    def _ids(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words, each with its blank."""
        if not self._merged:
            return self._kept(words)
        starts = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
        data = np.frombuffer(words.buffers()[2], np.uint8, starts[-1])
        kinds, low = _KINDS[data], _LOWER[data]
        first = np.flatnonzero(data == _LATIN)
        first = first[~np.isin(data[first + 1], _NO_LETTERS)]
        kinds[first] = kinds[first + 1] = _LETTER
        low[first[low[first + 1] < 0x9F] + 1] += 0x20
        odd = np.flatnonzero((kinds == _OTHER) | (kinds == _MARK) & (np.append(kinds[1:], _BLANK) == _LETTER))
        simple = np.ones(len(words), bool)
        simple[np.searchsorted(starts, odd, "right") - 1] = False
        if simple.all():
            return self._merged(kinds, low)
        stays, place = np.repeat(simple, np.diff(starts)), np.empty(len(words), np.int64)
        place[simple], place[~simple] = np.arange(simple.sum()), np.arange(simple.sum(), len(words))
        others = self._kept(words.filter(pa.array(~simple)))
        return pa.concat_arrays([self._merged(kinds[stays], low[stays]), others]).take(pa.array(place))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of every text; all words of the texts are encoded together."""
        data = " ".join(["", *texts, ""]).replace("\n", " ").encode()
        starts = np.flatnonzero(np.frombuffer(data, np.uint8) == ord(" "))
        starts += 1
        words = _array(pa.large_string(), starts, data).dictionary_encode()
        ids = self._ids(words.dictionary).take(words.indices)
        at = np.cumsum([0] + [text.count(" ") + text.count("\n") + 1 for text in texts])
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[at].tolist()
        found = memoryview(ids.buffers()[2])
        return [bytes(found[a:b]) for a, b in zip(at, at[1:])]


def _array(kind: pa.DataType, starts: np.ndarray, data: bytes | np.ndarray) -> pa.Array:
    """Texts or bytes that lie one behind the other in `data`; the last start is the end of the last one."""
    return pa.Array.from_buffers(kind, len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)])


class Merges:
    """Words of letters and marks -> ids, by the merges of a vocabulary whose ids stand in their order."""

    def __init__(self, vocabulary: dict[str, int], special: set[int]):
        import tiktoken

        letters, ranks = byte_letters(), {}
        self._last = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            if i not in special:
                body = token.removesuffix(_WORD_END)
                self._last[i] = body != token
                raw = bytes(letters[c] for c in body)
                if len(raw) == 1 or _END_BYTE not in raw:
                    ranks[raw + (_END_BYTE if body != token else b"")] = i
        # without a special token the engine would look for an empty one at every place
        self._engine = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={"\0": len(self._last)})

    def __call__(self, kinds: np.ndarray, low: np.ndarray) -> pa.Array:
        """The ids of the words whose bytes lie one behind the other, a blank behind each."""
        following = np.append(kinds[1:], _BLANK)
        cut = np.flatnonzero((kinds == _LETTER) & (following == _MARK)) + 1
        text = np.insert(low, cut, ord(_END_BYTE)).tobytes().decode()
        ids = self._engine.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        pieces = np.cumsum((kinds != _BLANK) & (kinds != following))[kinds == _BLANK]  # up to each word's end
        ends = np.concatenate(([0], np.flatnonzero(self._last[ids]) + 1))
        return _array(pa.large_binary(), 4 * ends[np.concatenate(([0], pieces))], ids)


def _merges(path: str) -> Merges | None:
    """The merges of a vocabulary whose ids stand in the order of its merges; None for another."""
    with open(path, encoding="utf-8") as file:
        known = json.load(file)
    vocabulary, merges = known["model"]["vocab"], known["model"]["merges"]
    special = {t["id"] for t in known.get("added_tokens", [])}
    in_order = all(vocabulary.get("".join(pair) if isinstance(pair, list) else pair.replace(" ", "")) == 2 * 256 + n for n, pair in enumerate(merges))
    if not in_order or known["model"].get("end_of_word_suffix") != _WORD_END:
        return None
    return Merges(vocabulary, special)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Drops this worker's encoders: their words take memory that a task without texts needs."""
    _encoders.clear()


def tokenized(docs: DataFrame, tokenizer: str, label: str = "pack-ids") -> DataFrame:
    """Every row's ids, written once, with its place in its task and the tokens of its source before it there."""
    ending = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, so_far = encoder(tokenizer), TaskContext.get().partitionId(), {}

        def rows() -> Iterator[tuple]:
            place = 0
            for batch in batches:
                docs_, texts, sources = (column.to_pylist() for column in batch.columns)
                at = 0
                while at < len(texts):
                    upto, weight = at, 0
                    while upto < len(texts) and weight < _BATCH:
                        weight += len(texts[upto] or "")
                        upto += 1
                    found = encode([text or "" for text in texts[at:upto]])
                    for doc_id, source, ids in zip(docs_[at:upto], sources[at:upto], found):
                        ids += ending
                        count, before = len(ids) // 4, so_far.get(source, 0)
                        yield part, place, doc_id, source, before, count, ids
                        so_far[source] = before + count
                        place += 1
                    at = upto

        gc.disable()  # many small objects without a cycle, walked again and again
        try:
            yield from arrow_batches(rows(), _TOKENS, weigh=lambda r: len(r[6]))
        finally:
            gc.enable()

    spark = docs.sparkSession
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), source.alias("source"))
    schema = "part long, place long, doc_id long, source string, before long, doc_tokens long, ids binary"
    path = new_path(spark, label)
    rows.mapInArrow(run, schema).write.option("compression", "lz4").parquet(path)
    return spark.read.schema(schema).parquet(path)


def queues(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """part, source, offset (tokens of the queue before this task's), low and high (S_(j-1), S_j), total."""
    parts = tokens.groupBy("part", "source").agg(F.sum("doc_tokens").alias("n"))
    everything = W.partitionBy(F.lit(1))
    totals = parts.groupBy("source").agg(F.sum("n").alias("n"))
    # one row per source; a source worth less than a token per window goes to the shared queue
    total = F.sum("n").over(everything)
    sized = totals.withColumn("total", total).withColumn("big", F.col("n").cast("decimal(38,0)") * window >= F.col("total"))
    name = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    pooled = F.coalesce(F.sum(F.when(~F.col("big"), F.col("n"))).over(everything), F.lit(0)).cast("decimal(38,0)")
    own = F.struct(F.lit(0).alias("shared"), name.alias("key"))
    nobody = F.struct(F.lit(False).alias("none"), F.lit("").alias("name"))
    shared = F.struct(F.lit(1).alias("shared"), nobody.alias("key"))
    first_big = F.min(F.when(F.col("big"), own)).over(everything)
    # too little even together: it stands behind the first big source's tokens
    queue = F.when(F.col("big"), own).when(pooled * window >= F.col("total"), shared).otherwise(first_big)
    assigned = sized.withColumn("queue", queue).select("source", "queue", "total")
    bounds = assigned.join(totals, assigned["source"].eqNullSafe(totals["source"])).groupBy("queue", "total").agg(F.sum("n").alias("n"))
    upto = W.orderBy("queue").rowsBetween(W.unboundedPreceding, 0)  # at most `window` + 1 queues
    bounds = bounds.withColumn("high", F.sum("n").over(upto)).withColumn("low", F.col("high") - F.col("n")).drop("n")
    placed = parts.join(assigned.drop("total"), parts["source"].eqNullSafe(assigned["source"])).drop(assigned["source"])
    earlier = W.partitionBy("queue").orderBy("part", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    return (placed.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
            .join(bounds, "queue").select(F.col("part").alias("q_part"), F.col("source").alias("q_source"), "offset", "low", "high", "total"))


def cuts(first: int, count: int, low: int, high: int, total: int, window: int) -> Iterator[tuple[int, int, int, int]]:
    """Pieces (place in queue, length, sequence, offset there) of the `count` tokens from `first` of a queue."""

    def spent(k: int) -> tuple[int, int]:
        filled = min(window * k, total)
        below = filled * low // total
        return filled * high // total - below, below

    end = first + count
    k = max(0, first * total // ((high - low) * window) - 1)
    done, below = spent(k)
    while done > first:
        k -= 1
        done, below = spent(k)
    while first < end:
        following, below_next = spent(k + 1)
        if following > first:
            length = min(end, following) - first
            yield first, length, k, below_next - below + first - done
            first += length
        if following <= end:
            k, done, below = k + 1, following, below_next


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.

    Proportions are the sources' own shares, so that every id is in exactly one piece and all queues
    end together. Queues keep the stored order of their documents. Null text is empty and gives one
    piece, its end id; null sources are one source; repeated rows are packed each. Only the last
    sequence may be short; it is padded to `window` unless its length is a power of two. Other
    columns are ignored. An empty table gives no rows.
    """
    tokens = tokenized(docs, tokenizer)
    # a row per task and source: written, so that its size is known and decides how it is joined
    plan = written(queues(tokens, window), "pack-plan")
    joined = tokens.join(
        plan, (tokens["part"] == plan["q_part"]) & tokens["source"].eqNullSafe(plan["q_source"])
    ).select("doc_id", "doc_tokens", "ids", (F.col("offset") + F.col("before")).alias("first"), "low", "high", "total")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                ids = batch.column(2)
                plain = zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6)))
                for i, (doc_id, n, first, low, high, total) in enumerate(plain):
                    data = memoryview(ids[i].as_buffer())
                    for at, length, sequence, offset in cuts(first, n, low, high, total, window):
                        start = at - first
                        filled = min(window, total - window * sequence)
                        padded = filled if filled & (filled - 1) == 0 else window
                        yield (doc_id, start, length, zlib.crc32(data[4 * start:4 * (start + length)]), n, sequence, offset, padded)

        gc.disable()  # as above
        try:
            yield from arrow_batches(rows(), _PIECES, limit_rows=50_000)
        finally:
            gc.enable()

    return joined.mapInArrow(run, ", ".join(f"{f.name} long" for f in _PIECES))
