"""Exact removal of passages that earlier documents have, by super-k-mer partitioning.

A window is 50 consecutive words. Its minimiser is the least hash of the 4-word groups in it, so equal
windows have equal minimisers, and consecutive windows mostly share theirs: they travel as one packed
string to the bucket of the minimiser, about 72 words for 23 windows. Before that a task merges equal
strings, keeping the smallest and largest doc_id, so copies and common passages leave it once. In a
bucket only minimisers of two or more documents are unpacked; their windows are sorted and compared
word by word. What goes back is, per packed string, which windows start in which smaller document,
joined to the strings' places in the documents by a 128-bit hash.

A minimiser of very many words, as of a license line with other words around it in each document, is
no group of one bucket: its windows go one by one as 128-bit hashes through an aggregation of the
smallest and largest doc_id, which combines before its shuffle and spreads over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderline.llm.common import arrow_batches
from ladderline.session import shuffle_partitions, written

WINDOW = 50
GRAM = 4
_RUN = 256  # windows of one packed string at most; a longer run is cut, which loses nothing
_HELD = 48 << 20  # bytes of packed strings a task holds before it sends them off
_BUCKET = 32 << 20  # bytes of packed strings that a bucket should get
_CHUNK = 400_000  # words unpacked at a time in a bucket
_HOT = 1_000_000  # words with one minimiser, above which its windows go as hashes
_UNSEEN = 2_000  # a task leaves out minimisers of fewer than this part of _HOT words when it looks for hot ones
_EXPANSION = 3
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_A_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _B
    return h ^ (h >> np.uint64(29))


def _hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def minimisers(h: np.ndarray) -> np.ndarray:
    """The minimiser of every window of the words hashed to `h`."""
    n = len(h) - GRAM + 1
    grams = np.zeros(n, np.uint64)
    for k in range(GRAM):
        grams = grams * _A + h[k:k + n]
    low, width, reach = _mixed(grams), 1, WINDOW - GRAM + 1
    while 2 * width <= reach:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[:len(low) - (reach - width)], low[reach - width:])


def _cuts(low: np.ndarray) -> list[int]:
    return [0, *(np.flatnonzero(low[1:] != low[:-1]) + 1).tolist(), len(low)]


def packed(text: bytes, hot: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, bytes]]:
    """(minimiser, first window, windows, words as one string) of every super-k-mer of a text whose minimiser isn't hot."""
    found = text.split()
    if len(found) < WINDOW:
        return
    low = minimisers(_hashes(found))
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    cuts = _cuts(low)
    for a, b in zip(cuts, cuts[1:]):
        if hot and int(low[a]) in hot:
            continue
        for first in range(a, b, _RUN):
            last = min(b, first + _RUN)
            start = int(ends[first - 1]) + 1 if first else 0
            yield int(low[first]), first, last - first, joined[start:int(ends[last + WINDOW - 2])]


def hot_windows(text: bytes, hot: frozenset[int]) -> Iterator[tuple[int, bytes]]:
    """(window, its words as one string) of every window whose minimiser is hot."""
    found = text.split()
    if len(found) < WINDOW:
        return
    low = minimisers(_hashes(found))
    cuts = _cuts(low)
    chosen = [(a, b) for a, b in zip(cuts, cuts[1:]) if int(low[a]) in hot]
    if not chosen:
        return
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    for a, b in chosen:
        for i in range(a, b):
            yield i, joined[int(ends[i - 1]) + 1 if i else 0:int(ends[i + WINDOW - 1])]


def hot_minimisers(texts: DataFrame) -> frozenset[int]:
    """Minimisers with more than _HOT words in their super-k-mers: one at most for each _HOT words that travel."""
    least = max(1, _HOT // _UNSEEN)
    schema = pa.schema([("low", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(lows: list[np.ndarray], sizes: list[np.ndarray]) -> Iterator[tuple]:
            names, at = np.unique(np.concatenate(lows), return_inverse=True)
            n = np.bincount(at, np.concatenate(sizes)).astype(np.int64)
            yield from zip(names[n >= least].view(np.int64).tolist(), n[n >= least].tolist())

        def rows() -> Iterator[tuple]:
            lows, sizes, held = [], [], 0
            for batch in batches:
                for text in batch.column(2):
                    found = text.as_py().split()
                    if len(found) < WINDOW:
                        continue
                    low = minimisers(_hashes(found))
                    cuts = np.array(_cuts(low))
                    lows.append(low[cuts[:-1]])
                    sizes.append(np.diff(cuts) + WINDOW - 1)
                    held += len(cuts) - 1
                    if held > 1 << 20:
                        yield from counted(lows, sizes)
                        lows, sizes, held = [], [], 0
            if lows:
                yield from counted(lows, sizes)

        yield from arrow_batches(rows(), schema, limit_rows=50_000)

    found = texts.mapInArrow(run, "low long, n long").groupBy("low").agg(F.sum("n").alias("n")).where(F.col("n") > _HOT)
    return frozenset(row.low % (1 << 64) for row in found.select("low").toLocalIterator())


def _key(string: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(string)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _blob(entries: list[tuple[int, int, int, bytes]]) -> bytes:
    """Minimisers, smallest and largest documents, lengths and strings, compressed together."""
    head = [np.array([len(entries)], "<i8").tobytes()]
    head += [np.array([e[k] for e in entries], kind).tobytes() for k, kind in ((0, "<u8"), (1, "<i8"), (2, "<i8"))]
    head.append(np.array([len(e[3]) for e in entries], "<i8").tobytes())
    return zstandard.compress(b"".join(head + [e[3] for e in entries]), 3)


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, memoryview]:
    data = memoryview(zstandard.decompress(blob))
    n = int(np.frombuffer(data[:8], "<i8")[0])
    column = lambda k, kind: np.frombuffer(data[8 + 8 * n * k:8 + 8 * n * (k + 1)], kind)
    return column(0, "<u8"), column(1, "<i8"), column(2, "<i8"), column(3, "<i8"), data[8 + 32 * n:]


def _sent(texts: DataFrame, buckets: int, hot: frozenset[int] = frozenset()) -> DataFrame:
    """bucket, blob: the packed strings of all documents, equal ones merged as far as a task sees them."""
    schema = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blobs(held: dict) -> Iterator[tuple]:
            by: dict[int, list] = {}
            for string, (low, first, last) in held.items():
                by.setdefault(low % buckets, []).append((low, first, last, string))
            for bucket, entries in by.items():
                yield bucket, _blob(entries)

        def rows() -> Iterator[tuple]:
            held, weight = {}, 0
            for batch in batches:
                for doc, text in zip(batch.column(0), batch.column(2)):
                    doc_id = doc.as_py()
                    for low, _, _, string in packed(text.as_py(), hot):
                        old = held.get(string)
                        if old is None:
                            held[string] = (low, doc_id, doc_id)
                            weight += len(string)
                        elif doc_id < old[1] or doc_id > old[2]:
                            held[string] = (low, min(doc_id, old[1]), max(doc_id, old[2]))
                        if weight > _HELD:
                            yield from blobs(held)
                            held, weight = {}, 0
            yield from blobs(held)

        yield from arrow_batches(rows(), schema, weigh=lambda r: len(r[1]))

    return texts.mapInArrow(run, "bucket long, blob binary")


def _runs(strings: dict[bytes, list[int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(key, key, first window, last window, document) where a window of a string also starts in a smaller
    document than the largest that has the string."""
    names = list(strings)
    cut = [s.split(b" ") for s in names]
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    h = _hashes([w for c in cut for w in c])
    place = np.arange(len(h), dtype=np.uint64)
    up = np.cumprod(np.where(place == 0, np.uint64(1), _A), dtype=np.uint64)
    down = np.cumprod(np.where(place == 0, np.uint64(1), _A_INVERSE), dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * down, dtype=np.uint64)))
    counts = sizes - WINDOW + 1
    owner = np.repeat(np.arange(len(names)), counts)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = offsets[owner] + starts
    content = _mixed((sums[at + WINDOW] - sums[at]) * up[at])
    low = np.array([strings[s][0] for s in names], np.int64)
    high = np.array([strings[s][1] for s in names], np.int64)
    order = np.argsort(content, kind="stable")
    same = content[order]
    edges = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1], [True])))
    least = np.minimum.reduceat(low[owner][order], edges[:-1])
    first = np.empty(len(owner), np.int64)
    first[order] = np.repeat(least, np.diff(edges))
    for g in np.flatnonzero(np.diff(edges) > 1).tolist():
        members = order[edges[g]:edges[g + 1]].tolist()
        by: dict[tuple, int] = {}
        shown = [tuple(cut[owner[m]][starts[m]:starts[m] + WINDOW]) for m in members]
        if any(w != shown[0] for w in shown):  # equal hashes of different words: told apart here
            for m, w in zip(members, shown):
                by[w] = min(by.get(w, low[owner[m]]), low[owner[m]])
            for m, w in zip(members, shown):
                first[m] = by[w]
    wanted = first < high[owner]
    breaks = np.flatnonzero(np.concatenate((
        [True], (owner[1:] != owner[:-1]) | (first[1:] != first[:-1]) | (wanted[1:] != wanted[:-1]), [True])))
    key, of = (0, 0), -1
    for a, b in zip(breaks[:-1].tolist(), breaks[1:].tolist()):
        if wanted[a]:
            if owner[a] != of:
                of = owner[a]
                key = _key(names[of])
            yield *key, int(starts[a]), int(starts[b - 1]), int(first[a])


def _bucket(table: pa.Table) -> pa.Table:
    parts = [_unblob(x.as_py()) for x in table.column("blob")]
    low, first, last, length = (np.concatenate([p[k] for p in parts]) for k in range(4))
    part = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    begin = np.concatenate([np.cumsum(p[3]) - p[3] for p in parts])
    order = np.argsort(low, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], low[order][1:] != low[order][:-1], [True])))
    shared = np.minimum.reduceat(first[order], edges[:-1]) < np.maximum.reduceat(last[order], edges[:-1])
    found: list[tuple] = []
    strings: dict[bytes, list[int]] = {}
    weight = 0
    for g in np.flatnonzero(shared).tolist():
        for i in order[edges[g]:edges[g + 1]].tolist():
            string = bytes(parts[part[i]][4][begin[i]:begin[i] + length[i]])
            old = strings.get(string)
            if old is None:
                strings[string] = [int(first[i]), int(last[i])]
                weight += len(string) // 5
            else:
                old[0], old[1] = min(old[0], int(first[i])), max(old[1], int(last[i]))
        if weight > _CHUNK:  # minimisers are independent of each other
            found.extend(_runs(strings))
            strings, weight = {}, 0
    if strings:
        found.extend(_runs(strings))
    kinds = pa.schema([(n, pa.int64()) for n in ("k1", "k2", "w_from", "w_to", "first_doc")])
    columns = list(zip(*found)) if found else [[]] * 5
    return pa.table([pa.array(c, pa.int64()) for c in columns], schema=kinds)


def _occurrences(texts: DataFrame, hot: frozenset[int] = frozenset()) -> DataFrame:
    """k1, k2, doc_id, text_hash, start of every packed string of every document."""
    schema = pa.schema([(n, pa.int64()) for n in ("k1", "k2", "doc_id", "text_hash", "start")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, text_hash, text in zip(*batch.columns):
                    doc_id, mark = doc.as_py(), text_hash.as_py()
                    for _, start, _, string in packed(text.as_py(), hot):
                        yield *_key(string), doc_id, mark, start

        yield from arrow_batches(rows(), schema, limit_rows=50_000)

    return texts.mapInArrow(run, "k1 long, k2 long, doc_id long, text_hash long, start long")


def _hot_spans(texts: DataFrame, hot: frozenset[int]) -> DataFrame:
    """doc_id, text_hash, span of the windows with hot minimisers that a smaller document has too."""
    schema = pa.schema([(n, pa.int64()) for n in ("k1", "k2", "doc_id", "text_hash", "start")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, text_hash, text in zip(*batch.columns):
                    doc_id, mark = doc.as_py(), text_hash.as_py()
                    for start, string in hot_windows(text.as_py(), hot):
                        yield *_key(string), doc_id, mark, start

        yield from arrow_batches(rows(), schema, limit_rows=50_000)

    windows = written(texts.mapInArrow(run, "k1 long, k2 long, doc_id long, text_hash long, start long"), "hot-windows")
    first = windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    shared = first.where("first_doc < last_doc").select("k1", "k2", "first_doc")
    return windows.join(shared, ["k1", "k2"]).where("first_doc < doc_id").select(
        "doc_id", "text_hash", F.struct(F.col("start").alias("a"), (F.col("start") + WINDOW - 1).alias("b")).alias("span"))


def kept_words(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    """The words outside `spans` (first and last word), and the number of all words."""
    found = text.split()
    if not spans:
        return found, len(found)
    gone = np.zeros(len(found) + 1, np.int64)
    for a, b in spans:
        gone[a] += 1
        gone[b + 1] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return [w for w, k in zip(found, keep.tolist()) if k], len(found)


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, spans (first and last word of what goes) for documents that lose words."""
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * shuffle_partitions(docs.sparkSession), -(-_EXPANSION * size // _BUCKET))
    hot = hot_minimisers(texts)
    runs = written(_sent(texts, buckets, hot).groupBy("bucket").applyInArrow(
        _bucket, "k1 long, k2 long, w_from long, w_to long, first_doc long"), "super-k-mers")
    spans = _occurrences(texts, hot).join(runs, ["k1", "k2"]).where("first_doc < doc_id").select(
        "doc_id", "text_hash", F.struct((F.col("start") + F.col("w_from")).alias("a"), (F.col("start") + F.col("w_to") + WINDOW - 1).alias("b")).alias("span"))
    if hot:
        spans = spans.unionByName(_hot_spans(texts, hot))
    # a set: a repeated row finds the same spans again
    return spans.groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("spans"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and `kept`, the words that stay joined by one space, of every row.

    Null text has no words. Rows without a doc_id are neither compared nor changed. Rows that repeat a
    doc_id don't count against each other, whatever their texts. Other columns are ignored. An empty
    table gives no rows.
    """
    spans = written(repeats(docs), "repeat-spans").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "spans")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_hash"))
    joined = rows.join(spans, (F.col("doc_id") == F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left").select("doc_id", "text", "spans")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text, spans in zip(*batch.columns):
                    found = [(s["a"], s["b"]) for s in spans.as_py() or ()]
                    kept, n = kept_words(text.as_py() or b"", found)
                    data = b" ".join(kept)
                    yield doc_id.as_py(), n, n - len(kept), hashlib.sha256(data).hexdigest(), data

        yield from arrow_batches(rows(), schema, weigh=lambda r: len(r[4]))

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary").withColumn("kept", F.col("kept").cast("string"))
