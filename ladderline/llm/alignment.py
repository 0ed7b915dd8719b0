"""Aligning the tokens of two tokenizers over every text, with corpus-wide counts of linked ids.

Both tokenizers run over the whole text. Where a token that begins with a blank starts at the same byte
in both, both have ended there (checked by byte offsets), so the text is cut into windows of token ids.
A window's alignment (groups between shared ends, links between overlapping tokens) is worked out once
and remembered under its ids.

Counts of linked id pairs concern the whole corpus. Texts are worked through in chunks of bounded size,
each with its own table of distinct windows and pairs; only those tables are shuffled to be summed by
pair, and the sums come back to their chunk, where every document's links are looked up by place.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline.llm.common import arrow_batches, byte_letters
from ladderline.session import written

CHUNK_BYTES = 48 << 20  # of text
CHUNK_WINDOWS = 300_000  # distinct, some 400 bytes each
CHUNK_IDS = 4_000_000  # in distinct windows
# fixed value: the pre-tokenization pattern of the byte-level vocabulary
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ROWS = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                   ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("used", pa.binary()), ("times", pa.binary()),
                   ("starts", pa.binary()), ("links", pa.binary()), ("codes", pa.binary()), ("counts", pa.binary())])
_DDL = ("chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, used binary, times binary, "
        "starts binary, links binary, codes binary, counts binary")
_loaded: dict[tuple[str, str], "Tokenizers"] = {}


class Tokenizers:
    """Both vocabularies: ids of a text, and the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # before the import that reads it
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as file:
            known = json.load(file)
        special = {t["id"] for t in known.get("added_tokens", [])}
        letters = byte_letters()
        bytes_a = {i: bytes(letters[c] for c in token) for token, i in known["model"]["vocab"].items() if i not in special}
        self._path_a, self._slow = path_a, None
        # in this vocabulary ids stand in the order of the merges
        self._fast = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks={v: i for i, v in bytes_a.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = (self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
        bytes_b = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.bytes_a, self.bytes_b = ([table.get(i, b"") for i in range(max(table) + 1)] for table in (bytes_a, bytes_b))
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        # both in one list, the second vocabulary's from first_b on
        self.first_b = len(self.bytes_a)
        self.size = self.size_a.tolist() + self.size_b.tolist()
        self.name = [str(i) for table in (self.bytes_a, self.bytes_b) for i in range(len(table))]
        self.blank_a, self.blank_b = (np.array([x[:1] == b" " for x in table]) for table in (self.bytes_a, self.bytes_b))

    def ids_a(self, text: str) -> list[int]:
        try:
            return self._fast.encode_ordinary(text)
        except Exception:  # the pattern engine gives up on extreme runs of white space
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(self._path_a)
                self._slow.encode_special_tokens = True
            return self._slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of blank + text; none where either's bytes differ from that."""
        if not text:
            return [], []
        whole = " " + text
        a, b = self.ids_a(whole), self.b.encode(text)
        data = whole.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != data or b"".join(map(self.bytes_b.__getitem__, b)) != data:
            return [], []
        return a, b


def loaded(path_a: str, path_b: str) -> Tokenizers:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Tokenizers(path_a, path_b)
    return _loaded[path_a, path_b]


def aligned(ids: list[int], n: int, first_b: int, size: list[int], name: list[str]) -> tuple[str, int, list[int]]:
    """(groups as text, number of groups, linked pairs as a << 32 | b) of ids that cover the same bytes.

    `ids` are n of the first vocabulary and then those of the second, counted from `first_b`; size and
    name are the bytes and the printed id of each.
    """
    x, y = ids[0], ids[n]
    groups, links, count, i, j, last = "", [x << 32 | y - first_b], 1, 0, n, n - 1
    own_a, own_b = name[x], name[y]
    ahead = size[x] - size[y]  # bytes that the first's tokens reach beyond the second's
    while True:
        if ahead == 0:
            groups += own_a + "|" + own_b
            if i == last:
                return groups, count, links
            i, j, count = i + 1, j + 1, count + 1
            x, y = ids[i], ids[j]
            groups += ";"
            own_a, own_b = name[x], name[y]
            ahead = size[x] - size[y]
        elif ahead < 0:
            i += 1
            x = ids[i]
            own_a += "," + name[x]
            ahead += size[x]
        else:
            j += 1
            y = ids[j]
            own_b += "," + name[y]
            ahead -= size[y]
        links.append(x << 32 | y - first_b)


class Windows:
    """Distinct windows of one chunk, remembered by their ids: the first vocabulary's, then the second's."""

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.place: dict[bytes, int] = {}
        self.text: list[str] = []
        self.groups: list[int] = []
        self.links: list[bytes] = []
        self.sizes: list[int] = []
        self.ids = 0

    def learn(self, key: bytes, n: int) -> int:
        place = self.place.get(key)
        if place is None:
            text, groups, links = aligned(array("I", key).tolist(), n, self.t.first_b, self.t.size, self.t.name)
            place = self.place[key] = len(self.text)
            self.text.append(text)
            self.groups.append(groups)
            self.links.append(array("q", links).tobytes())
            self.sizes.append(len(links))
            self.ids += len(key) // 4
        return place

    def of(self, a: list[int], b: list[int]) -> list[int]:
        """Places of a text's windows, in its order."""
        a, b = np.array(a, "<u4"), np.array(b, "<u4")
        start_a, start_b = (np.cumsum(size) - size for size in (self.t.size_a[a], self.t.size_b[b]))
        marked_a, marked_b = np.flatnonzero(self.t.blank_a[a]), np.flatnonzero(self.t.blank_b[b])
        at_a, at_b = start_a[marked_a], start_b[marked_b]
        near = np.minimum(np.searchsorted(at_b, at_a), max(len(at_b) - 1, 0))
        both = at_b[near] == at_a if len(at_b) else np.zeros(len(at_a), bool)
        cut_a, cut_b = marked_a[both], marked_b[near[both]]
        cut_a, cut_b = (np.concatenate(([0], x[x > 0], [n])) for x, n in ((cut_a, len(a)), (cut_b, len(b))))
        # all ids window by window: a window's first ids, then its second ones
        n_a, n_b = np.diff(cut_a), np.diff(cut_b)
        mixed = np.empty(len(a) + len(b), "<u4")
        mixed[np.arange(len(a)) + np.repeat(cut_b[:-1], n_a)] = a
        mixed[np.arange(len(b)) + np.repeat(cut_a[1:], n_b)] = b + np.uint32(self.t.first_b)
        data, ends = mixed.tobytes(), (4 * (cut_a + cut_b)).tolist()
        keys = [data[p:q] for p, q in zip(ends, ends[1:])]
        found = list(map(self.place.get, keys))
        if None in found:
            for at in [at for at, place in enumerate(found) if place is None]:
                found[at] = self.learn(keys[at], int(n_a[at]))
        return found

    def table(self, times: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
        """starts of every window in links, links as places in codes, codes, and how many links hold each."""
        size = np.array(self.sizes, np.int64)
        codes, place = np.unique(np.frombuffer(b"".join(self.links), np.int64), return_inverse=True)
        counts = np.bincount(place, weights=np.repeat(times, size), minlength=len(codes)).astype("<i8")
        return (np.cumsum(size) - size).astype("<u4").tobytes(), place.astype("<u4").tobytes(), codes.astype("<i8").tobytes(), counts.tobytes()


def _chunked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per document, and a row per chunk with its table (doc_id null, codes not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, part = loaded(path_a, path_b), TaskContext.get().partitionId()
        gc.disable()  # hundreds of thousands of small objects without a cycle, walked again and again

        def rows() -> Iterator[tuple]:
            number, held, windows, times = 0, 0, Windows(tokenizers), np.zeros(1024, np.int64)
            chunk = part << 32
            for batch in batches:
                for doc_id, text in zip(*batch.columns):
                    text = text.as_py()
                    a, b = tokenizers.ids(text)
                    if not a:
                        yield chunk, doc_id.as_py(), 0, 0, 0, 0, "", b"", b"", None, None, None, None
                        continue
                    places = windows.of(a, b)
                    used, count = np.unique(np.array(places), return_counts=True)
                    if used[-1] >= len(times):
                        times = np.r_[times, np.zeros(max(len(times), used[-1]), np.int64)]
                    times[used] += count
                    digest = hashlib.sha256(";".join(map(windows.text.__getitem__, places)).encode()).hexdigest()
                    yield (chunk, doc_id.as_py(), len(a), len(b), sum(map(windows.groups.__getitem__, places)),
                           sum(map(windows.sizes.__getitem__, places)),
                           digest, used.astype("<u4").tobytes(), count.astype("<u4").tobytes(), None, None, None, None)
                    held += len(text)
                    if held >= CHUNK_BYTES or len(windows.text) >= CHUNK_WINDOWS or windows.ids >= CHUNK_IDS:
                        yield (chunk, *[None] * 8, *windows.table(times[:len(windows.text)]))
                        number, held, windows, times = number + 1, 0, Windows(tokenizers), np.zeros(1024, np.int64)
                        chunk = part << 32 | number
            if windows.text:
                yield (chunk, *[None] * 8, *windows.table(times[:len(windows.text)]))

        try:
            yield from arrow_batches(rows(), _ROWS, weigh=lambda r: sum(map(len, r[7:9])) if r[11] is None else sum(map(len, r[9:])))
        finally:
            gc.enable()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _DDL)


def _pairs(tables: DataFrame) -> DataFrame:
    """chunk, code, n of every pair of every chunk."""
    schema = pa.schema([("chunk", pa.int64()), ("code", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, codes, counts in zip(*batch.columns):
                codes, counts = (np.frombuffer(x.as_py(), "<i8") for x in (codes, counts))
                for i in range(0, len(codes), 65_536):
                    part = codes[i:i + 65_536]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), chunk.as_py(), np.int64)), pa.array(part), pa.array(counts[i:i + 65_536])], schema=schema)

    return tables.select("chunk", "codes", "counts").mapInArrow(run, "chunk long, code long, n long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """code, count (links of the corpus that hold the pair), best (no pair of its B id has more).

    One row per id pair, so the window over a B id holds at most one row per A id of the vocabulary.
    """
    totals = pairs.groupBy("code").agg(F.sum("n").alias("count"))
    of_b = W.partitionBy(F.col("code").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return totals.withColumn("best", F.col("count") == F.max("count").over(of_b))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of `docs`.

    path_a is a byte-level vocabulary (JSON), path_b a sentencepiece model. Null and empty texts, and
    texts that either vocabulary doesn't give back byte for byte, have no tokens: zeros and ''. A null
    doc_id is an ordinary value, repeated rows count each. Other columns are ignored. An empty table
    gives no rows.
    """
    found = written(_chunked(docs, path_a, path_b), "align-chunks")
    tables = found.where("codes IS NOT NULL")
    pairs = written(_pairs(tables), "align-pairs")
    looked_up = pairs.select("chunk", "code").join(pair_counts(pairs), "code").select("chunk", "code", "count", "best")
    kept = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
    schema = pa.schema([*[(n, pa.int64()) for n in kept], ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])

    def run(key: tuple, rows: pa.Table, counted: pa.Table) -> pa.Table:
        has_table = rows.column("codes").is_valid()
        texts = rows.filter(pc.invert(has_table))
        table = rows.filter(has_table)
        best = total = np.zeros(0, np.int64)
        if table.num_rows:
            starts, links, codes = (np.frombuffer(table.column(c)[0].as_py(), kind) for c, kind in (("starts", "<u4"), ("links", "<u4"), ("codes", "<i8")))
            order = np.argsort(counted.column("code").to_numpy())
            assert len(order) == len(codes), "a chunk's pairs are incomplete"
            count = counted.column("count").to_numpy()[order][links]
            total = np.add.reduceat(count, starts)
            best = np.add.reduceat(counted.column("best").to_numpy(zero_copy_only=False)[order][links].astype(np.int64), starts)
        n_best, count_sum = [], []
        for used, times in zip(texts.column("used"), texts.column("times")):
            used, times = (np.frombuffer(x.as_py(), "<u4") for x in (used, times))
            n_best.append(int((best[used] * times).sum()) if len(used) else 0)
            count_sum.append(int((total[used] * times).sum()) if len(used) else 0)
        return pa.table([*[texts.column(n) for n in kept], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), texts.column("groups_sha256")], schema=schema)

    return found.groupBy("chunk").cogroup(looked_up.groupBy("chunk")).applyInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
