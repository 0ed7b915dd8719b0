"""Language identification by a convolutional network over bytes.

A byte is embedded, filters of several widths run over a window of fixed length, every filter keeps
its maximum, and a softmax over those maxima names the language. The network is trained in numpy on
windows of a bounded, hash-chosen number of labelled documents per language. It is applied to all
windows of every text, in batches; a document's scores are the means over its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderline.llm.common import arrow_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12  # per width
EMBEDDING = 6
DOCS_PER_LANGUAGE = 600  # bound of the training sample
WINDOWS_PER_DOC = 2
EPOCHS = 6
BATCH = 128
RATE = 0.01
UNKNOWN = "und"
_FOLD = 5
_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 256 x EMBEDDING; byte 0 pads
    filters: np.ndarray  # (widest * EMBEDDING) x all filters, zero beyond a filter's own width
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        widest = max(WIDTHS)
        n, length = x.shape
        e = self.embed[x].reshape(n, length * EMBEDDING)
        span = length - widest + 1
        cols = np.lib.stride_tricks.sliding_window_view(e, widest * EMBEDDING, axis=1)[:, ::EMBEDDING]
        cols = cols[:, :span].reshape(n * span, widest * EMBEDDING)
        raw = (cols @ self.filters).reshape(n, span, -1)
        top = raw.max(axis=1) + self.shift
        hidden = np.maximum(top, 0)
        logits = hidden @ self.out + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        return p, (cols, raw, top, hidden)


def windows(text: bytes, size: int = WINDOW) -> np.ndarray:
    """All windows of a text, side by side, the last one padded with zeros; at least one."""
    n = max(1, -(-len(text) // size))
    x = np.zeros(n * size, np.uint8)
    x[:len(text)] = np.frombuffer(text, np.uint8)
    return x.reshape(n, size)


def _mask() -> np.ndarray:
    widest = max(WIDTHS)
    mask = np.zeros((widest * EMBEDDING, len(WIDTHS) * FILTERS), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[:w * EMBEDDING, k * FILTERS:(k + 1) * FILTERS] = 1
    return mask


def train(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Adam on the cross-entropy of windows `x` with classes `y`; the same rows give the same network."""
    rng = np.random.default_rng(seed)
    mask = _mask()
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        (rng.normal(0, 1, mask.shape) / np.sqrt(mask.sum(axis=0))).astype(np.float32) * mask,
        np.zeros(mask.shape[1], np.float32),
        rng.normal(0, 0.2, (mask.shape[1], len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    names = ("embed", "filters", "shift", "out", "bias")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            grads = _gradients(net, x[rows], y[rows], mask)
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                move = RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                setattr(net, k, getattr(net, k) - move.astype(np.float32))
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    p, (cols, raw, top, hidden) = net.forward(x)
    n, span, width = len(x), raw.shape[1], max(WIDTHS) * EMBEDDING
    p[np.arange(n), y] -= 1
    p /= n
    grad_top = (p @ net.out.T) * (top > 0)
    best = raw.argmax(axis=1)  # n x filters
    chosen = cols.reshape(n, span, width)[np.arange(n)[:, None], best]  # n x filters x width
    grad_filters = np.einsum("nf,nfw->wf", grad_top, chosen) * mask
    back = grad_top[:, :, None] * net.filters.T[None]  # n x filters x width
    grad_embed = np.zeros_like(net.embed)
    for k in range(max(WIDTHS)):
        byte = x[np.arange(n)[:, None], best + k]
        np.add.at(grad_embed, byte.ravel(), back[:, :, k * EMBEDDING:(k + 1) * EMBEDDING].reshape(-1, EMBEDDING))
    return {"embed": grad_embed, "filters": grad_filters, "shift": grad_top.sum(axis=0), "out": hidden.T @ p, "bias": p.sum(axis=0)}


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _held_out(doc_id: str) -> Column:
    # crc32 of null is null: a row without an id is never trained on
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % _FOLD == 0, F.lit(True))


def sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, classes and languages of about `per_language` hash-chosen documents of each language.

    Only documents outside the held-out fold with a language, text and a letter. At most
    per_language * WINDOWS_PER_DOC windows per language reach the driver.
    """
    rows = docs.where(~_held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), []
    languages = sorted(counts)
    scale = 1 << 30
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, min(scale, per_language * scale // counts[k]))])
    chosen = rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(scale)) < share[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for doc_id, lang, text in zip(*batch.columns):
                data = text.as_py()
                own = windows(data)
                full = own[:-1] if len(own) > 1 else own
                # spread over the text: parts of a text differ less than texts
                picked = np.unique(np.linspace(0, len(full) - 1, WINDOWS_PER_DOC + 1)[:WINDOWS_PER_DOC].astype(int))
                for k in picked:
                    langs.append(lang.as_py())
                    found.append(full[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "x"])

    taken = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"))
    found = taken.mapInArrow(run, "lang string, x binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["x"])))  # the order of tasks must not matter
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in found), np.uint8).reshape(-1, WINDOW)
    return x, np.array([languages.index(r["lang"]) for r in found]), languages


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from its whole text.

    Null text and text without a letter give `und` with score 0, as does everything if there was
    nothing to learn from. held_out says whether a row's id is in the fold that training never sees;
    a null id counts as held out. Rows are independent. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                pending, weight = [], 0
                for doc_id, held, text in zip(*batch.columns):
                    value = text.as_py()
                    own = None if net is None or value is None or not has_letter(value) else windows(value.encode())
                    pending.append((doc_id.as_py(), held.as_py(), own))
                    weight += 0 if own is None else len(own)
                    if weight >= 512:
                        yield from score(pending)
                        pending, weight = [], 0
                yield from score(pending)

        def score(pending: list) -> Iterator[tuple]:
            full = [p[2] for p in pending if p[2] is not None]
            sums = iter(())
            if full:
                x = np.concatenate(full)
                p = np.concatenate([net.forward(x[k:k + 64])[0] for k in range(0, len(x), 64)])
                cut = np.cumsum([0] + [len(f) for f in full])
                sums = iter(np.add.reduceat(p.astype(float), cut[:-1], axis=0) / np.diff(cut)[:, None])
            for doc_id, held, own in pending:
                if own is None:
                    yield doc_id, held, UNKNOWN, 0.0
                else:
                    mean = next(sums)
                    k = int(mean.argmax())
                    yield doc_id, held, net.languages[k], float(min(1.0, mean[k]))

        yield from arrow_batches(rows(), _RESULT)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """Train on `docs` (doc_id, text, lang) and predict for all its rows; see `predict`."""
    x, y, languages = sample(docs)
    return predict(docs, train(x, y, languages) if languages else None)
