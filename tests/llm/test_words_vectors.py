"""Collision counting, spelling variants and token alignment against plain Python."""

import hashlib
import math
import random
import re
import string
import zlib
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest

import cases
from ladderline.llm import alignment, collision, common, spelling
from ladderline.llm.queries import vocabulary


# nearest vectors

VECTORS = "vec_id long, embedding array<float>, label int, row int, dim int, asks int, score string, shard int"


def vector_rows(seed=5, n=1500, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[100:140] = x[7]  # many copies
    x[200:230] = x[8] + rng.normal(size=(30, dim)).astype(np.float32) * 0.01
    rows = [(i, x[i].tolist()) for i in range(n)]
    rows[300], rows[350] = (300, None), (350, [0.0] * dim)
    rows[351], rows[352] = (351, [float("nan")] * dim), (352, [None] + [1.0] * (dim - 1))
    rows[353], rows[400] = (353, [float("inf")] + [1.0] * (dim - 1)), (400, [1.0, 2.0])  # another length
    return rows + [(401, [2.0, 1.0]), (None, x[9].tolist()), (50, x[50].tolist()), (450, [])]


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "s", 5) for r in rows], VECTORS).repartition(3)


def brute_nearest(rows, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    found = []
    for p, (i, q) in enumerate(good):
        if i % 50:
            continue
        scored = [(-float((v * q).sum() / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum()))), j) for o, (j, v) in enumerate(good) if o != p and len(v) == len(q)]
        found += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return found


def nearest_rows(spark, rows):
    found = collision.nearest(vector_table(spark, rows), cases.F.col("vec_id") % 50 == 0).collect()
    return [tuple(r) for r in found]


@pytest.mark.parametrize("dim", [8, 24, 64])
def test_nearest_recall_and_scores(spark, dim):
    rows = vector_rows(dim=dim)
    found, wanted = nearest_rows(spark, rows), brute_nearest(rows)
    assert len(found) == len(wanted)
    assert Counter(r[:2] for r in found) == Counter(r[:2] for r in wanted)
    pairs = Counter((r[0], r[2]) for r in wanted)
    assert sum((Counter((r[0], r[2]) for r in found) & pairs).values()) >= 0.9 * len(wanted)
    by_id = {i: np.array(v, float) for i, v in rows if v and None not in v}
    for query, _, other, score in found:
        q, v = by_id[query], by_id[other]
        assert score == pytest.approx(float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), abs=1e-12)
    ranked = defaultdict(list)
    for r in found:
        ranked[r[0]].append(r)
    assert all(sorted(own, key=lambda r: (-r[3], r[2])) == sorted(own, key=lambda r: (r[1], -r[3], r[2])) for own in ranked.values())


def test_nearest_takes_ties_in_order_of_ids(spark):
    found = {(q, r): v for q, r, v, _ in nearest_rows(spark, vector_rows())}
    assert [found[100, r] for r in range(1, 6)] == [7, 101, 102, 103, 104]
    assert found[400, 1] == 401 and (400, 2) not in found  # no other vector of its length
    assert not any(q in (300, 350) for q, _ in found)


def test_nearest_of_few_and_none(spark):
    assert nearest_rows(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])]) == [(0, 1, 1, 0.0)]
    assert nearest_rows(spark, [(0, [1.0, 0.0])]) == []
    assert collision.nearest(spark.createDataFrame([], VECTORS), cases.F.col("vec_id") % 50 == 0).count() == 0


def test_collision_plan_separates_near_from_far():
    for n in (10, 1000, 10 ** 9):
        m, least, w = collision.plan(n)
        near, far = collision._inside(w / 2), collision._inside(w / 4)
        assert far * m < least < near * m


# spelling variants

def observed_words(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in string.ascii_uppercase else c for c in run)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    if len(b) != len(a) + 1:
        return False
    if len(a) > 1000:  # runs of one letter
        return len(set(a + b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows, factor=10):
    seen = observed_words(rows)
    form, count = {}, {}
    for w, n in seen.items():
        close = [v for v in seen if near(w, v)]
        count[w] = len(close)
        best = min(close, key=lambda v: (-seen[v], v), default=None)
        form[w] = best if best is not None and seen[best] >= factor * n else None
    found = set()
    for w, n in seen.items():
        root = w
        while form[root]:
            root = form[root]
        found.add((w, form[w], root, n, count[w], seen[form[w]] if form[w] else None))
    return found


def spelling_rows(seed=3):
    rng = random.Random(seed)
    letters = "abcdeéÀß×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 11))) for _ in range(12)] + ["thousand", "Éclairage", "z" * 7, "z" * 8, "z" * 9]

    def edited(w):
        at = rng.randrange(len(w))
        return rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1:]])

    rows = []
    for d in range(30):
        found = []
        for _ in range(100):
            w = rng.choice(base[: 1 + rng.randrange(len(base))])
            for _ in range(rng.choice([0] * 12 + [1, 1, 2])):
                w = edited(w)
            found.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((d, " ".join(found)))
    rows += [(300 + d, "chainword " * 300 + "chainwore " * 18 + "chainwure") for d in range(9)]
    rows += [(100, None), (101, ""), (102, "x" * 30_000 + " " + "x" * 30_000), (103, "x" * 30_001 + ", " + "x" * 30_001), (None, base[0] + " " + base[1]), (5, rows[5][1]), (5, rows[5][1])]
    return rows


def spelled(spark, rows):
    table = spark.createDataFrame([(*r, "x", "y", 3, 4) for r in rows], "doc_id long, text string, word string, form string, n int, key int").repartition(3)
    return {tuple(r) for r in spelling.variants(table).collect()}


def test_variants_against_brute_force(spark):
    rows = spelling_rows()
    wanted = brute_variants(rows)
    assert spelled(spark, rows) == wanted
    assert any(r[1] and r[2] != r[1] for r in wanted)  # a chain


def test_variants_of_cut_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MAX_BLOCK", 8)
    monkeypatch.setattr(spelling, "BUCKET_ROWS", 64)
    rows = spelling_rows(4)
    assert spelled(spark, rows) == brute_variants(rows)


def test_tiles_and_class_counts_lose_no_pair(monkeypatch):
    words = sorted(observed_words(spelling_rows(6)))
    wanted = {(i, j) for i in range(len(words)) for j in range(len(words)) if i < j and near(words[i], words[j])}
    counts, _ = spelling.letter_counts(words)
    for tile in (4, 64, 512):
        monkeypatch.setattr(spelling, "TILE", tile)
        for k in (3, 5, 7):
            keys = spelling.block_keys(counts, k)
            picks = keys.shape[1]
            key, pick = keys.T.ravel(), np.repeat(np.arange(picks), len(words))
            i, j = spelling.near_pairs(words * picks, key, pick, np.zeros(len(key), int), k)
            found = [tuple(sorted((a % len(words), b % len(words)))) for a, b in zip(i.tolist(), j.tolist())]
            assert len(found) == len(set(found)) and set(found) == wanted
    assert [spelling.classes(n) for n in (0, 1, 1 << 22, (1 << 22) + 1, 1 << 25, 1 << 26)] == [5, 5, 5, 6, 6, 7]


def test_no_variants(spark):
    assert spelled(spark, [(1, None), (None, ""), (2, "short words only")]) == set()
    assert spelling.variants(cases.empty(spark)).count() == 0


# token alignment

PATHS = vocabulary("LLM_BYTE_BPE", "byte_bpe_50k.json"), vocabulary("LLM_PIECE_BPE", "piece_bpe_32k.model")


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(PATHS[0])
    slow.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = common.byte_letters()

    def bytes_b(i):
        p = pieces.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for doc_id, text in rows:
        links, groups, a, b = [], [], [], []
        if text:
            a, b = slow.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
            size_a = [len(bytes(letters[c] for c in slow.id_to_token(i))) for i in a]
            whole = b"".join(bytes(letters[c] for c in slow.id_to_token(i)) for i in a), b"".join(map(bytes_b, b))
            if whole != ((" " + text).encode(),) * 2:
                a, b = [], []
            at_a, at_b = np.cumsum([0, *size_a]).tolist(), np.cumsum([0, *(len(bytes_b(i)) for i in b)]).tolist()
            owner = {}
            for j in range(len(b)):
                for x in range(at_b[j], at_b[j + 1]):
                    owner[x] = j
            for i in range(len(a)):
                links += [(a[i], b[j]) for j in sorted({owner[x] for x in range(at_a[i], at_a[i + 1])})]
            shared = sorted(set(at_a) & set(at_b)) if a else []
            for low, high in zip(shared, shared[1:]):
                own = [",".join(map(str, ids[bisect_left(at, low):bisect_left(at, high)])) for ids, at in ((a, at_a), (b, at_b))]
                groups.append("|".join(own))
        counts.update(links)
        docs.append((doc_id, a, b, groups, links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return Counter(
        (doc_id, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") for doc_id, a, b, groups, links in docs)


def alignment_rows():
    rows = [(r[0], r[1]) for r in cases.rows()]
    return rows + [
        (200, "<|endoftext|> <s> </s> <unk> x"), (201, "  two  blanks\n\n\tand tabs  "), (202, "▁marked ▁"), (203, "漢字かな交じり文。no blanks漢字"),
        (204, "naïve café — “quotes” \U0001f600\U0001f468‍\U0001f469 zero\u0000byte\r\n"), (205, "a" * 5000), (206, "don't we'll 12345 3.14 x_y--z"),
        (207, "ﬁ ½ Å é"), (208, " "), (209, "\n")]


def test_alignment_against_brute_force(spark):
    rows = alignment_rows()
    table = spark.createDataFrame([(*r, 1, "c", 2, b"x") for r in rows], "doc_id long, text string, chunk int, code string, n_a int, codes binary").repartition(3)
    wanted = brute_alignment(rows)
    assert Counter(tuple(r) for r in alignment.align(table, *PATHS).collect()) == wanted
    assert sum(r[1] == 0 for r in wanted) >= 3


def test_alignment_of_small_chunks(spark, monkeypatch):
    # by value to the workers: chunks end after every few windows
    rows = alignment_rows()[:14]
    monkeypatch.setattr(alignment, "CHUNK_WINDOWS", 20)
    t = alignment.loaded(*PATHS)
    windows = alignment.Windows(t)
    for _, text in rows:
        a, b = t.ids(text)
        if a:
            text_, groups, links = alignment.aligned(a + [x + t.first_b for x in b], len(a), t.first_b, t.size, t.name)
            places = windows.of(a, b)
            assert ";".join(windows.text[p] for p in places) == text_
            assert [c for p in places for c in array("q", windows.links[p])] == links and sum(windows.groups[p] for p in places) == groups
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert Counter(tuple(r) for r in alignment.align(table, *PATHS).collect()) == brute_alignment(rows)


def test_alignment_of_nothing(spark):
    assert alignment.align(cases.empty(spark), *PATHS).count() == 0
    only = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert sorted(tuple(r)[1:] for r in alignment.align(only, *PATHS).collect()) == [(0, 0, 0, 0, 0, 0, "")] * 2
