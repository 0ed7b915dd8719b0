"""Quality rules, mixing, packing, SimHash, pseudonyms, language and passages against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import cases
from ladderline.llm import langid, mixing, packing, pii, quality, simhash, substrings
from ladderline.llm.queries import tokenizer_path


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# quality rules

def base_counts(text):
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    covered = {j for x in at.values() if len(x) > 1 for i in x for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality_against_brute_force(spark):
    extra = [(40, "a b c a b c " * 30, "en", "s"), (41, "x # y\nx # y\n|<>&%$*\n" + " ".join(map(str, range(80))), "en", "s"), (42, "a a a", "en", "s"), (43, "q w e r q w e", "en", "s")]
    found = cases.rows() + extra
    trusted = spark.createDataFrame([(0,), (1,), (1,), (2,), (None,)], "doc_id long")
    got = quality.rules(cases.table(spark, found), trusted).collect()
    assert len(got) == len(found)
    by_text = {r[0]: r[1] for r in found}
    one = lambda x: xxhash.xxh64_intdigest(x.encode(), 42)
    (n, m), a = quality.bins(0), quality.SMOOTHING
    grams = lambda w: [one(x) % n for x in w] + [n + (2 * one(x) ^ one(y)) % m for x, y in zip(w, w[1:])]
    raw = Counter(g for r in found for g in grams(words(r[1])))
    target = Counter(g for r in found if r[0] in (0, 1, 2) for g in grams(words(r[1])))
    part = lambda c, t: np.log((c + a) / (t + a * (n + m)))
    ratio = {g: part(target[g], sum(target.values())) - part(raw[g], sum(raw.values())) for g in raw}
    for r in got:
        if r.doc_id is None:
            continue
        text = by_text[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(text), r.doc_id
        own = grams(words(text))
        if own:
            assert r.llr == pytest.approx(np.mean([ratio[g] for g in own]), abs=1e-9)
        else:
            assert r.llr is None
        assert r.kept == (not r.base_failed and (r.llr is None or r.llr >= quality.THRESHOLD))
    again = {(r.doc_id, r.llr) for r in quality.rules(cases.table(spark, found), trusted).collect()}
    assert again == {(r.doc_id, r.llr) for r in got}


def test_quality_without_trust_and_empty(spark):
    nobody = spark.createDataFrame([], "doc_id long")
    got = quality.rules(cases.table(spark), nobody).collect()
    assert all(r.llr is None and r.kept == (not r.base_failed) for r in got)
    assert quality.rules(cases.empty(spark), nobody).count() == 0
    kept = quality.accepted(cases.table(spark), nobody)
    assert kept.columns == cases.table(spark).columns and kept.count() == sum(r.kept for r in got)


def test_quality_bins_grow_with_the_text(spark, monkeypatch):
    assert [quality.bins(n) for n in (0, 1 << 23, (1 << 23) + 1, 1 << 30, 1 << 40)] == [
        (1 << 16, 1 << 14), (1 << 16, 1 << 14), (1 << 17, 1 << 14), (1 << 23, 1 << 16), (1 << 33, 1 << 21)]
    # fewer slots than bins, so that many bins are joined, and a small bit table
    monkeypatch.setattr(quality, "BYTES_PER_BIN", 16)
    monkeypatch.setattr(quality, "UNIGRAM_SLOTS", 1 << 11)
    monkeypatch.setattr(quality, "BIGRAM_SLOTS", 1 << 11)
    monkeypatch.setattr(quality, "_SLOTS", 1 << 12)
    monkeypatch.setattr(quality, "TRUST_BITS", 1 << 7)
    rng = random.Random(3)
    text = lambda k: " ".join(f"w{int(rng.paretovariate(0.3)) % 10**9}" for _ in range(k))
    found = [(i, text(2_000), "en", "s") for i in range(200)]
    found += [(500, found[3][1], "en", "s"), (None, found[3][1], "en", "s"), (501, None, "en", "s")]
    found += [(600 + i, f"lonely{i}", "en", "s") for i in range(20)]  # some of their bins are in no slot
    got = quality.rules(cases.table(spark, found), spark.createDataFrame([(i,) for i in range(100)], "doc_id long")).collect()
    one = lambda x: xxhash.xxh64_intdigest(x.encode(), 42)
    (n, m), a = quality.bins(sum(len(r[1] or "") for r in found)), quality.SMOOTHING
    grams = lambda w: [one(x) % n for x in w] + [n + (2 * one(x) ^ one(y)) % m for x, y in zip(w, w[1:])]
    own = {t: grams(words(t)) for _, t, _, _ in found if t}
    raw = Counter(g for r in found for g in own.get(r[1], ()))
    target = Counter(g for r in found[:100] for g in own[r[1]])
    part = lambda c, t: np.log((c + a) / (t + a * (n + m)))
    of_target, of_raw = sum(target.values()), sum(raw.values())
    ratio = {g: part(target[g], of_target) - part(raw[g], of_raw) for g in raw}
    texts = {r[0]: r[1] for r in found}
    assert len(got) == len(found) and all(r.base_failed is not None and r.kept is not None for r in got)
    for r in got:
        if texts[r.doc_id]:
            assert r.llr == pytest.approx(np.mean([ratio[g] for g in own[texts[r.doc_id]]]), abs=1e-9)
        else:
            assert r.llr is None


def test_quality_threshold_on_labelled_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    got = quality.rules(docs, quality.trusted_documents(labels)).where("NOT base_failed")
    marked = got.join(labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("quality").alias("least"), F.max("toxic").alias("toxic")), "doc_id")
    assert marked.where("quality = 0 AND kept").count() == 0
    assert marked.where("least = 1 AND coalesce(toxic, 0) = 0 AND NOT kept").count() == 0


# mixing

def test_mixing_matches_sql_and_budgets(spark):
    docs = cases.table(spark)
    duck = duckdb.connect()
    documents = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841
    duck.register("documents", documents.astype({"doc_id": "Int64"}))
    want = Counter(map(tuple, duck.sql(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({mixing.ORACLE})").fetchall()))
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == want
    taken, goal = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        goal[r.source] = r.target
        assert r.taken <= 3 * r.size
    assert all(taken[s] == int(goal[s]) for s in goal)
    assert mixing.mix(cases.empty(spark)).count() == 0


def test_mixed_texts_have_the_words_taken(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    monkeypatch.setattr(mixing, "STRETCH", 2)
    # repeated rows, and rows without a doc_id of one size: some of one text, some of others
    found = cases.rows() + [(None, f"{w} b c", "en", "s1") for w in "aaaaefgh"] + [(None, f"x y {w}", "en", None) for w in "pqr"] + [(7, "a b", "en", "s0"), (7, "c d", "en", "s0")]
    docs = cases.table(spark, found)
    wanted, got = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        wanted[r.doc_id, r.source] += r.taken
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.doc_id, r.source] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert got == Counter({k: v for k, v in wanted.items() if v})
    assert mixing.mixed(cases.empty(spark)).count() == 0


def test_equal_rows_are_numbered_by_many_tasks(spark):
    docs = spark.range(300_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    rows = mixing.mix(docs)
    assert rows.groupBy("copy").count().where("count > 1").isEmpty() and rows.agg(F.sum("taken")).first()[0] == 600_000
    assert rows.select(F.spark_partition_id()).distinct().count() > 1


# packing

@pytest.mark.parametrize("window", [64, 2048])
def test_packing_round_trip(spark, window):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    found = cases.rows()
    got = packing.pack(cases.table(spark, found), tokenizer_path(), window).collect()
    sequences, pieces, of_source = defaultdict(list), defaultdict(list), {r[0]: r[3] for r in found}
    for r in got:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    ids = {r[0]: tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in found}
    for doc, own in pieces.items():
        places = Counter(p.start for p in own)
        assert all(n == (2 if doc == 29 else 1) or doc == 29 for n in places.values())
        total = 0
        for p in own:
            data = np.array(ids[doc][p.start:p.start + p.length], "<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(data) and p.doc_tokens == len(ids[doc])
            total += p.length
        assert total == len(ids[doc]) * sum(r[0] == doc for r in found)
    everything = sum(len(ids[r[0]]) for r in found)
    shares = Counter()
    for r in found:
        shares[of_source[r[0]]] += len(ids[r[0]])
    last = max(sequences)
    for k, own in sequences.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or k == last
        if k < last and min(shares.values()) * window >= everything:
            part = Counter()
            for p in own:
                part[of_source[p.doc_id]] += p.length
            assert all(abs(part[s] - Fraction(window * shares[s], everything)) < 2 for s in shares)
    assert sorted(sequences) == list(range(-(-everything // window)))


def test_packing_many_small_sources_and_empty(spark):
    found = [(i, "ea thorn " * (1 + i % 3), "en", f"s{i}" if i % 2 else "big") for i in range(400)]
    got = packing.pack(cases.table(spark, found), tokenizer_path(), 32).collect()
    full = Counter()
    for r in got:
        assert r.length > 0
        full[r.sequence_id] += r.length
    assert sorted(full.values())[1:] == [32] * (len(full) - 1)
    assert packing.pack(cases.empty(spark), tokenizer_path()).count() == 0


def test_word_by_word_encoding_equals_whole_texts():
    from tokenizers import Tokenizer

    whole, encode = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path())
    texts = ["", " ", "It's  a\ttest\n\nÉTÉ é <|endoftext|> x<|startoftext|>y", "a b c 12345 !!! İ ẞ", "\x00 \x1c\x1d z", "don't WE'LL ' s"]
    wanted = [np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
    assert encode(texts) == wanted
    few = packing.Encoder(tokenizer_path())
    few._words.limit = few._parts.limit = 500  # generations change all the time
    for _ in range(3):
        assert [few([text])[0] for text in texts] == wanted
    few._merged = None  # a vocabulary with its ids in another order
    assert few(texts) == wanted


def test_parts_of_words_merge_as_the_tokenizer_merges():
    from tokenizers import Tokenizer

    rng = random.Random(9)
    words_ = ["".join(rng.choice("etaoinshrdlucmfwypvbgkjqxzéèüß") for _ in range(rng.randint(1, 14))) for _ in range(5000)]
    words_ += ["".join(rng.choice("!#$%&()*+,-./:;<=>?@[]^_`{|}~") for _ in range(rng.randint(1, 6))) for _ in range(500)] + ["a" * 3000, "%" * 3000]
    slow, encode = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    assert encode._merged
    assert encode(words_) == [np.array(e.ids, "<u4").tobytes() for e in slow.encode_batch(words_, add_special_tokens=False)]


def test_new_words_of_a_batch_take_one_call_and_are_not_kept():
    encode, calls = packing.Encoder(tokenizer_path()), []
    merged = encode._merged
    encode._merged = lambda *batch: calls.append(1) or merged(*batch)
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("etaoinshrd") for _ in range(8)) + rng.choice(["", ".", ",)"]) for _ in range(500)) for _ in range(8)]
    ids = encode(texts)
    assert len(calls) == 1
    assert list(map(len, ids)) == [sum(map(len, encode(text.split()))) for text in texts]
    assert not encode._words.size and not encode._parts.size


@pytest.mark.parametrize("texts", [
    [], [""], ["", "", "a", ""], [" ", "\n\n", "x "], ["12 3"], ["12 3", "ab 4th"], ["\t", "a\tb ."], [".a ..a a.a a. .", "A'b 'a"],
    ["été ÉTÉ, ÀÞ àþ ×× a÷b ß ÿÿ! ÃÂ ©a ŸĀ", "naïve Œuvre"], ["\x00 \x7f \xa0 a\x00b", "漢字 Ünïcode漢 \U0001f600!"]])
def test_encoding_of_odd_batches(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    wanted = [np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
    assert packing.Encoder(tokenizer_path())(texts) == wanted


# SimHash

def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    text = {r[0]: r[1] for r in cases.rows()}
    for r in simhash.fingerprints(cases.table(spark)).collect():
        if r.doc_id is not None:
            assert r.fp % 2 ** 64 == plain_fingerprint(text[r.doc_id])


def test_ball_links_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 63, 30, dtype=np.int64).tolist() + [0, -1, 1 << 62, -(1 << 63)]
    fps = set(base)
    for x in base:
        for _ in range(4):
            y = x
            for b in rng.choice(64, rng.integers(1, 4), replace=False).tolist():
                y ^= (1 << b) if b < 63 else -(1 << 63)
            fps.add(y)
    fps = sorted(fps)
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[i + 1:]:
            if bin((x ^ y) % 2 ** 64).count("1") <= 2:
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")), "t").collect()}
    assert got == {x: find(x) for x in fps if find(x) != x}


def test_near_duplicates_and_keep_one(spark):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(cases.table(spark)).collect()}
    assert got[20] == got[21] == got[0] == 0 and got[24] == got[25] == got[23] == 23 and got[28] == 28
    docs = cases.table(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted({v for v in got.values() if v is not None})
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0


def test_keep_one_chooses_rows_not_ids(spark):
    rng = random.Random(5)
    a, b, c, d, e = (cases.prose(rng, 120) for _ in range(5))
    found = [(None, a), (None, b), (None, c), (None, c + " tail"), (None, c), (7, d), (7, e), (7, e), (8, d), (9, a)]
    docs = cases.table(spark, [(i, t, "en", "s") for i, t in found])
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    some = [t for i, t in kept if i is None and t.startswith(c)]
    assert len(some) == (1 if bin(simhash.fingerprint(c.encode()) ^ simhash.fingerprint((c + " tail").encode())).count("1") <= 2 else 2)
    assert [x for x in kept if x[1] not in some] == sorted([(None, b), (7, d), (7, e), (9, a)], key=str)
    assert simhash.keep_one(cases.empty(spark)).count() == 0


# pseudonyms

def plain_feistel(value, a, b, key, form):
    left, right = divmod(value, b)
    number = lambda i, other: int(hashlib.sha256(f"{key}:{form}:{a}:{b}:{i}:{other}".encode()).hexdigest()[:15], 16)
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + number(i, right) % a) % a
        else:
            right = (right + number(i, left) % b) % b
    return left * b + right


def plain_permuted(digits, key, form):
    n, low = len(digits), len(digits) // 2
    return str(plain_feistel(int(digits), 10 ** (n - low), 10 ** low, key, form)).zfill(n)


def test_pseudonyms_against_a_plain_network(spark):
    import datetime

    start = datetime.date(1800, 1, 1)
    day = (datetime.date(2020, 2, 29) - start).days
    wanted_day = start + datetime.timedelta(plain_feistel(day, *pii._DATE_HALVES, pii.KEY, "date"))
    address = plain_feistel(int.from_bytes(bytes([192, 168, 1, 77]), "big"), 65536, 65536, pii.KEY, "address")
    body = plain_permuted("453201511283036", pii.KEY, "card")
    card = next(body + c for c in "0123456789" if sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate((body + c)[::-1])) % 10 == 0)
    own = plain_permuted("9745553436", pii.KEY, "phone")
    abroad = plain_permuted("2071234567", pii.KEY, "phone")
    given = ["on 2020-02-29 it", "at 192.168.1.77 now", "card 4532015112830366 ok", "+19745553436", "+1 974 555 3436", "+1 (974) 555-3436", "974-555-3436",
             "+442071234567", "+44 20 7123 4567", "no number 12345"]
    wanted = [f"on {wanted_day} it", f"at {'.'.join(map(str, address.to_bytes(4, 'big')))} now", f"card {card} ok", f"+1{own}", f"+1 {own[:3]} {own[3:6]} {own[6:]}",
              f"+1 ({own[:3]}) {own[3:6]}-{own[6:]}", f"{own[:3]}-{own[3:6]}-{own[6:]}", f"+44{abroad}", f"+44 {abroad[:2]} {abroad[2:6]} {abroad[6:]}", "no number 12345"]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(given)], "doc_id long, text string").coalesce(1)
    assert [r.text for r in pii.pseudonymized_documents(docs).collect()] == wanted


TEXTS = [
    "write und.34@mail7.example.com, or +1 (974) 555-3436 now", "card 4845168114407329 and 4845 1681 1440 7329 again", "not a card 4845168114407328",
    "ip 97.51.17.173. but 999.1.1.1 stays", "ssn 123-45-6789, 000-12-3456 no", "born 1984-02-29 or 29.02.1984, never 31/02/2020",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "", None, "plain 12 34", "call 217-555-1212 on 1984-02-29, ip 97.51.17.173", "a" * 300_000 + "@",
    "un. +1 (843) 555-7672 170.106.47.218 Et +1 (843) 555-7672 4845168114407329 or +44 20 7946 0958 170.106.47.218",
]


def test_pseudonyms(spark):
    docs = cases.table(spark, [(i, t, "en", "s") for i, t in enumerate(TEXTS)] * 2)
    got = {r.doc_id: r for r in pii.pseudonymized(docs).collect()}
    new = {i: got[i].text for i in got}
    assert [got[i].n_replaced for i in range(len(TEXTS))] == [2, 2, 0, 1, 1, 2, 1, 0, 0, 0, 3, 0, 6]
    for i, t in enumerate(TEXTS):
        if got[i].n_replaced == 0:
            assert new[i] == t
    assert re.fullmatch(r"write \S+@mail.invalid, or \+1 \(\d{3}\) \d{3}-\d{4} now", new[0]) and "34@" not in new[0]
    a, b = re.fullmatch(r"card (\d{16}) and (\d{4} \d{4} \d{4} \d{4}) again", new[1]).groups()
    assert a == b.replace(" ", "") != "4845168114407329"
    total = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(a)))
    assert total % 10 == 0
    ip = re.fullmatch(r"ip (\S+)\. but 999.1.1.1 stays", new[3]).group(1)
    assert all(int(x) < 256 for x in ip.split(".")) and new[10].endswith(ip)
    iso, dotted = re.fullmatch(r"born (\d{4}-\d\d-\d\d) or (\d\d\.\d\d\.\d{4}), never 31/02/2020", new[5]).groups()
    assert iso == "-".join(reversed(dotted.split("."))) and f"on {iso}," in new[10]
    assert not any(x in new[12] for x in ("555-7672", "170.106.47.218", "4845168114407329", "7946"))
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', new[6]) and new[6] != TEXTS[6]
    whole = pii.pseudonymized_documents(docs)
    assert whole.columns == docs.columns
    assert all(r.n_replaced == 9 and r.n_chars == len(r.text or "") for r in whole.collect())
    assert pii.pseudonymized(cases.empty(spark)).count() == 0


def test_secrets_go_whole(spark):
    values = ["ab12" * 75, "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKKF2QT4", "c2VjcmV0c2VjcmV0cw=="]
    docs = cases.table(spark, [(i, f"token: {v} end, password={v}.", "en", "s") for i, v in enumerate(values)])
    for r in pii.pseudonymized(docs).collect():
        value = values[r.doc_id]
        new = re.fullmatch(r"token: ([0-9a-fA-F]+) end, password=([0-9a-fA-F]+)\.", r.text)
        assert new and new[1] == new[2] != value and len(new[1]) == len(value) and r.n_replaced == 2


@pytest.mark.parametrize("a, b", [(10, 10), (189, 7), (1, 50), (898, 3)])
def test_feistel_is_a_permutation(spark, a, b):
    found = spark.range(a * b).select(pii.feistel(F.col("id"), a, b, "key", "form").alias("v")).collect()
    assert sorted(r.v for r in found) == list(range(a * b))


# language

def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = langid.identified(docs).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r.lang_pred == lang[r.doc_id][0] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    got = langid.identified(cases.table(spark)).collect()
    assert len(got) == len(cases.rows())
    for r in got:
        if r.doc_id in (23, 24, 25):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.identified(cases.empty(spark)).count() == 0
    unlabelled = cases.table(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identified(unlabelled).collect()} == {"und"}


# passages

def kept_plain(found):
    first = {}
    for doc, text in sorted((r[0], r[1]) for r in found if r[0] is not None and r[1] is not None):
        w = words(text)
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i:i + 50]), doc)
    result = Counter()
    for doc, text, *_ in found:
        w = words(text)
        gone = set()
        if doc is not None:
            for i in range(len(w) - 49):
                if first[tuple(w[i:i + 50])] < doc:
                    gone.update(range(i, i + 50))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        result[(doc, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest())] += 1
    return result


def test_passages_against_brute_force(spark):
    rng = __import__("random").Random(5)
    passage, looped = cases.prose(rng, 90), "round and " * 400
    found = [r for r in cases.rows() if r[0] != 28]
    found += [(50 + i, cases.prose(rng, 30) + " " + passage + " " + cases.prose(rng, i), "en", "s") for i in range(8)]
    found += [(60, looped, "en", "s"), (61, looped + "end", "en", "s"), (62, passage.rsplit(" ", 41)[0], "en", "s"), (29, passage, "en", "s")]
    got = substrings.deduplicated(cases.table(spark, found)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == kept_plain(found)
    assert substrings.deduplicated(cases.empty(spark)).count() == 0


def test_windows_of_hot_minimisers_leave_the_buckets(spark, monkeypatch):
    rng = random.Random(8)
    passage = cases.prose(rng, 48)
    found = [(i, f"{i} {i + 100} {passage} {i + 200} {i + 300}", "en", "s") for i in range(60)]
    found += [(70, found[5][1] + " end", "en", "s"), (71, found[5][1], "en", "s"), (71, found[5][1], "en", "s")]
    docs = cases.table(spark, found)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    assert not substrings.hot_minimisers(texts)
    usual = sorted(substrings.deduplicated(docs).collect())
    monkeypatch.setattr(substrings, "_HOT", 2_000)
    hot = substrings.hot_minimisers(texts)
    assert hot
    for row in substrings._sent(texts, 4, hot).collect():
        assert not hot & set(substrings._unblob(row.blob)[0].tolist())
    assert sorted(substrings.deduplicated(docs).collect()) == usual and sum(r.n_removed for r in usual) > 100


def test_equal_window_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(substrings, "_mixed", lambda h: h * np.uint64(0))
    a, b = (" ".join(f"{c}{i}" for i in range(52)).encode() for c in "ab")
    assert list(substrings._runs({a: [1, 1], b: [2, 2]})) == []
    (run,) = substrings._runs({a: [1, 9], b: [2, 2]})
    assert run[2:] == (0, 2, 1)


