"""Quality rules: base counts of every text, then a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams are hashed into bins whose numbers grow with the text of the table: unigrams
into one bin per BYTES_PER_BIN bytes, bigrams, of which nearly all are rare, into a number that grows
with the square root. Two multinomials over all bins are counted: the raw corpus from all documents,
the target from the trusted ones. A document's score is the mean of log(target / raw) over its n-grams;
it is kept at a score of `THRESHOLD` or more.

Texts stay where they are but for trusted ones: a bit table of fixed size lets few others through to
the exact join with the trusted doc_ids. The most frequent bin of each of a fixed number of slots
reaches the scoring scan as a scalar of one size; the few n-grams in other bins are joined to theirs
and summed per text. Ratios are whole numbers of 2^-32, so sums don't depend on their order.
Everything is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderline.llm.common import digest, once, unused, words
from ladderline.session import written

BYTES_PER_BIN = 128  # about twenty words; with fuller bins junk words share theirs with good ones
UNIGRAM_BINS = 1 << 16  # at least
BIGRAM_BINS = 1 << 14  # at least
BIGRAM_ROOT = 4  # bigram bins per square root of the words
UNIGRAM_SLOTS = 1 << 20
BIGRAM_SLOTS = 1 << 17
_SLOTS = UNIGRAM_SLOTS + BIGRAM_SLOTS
_SLOT_GROUP = 1 << 10
_RATIO_BITS = 40  # of a slot's number: a ratio below 128 in size; the bin's bits above its slot stand over them
_NO_BIN = -1 << _RATIO_BITS
TRUST_BITS = 1 << 24  # of the table that spares other texts the join
_UNIT = 1 << 32
THRESHOLD = -0.22
SMOOTHING = 1.0
MIN_WORDS = 50
REPEAT_PERCENT = 50
_SYMBOLS = r"[#*$%&|<>]"


def _long(column: Column) -> Column:
    return column.cast("long")


def _after(values: Column, n: int) -> Column:
    """The array without its first n elements."""
    return F.slice(values, F.lit(n + 1), F.greatest(F.size(values) - n, F.lit(0)))


def _pairs(values: Column, make) -> Column:
    """`make` of every two neighbours, without naming the array inside, where it would be built for each element."""
    return F.zip_with(F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))), _after(values, 1), make)


def _chained(left: Column, right: Column) -> Column:
    """Of two 64-bit hashes one that depends on their order; cheap, as it runs for every word."""
    return F.shiftleft(left, 1).bitwiseXOR(right)


def word_hashes(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def pair_hashes(one: Column) -> Column:
    """Hashes of the word bigrams, from the words' hashes."""
    return _pairs(one, _chained)


def window_hashes(one: Column, two: Column) -> Column:
    """64-bit hashes of the 3-word windows: among the n of one text a false match has a chance of n * n / 2^63."""
    n = F.greatest(F.size(one) - 2, F.lit(0))
    return F.zip_with(F.slice(two, F.lit(1), n), _after(one, 2), _chained)


def covered_words(hashes: Column) -> Column:
    """Words in 3-word windows that occur twice or more; windows are sorted with their places."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(p: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(p, i)["h"] == x["h"], F.lit(False))
        starts = F.sort_array(F.transform(F.filter(p, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
        return F.aggregate(
            starts, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")))["n"]

    return once(placed, covered)


def base_rules(found: str, hashes: str) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, from text, its words and window hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    return {
        "n_words": _long(F.size(found)),
        "word_chars": _long(F.length(F.array_join(found, ""))),
        "n_symbols": _long(F.regexp_count(text, F.lit(_SYMBOLS))),
        "n_dup_lines": _long(F.size(lines) - F.size(F.array_distinct(lines))),
        # few texts repeat a window, and only those are sorted
        "n_repeat_words": _long(F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered_words(F.col(hashes))).otherwise(F.lit(0))),
    }


def bins(n_bytes: int) -> tuple[int, int]:
    """(unigram bins, bigram bins), powers of two, for texts of so many bytes."""
    power = lambda least, x: max(least, 1 << max(0, math.ceil(x) - 1).bit_length())
    return power(UNIGRAM_BINS, n_bytes / BYTES_PER_BIN), power(BIGRAM_BINS, BIGRAM_ROOT * math.sqrt(n_bytes / BYTES_PER_BIN * 20))


def _masked(h: Column, n: int) -> Column:
    return h.bitwiseAND(F.lit(n - 1).cast("long"))


def _grams(one: Column, two: Column, size: tuple[int, int]) -> Column:
    """Bins of all unigrams, then of all bigrams, which lie behind the unigrams' bins."""
    return F.concat(F.transform(one, lambda h: _masked(h, size[0])),
                    F.transform(two, lambda h: _masked(h, size[1]) + F.lit(size[0]).cast("long")))


def _slot(gram: Column, size: tuple[int, int]) -> Column:
    return F.when(gram < size[0], _masked(gram, UNIGRAM_SLOTS)).otherwise(
        _masked(gram - size[0], BIGRAM_SLOTS) + F.lit(UNIGRAM_SLOTS).cast("long"))


def _high(gram: Column, size: tuple[int, int]) -> Column:
    """The bits of a bin above its slot: slot and these are the bin."""
    return F.when(gram < size[0], F.shiftright(gram, UNIGRAM_SLOTS.bit_length() - 1)).otherwise(
        F.shiftright(gram - size[0], BIGRAM_SLOTS.bit_length() - 1))


def _array(rows: DataFrame, slots: int, name: str, absent: int) -> DataFrame:
    """One row with an array of `slots` places: `name` of every slot, `absent` where a slot has no row."""
    every = rows.sparkSession.range(slots).select(F.col("id").alias("slot")).join(rows.hint("merge"), "slot", "left")
    filled = every.select("slot", F.coalesce(name, F.lit(absent).cast("long")).alias("x"))
    # arrays of a group of slots first, so that one task only joins arrays together
    part = filled.groupBy(F.shiftright("slot", _SLOT_GROUP.bit_length() - 1).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("slot", "x"))).alias("all"))
    pick = F.transform("all", lambda x: x["x"])
    whole = part.select("part", pick.alias("x")).agg(F.array_sort(F.collect_list(F.struct("part", "x"))).alias("all"))
    return whole.select(F.flatten(pick).alias("head"))


def _trusted(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """text of the trusted rows of `docs`."""
    mark = written(trusted.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("_trusted")).distinct(), "quality-trusted")
    place = lambda c: _masked(F.xxhash64(c), TRUST_BITS)
    bit = lambda c: place(c).bitwiseAND(F.lit(63).cast("long")).cast("int")
    slot = lambda c: F.shiftright(place(c), 6)
    power = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), bit(c))
    rows = mark.select(slot("_trusted").alias("slot"), power("_trusted").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    table = written(_array(rows, TRUST_BITS // 64, "bits", 0), "quality-trusted-bits")
    own = docs.select(F.col("doc_id").cast("string").alias("_own"), "text").where("_own IS NOT NULL")
    maybe = own.where(F.get(table.scalar(), slot("_own").cast("int")).bitwiseAND(power("_own")) != 0)
    # labels grow with the documents: sorted and merged at every size, never broadcast
    return maybe.join(mark.hint("merge"), F.col("_own") == F.col("_trusted"), "left_semi").select("text")


def _counted(texts: DataFrame, size: tuple[int, int], name: str) -> DataFrame:
    """bin and `name`, the n-grams of all texts in each bin."""
    one = texts.select(word_hashes(words("text")).alias("one"))
    grams = one.select(_grams(F.col("one"), pair_hashes(F.col("one")), size).alias("grams"))
    # outer: for an inner one the optimizer would test the array's size and build it several times over
    return grams.select(F.explode_outer("grams").alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias(name))


def log_ratios(docs: DataFrame, trusted: DataFrame, size: tuple[int, int], smoothing: float = SMOOTHING) -> DataFrame | None:
    """bin, raw and `ratio`, log(target / raw) in 1 / _UNIT, of the bins that occur; None if no trusted document has a word.

    `trusted` holds doc_ids, repeats and nulls allowed.
    """
    raw = _counted(docs.select("text"), size, "raw")
    target = _counted(_trusted(docs, trusted), size, "target")
    counted = written(raw.join(target.hint("merge"), "bin", "left").select("bin", "raw", F.coalesce("target", F.lit(0)).alias("target")), "quality-bins")
    total = counted.agg(F.sum("raw").alias("r"), F.sum("target").alias("t")).first()
    if not total.t:
        return None
    part = lambda count, whole: F.log((F.col(count) + F.lit(smoothing)) / F.lit(whole + smoothing * sum(size)))
    ratio = F.round((part("target", total.t) - part("raw", total.r)) * _UNIT).cast("long")
    return counted.select("bin", "raw", ratio.alias("ratio"))


def _head(ratios: DataFrame, size: tuple[int, int]) -> DataFrame:
    """One row with `head`: for each slot the high bits of its most frequent bin, and that one's ratio, in one number.

    The driver holds it and sends it with the scan's tasks, once for each look into it.
    """
    best = ratios.groupBy(_slot(F.col("bin"), size).alias("slot")).agg(F.max(F.struct("raw", "bin", "ratio")).alias("best"))
    low = F.col("best.ratio").bitwiseAND(F.lit((1 << _RATIO_BITS) - 1).cast("long"))
    entry = F.shiftleft(_high(F.col("best.bin"), size), _RATIO_BITS).bitwiseOR(low)
    return _array(best.select("slot", entry.alias("entry")), _SLOTS, "entry", _NO_BIN)


def _texts(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """text's digest, base counts, and the word and bigram hashes `one` and `two`; the names of the counts."""
    table = docs.select(F.col("text").cast("string").alias("text")).withColumn("found", words("text"))
    table = table.withColumn("one", word_hashes(F.col("found")))
    table = table.withColumn("two", pair_hashes(F.col("one")))
    table = table.withColumn("hashes", window_hashes(F.col("one"), F.col("two")))
    counts = base_rules("found", "hashes")
    for name, value in counts.items():
        table = table.withColumn(name, value)
    return table.select(digest("text").alias("_digest"), *counts, "one", "two"), list(counts)


def _scored(docs: DataFrame, ratios: DataFrame | None, size: tuple[int, int]) -> DataFrame:
    """_digest, base counts and llr of every distinct text.

    Copies of a text count together; their mean is that of each, their counts are the same.
    """
    texts, counts = _texts(docs)
    alike = [F.max(c).alias(c) for c in counts]
    if ratios is None:
        return texts.groupBy("_digest").agg(*alike, F.lit(None).cast("double").alias("llr"))
    head = written(_head(ratios, size), "quality-head").scalar()
    # a null before the n-grams gives every text its row without a bin
    grams = F.concat(F.array(F.lit(None).cast("long")), _grams(F.col("one"), F.col("two"), size))
    every = texts.select("_digest", *counts, grams.alias("grams")).select("_digest", *counts, F.explode_outer("grams").alias("bin"))
    # a look into the slots holds them in the plan: one is enough
    looked = every.select("_digest", *counts, "bin", F.get(head, _slot(F.col("bin"), size).cast("int")).alias("entry"))
    own = F.shiftright("entry", _RATIO_BITS) == _high(F.col("bin"), size)
    ratio = F.shiftright(F.shiftleft("entry", 64 - _RATIO_BITS), 64 - _RATIO_BITS)
    # per text one row for all n-grams in the slots, with its counts, and one for every other bin
    placed = looked.select("_digest", *counts, "bin", F.when(~own, F.col("bin")).alias("rest"), ratio.alias("ratio"))
    inside = F.col("rest").isNull()
    first = [F.max(F.when(inside, F.col(c))).alias(c) for c in counts]
    counted = written(placed.groupBy("_digest", "rest").agg(
        F.sum(F.when(inside & F.col("bin").isNotNull(), F.col("ratio"))).alias("inside"), F.count("bin").alias("grams"), *first), "quality-grams")
    whole = counted.groupBy("_digest").agg(F.sum("inside").alias("inside"), F.sum("grams").alias("grams"), *alike)
    rest = (counted.where("rest IS NOT NULL").select("_digest", "rest", "grams").join(ratios.select("bin", "ratio").hint("merge"), F.col("rest") == F.col("bin"))
            .groupBy(F.col("_digest").alias("_own")).agg(F.sum(F.col("ratio") * F.col("grams")).alias("outside")))
    total = F.coalesce("inside", F.lit(0)) + F.coalesce("outside", F.lit(0))
    return whole.join(rest.hint("merge"), F.col("_digest") == F.col("_own"), "left").select(
        "_digest", *counts, F.when(F.col("grams") > 0, total / F.lit(float(_UNIT)) / F.col("grams")).alias("llr"))


def _judged(docs: DataFrame, trusted: DataFrame, threshold: float) -> DataFrame:
    """_digest (of the text), the base counts, llr, base_failed and kept for every distinct text."""
    size = bins(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ratios = log_ratios(own, trusted, size)
    table = _scored(own, ratios, size)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    verdict = ~F.col("base_failed") & F.coalesce(F.col("llr") >= F.lit(threshold), F.lit(True))
    return table.withColumn("base_failed", failed).withColumn("kept", verdict)


def rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, llr and kept for every row.

    Null text has no words, so it fails the base rules; so does every text of fewer than 50 words.
    Without any trusted document llr is null and the base rules decide alone. Repeated rows count and
    are judged each; a null doc_id is never trusted but judged like any other. Other columns are
    ignored. An empty table gives no rows.
    """
    judged = written(_judged(docs, trusted, threshold), "quality-judged")
    rows = docs.select("doc_id", digest("text").alias("digest"))
    return rows.join(judged.hint("merge"), F.col("digest") == F.col("_digest")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def accepted(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that `rules` keeps, same columns. The verdict is the text's, known by a 128-bit hash."""
    kept = _judged(docs, trusted, threshold).where("kept").select("_digest")
    own = unused(docs, "digest")
    rows = docs.withColumn(own, digest("text"))
    return rows.join(kept, F.col(own) == F.col("_digest"), "left_semi").select(*docs.columns)


def trusted_documents(labels: DataFrame) -> DataFrame:
    """doc_ids that are labelled good and not toxic; a document with contradicting labels isn't trusted."""
    return (labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
            .where("q = 1 AND coalesce(t, 0) = 0").select("doc_id"))
