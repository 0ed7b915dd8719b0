"""Small document tables with the awkward rows that every operator must take."""

import random

from pyspark.sql import functions as F

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars int, taken long, kept boolean, fp long, "
          "words string, bin int, bucket long, n_replaced long, part long")


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "anea", "thorn", "reble", "with", "ti", "onder", "ea", "wh"]) + rng.choice(["", "", ".", "ing"]) for _ in range(n))


def rows(seed=1):
    """(doc_id, text, lang, source): null and empty text, white space only, copies, near copies, one very long text,
    repeated rows, null ids and sources."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(40, 160)) for _ in range(12)]
    found = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    found += [(20, base[0], "en", "s0"), (21, base[0], "en", "s1"), (22, base[1] + " tail", "en", "s1")]
    found += [(23, None, "en", "s0"), (24, "", "en", "s1"), (25, " \t\n ", "en", None), (26, "one", None, "s2"), (27, "two words", "fr", "s2")]
    found += [(28, prose(rng, 30_000), "en", "s0"), (29, base[2], "en", "s2"), (29, base[2], "en", "s2"), (None, base[3], "en", None)]
    found += [(30, base[4].replace(" ", "\n") + "\n\n" + base[4], "en", "s1"), (31, "été ßø \U0001f600 " * 30, "fr", "s1")]
    return found


def table(spark, found=None):
    found = rows() if found is None else found
    return spark.createDataFrame([(*r, len(r[1] or ""), 5, False, 7, "w", 1, 2, 9, 3) for r in found], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
