"""The pipeline's stages keep the table's form, and its result is what the stages give by hand."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import cases
import corpus_pipeline
from ladderline.llm import mixing, quality, simhash
from ladderline.llm.common import read_table
from ladderline.session import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    columns, tables = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        tables.append(stage(spark, tables[-1], SF).cache())
        assert tables[-1].columns == columns
    given, accepted, single, private, mix = tables
    trusted = quality.trusted_documents(read_table(spark, SF, "labels"))
    kept = {r.doc_id for r in quality.rules(given, trusted).where("kept").collect()}
    assert {r.doc_id for r in accepted.collect()} == kept and 0 < len(kept) < given.count()
    found = simhash.near_duplicates(accepted).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in found})
    assert private.count() == single.count() and not any(re.search(r"\d@mail\d", r.text) for r in private.collect())
    plan = {r.doc_id: r.taken for r in mixing.mix(private).collect() if r.taken}
    taken = Counter()
    for r in mix.collect():
        taken[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert taken == plan
    pieces, length = corpus_pipeline.run(spark, SF).collect(), defaultdict(int)
    for p in pieces:
        length[p.doc_id] += p.length
    assert set(length) == set(plan)
    sizes = Counter()
    for p in pieces:
        sizes[p.sequence_id] += p.length
    assert all(n == 2048 for k, n in sizes.items() if k < max(sizes))


def test_stages_take_awkward_rows(spark, tmp_path):
    """Null, empty, repeated and very long texts, null and repeated ids and sources, clashing columns, no rows."""
    rng = random.Random(2)
    good = [" ".join(f"w{i}" for i in rng.sample(range(400), 200)) for _ in range(8)]
    rows = cases.rows() + [(50 + i % 6, text, "en", "s1") for i, text in enumerate(good)]
    rows += [(None, good[2], "en", None), (None, good[3] + " more", "en", "s2"), (None, good[3] + " more", "en", "s2"), (60, good[4], "en", "s2")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50, 56)] + [(2, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int")
    for number, docs in enumerate((cases.table(spark, rows), cases.empty(spark))):
        folder = f"{tmp_path}/{number}"
        labels.write.parquet(f"{folder}/labels.parquet")
        docs.write.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, folder), "awkward")
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
        assert pieces.agg(F.sum("length")).first()[0] == pieces.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
        assert pieces.isEmpty() == (number == 1)
        assert corpus_pipeline.run(spark, folder).count() == pieces.count()


def test_every_operator_has_one_query():
    import __spark_entry__ as contract

    names = [n for n in contract.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in contract.queries()
