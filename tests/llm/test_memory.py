"""What the driver and idle workers have to hold."""

import re

import cases
import pyarrow as pa
from ladderline.llm import packing, quality
from ladderline.llm.queries import tokenizer_path


def test_slots_are_one_array_that_a_scan_holds_once(spark, monkeypatch):
    """The driver sends the slots with a scan's tasks, once for each look into them."""
    plans, tables, write = {}, {}, quality.written

    def noted(df, label):
        plans[label], tables[label] = df._jdf.queryExecution().optimizedPlan().toString(), write(df, label)
        return tables[label]

    monkeypatch.setattr(quality, "written", noted)
    docs = cases.table(spark, [(i, f"alpha beta gamma delta{i % 7} " * 30, "en", "web") for i in range(40)])
    trusted = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    assert quality.rules(docs, trusted).where("llr IS NOT NULL").count() == 40
    assert len(re.findall(r"scalar-subquery#\d+ \[\]", plans["quality-grams"])) == 1
    head = tables["quality-head"]
    assert head.schema.simpleString() == "struct<head:array<bigint>>"
    assert len(head.first()[0]) == quality.UNIGRAM_SLOTS + quality.BIGRAM_SLOTS


def test_workers_let_go_of_the_words_when_texts_are_done(spark):
    def held(batches):
        from ladderline.llm import packing as own

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(own._encoders)], pa.int64())], ["n"])

    docs = cases.table(spark, [(i, f"alpha beta {i}", "en", "web") for i in range(40)]).repartition(8)
    assert packing.pack(docs.repartition(8), tokenizer_path()).count() == 40
    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()} == {0}
