"""One registered query per operator, with production parameters, over the whole given table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderline.llm import alignment, archives, collision, html_text, itq, langid, mixing, packing, pii, quality, simhash, spelling, substrings
from ladderline.llm.common import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def vocabulary(setting: str, default: str) -> str:
    """Place of a vocabulary file; the environment variable `setting` names another one."""
    named = os.environ.get(setting)
    if named:
        return named
    import public_tokenizers  # only where a default is used

    return public_tokenizers.path(default)


def tokenizer_path() -> str:
    """Vocabulary of the packing operator; LLM_TOKENIZER names another one."""
    return vocabulary("LLM_TOKENIZER", "word_bpe_49k.json")


@register("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality.trusted_documents(read_table(spark, sf_dir, "labels"))
    return quality.rules(read_table(spark, sf_dir, "documents"), trusted)


@register("op2_mixing", mixing.ORACLE)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(read_table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


@register("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


@register("op4_main_text")
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(read_table(spark, sf_dir, "pages"))


@register("op5_itq")
def op5_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(read_table(spark, sf_dir, "embeddings"))


@register("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op7_pseudonyms")
def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymized(read_table(spark, sf_dir, "documents"))


@register("op8_language")
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(read_table(spark, sf_dir, "documents"))


@register("op9_substrings")
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicated(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@register("op10_arc_to_warc")
def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archives.archived(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op11_collisions")
def op11_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@register("op12_spelling")
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


@register("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"), vocabulary("LLM_BYTE_BPE", "byte_bpe_50k.json"), vocabulary("LLM_PIECE_BPE", "piece_bpe_32k.model"))
