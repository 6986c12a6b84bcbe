"""Registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm import conversations, linededup, ordinal, packing, piecewise, pseudonym, rules, simhash, sitetree, subwords
from quiver.llm.common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.edited_next(table(spark, sf_dir, "documents"), "doc_id", "text")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.render(table(spark, sf_dir, "conversations"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"), "doc_id", "text", per_edit=linededup.PER_EDIT, copy_chars=1)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"), "text", keep=["doc_id"]).drop("rejected_by")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text")


#: Documents are kept whose chance of the highest grade is so large.
LEAST_TAIL = 0.7


def graded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with expected_grade, tail_probability and kept, by a model fitted on the labelled ones among them."""
    model = ordinal.graded(docs, table(spark, sf_dir, "labels"))
    return ordinal.score(docs, model, "text").withColumn("kept", F.col("tail_probability") >= LEAST_TAIL)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return graded(spark, docs, sf_dir).select("doc_id", "expected_grade", "tail_probability", "kept")


#: The session's setting that holds the key of pseudonyms, and the key of sessions that set none, which hides nothing.
KEY_SETTING = "spark.quiver.pseudonymKey"
EXAMPLE_KEY = "example key"


def pseudonym_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, EXAMPLE_KEY)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonym.pseudonymize(docs, pseudonym_key(spark), "text", count_col="n_finds")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), "doc_id", "text")


def op10_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.segmentation_report(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_html_extraction": op5_html_extraction,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_subwords": op10_subwords,
}

ORACLES: dict[str, str] = {
    "op2_chat_formatting": conversations.oracle(),
    "op4_quality_rules": rules.oracle(),
}
