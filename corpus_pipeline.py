"""The corpus pipeline: language, near-duplicates, contamination, personal data, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.llm import bpe, contamination, language, pii, resemblance
from marram.llm.registry import tokenizer_path
from marram.sources.shared import materialise, table

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
CARRIED = {name: kind for name, kind in COLUMNS.items() if name != "doc_id"}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Names each document's language; those without a text or a letter go (if no language was learned, only those)."""
    return language.identify(docs, carry=CARRIED).where((F.col("lang_pred") != "und") | F.col("text").rlike(r"\p{L}")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (SimHash at three bits or fewer, or five-word shingles of similarity 0.8 or more): the smallest id, null ids last."""
    return resemblance.keep_one_of_each(docs, COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents a twentieth of whose words or more lie in windows of test items."""
    found = contamination.find_occurrences(docs, table(spark, sf_dir, "benchmark"), carry=CARRIED)
    return found.where(~contamination.contaminated()).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of each confirmed span in its place; n_chars follows the text."""
    rows = pii.redact_documents(docs, {c: t for c, t in CARRIED.items() if c != "text"})
    n_chars = F.when(F.col("n_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", n_chars).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and their round trip."""
    return bpe.encode_documents(docs, tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("contamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("tokens", encode),
]

#: Stages with models and fixpoints have no SQL; tests/llm compares the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
