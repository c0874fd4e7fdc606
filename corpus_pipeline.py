"""Document pipeline: stages of the training-data operators, each written as Parquet and read again by the next.

Language ID drops documents without a language, the shingle join keeps one document of each group of near duplicates,
decontamination drops documents that hold a benchmark passage (both decide by row, not by doc_id), mixing repeats documents so
that sources meet their weights, and the last stage writes the token files and returns what they hold.

Defined cases: null texts and texts without a letter have no language and go in the first stage; rows with a null doc_id are
rows like any other, the last of their group to be kept; rows that share a doc_id but not their text are different documents;
equal rows are near duplicates of one another, so one stays; ties (equal doc_ids of a group) go by a hash of the row; texts of
any length are read whole; benchmark items that are null or empty match nothing; an empty table passes through all stages as an
empty one; columns beyond those of ``documents`` are dropped by the first stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groveframe.llm.common import materialize, table
from groveframe.llm.decontaminate import clean
from groveframe.llm.languages import identify, learn_samples
from groveframe.llm.mixing import mix
from groveframe.llm.shingle_join import near_duplicates
from groveframe.llm.token_files import token_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language."""
    return identify(docs, learn_samples(docs), keep=COLUMNS).where("lang_pred != 'und'").select(COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a number each, written once so that it stays theirs: ids may be null, shared or repeated."""
    return materialize(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()), "keyed-rows")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: that with the smallest doc_id, null ids last; rows without words are each their own.

    Rows of one doc_id go by a hash of their content, so only equal rows depend on how the table is cut.
    """
    rows = keyed(docs)
    found, _ = near_duplicates(rows, id_col="row")
    rank = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", F.xxhash64(*COLUMNS).alias("content"), "row")
    ranked = found.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", rank.alias("rank")), "row")
    kept = ranked.groupBy("component_id").agg(F.min("rank").alias("rank")).select("rank.row")
    return rows.join(kept, "row", "left_semi").select(COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a passage of the benchmark."""
    return clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix holds it, at least once."""
    mixed = mix(docs.select(COLUMNS))
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32 of each copy."""
    return token_rows(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]

#: SQL can't express language ID by cross-parsing or subword encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
