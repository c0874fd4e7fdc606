"""Canonical exact digests of documents, with DataFrame functions only.

The canonical form of a text is case-folded, NFKC-normalised and has runs of white space folded to one blank. Its digest is
128 bits of xxhash64 under two seeds. Documents that share a digest are compared byte by byte: should two different canonical
texts meet in one digest, all but the first (in byte order) get a numbered suffix, so equal fingerprints mean equal canonical
texts.

Defined cases: null texts count as empty; a table of one row is its own neighbour; rows with the same id stand next to each
other, ordered by a hash of their text, and each gets a result; null ids come last; an empty table gives an empty result; any
further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bucket_of, quantile_bounds, table

#: White space that NFKC leaves alone and Java's \s does not cover.
SPACES = r"[\s\x{85}\x{1680}\x{2028}\x{2029}]+"


def canonical(text: Column) -> Column:
    """The canonical form. ASCII texts need no more than lower(); others pass ICU's case folding and NFKC composition."""

    def nfkc(c: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    form = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(nfkc(folded))
    return F.trim(F.regexp_replace(form, SPACES, " "))


def wide_hash(text: Column) -> Column:
    """128 bits of xxhash64, as 32 hexadecimal digits."""
    return F.concat(*(F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), text))), 16, "0") for seed in (1, 2)))


def collisions(digests: DataFrame) -> DataFrame | None:
    """Byte comparison inside equal digests: (digest, form, suffix) of the canonical texts that share their digest with a smaller one.

    None if there are none, which is the usual case. ``digests`` has columns digest and form. Copies of a text meet in the map-side
    part of the grouping, so a text that fills a third of the table still sends one row from each task.
    """
    texts = digests.groupBy("digest", "form").agg(F.lit(1).alias("one"))
    shared = texts.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    if shared.isEmpty():
        return None
    order = W.partitionBy("digest").orderBy("form")
    return texts.join(shared, "digest").select("digest", "form", (F.row_number().over(order) - 1).alias("suffix")).where("suffix > 0")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = wide_hash) -> DataFrame:
    """One row per group of equal canonical texts: fingerprint, first_id (smallest id), n_docs."""
    forms = docs.select(F.col(id_col).alias("id"), canonical(F.coalesce(F.col(text_col), F.lit(""))).alias("form"))
    groups = forms.groupBy(digest(F.col("form")).alias("digest"), "form").agg(F.min("id").alias("first_id"), F.count("*").alias("n_docs"))
    return with_suffix(groups, collisions(groups.select("digest", "form")), "digest", "form").select(F.col("digest").alias("fingerprint"), "first_id", "n_docs")


def with_suffix(df: DataFrame, found: DataFrame | None, digest: str, form: str) -> DataFrame:
    """``digest`` with the number of its canonical text appended where digests collided."""
    if found is None:
        return df
    named = found.select(F.col("digest").alias("_d"), F.col("form").alias("_f"), F.col("suffix").alias("_s"))
    joined = df.join(named, (F.col(digest) == F.col("_d")) & (F.col(form) == F.col("_f")), "left")
    return joined.withColumn(digest, F.when(F.col("_s").isNull(), F.col(digest)).otherwise(F.concat_ws("-", digest, "_s"))).drop("_d", "_f", "_s")


def with_next(docs: DataFrame, rows_per_bucket: int = 512) -> DataFrame:
    """(id, text, ...) rows with ``next_text``: the text of the following row by descending id, of the first row for the last one.

    Rows are dealt into many small buckets of adjacent ids, each sorted on its own; the head of a bucket is also sent to the bucket
    before it. One shuffle, no global sort, no bucket that grows with the table (up to 65,536 buckets).
    """
    bounds = quantile_bounds(docs, "id", rows_per_bucket)
    n = max(1, len(bounds))
    bucket = bucket_of("id", bounds or [0])
    head = F.col("id") == F.expr(f"element_at(from_json('{bounds}', 'array<bigint>'), bucket + 1)") if bounds else F.lit(True)
    places = F.when(
        F.coalesce(head, F.lit(False)),
        F.array(F.struct(F.col("bucket").alias("at"), F.lit(False).alias("copy")), F.struct(F.pmod(F.col("bucket") + 1, F.lit(n)).alias("at"), F.lit(True).alias("copy"))),
    ).otherwise(F.array(F.struct(F.col("bucket").alias("at"), F.lit(False).alias("copy"))))
    spread = docs.withColumn("bucket", bucket).withColumn("place", F.explode(places)).select("id", "text", "place.at", "place.copy")
    order = W.partitionBy("at").orderBy("copy", F.col("id").desc_nulls_last(), F.xxhash64("text"))
    return spread.withColumn("next_text", F.lead("text").over(order)).where(~F.col("copy")).select("id", "text", "next_text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = wide_hash) -> DataFrame:
    """Fingerprints of all documents and of their edited texts (second half replaced by the start of the next document).

    The fingerprint is exact, so likeness is 1 for equal canonical texts (their bytes are compared) and 0 otherwise.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = with_next(rows).select(
        "id",
        n.cast("long").alias("n_chars"),
        F.concat(F.left("text", n - half), F.left(F.coalesce("next_text", "text"), half)).alias("edited"),
        canonical(F.col("text")).alias("form"),
        canonical(F.coalesce("next_text", "text")).alias("next_form"),
    ).select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "form", canonical(F.col("edited")).alias("edited_form"), (F.col("form") == F.col("next_form")).cast("double").alias("near_next"))
    near = edited.select("id", "n_chars", "edited_sha256", "form", "edited_form", digest(F.col("form")).alias("fingerprint"), digest(F.col("edited_form")).alias("edited_fingerprint"), (F.col("form") == F.col("edited_form")).cast("double").alias("near_edited"), "near_next")
    found = collisions(rows.select(canonical(F.col("text")).alias("form")).select(digest(F.col("form")).alias("digest"), "form"))
    named = with_suffix(with_suffix(near, found, "fingerprint", "form"), found, "edited_fingerprint", "edited_form")
    return named.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
