"""Source divergence audit by sketch-prefiltered counting.

Within each language, how far the use of terms in a source departs from that in each other source, and which terms are overused.

1. Each task counts in how many of its documents a (language, term) occurs, in a count-min sketch: DEPTH rows of counters, of which
   the smallest is never below the true count. The sketches are added up in Spark, block by block, and as counters matter only up to
   the threshold, the sum is kept in one byte each: DEPTH * WIDTH bytes are broadcast, whatever the size of the corpus.
2. Terms that the sketch shows to be in too few documents are dropped before anything is shuffled; what is left is counted exactly,
   first within tasks, then by (language, source, term), and the threshold is applied to exact document counts. A sketch that fills
   up drops less and changes no result.
3. Smoothed shares are compared by a sparse join: most terms do not occur in most sources and have the source's base share there.
   With f the distance |p - q| and b the base shares, the sum over all V terms is V f(ba, bb), plus the change that the terms of a
   make alone against bb, plus that of b against ba, plus for the terms of both the difference to these two. Only the last is a join
   on terms; the changes of one source alone follow from how often each share occurs in it.

All arithmetic is in whole numbers. Defined cases: null text, language and source are empty strings, which are a language and a
source like any other; a (language, source) without terms is compared as well; a language without kept terms has differences of 0
and no terms; ties go by the bytes of the item; repeated rows are documents of their own; an empty table gives an empty result;
further columns are ignored, and a null doc_id is of no matter.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

#: Rows and counters a row of the sketch, and counters of a block of it.
DEPTH, WIDTH, BLOCK = 4, 1 << 21, 1 << 16
#: Counts that a task holds before it hands them on.
HELD = 500_000

#: What belongs to a term (letters and all beyond ASCII, A-Z lower-cased); the rest parts terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: bytes beyond ASCII are those of characters beyond ASCII."""
    return text.translate(LETTERS).split()


def cells_of(lang: bytes, terms: list[bytes], depth: int, width: int) -> np.ndarray:
    """(terms, depth): the places of the terms of a language in the rows of the sketch, one number each over all rows."""
    import xxhash

    lead = lang + b"\x00"  # no term holds a zero byte
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(lead + t) for t in terms), np.uint64).reshape(-1, 2)
    rows = np.arange(depth, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return (rows * np.uint64(width) + (both[:, :1] + rows * (both[:, 1:] | np.uint64(1))) % np.uint64(width)).astype(np.int64)


def sketch_rows(docs: DataFrame, threshold: int) -> DataFrame:
    """(block, counters): the parts of the sketch of each task that are not empty. ``docs`` is (lang, source, text)."""
    top = min(threshold, 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(DEPTH * WIDTH, np.uint8), defaultdict(Counter), 0

        def put() -> None:
            for lang, own in held.items():
                where, back = np.unique(cells_of(lang, list(own), DEPTH, WIDTH), return_inverse=True)
                n = np.bincount(back.ravel(), np.repeat(np.fromiter(own.values(), np.int64, len(own)), DEPTH))
                counts[where] = np.minimum(counts[where] + n, top)
            held.clear()

        for batch in batches:
            for lang, text in zip(*(batch.column(i).cast(pa.binary()).to_pylist() for i in (0, 2)), strict=True):
                own = held[lang]
                size -= len(own)
                own.update(set(terms_of(text)))
                size += len(own)
                if size > HELD:
                    put()
                    size = 0
        put()
        parts = counts.reshape(-1, BLOCK)
        for block in np.flatnonzero(parts.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([parts[block].tobytes()], pa.binary())], ["block", "counters"])

    return docs.mapInArrow(run, "block int, counters binary")


def merged(rows: DataFrame, threshold: int) -> DataFrame:
    """(block, counters): the sum of the blocks, up to the threshold; a task adds up one block after another as they come."""
    top = min(threshold, 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counters in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(counters, np.uint8)
                sums[block] = np.minimum(sums[block] + new, top).astype(np.uint16) if block in sums else new.astype(np.uint16)
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.astype(np.uint8).tobytes()], pa.binary())], ["block", "counters"])

    return rows.repartition("block").mapInArrow(run, "block int, counters binary")


def sketch(docs: DataFrame, threshold: int) -> np.ndarray:
    """Document counts of all (language, term), too high or right, up to the threshold (255 at most): DEPTH * WIDTH bytes."""
    out = np.zeros((DEPTH * WIDTH // BLOCK, BLOCK), np.uint8)
    for row in merged(sketch_rows(docs, threshold), threshold).toLocalIterator():  # as many blocks as the sketch has
        out[row["block"]] = np.frombuffer(row["counters"], np.uint8)
    return out.ravel()


def survivor_counts(docs: DataFrame, threshold: int) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term that the sketch does not rule out, exact."""
    spark = docs.sparkSession
    counters = spark.sparkContext.broadcast(sketch(docs, threshold))
    least = min(threshold, 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = counters.value, defaultdict(lambda: (Counter(), Counter())), 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (often, inside) in held.items():
                terms = list(often)
                if not terms:
                    continue
                kept = seen[cells_of(lang, terms, DEPTH, WIDTH)].min(axis=1) >= least
                names = [pa.repeat(pa.scalar(x.decode()), int(kept.sum())) for x in (lang, source)]
                term = pa.array([t for t, k in zip(terms, kept.tolist(), strict=True) if k], pa.binary()).cast(pa.string())
                n = np.fromiter(often.values(), np.int64, len(terms))[kept]
                docs = np.fromiter(map(inside.__getitem__, terms), np.int64, len(terms))[kept]
                yield pa.RecordBatch.from_arrays([*names, term, pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).cast(pa.binary()).to_pylist() for i in range(3)), strict=True):
                often, inside = held[lang, source]
                terms = terms_of(text)
                size -= len(often)
                often.update(terms)
                inside.update(set(terms))
                size += len(often)
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    rows = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def exact_share(df: DataFrame, name: str, count: str, total: str, terms: str) -> DataFrame:
    """``df`` with the share 1 + floor(10^9 (count + 5) / (N + 5 V)), null where there are no terms; in decimals, as the product may exceed 64 bits."""
    whole = f"cast(1000000000 as decimal(10,0)) * cast({count} + 5 as decimal(19,0)) div cast(nullif({total} + 5 * {terms}, 0) as decimal(19,0)) + 1"
    return df.withColumn(name, F.expr(whole))


def audit(docs: DataFrame, threshold: int = 30, most: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources of the language, and the terms used more than there.

    ``docs`` has text, lang and source; terms count from ``threshold`` documents of the language on.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = materialize(docs.groupBy("lang", "source").agg(F.count("*").alias("rows")).select("lang", "source"), "audit-groups")
    counts = materialize(survivor_counts(docs, threshold), "audit-counts")
    known = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= threshold).select("lang", "term", "all")
    kept = materialize(counts.select("lang", "source", "term", "n").join(known, ["lang", "term"]), "audit-kept")

    # of languages and groups: V terms, N occurrences, and the base share of a term that does not occur
    langs = kept.groupBy("lang", "term").agg(F.first("all").alias("all")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("total"))
    sizes = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n_kept")), ["lang", "source"], "left").join(langs, "lang", "left")
    sizes = sizes.select("lang", "source", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"))
    sizes = materialize(exact_share(sizes.withColumn("zero", F.lit(0)), "base", "zero", "n_kept", "v").drop("zero"), "audit-sizes")

    shares = exact_share(kept.join(sizes, ["lang", "source"]), "p", "n", "n_kept", "v")
    shares = materialize(exact_share(shares, "q", "all", "total", "v").select("lang", "source", "term", "n", "p", "q", "base"), "audit-shares")
    return pair_rows(sizes, shares).unionByName(term_rows(shares, most))


def pair_rows(sizes: DataFrame, shares: DataFrame) -> DataFrame:
    """The part ``pair``."""
    one = sizes.select("lang", F.col("source").alias("a"), F.col("base").alias("base_a"), "v")
    two = sizes.select("lang", F.col("source").alias("b"), F.col("base").alias("base_b"))
    # the result has a row for each of these pairs
    pairs = one.join(two, "lang").where("a != b")
    # what the terms of a change against the base of b: a share that occurs m times counts m times
    often = shares.groupBy("lang", F.col("source").alias("a"), "p", F.col("base").alias("base_a")).agg(F.count("*").alias("m"))
    alone = often.join(two, "lang").where("a != b").groupBy("lang", "a", "b").agg(F.sum(F.col("m") * (F.abs(F.col("p") - F.col("base_b")) - F.abs(F.col("base_a") - F.col("base_b")))).alias("alone"))
    left, right = (shares.select("lang", "term", F.col("source").alias(x), F.col("p").alias(f"p_{x}"), F.col("base").alias(f"base_{x}")) for x in "ab")
    # terms that both have; each unordered pair once
    change = F.abs(F.col("p_a") - F.col("p_b")) - F.abs(F.col("p_a") - F.col("base_b")) - F.abs(F.col("base_a") - F.col("p_b")) + F.abs(F.col("base_a") - F.col("base_b"))
    both = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(change).alias("both"))
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "both"))
    back = alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("alone").alias("back"))
    zero = F.lit(0)
    every = pairs.join(alone, ["lang", "a", "b"], "left").join(back, ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left")
    value = F.coalesce(F.col("v") * F.abs(F.col("base_a") - F.col("base_b")), zero) + F.coalesce("alone", zero) + F.coalesce("back", zero) + F.coalesce("both", zero)
    out = every.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.cast("long").alias("value"))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def term_rows(shares: DataFrame, most: int) -> DataFrame:
    """The part ``term``: Spark cuts each group down to its first ranks within tasks before it is sorted as a whole."""
    over = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_SHARE = "CAST(1 + (CAST(1000000000 AS HUGEINT) * ({n} + 5)) // nullif({total} + 5 * {v}, 0) AS BIGINT)"
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, {_SHARE.format(n="coalesce(c.n, 0)", total="s.total", v="l.v")} AS p, {_SHARE.format(n="k.n", total="l.total", v="l.v")} AS q
      FROM s JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms)) WHERE part = 'pair' OR rank <= 50
"""
