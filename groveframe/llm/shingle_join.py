"""Exact similarity join of documents on word shingles, by parity sketches.

A document is the set of its five-word shingles (64-bit hashes). Two documents link when their Jaccard similarity reaches
80 %, that is when their sets differ in at most (|A| + |B|) / 9 elements.

Sketches. For a band of set sizes the hash range is cut into blocks; XOR-hashing the shingles of a block gives a word of the
sketch. A differing shingle changes one word, so the number of differing words (the Hamming distance over words) is at most the
size of the symmetric difference. With D the largest difference that a linked pair of the band can have and B > D words, linked
pairs agree in at least B - D words: a join on (band, block, word) finds them all. A second sketch of single bits, at least 512
and at least one for each shingle, bounds the difference likewise and rules out pairs before their sets are fetched. Its length
is a power of two; XOR of its halves is the sketch of half the length, so sketches of neighbouring sizes can be compared.

Classes are named by 64 bits of a hash of their set. Where two sets share a name, which the other 64 bits tell, all but one of
them get another name; that is about one pair for each 2^65 pairs of sets.

Words of empty blocks say nothing and would join everything. B leaves room beyond D + 1: as long as a document has fewer empty
words than B - D, one of its matches is not empty, and its empty words are left out; otherwise they are kept. In the last round a
document also leaves out as many other words as it has empty ones to spare, the most frequent first (a common line alone in its
block), in one order of all words: of the words that two linked documents share, more than either may leave out, both keep the
rarest. None is left out where the empty words are kept, as a partner that leaves out its own shares none of these. Both are exact.

Equal sets are one class, represented by its smallest doc_id, and each task emits a class once, so copies of a text cost no
more than one. Within a join key each class is first paired with the key's first class and the one before it, never with all; a hot
key is dealt to shares for this, whose first classes are then paired in the same way.
Pairs are verified on their full sets; classes already connected need no further pairs; what remains open in any key is then
compared in full. This settles the components, which is what the query and the pipeline ask for; ``all_links`` and
``link_counts`` verify every pair that the sketches leave, inside components too.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; with fewer than five words the whole sequence is one
shingle; null, empty and blank texts have the empty set, link with nothing and are their own component; repeated rows are equal
sets; a null doc_id takes part, a component's id is its smallest non-null doc_id; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hot_keys, in_sample, kept_table, materialize, table, use_only, with_shares
from .components import components

SHINGLE = 5
#: Sizes at which bands begin; a band holds sizes up to half as many again.
BAND_RATIO, BANDS = 1.5, 60
SKETCH_WORDS = 8
#: Classes of a join key that a task pairs at a time where all links are asked for.
COMMON = 24
#: Classes of a join key that a task pairs at a time in the last round.
SHARE = 256
CACHED_WORDS = 150_000
VERIFY_BLOCKS = 2
#: Bits of a number of spare words; the band stands above them.
SPARE_BITS = 40

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing step."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def band_starts() -> list[int]:
    out = [1]
    while len(out) < BANDS:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * BAND_RATIO))))
    return out


STARTS = band_starts()


def differing(low_size: int, high_size: int) -> int:
    """The largest symmetric difference of a linked pair of these set sizes."""
    return (low_size + high_size) // 9


def band_blocks(band: int) -> tuple[int, int]:
    """(D, B) of a band: for pairs whose smaller set lies in it."""
    largest = STARTS[band + 1] - 1
    d = differing(largest, largest * 5 // 4)
    return d, d + 2 + -(-d // 5)


BLOCKS = [band_blocks(b) for b in range(BANDS - 1)]


def bands_of(size: int) -> list[int]:
    """Bands in which a set of this size may be part of a linked pair: its own, and those of its smaller partners."""
    own = int(np.searchsorted(STARTS, size, "right")) - 1
    low = int(np.searchsorted(STARTS, -(-4 * size // 5), "right")) - 1
    return list(range(low, own + 1))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHED_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word, 7)
        return got


_WORDS = kept_table("words", _Words())


#: Odd factors of the words of a shingle, by place.
FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; the words of all texts are hashed and combined in one go."""
    words = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    sizes = [len(w) for w in words]
    hashes = np.fromiter((h for w in words for h in map(_WORDS.__getitem__, w)), np.uint64, sum(sizes))
    out, at = [], 0
    with np.errstate(over="ignore"):
        runs = hashes * np.uint64(FACTORS[0])
        for i in range(1, SHINGLE):
            runs[: len(hashes) - i] += hashes[i:] * np.uint64(FACTORS[i])
        runs = mix(runs)
        for n in sizes:
            if n >= SHINGLE:
                out.append(np.unique(runs[at : at + n - SHINGLE + 1]))
            else:
                short = sum(int(h) * f for h, f in zip(hashes[at : at + n], FACTORS, strict=False)) + n
                out.append(mix(np.array([short & (2**64 - 1)], np.uint64)) if n else np.zeros(0, np.uint64))
            at += n
    return out


def class_key(found: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers."""
    import xxhash

    digest = xxhash.xxh3_128_digest(found.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


class ClassNames:
    """Names of sets: 64 bits of ``key``, or another name for the few sets that share theirs."""

    def __init__(self, key: Callable[[np.ndarray], tuple[int, int]] = class_key):
        self.key, self.renamed = key, {}

    def __call__(self, found: np.ndarray) -> tuple[int, int]:
        c, c2 = self.key(found)
        return self.renamed.get((c, c2), c), c2

    def rename(self, known: DataFrame, shared: DataFrame) -> DataFrame:
        """``known`` (c, c2, ...) with names of their own for all but one of the sets that share a name (c of ``shared``)."""
        found = known.join(shared, "c").select("c", "c2").distinct().collect()  # about n * n / 2^65 of n sets
        first: dict[int, int] = {}
        for c, c2 in sorted(found):
            if first.setdefault(c, c2) != c2:
                self.renamed[c, c2] = int(mix(np.array([(c2 + FACTORS[0]) & (2**64 - 1)], np.uint64)).view(np.int64)[0])
        names = known.sparkSession.createDataFrame([(*k, v) for k, v in self.renamed.items()], "c long, c2 long, _new long")
        return known.join(F.broadcast(names), ["c", "c2"], "left").withColumn("c", F.coalesce("_new", "c")).drop("_new")


def named_classes(rows: DataFrame, names: ClassNames) -> tuple[DataFrame, DataFrame]:
    """The summaries of all rows, and of each class c: doc_id (the smallest), copies, n."""

    def classes_of(known: DataFrame) -> DataFrame:
        grouped = known.where("n_shingles > 0").groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("c2").alias("low"), F.max("c2").alias("high"), F.min("n_shingles").alias("n"))
        return materialize(grouped, "shingle-classes")

    known = materialize(summaries(rows, names), "shingle-summaries")
    classes = classes_of(known)
    shared = classes.where("low != high").select("c")
    if not shared.isEmpty():
        known = materialize(names.rename(known, shared), "shingle-summaries")
        classes = classes_of(known)
        if not classes.where("low != high").isEmpty():
            raise RuntimeError("sets share the second name too")
    return known, classes


def star_rows(rows: DataFrame, names: ClassNames) -> DataFrame:
    """(key, c, first, before): each class of a join key with the first one of the key, or of its share of a hot key, and the one before."""
    hot = hot_keys(key_rows(rows.where(in_sample("doc_id", "text")), names).distinct())

    def ranked(keys: DataFrame, *by: str) -> DataFrame:
        order = W.partitionBy(*by).orderBy("c")
        return keys.withColumn("first", F.first("c").over(order)).withColumn("before", F.lag("c").over(order))

    inner = ranked(with_shares(key_rows(rows, names), hot, "c"), "key", "share").where("c != before or (before is null and share > 0)")
    inner = materialize(inner.select("key", "c", "first", "before"), "shingle-stars")
    heads = ranked(inner.where("before is null").select("key", "c"), "key").where("c != before")  # one of each share of a hot key
    return inner.where("before is not null").unionByName(heads.select("key", "c", "first", "before"))


def band_words(found: np.ndarray, band: int) -> np.ndarray:
    """Join keys of a set in a band; their last six bits hold the band."""
    d, blocks = BLOCKS[band]
    if d == 0:  # only equal sets link
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        block = ((found >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        word, at = np.bitwise_xor.reduceat(mix(found), starts), block[starts]
        empty = blocks - len(at)
        if empty >= blocks - d:
            gone = np.setdiff1d(np.arange(blocks, dtype=np.uint64), at)
            word, at = np.concatenate([word, np.zeros(len(gone), np.uint64)]), np.concatenate([at, gone])
        key = mix(word ^ mix(at * np.uint64(BANDS) + np.uint64(band) + np.uint64(1)))
    return ((key & ~np.uint64(63)) | np.uint64(band)).view(np.int64)


def spare_words(found: np.ndarray, band: int) -> int:
    """How many more words of a set in a band may be left out: none if its empty words are kept, since a partner may have none of these."""
    d, blocks = BLOCKS[band]
    block = ((found >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    used = 1 + int(np.count_nonzero(block[1:] != block[:-1]))
    empty = blocks - used
    return blocks - d - 1 - empty if d and empty < blocks - d else 0


def parity_bits(found: np.ndarray) -> np.ndarray:
    """At least 512 bits and at least one for each shingle, each the parity of the number of shingles that hash to it."""
    bits = max(64 * SKETCH_WORDS, 1 << max(0, len(found) - 1).bit_length())
    bit = (mix(found) >> np.uint64(20)) & np.uint64(bits - 1)
    odd = (np.bincount(bit.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def shortened(sketch: np.ndarray) -> np.ndarray:
    """The sketch of SKETCH_WORDS words that belongs to a longer one."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, SKETCH_WORDS), axis=0)


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else [], kind))


def summaries(docs: DataFrame, names: ClassNames) -> DataFrame:
    """doc_id, n_shingles, c and c2 (the class), both sketches, and for each band how many words may be left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_only("words")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingle_sets(part.column(1).to_pylist())
                keys = [names(s) if len(s) else (None, None) for s in sets]
                wide = [parity_bits(s) for s in sets]
                slack = [np.array([b << SPARE_BITS | max(0, spare_words(s, b)) for b in bands_of(len(s))] if len(s) else [], np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), lists([shortened(w) for w in wide], pa.int64()), lists(wide, pa.int64()), lists(slack, pa.int64())],
                    ["doc_id", "n_shingles", "c", "c2", "sketch", "wide", "slack"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, c long, c2 long, sketch array<long>, wide array<long>, slack array<long>")


def key_rows(docs: DataFrame, names: ClassNames) -> DataFrame:
    """(key, c): the join keys of each class, at least once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_only("words")
        done: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                owners, keys = [], []
                for found in shingle_sets(batch.column(1).slice(at, 512).to_pylist()):
                    if len(found) and (c := names(found)[0]) not in done:
                        done.add(c)
                        own = np.concatenate([band_words(found, b) for b in bands_of(len(found))])
                        owners.append(np.full(len(own), c, np.int64))
                        keys.append(own)
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], ["key", "c"])

    return docs.mapInArrow(run, "key long, c long")


def class_sets(docs: DataFrame, wanted: DataFrame, names: ClassNames) -> DataFrame:
    """(c, s): the sets of the wanted classes (c, doc_id). Classes of rows without an id are found by their name."""

    def sets(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    found = [(c, names(s)[0], s) for c, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist()), strict=True) if len(s)]
                    found = [(own, s) for c, own, s in found if c in (None, own)]  # other rows may share the doc_id
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), lists([s.view(np.int64) for _, s in found], pa.int64())], ["c", "s"])

        return rows.mapInArrow(run, "c long, s array<long>")

    out = sets(docs.join(wanted.where("doc_id is not null"), "doc_id").select("c", "text"))
    nameless = wanted.where("doc_id is null").select("c")
    if nameless.isEmpty():
        return out
    found = sets(docs.where("doc_id is null").select(F.lit(None).cast("long").alias("c"), "text")).join(nameless, "c", "left_semi")
    return out.unionByName(found.groupBy("c").agg(F.first("s").alias("s")))


def plausible(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs (a, b) that the bounds on sizes and long sketches do not rule out."""
    one, two = (facts.select(F.col("c").alias(k), F.col("n").alias("n" + k), F.col("wide").alias("s" + k)) for k in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").where(within_bounds("na", "nb", folded("sa", "sb"), folded("sb", "sa"))).select(*pairs.columns)


def folded(sketch: str, other: str):
    """``sketch`` at the length of ``other`` where it is twice as long; beyond that the sizes alone rule a pair out."""
    half = F.floor(F.size(sketch) / 2).cast("int")
    return F.when(F.size(sketch) > F.size(other), F.zip_with(F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(sketch))


def within_bounds(n1: str, n2: str, sketch1, sketch2):
    differ = F.aggregate(F.zip_with(sketch1, sketch2, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (5 * F.least(n1, n2) >= 4 * F.greatest(n1, n2)) & (9 * differ <= F.col(n1) + F.col(n2))


def sets_of(rows: DataFrame, pairs: DataFrame, classes: DataFrame, names: ClassNames) -> DataFrame:
    """The sets of all classes in the pairs (a, b), written once."""
    members = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    wanted = materialize(members.join(classes.select("c", "doc_id"), "c"), "shingle-members")
    return materialize(class_sets(rows, wanted, names), "shingle-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity, in VERIFY_BLOCKS shares of the pairs one after another.

    A pair carries a whole set through a shuffle, so the shares divide the disk this takes at any one time.
    """
    share, out = F.pmod(F.xxhash64("b", "a"), F.lit(VERIFY_BLOCKS)), None
    for k in range(VERIFY_BLOCKS):
        part = materialize(similar(pairs.where(share == k), sets), "shingle-verified")
        out = part if out is None else out.unionByName(part)
    return out


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("c").alias("a"), F.col("s").alias("sa"))
    two = sets.select(F.col("c").alias("b"), F.col("s").alias("sb"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.where("100 * common >= 80 * (n - common)").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Callable[[np.ndarray], tuple[int, int]] = class_key) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id) of every row, and the links (a, b) between classes that were verified on the way."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ClassNames(key)
    known, classes = named_classes(rows, names)
    stars = star_rows(rows, names)

    facts = materialize(known.where("n_shingles > 0").groupBy("c").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide")), "shingle-facts")
    partners = stars.select("c", F.explode(F.array_distinct(F.array("first", "before"))).alias("a")).groupBy("a", "c").agg(F.count("*").alias("shared"))
    partners = materialize(plausible(partners.select("a", F.col("c").alias("b"), "shared"), facts), "shingle-partners")

    sets = sets_of(rows, partners, classes, names)

    # first the most promising partner of each class
    best = partners.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a").cast("decimal(20,0)"))).alias("a")).select("a", "b")
    links = materialize(verified(materialize(best, "shingle-best"), sets), "shingle-links")

    # then first and previous partners that are not yet connected
    found = components(links)
    open_pairs = with_roots(partners.select("a", "b"), found).where("ra != rb")
    links = materialize(links.unionByName(verified(materialize(open_pairs, "shingle-open"), sets)).distinct(), "shingle-links")

    # last, all pairs of a key that are still in different components
    found = components(links)
    left = materialize(remaining_pairs(stars, known, facts, found), "shingle-remaining")
    links = materialize(links.unionByName(verified(left, sets_of(rows, left, classes, names))).distinct(), "shingle-links")

    roots = components(links)
    named = roots.join(classes.select(F.col("c").alias("node"), "doc_id"), "node")
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = named.select("node", "root").join(lowest, "root").select(F.col("node").alias("c"), "component_id")
    copied = classes.where("copies > 1").join(linked, "c", "left_anti").select("c", F.col("doc_id").alias("component_id"))
    final = materialize(linked.unionByName(copied), "shingle-components")
    out = known.select("doc_id", "n_shingles", "c").join(final, "c", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out, links


def with_roots(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, ra, rb): the components of both ends; a class without links is its own."""
    one, two = found.select(F.col("node").alias("a"), F.col("root").alias("ra")), found.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return pairs.join(one, "a", "left").join(two, "b", "left").select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))


def kept_words(live: DataFrame, known: DataFrame) -> DataFrame:
    """(key, c, root) of ``live`` (and the size of each key) without the most frequent words of each class in a band, as many as it may leave out."""
    spare = known.where("n_shingles > 0").select("c", F.explode("slack").alias("x")).distinct().select("c", F.shiftright("x", SPARE_BITS).alias("band"), F.col("x").bitwiseAND(F.lit((1 << SPARE_BITS) - 1)).alias("spare"))
    order = W.partitionBy("c", "band").orderBy(F.desc("size"), "key")
    ranked = live.withColumn("band", F.col("key").bitwiseAND(F.lit(63))).join(spare, ["c", "band"]).withColumn("nth", F.row_number().over(order))
    return ranked.where("nth > spare").select("key", "c", "root")


def remaining_pairs(stars: DataFrame, known: DataFrame, facts: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of classes that share a join key, lie in different components, and pass the bounds on sizes and sketches."""
    rows = stars.select("key", "c").unionByName(stars.select("key", F.col("first").alias("c"))).distinct()
    rooted = rows.join(found.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    state = rooted.groupBy("key").agg(F.count("*").alias("size"), (F.min("root") != F.max("root")).alias("open"))
    kept = materialize(kept_words(rooted.join(state.where("open"), "key"), known), "shingle-kept")  # two plans read it
    # in each key one root is the most frequent: every pair of two roots has a class outside it, so only these go to all shares
    counted = kept.groupBy("key", "root").agg(F.count("*").alias("n_root"))
    sizes = counted.groupBy("key").agg(F.max_by("root", F.struct("n_root", "root")).alias("major"), F.ceil(F.sum("n_root") / SHARE).alias("shares"))
    full = kept.join(sizes, "key").join(facts.select("c", "n", "sketch"), "c")
    names = ("c", "root", "n", "sketch")
    one = full.where("root != major").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), *(F.col(x).alias(x + "1") for x in names))
    two = full.select("key", F.pmod(F.xxhash64("c"), F.col("shares")).alias("share"), *(F.col(x).alias(x + "2") for x in names))
    close = (F.col("root1") != F.col("root2")) & within_bounds("n1", "n2", "sketch1", "sketch2")
    pairs = one.join(two, ["key", "share"]).where(close).select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).distinct()
    return plausible(pairs, facts)  # long sketches meet each pair once, not each key


def all_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Callable[[np.ndarray], tuple[int, int]] = class_key) -> tuple[DataFrame, DataFrame]:
    """The classes (c, doc_id, copies, n) and every link (a, b), a < b, between two of them, inside components too.

    All pairs of a join key that the bounds leave are verified; no word is left out. A key of over COMMON classes is dealt to as
    many shares as it holds times COMMON: one side goes to its share, the other to all. Copies are linked by being one class.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ClassNames(key)
    known, classes = named_classes(rows, names)
    facts = materialize(known.where("n_shingles > 0").groupBy("c").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide")), "shingle-facts")
    classes = classes.select("c", "doc_id", "copies", "n")
    keys = materialize(key_rows(rows, names).distinct(), "shingle-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    full = keys.join(sizes, "key").withColumn("shares", F.ceil(F.col("size") / COMMON)).join(facts.select("c", "n", "sketch"), "c")
    one = full.select("key", F.pmod(F.xxhash64("c"), F.col("shares")).alias("share"), F.col("c").alias("c1"), F.col("n").alias("n1"), F.col("sketch").alias("sketch1"))
    two = full.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2"))
    close = (F.col("c1") < F.col("c2")) & within_bounds("n1", "n2", "sketch1", "sketch2")
    pairs = one.join(two, ["key", "share"]).where(close).select(F.col("c1").alias("a"), F.col("c2").alias("b")).distinct()
    pairs = materialize(plausible(pairs, facts.select("c", "n", "wide")), "shingle-pairs")
    return classes, verified(pairs, sets_of(rows, pairs, classes, names))


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(c, doc_id, copies, n_links) of every class: how many other rows each of its rows links with, copies among them."""
    classes, links = all_links(docs, id_col, text_col)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(classes.select(F.col("c").alias("b"), "copies"), "b").groupBy(F.col("a").alias("c")).agg(F.sum("copies").alias("near"))
    return classes.join(near, "c", "left").select("c", "doc_id", "copies", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))[0]
