"""The training-data operators against brute force, on the smallest tables and on small made-up ones."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from groveframe.llm import attention_model, common, decontaminate, fingerprints, language_model, languages, mixing, passages, quality, shingle_join, spelling, token_files, warc
from groveframe.llm.common import materialize, one_task_each, scratch
from groveframe.llm.subwords import ByteLevelEncoder

from ..conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, fingerprint int"
BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def words(n: int, seed: int = 1) -> list[str]:
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, equal ids, columns with clashing names."""
    long = " ".join(words(3000))
    rows = [
        (1, "Hello big wide world of trees.", "en", "a", 30, "x", 1), (2, None, None, None, None, None, None), (3, "", "en", "a", 0, "", 0), (4, " \t\n ", "de", "b", 4, "", 0),
        (5, long, "en", "a", 1, "", 0), (6, long, "en", "a", 1, "", 0), (7, "straße ÄÖ  <|endoftext|> ^x ^", "de", "b", 9, "", 0), (7, "straße ÄÖ  <|endoftext|> ^x ^", "de", "b", 9, "", 0),
        (None, "no id at all here, friend", "en", None, 5, "", 0), (8, "12345 !!! 🌲🌲", "fr", "c", 3, "", 0), (9, "one two three", "en", "c", 3, "", 0),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def canon(text: str) -> str:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return re.sub(r"\s+", " ", folded).strip()


def test_fingerprints_brute_force(documents):
    got = {r.doc_id: r for r in fingerprints.fingerprints(documents).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in documents.collect()), reverse=True)
    by_form = {}
    for i, (key, text) in enumerate(rows):
        following, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        edited, r = text[: len(text) - half] + following[:half], got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(canon(edited) == canon(text)), float(canon(following) == canon(text)))
        assert by_form.setdefault(canon(text), r.fingerprint) == r.fingerprint
    assert len(set(by_form.values())) == len(by_form)


def test_fingerprints_compare_bytes_in_equal_digests(spark):
    docs = spark.createDataFrame([(1, "b"), (2, "a"), (3, "A "), (4, "c")], "doc_id long, text string")
    weak = lambda c: F.lit("same")
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs, digest=weak).collect()}
    assert got == {1: "same-1", 2: "same", 3: "same", 4: "same-2"}
    groups = {(r.fingerprint, r.first_id, r.n_docs) for r in fingerprints.exact_groups(docs, digest=weak).collect()}
    assert groups == {("same", 2, 2), ("same-1", 1, 1), ("same-2", 4, 1)}


def test_fingerprints_odd_rows(odd, none):
    got = fingerprints.fingerprints(odd).collect()
    assert len(got) == 11 and len({r.fingerprint for r in got if r.doc_id in (2, 3, 4)}) == 1
    assert fingerprints.fingerprints(none).count() == 0
    one = fingerprints.fingerprints(odd.where("doc_id = 1")).first()
    assert one.near_next == 1.0


def test_canonical_forms(spark):
    texts = ["Ａbc　def", "ſtraße", "été", "ﬁn    x", "İ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.c for r in df.select("i", fingerprints.canonical(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [canon(t) for t in texts]


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    texts = ["", " a", "Hello, world.\nNew line.. it's", "a  b", "tab\there", "^caret ^x", "x <|endoftext|> y", "ÄÖ äö, 日本。", "don't, stop.,", "a.b,c 12.5, end", "...", ", ,"]
    expected = [Tokenizer.from_file(BPE).encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in ByteLevelEncoder(BPE).encode(texts)] == expected


@pytest.mark.parametrize("table", ["documents", "odd", "none"])
def test_token_files(spark, request, table):
    from tokenizers import Tokenizer

    docs, encode = request.getfixturevalue(table), Tokenizer.from_file(BPE)
    got = sorted(token_files.token_rows(docs).collect(), key=lambda r: r.start)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()), key=lambda x: x[:2])
    start = 0
    for r, (known, key, text) in zip(got, rows, strict=True):
        ids = np.array([*encode.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key if known else None, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_files_are_read_in_a_task_each(spark):
    """Of 40 files none shares a task with more than one other; ranges are cut from a sample of the few rows, so most stand alone."""
    files = spark.range(40).select(F.format_string("file-%03d", "id").alias("path"), F.lit(1).cast("long").alias("n_tokens"), F.col("id").cast("int").alias("part"))
    dealt = one_task_each(files, "path").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(dealt) == 40 and max(r["count"] for r in dealt) == 1


def test_token_file_reader_fetches_only_asked_frames(tmp_path, monkeypatch):
    import zstandard

    monkeypatch.setattr(token_files, "FRAME_TOKENS", 5)
    uri = f"file://{tmp_path}/x.ztok"
    writer = token_files.TokenFileWriter(uri, 2)
    for k in range(10):
        writer.add(k, np.arange(k, k + 3, dtype="<u2").tobytes())
    writer.close()
    reader = token_files.TokenFileReader(uri)
    assert len(reader.frames) == 5
    opened = []
    frame = reader.frame
    reader.frame = lambda i: opened.append(i) or frame(i)
    assert {k: ids.tolist() for k, ids in reader.documents({3, 8})} == {3: [3, 4, 5], 8: [8, 9, 10]}
    assert opened == [1, 4]
    plain = b"".join(zstandard.ZstdDecompressor().stream_reader(open(tmp_path / "x.ztok", "rb"), read_across_frames=True).read() for _ in range(1))
    assert len(plain) == sum(f[1] for f in reader.frames)  # skippable frames are skipped by any reader
    data = bytearray((tmp_path / "x.ztok").read_bytes())
    data[reader.offsets[0] + reader.frames[0][0] - 1] ^= 1
    (tmp_path / "y.ztok").write_bytes(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.TokenFileReader(f"file://{tmp_path}/y.ztok").frame(0))


def test_quality_learns(spark, documents, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.score(quality.features(documents), quality.learn(quality.features(documents), labels)).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    right = [(got[k].score >= 0.7) == (q == 1) for k, q in truth.items()]
    assert len(got) == documents.count() and np.mean(right) > 0.9
    model = quality.learn(quality.features(odd), labels.limit(0))
    assert {round(r.score, 6) for r in quality.score(quality.features(odd), model).collect()} == {0.5}
    assert quality.score(quality.features(none), model).count() == 0


def test_quality_scores_are_naive_sums_of_look_ups(documents, odd):
    """Scores of whole tables against one look-up at a time, and held-out labels only; ties on a bin's edge belong to the upper bin."""
    labels = documents.sparkSession.read.parquet(f"{SF}/labels.parquet")
    described = quality.features(documents)
    model = quality.learn(described, labels)
    x = {r.doc_id: r.x for r in described.collect()}
    got = {r.doc_id: r.score for r in quality.score(described, model).collect()}

    def place(cuts, value):
        return sum(bool(value >= c) for c in cuts)

    for k, row in x.items():
        total = model.intercept + sum(t[place(c, v)] for c, t, v in zip(model.cuts, model.tables, row, strict=True))
        total += sum(t[place(model.coarse[i], row[i]), place(model.coarse[j], row[j])] for i, j, t in model.pairs)
        assert abs(got[k] - 1 / (1 + math.exp(-total))) < 1e-9
    held = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert len(held) > 10 and np.mean([(got[k] >= 0.7) == (q == 1) for k, q in held.items()]) > 0.85


def test_quality_of_repeated_labels_and_rows(spark, odd):
    """Labels that repeat or contradict count as rows each; equal rows get equal scores; labels that are null or no 0 or 1 go."""
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (5, 0), (6, 0), (7, 1), (9, 5), (None, 1), (8, None)], "doc_id long, quality int")
    model = quality.learn(quality.features(odd), labels, folds=1, held_out=9)
    got = quality.score(quality.features(odd), model).collect()
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(round(r.score, 9))
    assert len(got) == 11 and len(by_id[7]) == 1 and by_id[5] == by_id[6] and by_id[2] == by_id[3] and all(0 <= v <= 1 for vs in by_id.values() for v in vs)


def test_quality_finds_interactions():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((quality.fit(x[:3000], y[:3000]).score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


@pytest.mark.parametrize("table", ["documents", "odd", "none"])
def test_shingle_join_brute_force(request, table):
    docs = request.getfixturevalue(table)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id) for r in shingle_join.near_duplicates(docs)[0].collect())
    assert got == sorted(brute_components([(r.doc_id, r.text) for r in docs.collect()]))


def test_shingle_join_on_groups_of_near_copies(spark):
    """Chains of edits, subsets, short texts around the threshold, a line that all share."""
    rng, rows, base = np.random.default_rng(3), [], words(120, 5)
    for i in range(60):
        text = list(base)
        for at in rng.integers(0, 120, i % 6):
            text[at] = f"edit{rng.integers(9)}"
        rows.append((i, " ".join(text)))
    for i in range(60, 100):
        rows.append((i, " ".join(words(int(rng.integers(1, 14)), int(rng.integers(6))))))
    line = words(12, 9)
    for i in range(100, 160):
        rows.append((i, " ".join(words(40, i) + line)))
    for i in range(160, 180):
        rows.append((i, " ".join(base[: 120 - 2 * (i - 160)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((True, r.doc_id, r.n_shingles, r.component_id) for r in shingle_join.near_duplicates(docs)[0].collect())
    assert got == sorted(brute_components(rows))


def joined(docs, **more):
    """Sorted rows; a component of rows without ids has none."""
    return sorted(((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id) for r in shingle_join.near_duplicates(docs, **more)[0].collect()), key=str)


def copies_and_edits(n=60, null_every=7):
    """Groups of copies and edits, a line that all share, ids that are null now and then."""
    rng, base, line, rows = np.random.default_rng(8), [words(60, k) for k in range(6)], words(14, 99), []
    for i in range(n):
        text = list(base[i % 6])
        if i % 3:
            text[int(rng.integers(60))] = f"edit{i}"
        rows.append((None if i % null_every == 0 else i, " ".join(text + line * (i % 2))))
    return rows


def test_shingle_join_when_sets_share_a_name(spark):
    """Names of two bits: nearly all sets share one, and get names of their own."""
    rows = copies_and_edits()
    short = lambda found: (shingle_join.class_key(found)[0] & 3, shingle_join.class_key(found)[1])
    assert joined(spark.createDataFrame(rows, "doc_id long, text string"), key=short) == sorted(brute_components(rows), key=str)


def test_shingle_join_deals_hot_keys(spark, monkeypatch):
    rows = copies_and_edits(90)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(shingle_join, "in_sample", lambda *columns: F.lit(True))
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "HOT_SHARES", 5)
    names = shingle_join.ClassNames()
    stars = shingle_join.star_rows(docs, names).select("key", "c", "first").collect()
    held = defaultdict(set)
    for r in shingle_join.key_rows(docs, names).distinct().collect():
        held[r.key].add(r.c)
    linked = defaultdict(set)
    for r in stars:
        linked[r.key] |= {r.c, r.first}
    assert {k: v for k, v in held.items() if len(v) > 1} == dict(linked)  # every class of a key hangs on another one
    assert joined(docs) == sorted(brute_components(rows), key=str)


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [(k is not None, k or 0, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)]


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
        b = np.union1d(a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, 20).astype(np.uint64))
        odd_bits = sum(bin(int(x) & (2**64 - 1)).count("1") for x in shingle_join.parity_bits(a) ^ shingle_join.parity_bits(b))
        assert odd_bits <= len(np.setxor1d(a, b))


def test_all_links_brute_force(spark):
    """Every link inside the groups of near copies, copies counted, and a short template whose only shared key is common."""
    base, rng = words(90, 51), np.random.default_rng(5)
    texts = [" ".join(f"new{i}-{j}" if rng.random() < 0.02 else w for j, w in enumerate(base)) for i in range(15)]
    texts += [" ".join([*base, f"end{i}"]) for i in range(15)] + [" ".join(base)] * 3 + [" ".join(base[:-6])]
    texts += [" ".join(words(8, 52))] + [" ".join([*words(8, 52), f"x{i}"]) for i in range(40)] + ["", None]
    sets = shingle_join.shingle_sets(texts)
    near = [[j for j in range(len(texts)) if j != i and len(sets[i]) and len(sets[j]) and 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))] for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes, links = shingle_join.all_links(docs)
    owner = {r.c: r.doc_id for r in classes.collect()}
    got = {frozenset((owner[r.a], owner[r.b])) for r in links.collect()}
    firsts = set(owner.values())
    assert got == {frozenset((i, j)) for i in firsts for j in near[i] if j in firsts}
    assert len(got) > len(firsts) + 40
    assert {r.doc_id: r.n_links for r in shingle_join.link_counts(docs).collect()} == {i: len(near[i]) for i in firsts}


def test_sketch_halves_fold_to_the_shorter_sketch(monkeypatch):
    found = np.unique(np.random.default_rng(3).integers(0, 2**63, 5_000).astype(np.uint64))
    wide = shingle_join.parity_bits(found)
    assert len(wide) == 128
    monkeypatch.setattr(shingle_join, "SKETCH_WORDS", 64)
    assert np.array_equal(wide[:64] ^ wide[64:], shingle_join.shortened(wide))
    monkeypatch.setattr(shingle_join, "SKETCH_WORDS", 256)
    longer = shingle_join.parity_bits(found)
    assert np.array_equal(longer[:128] ^ longer[128:], wide)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(words(30, 21))), (2, " ".join(words(25, 22))), (3, None), (4, "tiny item"), (None, " ".join(words(20, 23)))], "item_id long, text string")


def test_decontamination(spark, items, none, odd):
    one, two, three = words(30, 21), words(25, 22), words(20, 23)
    edited = [w if i % 6 else "changed" for i, w in enumerate(one)]
    rows = [(i, " ".join(words(80, 100 + i))) for i in range(40)]
    rows += [(100, " ".join(words(50, 1) + one + words(9, 2))), (101, " ".join(words(5, 3) + edited)), (102, " ".join(two[:6] + words(60, 4))), (103, " ".join(w.upper() + "!" for w in two)), (104, " ".join(three)), (105, "a tiny item here")]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(100, 1), (101, 1), (103, 2), (104, None), (105, 4)}
    assert {(r.start_word, r.end_word, r.score) for r in got if r.doc_id == 100} == {(50, 80, 1.0)}
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0


@pytest.mark.parametrize("verbatim", [0, 1])
def test_decontamination_of_passages_that_many_documents_hold(spark, items, verbatim):
    """Every fourth word replaced, in 100 documents, with and without a whole copy; one more holds a seed of the item elsewhere too."""
    one, other = words(30, 21), words(120, 5)
    edited = [w if i % 4 != 3 else f"new{i}" for i, w in enumerate(one)]
    rows = [(i, " ".join(words(40, 200 + i) + edited + words(9, 400 + i))) for i in range(100)]
    rows += [(100, " ".join(one[6:9] + other + edited + words(200, 6)))] + [(101, " ".join(one))] * verbatim
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, 1) for i in range(101 + verbatim)}
    assert {(r.start_word, r.end_word) for r in got if r.doc_id < 100} == {(40, 70)}


def test_decontamination_of_whole_tables(documents):
    """Every document against every item by full alignment; what no seed leads to is no passage of half an item."""
    items = [(r.item_id, decontaminate.words_of(r.text)) for r in documents.sparkSession.read.parquet(f"{SF}/benchmark.parquet").collect()]
    block = decontaminate.ItemBlock(items)
    want = set()
    for r in documents.collect():
        coded = block.encode(r.text)
        for (k, _), item in zip(items, block.coded, strict=True):
            if np.isin(item, coded).mean() >= decontaminate.THRESHOLD and decontaminate.align(item, coded)[0] >= decontaminate.THRESHOLD:
                want.add((r.doc_id, k))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents, documents.sparkSession.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert got == want and len(want) >= 3


def test_decontamination_of_very_long_items():
    """Numbers of n-grams stay apart in a vocabulary of any size."""
    block = decontaminate.ItemBlock([(1, ["a", "b", "c", "d", "e", "f", "g", "h"])])
    block.base = 3_000_000
    coded = np.array([2_999_999, 2_999_998, 2_999_997, 5, 1, 2_999_999])
    got = block.grams(coded, 3)
    assert len(set(got.tolist())) == len(got) and (got >= 0).all() and block.grams(np.array([1, 0, 2, 3]), 3).tolist() == [-1, -1]


def test_decontamination_brute_force():
    """Long documents of few words, so that most seeds are common: the windows lose no alignment that holds a seed."""
    rng = np.random.default_rng(8)
    vocabulary = np.array([f"w{i}" for i in range(60)])
    found = 0
    for _ in range(40):
        item = rng.choice(vocabulary, rng.integers(8, 20))
        held = [w for w in item if rng.random() > 0.15] if rng.random() < 0.7 else []
        text = " ".join([*rng.choice(vocabulary, rng.integers(0, 150)), *held, *rng.choice(vocabulary, rng.integers(3, 150))])
        block = decontaminate.ItemBlock([(1, item.tolist())])
        score = decontaminate.align(block.coded[0], block.encode(text))[0]
        if len(block.hits(block.encode(text), block.seeds)[0]):
            got = block.matches(text, 0.5)
            assert [m[1] for m in got] == [score] * (score >= 0.5)
            found += score >= 0.5
    assert found > 10


def test_alignment_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == h.max() / (2 * len(a))


def test_mixing(spark, none):
    rows = [(i, "w " * 10, "big" if i < 800 else f"s{i % 4}" if i < 1000 else None) for i in range(1010)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, max_repeats=2.0).toPandas()
    assert len(got) == 1010 and got.copies.min() >= 1
    assert math.isclose(got.groupby("source", dropna=False).weight.first().sum(), 1)
    assert math.isclose(got.passes.max() / got.passes.min(), 2.0, rel_tol=1e-6)
    spent = (got.copies * got.n_tokens).groupby(got.source.fillna("-")).sum()
    for s, part in got.groupby(got.source.fillna("-")):
        assert abs(spent[s] - part.passes.iloc[0] * part.n_tokens.sum()) <= 10
        assert sorted(part.place.round(9)) == sorted(np.round(np.arange(len(part)) / len(part), 9))
    shares = {s: p.weight.iloc[0] for s, p in mixing.mix(docs, target_entropy=1.5).toPandas().groupby(got.source.fillna("-"))}
    assert math.isclose(-sum(w * math.log(w) for w in shares.values()), 1.5, rel_tol=1e-6)
    half = mixing.mix(docs, budget=5000.0).toPandas()
    assert abs((half.copies * half.n_tokens).sum() - 5000) <= 60
    assert mixing.mix(none).count() == 0


def test_mixing_replayed(documents, monkeypatch):
    """The permutation of each source, replayed document by document: blocks in hash order, documents in hash order, tokens spent one by one."""
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 1_000)
    docs = documents.select("doc_id", "text", "source")
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    n = {r.doc_id: len(re.findall(r"\S+", r.text or "")) for r in docs.collect()}
    blocks = {s: min(mixing.MOST_BLOCKS, math.ceil(max(1, sum(n[k] for k in got if got[k].source == s) / 1_000))) for s in {r.source for r in got.values()}}
    sized = docs.select("doc_id", "text", "source", F.create_map(*[F.lit(v) for kv in blocks.items() for v in kv])[F.col("source")].alias("b"))
    sized = sized.withColumn("block", mixing.block_of(1, F.col("b")))
    hashes = sized.select("doc_id", "source", "block", F.xxhash64(F.lit(3), "source", "block").alias("h1"), F.xxhash64(F.lit(4), "doc_id", "text").alias("h2")).collect()
    assert max(blocks.values()) > 2
    for source in blocks:
        own = sorted((r.h1, r.block, r.h2, r.doc_id) for r in hashes if r.source == source)
        total, spent = sum(n[r[3]] for r in own), 0
        for *_, k in own:
            r = got[k]
            assert r.n_tokens == n[k] and math.isclose(r.place, spent / total, abs_tol=1e-12)
            whole = math.floor(r.passes)
            assert r.copies == whole + ((r.passes - whole) * total > spent and n[k] > 0)
            spent += n[k]


def test_mixing_of_rows_without_ids(spark):
    """Null ids and equal rows are dealt over blocks by their text, and each is kept."""
    rows = [(None, " ".join(words(20, i % 40)), "a") for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_repeats=None, target_entropy=0.0)
    assert got.count() == 200 and got.agg(F.min("copies")).first()[0] == 1


def test_mixing_odd_rows(odd):
    got = mixing.mix(odd).collect()
    assert len(got) == 11 and min(r.copies for r in got) == 1


@pytest.mark.parametrize("least", [0, 3])
def test_warc(spark, least):
    rows = [(5, "http://a/x y", "<p>same</p>"), (3, None, "<p>same</p>"), (4, "u", ""), (9, "u", None), (7, "v", "ünïcode"), (None, "w", "<p>same</p>"), (3, None, "<p>same</p>")] + [(20 + i, "z", "filler " * i) for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(pages, scratch(spark, "warc"), least)).collect()
    first = {}
    for key, _, html in rows:
        if key is not None:
            first[html or ""] = min(key, first.get(html or "", key))
    expected = []
    for key, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= least and first.get(html or "") not in (None, key)
        expected.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[html or ""] if revisit else None))
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(expected, key=order)
    assert warc.read_archives(warc.write_archives(pages.limit(0), scratch(spark, "warc"))).count() == 0


def made_sequence(rng, lengths):
    n = int(np.sum(lengths))
    return attention_model.Sequence(rng.integers(0, attention_model.INPUTS, n), rng.integers(0, 9, n), rng.integers(0, attention_model.GROUPS, n), np.array(lengths))


def test_attention_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) + 0.01 * (k == "U") * rng.standard_normal(v.shape) for k, v in attention_model.init().items()}
    seq, w = made_sequence(rng, [70, 1, 99]), attention_model.windows(np.array([70, 1, 99]))
    assert sorted(w.at[w.take].tolist()) == list(range(170))  # each place once
    prior = rng.random((170, attention_model.GROUPS)) + 0.1
    here = w.at[w.take]
    call = lambda: attention_model.gradients(p, seq.ids[w.at], w.take, prior[here], seq.groups[here])
    g = call()[1]
    for k in p:
        at = tuple(np.unravel_index(np.abs(g[k]).argmax(), g[k].shape))
        sides = []
        for e in (1e-5, -2e-5):
            p[k][at] += e
            sides.append(call()[0])
        p[k][at] += 1e-5
        assert abs((sides[0] - sides[1]) / 2e-5 - g[k][at]) < 1e-4


def test_places_of_context_get_keys_and_values_alone():
    """Windows after the first of a text have their hidden states from their first new place on, the same as from all places."""
    rng, m = np.random.default_rng(4), attention_model
    p, skip, ids = m.init(), m.WINDOW - m.STRIDE, rng.integers(0, m.INPUTS, (5, m.WINDOW))
    later, whole = (m.body(p, m.joined(p), ids, k, m.Buffers())[0] for k in (skip, 0))
    assert later.shape[1] == m.STRIDE and np.allclose(later, whole[:, skip:], atol=1e-5)
    take = m.windows(np.array([70, 1, 99])).take
    kinds = list(m.blocks(take, 2))
    assert sorted(i for some, _ in kinds for i in some) == list(range(len(take)))
    assert {i for some, skip in kinds for i in some if not skip} == {0, 4, 5}


def test_gradients_do_not_depend_on_blocks(monkeypatch):
    rng, m = np.random.default_rng(5), attention_model
    seq, w = made_sequence(rng, [70, 1, 99, 30]), m.windows(np.array([70, 1, 99, 30]))
    here = w.at[w.take]
    p, prior = {k: v + 0.01 * (k == "U") for k, v in m.init().items()}, (rng.random((200, m.GROUPS)) + 0.1).astype(np.float32)
    (loss, g), new = m.gradients(p, seq.ids[w.at], w.take, prior[here], seq.groups[here]), m.Buffers()
    for at_once in (256, 3, 256):
        monkeypatch.setattr(m, "AT_ONCE", at_once)
        again, h = m.gradients(p, seq.ids[w.at], w.take, lambda i: prior[here[i]], seq.groups[here], new)
        assert abs(again - loss) < 1e-5 and all(np.allclose(h[k], g[k], atol=1e-5) for k in g)


def test_sums_by_id_are_plain_sums():
    rng = np.random.default_rng(3)
    ids, rows = rng.integers(0, 9, 50), rng.random((50, 4))
    expected = [sum((row for i, row in zip(ids, rows, strict=True) if i == k), np.zeros(4)) for k in range(12)]
    assert np.allclose(attention_model.sums_by_id(ids, rows, 12), expected)


def naive_log_prob(p, ids, prior, group):
    """The last of some ids, one number at a time: attention over all of them, no windows or buffers."""
    x = [p["E"][i] + p["P"][k] for k, i in enumerate(ids)]
    weights = [math.exp(float((x[-1] @ p["Q"]) @ (z @ p["K"]))) for z in x]
    h = x[-1] + sum(w * (z @ p["V"]) for w, z in zip(weights, x, strict=True)) / sum(weights)
    h = h + np.maximum(h @ p["W1"] + p["b1"], 0) @ p["W2"]
    e = np.exp(h @ p["U"]) * prior
    return math.log(e[group] / e.sum())


def test_attention_scores_brute_force():
    rng = np.random.default_rng(1)
    p = attention_model.init()
    p["U"] = rng.standard_normal(p["U"].shape).astype(np.float32)
    lengths = [1, 5, attention_model.WINDOW, attention_model.WINDOW + 1, 3 * attention_model.WINDOW]
    seq, prior = made_sequence(rng, lengths), (rng.random((9, attention_model.GROUPS)) + 0.01).astype(np.float32)
    got, at = attention_model.score_texts(p, seq, prior), 0
    for n, value in zip(lengths, got, strict=True):
        total = 0.0
        for i in range(n):
            # the window that counts place i: the first one, or that in which i is among its last STRIDE places
            k = 0 if i < attention_model.WINDOW else -(-(i + 1 - attention_model.WINDOW) // attention_model.STRIDE)
            ids = seq.ids[at + k * attention_model.STRIDE : at + i + 1]
            total += naive_log_prob(p, ids, prior[seq.contexts[at + i]], seq.groups[at + i])
        assert abs(total - value) < 1e-3 * n
        at += n


def test_words_encode_as_one_text():
    known = spelling.Speller(RANKS)
    odd_words = ["the", "don't", "'t", "12,5", "straße", "\u00a0x", "x\u00a0", "\u2003", "🌲🌲", "<|endoftext|>", "a" * 5000, "日本語", "$$$", "end."]
    for some in (odd_words, ["x\u00a0", "\u00a0y"], ["plain"]):
        got = known.read(pa.array([" " + " ".join(some), None, "", "THE\x0bThe\n "]))
        assert got.sizes.tolist() == [len(some), 0, 0, 2]
        for w, i in zip([*some, "the", "the"], got.numbers, strict=True):
            assert got.pieces[got.starts[i] : got.starts[i + 1]].tolist() == known.encoder.encode_ordinary(" " + w)


def test_prior_is_a_distribution():
    """In any context the probabilities of all subwords and of the end of the word add up to one, whatever was counted."""
    known = spelling.Speller(RANKS)
    stop = known.stop
    prefix, cell, n = known.read(pa.array([" ".join(words(40, 8) + ["the", "tree's", "and"] * 5), "the 12,5 straße"])).edges()
    prefix, cell, n = np.append(prefix, 0), np.append(cell, stop << spelling.SHIFT | stop), np.append(n, 2)
    piece, inner = cell & language_model.LOW, prefix != 0
    cells, back = np.unique(cell[inner], return_inverse=True)
    for most in (1000, 5):  # with and without falling back to the last subword
        prior = spelling.build_prior(stop, Counter(dict(enumerate(np.bincount(piece, n)))), np.bincount(piece[~inner], n[~inner], stop + 1), (prefix, cell, n), (cells, np.bincount(back, n[inner])), [], 64, most)
        assert np.allclose(prior.rows.sum(1), 1, atol=1e-4)
        every = np.arange(stop)
        begins = np.flatnonzero(prior.group < spelling.STARTS)
        assert abs((10 ** prior.place(np.zeros(len(begins), np.uint64), np.full(len(begins), stop), begins)).sum() - len(set(prior.group[begins]))) < 1e-6
        insides = every[prior.group[:-1] >= spelling.STARTS]
        for at in np.flatnonzero(inner)[:20]:
            last = np.full(len(insides), cell[at] >> spelling.SHIFT)
            p = 10 ** prior.place(np.full(len(insides), prefix[at]).view(np.uint64), last, insides)
            assert np.allclose(np.bincount(prior.group[insides], p, spelling.STARTS + spelling.INNER)[sorted(set(prior.group[insides]))], 1, atol=1e-4)


def test_model_beats_the_unigram_base_on_held_out_text(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    r = language_model.model_scores(docs, RANKS).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r.s / r.n > r.b / r.n + 0.02


@pytest.mark.parametrize("table", ["documents", "odd", "none"])
def test_language_model(request, table):
    docs = request.getfixturevalue(table)
    got = language_model.model_scores(docs, RANKS, steps=60).collect()
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b"\0end"]) for r in docs.collect()]
    fold = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1
    counts = Counter(w for k, t in rows if not fold(k) for w in t)
    total, base = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    expected = sorted((str(k), fold(k), len(t), sum(counts[w] > 0 for w in t), total, round(sum(math.log10((counts[w] + 0.5) / base) for w in t), 5)) for k, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == expected
    assert all(r.score < 0 for r in got)


def test_words_beyond_the_frequent_are_joined(documents, monkeypatch):
    full = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in language_model.model_scores(documents, RANKS, steps=1).collect()}
    monkeypatch.setattr(language_model, "FREQUENT", 5)
    assert {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in language_model.model_scores(documents, RANKS, steps=1).collect()} == full


def test_languages(documents, odd, none):
    samples = languages.learn_samples(documents)
    got = languages.identify(documents, samples).select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    named = {r.doc_id: r.lang_pred for r in languages.identify(odd, samples, keep=["doc_id"]).collect()}
    assert named[2] == named[3] == named[4] == "und" and named[8] == "und" and named[1] == "en"
    assert {r.lang_pred for r in languages.identify(odd, {}, keep=["doc_id"]).collect()} == {"und"}
    assert languages.identify(none, samples).count() == 0 and languages.learn_samples(none) == {}


def test_cross_parsing_brute_force():
    """Whole texts, longer than a lane too: the parse of the lanes is the greedy parse from start to end."""
    rng = np.random.default_rng(6)
    sample = "".join(rng.choice(list("abc "), 300))
    parser = languages.CrossParser({"x": sample})
    joined = "," + ",".join(map(str, parser.alphabet.encode(sample).tolist())) + ","
    texts = ["".join(rng.choice(list("abcd "), n)) for n in (0, 1, 5, 60, 700, 2000, 511, 512, 513)] + ["a" * 1500, sample * 5, "d" * 600]
    rate, _ = parser.rate(texts)
    for text, got in zip(texts, rate[0], strict=True):
        coded, i, phrases = parser.alphabet.encode(text).tolist(), 0, 0
        while i < len(coded):
            j = i + 1
            while j < len(coded) and ("," + ",".join(map(str, coded[i : j + 1])) + ",") in joined:
                j += 1
            i, phrases = j, phrases + 1
        assert abs(got - phrases * parser.bits[0] / max(1, len(coded))) < 1e-9


def test_language_samples_are_whole_rows(spark):
    """Samples are whole texts; a language with none short enough gives its shortest; equal texts and ties are no matter."""
    long = "mot " * 20_000
    rows = [(i, t, k) for i, (t, k) in enumerate([("one two three", "en")] * 3 + [(long, "fr"), (long + "x", "fr"), (None, "de"), ("12 !", "xx"), ("", "en")])] + [(None, "no id here", "en")]
    rows = [(None if i is None else 7 * i + 1, t, k) for i, t, k in rows]
    got = languages.learn_samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"), folds=1, held_out=9)
    assert got["fr"] == long + " " and "de" not in got and "xx" not in got
    assert set(got["en"].replace("one two three", "").split()) <= {"no", "id", "here"}
    assert len(languages.CrossParser(got).tables) == 2


def test_alphabet_covers_its_sample():
    latin = languages.Alphabet(["abc déf ÀÉ"])
    assert len({latin.symbol(c) for c in "abcdéfà"}) == 7 and latin.symbol("z") == latin.size - 1 and latin.symbol("1") == 0
    many = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 2000))
    wide = languages.Alphabet([many])
    assert wide.size <= 250 and all(0 < wide.symbol(c) < wide.size - 1 for c in many)


def test_passages(spark, none, odd):
    shared, fuzzy = words(60, 31), words(70, 32)
    edited = [w if i % 12 != 5 else "other" for i, w in enumerate(fuzzy)]
    del edited[30]
    rows = [(i, " ".join(words(90, 200 + i))) for i in range(30)]
    rows += [(100, " ".join(words(20, 1) + shared + words(20, 2))), (101, " ".join(words(3, 3) + shared)), (102, " ".join(shared)), (103, " ".join(fuzzy + words(30, 4))), (104, " ".join(words(30, 5) + edited)), (105, " ".join(shared[:20] + words(50, 6)))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = defaultdict(set)
    for r in got:
        linked[r.doc_id].add(r.repeats_doc_id)
        linked[r.repeats_doc_id].add(r.doc_id)
    assert set(linked) == {100, 101, 102, 103, 104} and linked[103] == {104}
    assert all((r.start_word, r.end_word) in {(20, 80), (3, 63), (0, 60), (0, 70), (30, 99)} for r in got)
    assert passages.repeated_passages(none).count() == 0
    assert {(r.doc_id, r.repeats_doc_id) for r in passages.repeated_passages(odd).collect()} == {(6, 5)}


def test_passages_that_most_documents_hold(spark, monkeypatch):
    """Hot seeds are dealt to shares; each document still ends up linked, and with the right places."""
    shared = words(70, 41)
    rows = [(i, " ".join(words(20, 300 + i) + shared + words(5, 900 + i))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(passages, "in_sample", lambda *columns: F.lit(True))
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "HOT_SHARES", 5)
    got = passages.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == set(range(1, 40)) and all((r.start_word, r.end_word, r.repeats_start, r.repeats_end) == (20, 90, 20, 90) for r in got)
    reached, todo = {0}, [0]
    while todo:
        at = todo.pop()
        more = {r.doc_id for r in got if r.repeats_doc_id == at} - reached
        reached |= more
        todo += more
    assert reached == set(range(40))


def test_every_place_of_a_passage_counts(spark):
    """A passage three times in one document, once in another; a run of one word in two documents."""
    shared = words(60, 42)
    rows = [(1, " ".join(shared)), (2, " ".join(words(10, 50) + shared + words(10, 51) + shared + words(10, 52) + shared)), (3, "x " + "same " * 200 + "y"), (4, "same " * 150)]
    got = sorted((r.doc_id, r.start_word, r.end_word, r.repeats_doc_id) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [r for r in got if r[0] == 2] == [(2, 10, 70, 1), (2, 80, 140, 1), (2, 150, 210, 1)]
    runs = [r for r in got if r[0] == 4]
    assert runs and runs[0][3] == 3 and runs[0][2] - runs[0][1] >= 140


def numbered_words(*parts):
    return " ".join(f"{name}{i}" for name, a, b in parts for i in range(a, b))


def test_passages_that_earlier_documents_quote_in_fragments(spark):
    """Two whole copies among fragments before and between them, of 22 and of 46 words, and copies of the least length."""
    pieces = [(0, 22), (19, 41), (38, 60), (0, 46), (9, 55), (14, 60)]
    rows = [(i, numbered_words((f"u{i}x", 0, 30), ("p", a, b), (f"v{i}x", 0, 30))) for i, (a, b) in enumerate(pieces)]
    rows += [(20 + i, t.replace(f"u{i}x", f"y{i}x").replace(f"v{i}x", f"z{i}x")) for i, t in rows]
    rows += [(10, numbered_words(("a", 0, 40), ("p", 0, 60), ("b", 0, 40))), (30, numbered_words(("c", 0, 50), ("p", 0, 60), ("d", 0, 20)))]
    rows += [(40, numbered_words(("e", 0, 20), ("q", 0, 50))), (41, numbered_words(("q", 0, 50), ("f", 0, 20))), (42, numbered_words(("g", 0, 20), ("q", 0, 49), ("h", 0, 20)))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.repeats_doc_id, r.repeats_start, r.repeats_end, r.identity) for r in got} == {(30, 50, 110, 10, 40, 100, 1.0), (41, 0, 50, 40, 20, 70, 1.0)}


def test_edited_passages_that_earlier_documents_quote_in_fragments(spark):
    """Two edited copies without a run of 50 equal words, behind fragments that have all of their seeds first."""
    rows = [(i, numbered_words((f"u{i}x", 0, 30), ("p", a, b), (f"v{i}x", 0, 30))) for i, (a, b) in enumerate([(0, 24), (16, 40), (30, 54), (46, 70)])]
    whole = [f"p{i}" for i in range(70)]
    edited = [w if i not in (17, 35, 53) else f"edit{i}" for i, w in enumerate(whole)]
    rows += [(10, " ".join([*words(30, 81), *whole, *words(30, 82)])), (11, " ".join([*words(20, 83), *edited, *words(20, 84)]))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.repeats_doc_id) for r in got} == {(11, 10)}
    assert min(r.start_word for r in got) == 20 and max(r.end_word for r in got) == 90


def test_originals_ask_for_no_pairs_of_seeds(spark, monkeypatch):
    """The first document of a text has no earlier one to look for, so texts and their exact copies pair no seeds (an edited copy does)."""
    made, write = {}, passages.materialize

    def counted(df, label):
        out = write(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(passages, "materialize", counted)
    rows = [(i, " ".join(words(300, 700 + i % 10))) for i in range(20)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.repeats_doc_id, r.start_word, r.end_word) for r in got} == {(i + 10, i, 0, 300) for i in range(10)}
    assert made["passage-matches"] > 0 and made["passage-pairs"] == 0


def test_passages_leave_no_run_of_fifty_words(documents):
    """Every run of 50 words that an earlier document has lies in a reported passage, but for single words at its ends."""
    rows = documents.select("doc_id", "text").collect()
    first, runs = {}, {}
    for r in sorted((r for r in rows if r.doc_id is not None), key=lambda r: r.doc_id):
        words = (r.text or "").encode().lower().split()
        for i in range(len(words) - 49):
            run = tuple(words[i : i + 50])
            if first.setdefault(run, r.doc_id) != r.doc_id:
                runs.setdefault(r.doc_id, set()).add(i)
    held = {}
    for r in passages.repeated_passages(documents).collect():
        held.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    total, missed = sum(map(len, runs.values())), [(d, i) for d, at in runs.items() for i in at if not any(a <= i + 25 < b for a, b in held.get(d, []))]
    assert total > 0 and not missed


def test_passages_brute_force(documents):
    """Every document with 60 equal words in a row in another one is found, and what is found is at least as alike as it says."""
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in documents.collect()}
    holders = defaultdict(set)
    for k, w in texts.items():
        for i in range(len(w) - 59):
            holders[tuple(w[i : i + 60])].add(k)
    expected = {k for group in holders.values() if len(group) > 1 for k in group}
    got = passages.repeated_passages(documents).collect()
    found = {r.doc_id for r in got} | {r.repeats_doc_id for r in got}
    assert len(expected & found) >= 0.99 * len(expected) and len(expected) > 20
    for r in got[::7]:
        a, b = texts[r.doc_id][r.start_word : r.end_word], texts[r.repeats_doc_id][r.repeats_start : r.repeats_end]
        row = [0] * (len(b) + 1)
        for x in a:
            before = row
            row = [0]
            for j, y in enumerate(b):
                row.append(max(before[j + 1], row[j], before[j] + (x == y)))
        assert r.identity >= 0.8 and row[-1] / max(len(a), len(b)) >= r.identity - 1e-9 and len(a) >= 50


def test_chains_brute_force():
    """The first chain is one of the best: its value is that of a search over all predecessors."""
    rng, seen = np.random.default_rng(7), 0
    for _ in range(60):
        pos = np.sort(rng.choice(60, 8, replace=False)).astype(np.int32)
        ref = rng.integers(0, 60, 8).astype(np.int32)
        best, starts = np.full(8, float(passages.K)), np.arange(8)
        for i in range(8):
            for j in range(i):
                value = passages.K + best[j] - passages.GAP_COST * (pos[i] - pos[j] + ref[i] - ref[j])
                if pos[j] < pos[i] and ref[j] < ref[i] and value > best[i]:
                    best[i], starts[i] = value, starts[j]
        found = passages.chains(pos, ref)
        for c in found:
            assert (np.diff(pos[c]) > 0).all() and (np.diff(ref[c]) > 0).all()
        top = int(best.argmax())
        if best[top] > passages.K and passages.K + pos[top] - pos[starts[top]] >= passages.LEAST_CHAIN:
            c, seen = found[0], seen + 1
            value = passages.K * len(c) - passages.GAP_COST * (pos[c[-1]] - pos[c[0]] + ref[c[-1]] - ref[c[0]])
            assert abs(value - best[top]) < 1e-6
    assert seen > 20


def test_pipeline(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "token_files"]
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert docs.columns == corpus_pipeline.COLUMNS or name == "token_files"
    assert seen[0] >= seen[1] >= seen[2] and seen[2] == seen[3] == seen[4]
    components = {c for *_, c in brute_components([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.doc_id in seen[0]])}
    assert seen[1] == components
    benchmark = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if any(b in r.text for b in benchmark):
            assert r.doc_id not in seen[2]


def test_pipeline_decides_by_row(spark):
    """Null, shared and repeated ids: one row of each group stays, clean rows stay, contaminated ones go."""
    import corpus_pipeline

    a, b, c, d = (" ".join(words(60, 300 + i)) for i in range(4))
    leak = " ".join(words(20, 310)) + " " + spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    near = b + " more"

    def table_of(rows):
        return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")

    def run(stage, rows):
        return Counter((r.doc_id, r.text) for r in stage(spark, table_of(rows), SF).collect())

    rows = [(None, a), (None, a), (None, a), (1, b), (2, near), (2, c), (3, d), (3, d), (None, ""), (None, None), (4, ""), (4, "")]
    assert run(corpus_pipeline.near_duplicate_stage, rows) == Counter([(None, a), (1, b), (2, c), (3, d), (None, ""), (None, None), (4, ""), (4, "")])
    assert run(corpus_pipeline.near_duplicate_stage, [(None, a), (7, a), (9, a)]) == Counter([(7, a)])
    rows = [(None, leak), (None, a), (5, leak), (5, b), (6, c), (6, c)]
    assert run(corpus_pipeline.decontamination_stage, rows) == Counter([(None, a), (5, b), (6, c), (6, c)])


def test_decontamination_stage_writes_no_rows(spark, monkeypatch):
    """The stage filters rows where they are read: no copy of the texts stays on disk; several blocks of items drop the same rows as one."""
    import corpus_pipeline

    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = spark.createDataFrame([(i, " ".join(words(30, 400 + i)) + (" " + leak if i % 3 == 0 else ""), "en", "s", 1) for i in range(9)] + [(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    written, kept = [], [None, 1, 2, 4, 5, 7, 8]
    for module in (corpus_pipeline, decontaminate):
        monkeypatch.setattr(module, "materialize", lambda df, label: written.append(label) or materialize(df, label))
    left = lambda: sorted((r.doc_id for r in corpus_pipeline.decontamination_stage(spark, rows, SF).collect()), key=lambda i: i or 0)
    assert left() == kept and not written
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 2000)
    assert left() == kept


def test_pipeline_on_odd_rows(spark, odd, none, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, clashing names; no rows at all; items that are null or empty."""
    import corpus_pipeline

    spark.createDataFrame([(1, "no id at all here, friend, and more words of it"), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = odd.withColumns({c: F.lit(1) for c in ("row", "copy", "lang_pred", "component_id", "copies", "start")}), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        seen.append(docs)
        assert docs.columns == corpus_pipeline.COLUMNS or name == "token_files"
    ids = [Counter(r.doc_id for r in d.collect()) for d in seen]
    assert ids[0] == Counter([1, 5, 6, 7, 7, None, 9])  # no letter, no language
    assert ids[1] == Counter([1, 5, 7, None, 9])
    assert ids[2] == Counter([1, 5, 7, 9])
    assert set(ids[3]) == set(ids[2]) and min(ids[3].values()) >= 1
    tokenizer, texts = ByteLevelEncoder(BPE).tokenizer, {r.doc_id: r.text for r in odd.collect() if r.doc_id}
    start = 0
    for r in sorted(seen[4].collect(), key=lambda r: r.start):
        ids_of = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids_of), zlib.crc32(np.array(ids_of, "<u4").tobytes()))
        start += r.n_tokens
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0


def test_very_long_texts(spark):
    """Texts of 20,000 words, copied, edited and cut, through the operators that pair documents or walk through texts."""
    base = words(20_000, 61)
    edited = [w if i % 400 else "edit" for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(base[:9_000])), (4, " ".join(words(200, 62)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in shingle_join.near_duplicates(docs)[0].collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {(r.doc_id, r.repeats_doc_id) for r in passages.repeated_passages(docs).collect()} == {(2, 1), (3, 1)}
    got = {r.doc_id: r for r in language_model.model_scores(docs, RANKS, steps=5).collect()}
    assert [got[k].n_tokens for k in (1, 2, 3, 4)] == [20_001, 20_001, 9_001, 201] and all(r.score < 0 for r in got.values())
    assert {r.lang_pred for r in languages.identify(docs, {"xx": " ".join(base[:500]), "yy": "zzz qqq " * 50}, keep=["doc_id"]).collect()} == {"xx"}
