import random
from collections import Counter

from tests.llm import brute
from tidewright.llm import blocks as B
from tidewright.llm import minhash
from tidewright.llm.components import components
from tidewright.llm.minhash import bands_for, least_matches, near_duplicates
from tidewright.llm.substring_dedup import substring_dedup
from tidewright.llm.suffix_dedup import suffix_dedup


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_suffix_dedup_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup(docs, block_bytes=20_000, batch_windows=500).collect()}
    assert got == brute.suffix_dedup(texts(docs))


def test_suffix_dedup_edges(spark, edge_docs, no_docs):
    got = suffix_dedup(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_removed == 0 and by[2][0].n_removed == by[2][0].n_bytes > 0 and by[2][0].kept == b""
    assert [r.n_bytes for r in by[3]] == [0] and by[3][0].kept_sha256 == brute.sha(b"")
    assert {r.n_removed for r in by[12]} == {0} and by[13][0].n_removed == 500 and by[13][0].kept == b"b"
    assert len(by[None]) == 2
    assert suffix_dedup(no_docs).collect() == []


def test_substring_dedup_equals_brute_force(spark, small, edge_docs, no_docs):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for df in (docs, edge_docs):
        got = Counter(tuple(r)[:4] for r in substring_dedup(df, block_bytes=20_000).collect())
        assert got == Counter(brute.substring_dedup(texts(df)))
    assert substring_dedup(no_docs).collect() == []


def test_near_duplicates_equal_brute_force(spark, small, no_docs):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for size, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: tuple(r)[1:] for r in near_duplicates(docs, size=size, percent=percent).collect()}
        assert got == brute.near_duplicates(texts(docs), size, percent)
    assert near_duplicates(no_docs).collect() == []


def test_near_duplicates_edges(spark, edge_docs):
    got = {}
    for r in near_duplicates(edge_docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for i in (1, 2, 11) for r in got[i]} == {1} and not got[11][0].kept
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id and r.kept for i in (3, 4, 5) for r in got[i])
    assert got[6][0].n_shingles == 1 and len(got[None]) == 2 and len(got[10]) == 2


def test_chain_of_near_copies_is_one_component(spark):
    """Neighbours link, the ends don't: the sweep across components has to find the links."""
    words = [f"w{i}" for i in range(100)]
    rows = []
    for step in range(12):
        rows.append((step, " ".join([f"s{j}" for j in range(4 * step)] + words[4 * step :])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates(docs, size=3, percent=85).collect()}
    assert got == brute.near_duplicates(rows, 3, 85)
    assert {c for _, c, _ in got.values()} == {0}


def test_band_values_of_many_chunks(spark, monkeypatch):
    """Chunks of three members: every pair across components still meets."""
    monkeypatch.setattr(minhash, "CHUNK", 3)
    r, rows = random.Random(5), []
    for group in range(4):
        words = [f"g{group}w{i}" for i in range(80)]
        for copy in range(14):
            own = list(words)
            for _ in range(r.randint(0, 5)):
                own[r.randrange(80)] = f"x{r.random()}"
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent in ((3, 85), (5, 80)):
        got = {x.doc_id: tuple(x)[1:] for x in near_duplicates(docs, size=size, percent=percent).collect()}
        assert got == brute.near_duplicates(rows, size, percent)


def test_bands_and_posterior():
    assert (1 - 0.8**3) ** bands_for(0.8, 3, 1e-6) <= 1e-6
    assert least_matches(45, 0.85, 1e-8) < 30 and least_matches(1000, 0.85, 1e-8) > 750


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.label for r in components(links).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100


def test_common_grams_with_different_surroundings(spark):
    """More blocks than ``hot_blocks`` share a phrase below the window, and some share more: hot names are split, nothing is lost."""
    phrase = "a phrase of words that is on every page of it"
    rows = [(i, f"{i * 7919 % 1009:04} {i * 31:06} " * 3 + phrase + f" {i % 40:03} of the {i % 40} pages with some more words after " * 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup(docs, block_bytes=400, hot_blocks=8).collect()}
    assert got == brute.suffix_dedup(rows)
    words = [(i, " ".join([f"x{i}y{j}" for j in range(30)] + [f"w{j}" for j in range(20)] + [f"z{i % 40}y{j}" for j in range(30)])) for i in range(200)]
    docs = spark.createDataFrame(words, "doc_id long, text string")
    assert Counter(tuple(r)[:4] for r in substring_dedup(docs, block_bytes=900, hot_blocks=8).collect()) == Counter(brute.substring_dedup(words))


def test_one_far_id_and_many_null_ids(spark):
    """Blocks don't follow ids: neither an outlier nor a null key gathers the rows in one block."""
    docs = spark.createDataFrame([(i if i % 3 else None, f"text {i} " * 20) for i in range(600)] + [(10**15, "far")], "doc_id long, text string")
    sizes = [r["count"] for r in B.text_blocks(docs, 4000).rows.groupBy("block").count().collect()]
    assert max(sizes) < 80 and sum(sizes) == 601


def test_ids_with_wide_gaps_and_below_zero(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i * 10**15 - 5 * 10**15, f"{text} {i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup(docs, block_bytes=1000).collect()}
    assert got == brute.suffix_dedup(rows)
    assert Counter(tuple(r)[:4] for r in substring_dedup(docs, block_bytes=1000).collect()) == Counter(brute.substring_dedup(rows))
