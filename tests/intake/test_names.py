"""Spelling candidates against all pairs compared, and what is done with a type that nobody declared."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidewright.operators import mapping
from tidewright.operators.mapping import KEYWORDS, alike_pairs, plain_name, rename_plan, spelling_candidates, suggest_file_type, suggest_mappings

WORDS = ["order", "date", "amount", "net", "total", "buyer", "name", "phone", "zip", "code", "sku", "qty", "unit", "ship", "via", "ref", "note", "city", "ราคา", "id", "no"]


def names(seed, n):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        word = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4)))
        cut = rng.randrange(len(word))
        out.add(rng.choice([word, word.title(), word[:cut] + rng.choice("xyz_") + word[cut:], word[:cut] + word[cut + 1 :], word.replace(" ", "_") + str(rng.randrange(50))]) or "a")
    return sorted(out | {"", "  ", "!!"})


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("least", [0.5, 0.86])
def test_no_pair_alike_is_left_out_and_few_others_are_compared(spark, least):
    left, right = ({x.lower().strip() for x in names(s, 300)} for s in (1, 2))
    got = {(r.a, r.b) for r in alike_pairs(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), least).collect()}
    want = {(a, b) for a in left for b in right if ratio(a, b) >= least}
    assert want <= got
    if least > 0.8:
        assert len(got) < 0.02 * len(left) * len(right)


def brute_suggestions(own, other, renormalize):
    plain = {}
    for x in {*own, *other}:
        kept = "".join(c for c in x.lower() if c == "_" or c.isspace() or c.isalnum() )
        plain[x] = " ".join(kept.split())
    out = {}
    for a in own:
        found = []
        for b in other:
            x, y = set(plain[a].split()), set(plain[b].split())
            string = 0.7 * ratio(plain[a], plain[b]) + 0.3 * (len(x & y) / len(x | y) if x and y else 0)
            context = 0.5 if any(any(w in a.lower() for w in g) and any(w in b.lower() for w in g) for g in KEYWORDS.values()) else 0.0
            score = (0.3 * string + 0.2 * context) / (0.5 if renormalize else 1)
            if score > 0.2:
                found.append((round(score * 100, 1), b))
        out[a] = sorted(found, key=lambda f: (-f[0], f[1]))[:5]
    return {a: f for a, f in out.items() if f}


@pytest.mark.parametrize("renormalize", [False, True])
def test_suggestions_equal_those_from_all_pairs(spark, renormalize):
    own, other = names(3, 60), names(4, 80)
    frames = (spark.createDataFrame([(x,) for x in v], f"{c} string") for v, c in ((own, "source_column"), (other, "target_column")))
    got = {}
    for r in suggest_mappings(*frames, renormalize=renormalize).orderBy("source_column", "rank").collect():
        got.setdefault(r.source_column, []).append((r.confidence, r.target_column))
    want = brute_suggestions(own, other, renormalize)
    assert got.keys() == want.keys()
    for a, found in want.items():
        assert [c for c, _ in got[a]] == pytest.approx([c for c, _ in found], abs=0.11), a


def test_file_types_equal_those_from_all_pairs(spark):
    own = names(5, 40)
    specs = [(t, x) for t, s in (("one", 5), ("two", 6), ("three", 7)) for x in names(s, 40)]
    near = spelling_candidates(spark.createDataFrame([(x,) for x in own], "source_column string"), spark.createDataFrame([(x,) for _, x in specs], "target_column string"), 0.6)
    near = {(r[0], r[1]) for r in near.where(mapping.string_similarity(F.col("source_column"), F.col("target_column")) > 0.6).collect()}
    every = spark.createDataFrame([(x,) for x in own], "a string").crossJoin(spark.createDataFrame([(x,) for _, x in specs], "b string").distinct())
    assert near == {(r.a, r.b) for r in every.where(mapping.string_similarity(F.col("a"), F.col("b")) > 0.6).collect()}
    found = suggest_file_type(spark.createDataFrame([(x,) for x in own], "column string"), spark.createDataFrame([(t, x, x) for t, x in specs], "file_type string, source string, target string"))
    assert found.first().file_type == "one" and found.first().confidence == 100.0


def test_a_type_that_nobody_declared_is_taken_reviewed_or_unmapped(spark):
    specs = spark.createDataFrame([("orders", f"src {i}", t) for i, t in enumerate(("order date", "buyer phone", "net amount", "zip code", "city name"))], "file_type string, source string, target string")
    columns = spark.createDataFrame([("Order  Date",), ("net amounts x",), ("qqq",), ("src 0",)], "column string")
    plan = {r.column: r for r in rename_plan(columns, specs, "new", 75, renormalize=True).collect()}
    assert (plan["Order  Date"].new_name, plan["Order  Date"].how) == ("order date", "suggested")
    assert plan["net amounts x"].how == "review" and plan["net amounts x"].suggestions[0].target == "net amount" and plan["net amounts x"].new_name is None
    assert plan["qqq"].how == "unmapped" and plan["qqq"].suggestions == []
    known = {r.column: r.how for r in rename_plan(columns, specs, "orders", 75, renormalize=True).collect()}
    assert known["src 0"] == "exact"
    renamed, shown = mapping.auto_rename(spark.createDataFrame([(1, 2)], "`Order  Date` int, qqq int"), specs, "new", 75, renormalize=True)
    assert renamed.columns == ["order date", "qqq"] and shown.count() == 2
    assert spark.createDataFrame([("a b",)], "x string").select(plain_name(F.col("x"))).first()[0] == "a b"
