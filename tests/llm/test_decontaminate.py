import re
from collections import Counter

import pytest

from tests.llm import brute
from tidewright.llm.decontaminate import UNITS, contaminated, decontaminate

NUMBER = re.compile(r"\d[\d.,:/-]*(?:st|nd|rd|th|[a-z%]{0,3})$", re.IGNORECASE)


def tokens(text):
    """(placeholder or word, value) by the definition, a token at a time."""
    out = []
    for word in re.findall(brute.WORD, text or ""):
        bare = re.sub(r"^[\W_]+|[\W_]+$", "", word) or (word if re.fullmatch(r"[-+*/=<>^%×÷]+", word) else "")
        if not bare:
            continue
        if NUMBER.match(bare):
            out.append(("#", bare.lower()))
        elif bare.lower() in UNITS:
            out.append(("unit" if out and out[-1][0] == "#" else "=" + bare.lower(), bare.lower()))
        elif bare not in ("A", "I") and any(c.isupper() for c in bare):
            if out and out[-1][0] == "name":
                out[-1] = ("name", f"{out[-1][1]} {bare.lower()}")
            else:
                out.append(("name", bare.lower()))
        else:
            out.append(("=" + bare.lower(), bare.lower()))
    return out


def windows(t, size=5, least=3):
    for i in range(len(t)):
        for j in range(i + size, len(t) + 1):
            if sum(x[0][0] == "=" for x in t[i:j]) >= least:
                yield i, j
                break


def found(docs, items, similarity=0.8):
    out = set()
    docs = [(i, tokens(t)) for i, t in docs]
    docs = [(i, d, [(k, tuple(x[0] for x in d[k:j])) for k, j in windows(d)]) for i, d in docs]
    for item_id, item in items:
        q = tokens(item)
        of = {i: tuple(x[0] for x in q[i:j]) for i, j in windows(q)}
        at = {}
        for i, shape in of.items():
            at.setdefault(shape, []).append(i)
        for doc_id, d, shapes in docs:
            if not of:
                words, own = [x[1] for x in q], [x[1] for x in d]
                if words and (words == own if len(q) < 5 else any(own[k : k + len(q)] == words for k in range(len(own)))):
                    out.add((doc_id, item_id))
                continue
            lines = {}
            for k, shape in shapes:
                for i in at.get(shape, ()):
                    lines.setdefault(k - i, {})[i] = (k, len(shape))
            places, sure = set(), set()  # with every value of a tie, with none
            for line in lines.values():
                slots = {i + x: (q[i + x][1], d[k + x][1]) for i, (k, n) in line.items() for x in range(n) if q[i + x][0][0] != "="}
                most = {}
                for (a, b), n in Counter(slots.values()).items():
                    most.setdefault(a, []).append((n, b))
                tops = {a: {b for n, b in v if n == max(x[0] for x in v)} for a, v in most.items()}
                for out_of, fits in ((places, lambda a, b: b in tops[a]), (sure, lambda a, b: tops[a] == {b})):
                    out_of |= {i for i, (k, n) in line.items() if all(i + x not in slots or fits(*slots[i + x]) for x in range(n))}
            enough = [len(x) >= similarity * len(of) - 1e-9 for x in (places, sure)]
            assert enough[0] == enough[1], "ties decide nothing here"
            if enough[0]:
                out.add((doc_id, item_id))
    return out


TRAIN = "A train leaves {} at {} km per hour and meets {} after {} hours near the old stone bridge by the river. {} then walks back to {} in {} minutes while {} likes {} more than before"
ITEMS = [
    (1, TRAIN.format("Boston", 45, "Alice", 3, "Alice", "Boston", 30, "Alice", "Boston")),
    (2, "The bus departs at 10:30 and then arrives at 11:30 so how long does the whole trip to the lake take"),
    (3, "Compute 12 + 45 - 7 + 3"),
    (4, "What is 7"),
    (5, "99 100 101 102 103 104"),
    (6, None),
    (7, ""),
    (1, TRAIN.format("Boston", 45, "Alice", 3, "Alice", "Boston", 30, "Alice", "Boston")),
]
DOCS = [
    (1, f"Some words before. {ITEMS[0][1]} and some words after"),
    (2, "so " + TRAIN.format("Denver", 80, "Maria", 7, "Maria", "Denver", 12, "Maria", "Denver")),
    (3, "so " + TRAIN.format("Denver", 80, "Maria", 12, "Maria", "Denver", 12, "Maria", "Denver")),
    (4, TRAIN.format("Denver", 80, "Maria", 7, "Peter", "Oslo", 12, "Peter", "Denver")),
    (5, TRAIN.format("New York", 80, "McDonald", 7, "McDonald", "New York", 12, "McDonald", "New York")),
    (6, "The bus departs at 9:15 and then arrives at 8:45 so how long does the whole trip to the lake take"),
    (7, "x y Compute 12 + 45 - 7 + 3 z and more words of a text"),
    (8, "we Compute 1 + 2 - 3 + 4 z and more words of a text"),
    (9, "what is 7"),
    (10, "but what is 7 here"),
    (11, "so 99 100 101 102 103 104 end"),
    (12, "so 99 100 101 102 103 105 end"),
    (13, None),
    (14, "A train leaves Denver at 80 km per hour and meets Maria after 7 hours"),
    (15, "nothing of the kind at all in here"),
]


def test_equals_brute_force(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    want = found(DOCS, ITEMS)
    assert {d for d, i in want if i == 1} == {1, 2, 3, 5} and (6, 2) in want and (7, 3) in want and (8, 3) in want
    assert (9, 4) in want and (10, 4) not in want and (11, 5) in want and (12, 5) not in want
    for n in (1_000_000, 1):
        assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench, broadcast_hashes=n).collect()} == want


def test_equals_brute_force_on_the_tables(spark, small):
    docs, bench = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert got == found(texts, items)
    assert {(d, i) for d, t in texts for i, x in items if x in t} <= got


def test_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([*DOCS, (5, "again under one id"), (None, ITEMS[0][1])], "doc_id long, text string")
    got = decontaminate(docs, bench).collect()
    assert len(got) == len(DOCS) + 2 and sum(r.contaminated for r in got if r.doc_id == 5) == 2
    assert [r.contaminated for r in got if r.doc_id is None] == [False]
    assert decontaminate(edge_docs, bench).count() == edge_docs.count()
    assert contaminated(no_docs, bench).count() == 0 and contaminated(docs, bench.where("false")).count() == 0


@pytest.mark.parametrize("n", [1_000_000, 1])
def test_windows_of_any_length(spark, n):
    """Thirty numbers, then words, then thirty numbers again, asked with other numbers."""
    numbers = lambda seed, m=30: " ".join(str((seed + 7 * i) % 9973 + 10) for i in range(m))
    ask = "{} add them all {} subtract these now {}"
    items = [(1, ask.format(numbers(1), numbers(500), numbers(900))), (2, "take " + numbers(3, 200) + " and find the mean value of them")]
    docs = [
        (1, "here " + ask.format(numbers(11), numbers(1500), numbers(2900)) + " end of it"), (2, "so take " + numbers(7, 200) + " and find the mean value of them"), (3, "so take " + numbers(7, 199) + " and find the mean value of them"),
        (4, ask.format(numbers(11, 29), numbers(1500, 29), numbers(2900, 29))), (5, numbers(5, 20_000)),
    ]
    want = found(docs[:4], items)
    assert {(1, 1), (2, 2)} <= want
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_hashes=n)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
