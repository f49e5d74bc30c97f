import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm import brute
from tidewright.llm.mixing import mix_sources, source_targets
from tidewright.llm.page_differencing import extract_pages, lines_of, main_text, shared_lines
from tidewright.llm.spotsigs import COMMON, edited_text, near_copies, pruned_jaccard, spot_fingerprints
from tidewright.llm.suffix_tree_lm import SHARDED_FROM, SHARDS, held_out, score_texts
from tidewright.llm.token_counts import Rollup, bpe_counts, built_in_counts, changes, later_copies
from tidewright.llm.toxicity import build_index, score_toxicity


def test_token_rollup_is_idempotent_and_additive(spark, edge_docs, no_docs, tmp_path):
    store = Rollup(spark, f"file://{tmp_path}/store")
    assert store.totals().count() == 0
    counts = built_in_counts(changes(inserted=edge_docs))
    assert store.commit("a", counts) and not store.commit("a", counts)
    assert store.commit("none", built_in_counts(changes(inserted=no_docs)))
    want = Counter()
    for r in edge_docs.collect():
        want[r.source, r.lang, "words@1"] += len(re.findall(brute.WORD, r.text or ""))
    got = {(r.source, r.lang, r.tokenizer): r.n_tokens for r in store.totals().where("tokenizer = 'words@1'").collect()}
    assert got == dict(want)
    revised = edge_docs.where("doc_id = 8")
    store.commit("b", built_in_counts(changes(deleted=edge_docs.where("doc_id = 9"), revised=(revised, revised.selectExpr("doc_id", "'two words' as text", "lang", "source")))))
    c = {(r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().where("source = 'c'").collect()}
    assert c["en", "words@1"] == (1, 2) and c["de", "words@1"] == (0, 0)
    small_store = store.compact(f"file://{tmp_path}/compact")
    assert small_store.totals().where("source = 'c' and lang = 'de'").count() == 0


def test_a_batch_committed_while_compacting_is_in_one_store_only(spark, edge_docs, tmp_path):
    store = Rollup(spark, f"file://{tmp_path}/store")
    counts = built_in_counts(changes(inserted=edge_docs))
    store.commit("a", counts)
    totals = store.totals

    def meanwhile(of=None):
        store.commit("b", counts)
        return totals(of)

    store.totals = meanwhile
    new = store.compact(f"file://{tmp_path}/new")
    assert new.batches() == {"compacted", "a"} and totals().agg({"n_docs": "sum"}).first()[0] == 2 * new.totals().agg({"n_docs": "sum"}).first()[0]
    assert new.commit("b", counts) and not new.commit("a", counts)
    assert sorted(map(str, new.totals().collect())) == sorted(map(str, totals().where("n_docs <> 0 or n_tokens <> 0").collect()))


def test_bpe_counts_round_trip(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(30)
    got = sum(r.tokens for r in bpe_counts(changes(inserted=docs)).collect())
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    parts = [coder.encode_ordinary(r.text) for r in docs.collect()]
    assert got == sum(map(len, parts)) and all(coder.decode(p) == r.text for p, r in zip(parts, docs.collect(), strict=True))


def spots(text):
    """Anchor and up to two content words, a word at a time."""
    words = re.findall(brute.WORD, brute.lower(text))
    content = [(i, w) for i, w in enumerate(words) if w not in COMMON]
    out = {("", *[w for _, w in content][:2])} if words else set()
    return out | {(a, *[w for j, w in content if j > i][:2]) for i, a in enumerate(words) if a in COMMON}


def test_fingerprint_likeness_by_brute_force(spark, small):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 60").collect())
    rows += [(90, ""), (91, None), (92, "one"), (93, "the"), (94, "one of the two")]
    got = {r.doc_id: r for r in spot_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    like = lambda a, b: float(a == b) if not a or not b else len(a & b) / len(a | b)
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1] or ""
        assert math.isclose(got[i].near_edited, like(spots(text), spots(edited_text(text or "", after))))
        assert math.isclose(got[i].near_next, like(spots(text), spots(after)))
        assert len(got[i].fingerprint) == 8 * len(spots(text))


def test_fingerprints(spark, small, edge_docs, no_docs):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in spot_fingerprints(docs).collect()}
    better = 0
    for k, (i, text) in enumerate(rows):
        edited = edited_text(text, rows[(k + 1) % len(rows)][1])
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
        better += got[i].near_edited > got[i].near_next or edited == text
    assert better > 0.95 * len(rows)
    edge = spot_fingerprints(edge_docs).collect()
    assert len(edge) == edge_docs.count()
    assert len({r.fingerprint for r in edge if r.doc_id in (1, 2, 11)}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in edge)
    assert spot_fingerprints(no_docs).count() == 0
    assert pruned_jaccard(np.arange(10), np.arange(100), 0.8) == 0.0 and pruned_jaccard(np.arange(10), np.arange(10), 0.8) == 1.0


def test_spot_near_copies(spark):
    words = [random.Random(i).choice(["the", "of", "to"]) if i % 3 == 0 else f"word{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:150], "changed", *words[151:]])), (3, " ".join(f"other{w}" for w in words)), (4, None), (5, " ".join(words))]
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 0.8).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)]


def test_toxicity_on_held_out_rows(spark, edge_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if got[r.doc_id].held_out}
    right = sum(got[i].predicted == y for i, y in truth.items())
    assert len(got) == docs.count() and right >= 0.93 * len(truth)
    edge = score_toxicity(edge_docs, labels).collect()
    assert len(edge) == edge_docs.count() and all(0 <= r.score <= 1 for r in edge)
    assert score_toxicity(edge_docs, labels.where("false")).where("predicted = 1").count() == 0
    assert score_toxicity(no_docs, labels).count() == 0


def test_toxicity_meets_neighbours_at_every_size(spark, small):
    """Every text that shares a word with an example has neighbours, also with few labels."""
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    rows = score_toxicity(docs, labels).collect()
    texts, known = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id for r in labels.collect()}
    letters = lambda t: set(re.findall(r"[^\W\d_]+", (t or "").lower()))
    held = set().union(*(letters(texts[r.doc_id]) for r in rows if r.doc_id in known and not r.held_out))
    met = [r for r in rows if letters(texts[r.doc_id]) & held]
    assert len(met) > 0.9 * len(rows) and all(r.neighbours for r in met)
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert sum(r.predicted for r in rows if r.doc_id in toxic) >= 0.8 * len(toxic)


def test_block_max_neighbours_are_exact(spark):
    sf = "/root/testdata/sf0.01"
    labelled = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").selectExpr("doc_id", "text", "cast(toxic as long) as toxic")
    index = build_index(labelled, k=7)[0].value
    dense = np.zeros((len(index.ids), len(index.words)))
    for w, (place, weight) in enumerate(index.postings):
        dense[place, w] = weight
    row, words = np.nonzero(dense[:40])
    places, cosines = index.nearest(row, words, dense[:40][row, words], 40)
    _, alone = index.nearest(row, words, dense[:40][row, words], 40, index.ids[:40])
    for i, q in enumerate(dense[:40]):
        every = dense @ q
        assert np.allclose(cosines[i], np.sort(every)[::-1][:7], atol=1e-5) and np.allclose(every[places[i]], cosines[i], atol=1e-5)
        assert np.allclose(alone[i], np.sort(np.delete(every, i))[::-1][:7], atol=1e-5)


def test_shared_lines_are_longest():
    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        got = sorted(shared_lines(a, b))
        rest = iter(b)
        assert len(got) == length(a, b) and all(a[i] in rest for i in got)


def test_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    texts = {" ".join(r.text.split()) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = extract_pages(pages).collect()
    bodies = [" ".join(r.text.split("\n\n")[1:]) for r in got]  # the heading repeats the first line
    assert len(got) == pages.count() and all(b in texts for b in bodies)
    lines, article = lines_of("<nav>menu</nav><article><h1>T</h1><p>a &amp; b\n c<p>d<br>e<div class='comments'>no</div><aside>x</aside></article><footer>f</footer>")
    assert article and main_text(lines, article, None) == "T\n\na & b c\n\nd e"


def test_pages_without_article_lose_what_neighbours_share(spark):
    page = lambda body: f"<body><p>Site name</p><p>{body}</p><p>All rights reserved</p></body>"
    rows = [(1, "http://h/a/1", page("first story")), (2, "http://h/a/2", page("second story")), (3, None, None), (4, "http://h/a/2", page("second story")), (5, "not a url", "<p>alone")]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)).collect()}
    assert got[3] == "" and got[5] == "alone" and len(got) == 5
    assert got[1] in ("first story", "Site name\n\nfirst story\n\nAll rights reserved")
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string, host string, path string")).count() == 0


def test_language_model_base_is_exact_and_beaten(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in score_texts(docs).collect()}
    tokens = {r.doc_id: [*re.findall(brute.WORD, brute.lower(r.text)), None] for r in docs.collect()}
    c = Counter(w for i, t in tokens.items() if not held_out(i) for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > 0.95 * sum(r.base_score for r in out) and all(r.score <= 0 for r in out)
    assert score_texts(edge_docs).count() == edge_docs.count() and score_texts(no_docs).count() == 0
    spelled = score_texts(docs, unseen="spelled").collect()
    assert all(r.score < 0 for r in spelled)


def test_language_model_contexts_of_frequent_words(spark):
    """The tree by brute force: all contexts of up to three words, however often they occur."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokens = {r.doc_id: [*re.findall(brute.WORD, brute.lower(r.text)), None] for r in docs.collect()}
    c = Counter(w for i, t in tokens.items() if not held_out(i) for w in t)
    total = sum(c.values())
    assert any(n > max(SHARDED_FROM, total // SHARDS) for w, n in c.items() if w)
    discount = min(0.9, sum(n == 1 for n in c.values()) / len(c))
    branches = {}
    for i, t in tokens.items():
        for j, w in enumerate(t) if not held_out(i) else ():
            for length in range(1, min(3, j) + 1):
                branches.setdefault(tuple(t[j - length : j]), Counter())[w] += 1
    root = lambda w: max(c[w] - discount, 1e-12) / total if c[w] else max(discount * len(c) / total, 0.5 / total)

    def p(context, w):
        if not context:
            return root(w)
        n = branches[context]
        return (max(n[w] - 0.5, 0) + 0.5 * len(n) * p(context[1:], w)) / n.total()

    gain = {s: sum(x * math.log(x / n.total() / p(s[1:], w)) for w, x in n.items()) - len(n) * math.log(total) for s, n in branches.items() if n.total() >= 2}
    unsure = {s for s, g in gain.items() if abs(g) < 1e-3 * branches[s].total()}  # probabilities travel rounded
    ruled_out = [s for s, n in branches.items() if len(s) == 3 and n.total() >= 2 and n.total() * math.log(branches[s[1:]].total() / n.total()) < math.log(total * (1 - max(discount, 0.5)))]
    assert len(ruled_out) > 1000 and all(gain[s] < 0 for s in ruled_out)  # what is never sent could not have stayed
    for r in score_texts(docs).collect():
        t, low, high = tokens[r.doc_id], 0.0, 0.0
        for j, w in enumerate(t):
            states = []  # the longest context that stays; with unsure ones, all that it may be
            for s in [*(tuple(t[j - k : j]) for k in range(min(3, j), 0, -1)), ()]:
                if s in unsure or not s or gain.get(s, -1) >= 0:
                    states.append(math.log10(p(s, w)))
                if not s or (s not in unsure and gain.get(s, -1) >= 0):
                    break
            low, high = low + min(states), high + max(states)
        assert low * (1 + 1e-6) <= r.score <= high * (1 - 1e-6), (r, low, high)


def test_mix(spark, edge_docs, no_docs):
    got = mix_sources(edge_docs).collect()
    assert len(got) == edge_docs.count() and all(r.taken == r.copies * r.size <= 3 * r.size for r in got)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix_sources(edge_docs.repartition(7)).collect()), key=repr)
    assert mix_sources(no_docs).count() == 0


def test_targets_stop_at_three_times_a_source(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 980)], "source string, size long")
    got = {r.source: r.target for r in source_targets(sizes).collect()}
    assert math.isclose(sum(got.values()), 2000) and got["b"] == 30 and got["c"] == 30 and math.isclose(got["a"], got[None])


def test_inclusion_follows_size(spark):
    """Factors by bisection; over many seeds a document is included as often as its probability says."""
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 7 * (1 + i % 3))), "ab"[i % 5 == 0]) for i in range(120)], "doc_id long, text string, source string")
    sizes, targets, times = {}, {}, Counter()
    for seed in range(6):
        for r in mix_sources(docs, seed=f"s{seed}").collect():
            sizes[r.doc_id] = (r.source, r.size)
            targets[r.source] = (r.target, r.source_size)
            times[r.doc_id] += r.copies
    for source, (target, total) in targets.items():
        base, rest = divmod(target, total)
        own = [i for i, (s, _) in sizes.items() if s == source]
        low, high = 0.0, 1.0
        for _ in range(100):
            f = (low + high) / 2
            low, high = (f, high) if sum(sizes[i][1] * min(1, f * sizes[i][1]) for i in own) < rest else (low, f)
        for size in {sizes[i][1] for i in own}:
            same = [i for i in own if sizes[i][1] == size]
            p = min(1, low * size)
            got = sum(times[i] for i in same) / 6 / len(same) - base
            assert abs(got - p) <= 0.03 + 4 * math.sqrt(p * (1 - p) / 6 / len(same)), (source, size, got, p)


def test_every_source_comes_near_its_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    per = {}
    for r in mix_sources(docs).collect():
        t = per.setdefault(r.source, [r.target, 0, 0])
        t[1], t[2] = t[1] + r.taken, max(t[2], r.size)
    assert all(abs(taken - target) <= largest for target, taken, largest in per.values())


def test_later_copies(spark):
    rows = [(3, "a", 0), (1, "a", 0), (1, "a", 1), (2, None, 0), (4, "", 0), (None, "a", 0), (5, "b", 0), (6, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _first long")  # a null text counts as empty
    for broadcast_rows in (100, 0):
        got = later_copies(docs, broadcast_rows)
        assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [3, 4, 6]
    assert later_copies(docs.where("false")).count() == 0


def test_blocks_of_the_language_model_travel_as_numbers():
    """Words are cut and hashed once for a block; what later steps read is smaller than its texts."""
    from tidewright.llm.suffix_tree_lm import END, _Block

    table = pa.table([pa.array([5, 3, -(2**63), 9], pa.int64()), pa.array(["a B c A", None, "\u00e9 b", " x" * 500])], ["doc_id", "text"])
    block = _Block(table, 3)
    payload = block.packed(True)
    again = _Block(pa.table({"block": [0], "payload": [payload]}), 3)
    for name in ("ids", "at", "names", "place", "sent", "train", "learns"):
        assert getattr(block, name).tolist() == getattr(again, name).tolist(), name
    words = again.vocabulary.to_pylist()
    assert [[words[i] for i in again.place[a:b]] for a, b in zip(again.at[:-1], again.at[1:], strict=True)] == [["\u00e9", "b", END], [END], ["a", "b", "c", "a", END], ["x"] * 500 + [END]]
    assert len(_Block(table.slice(3), 3).packed(False)) < 500
