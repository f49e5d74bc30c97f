"""Token alignment against whole texts tokenized at once, with ends counted from decoded bytes."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

from tidewright.llm import token_alignment
from tidewright.llm.token_alignment import _CUT, Aligner, align_tokens, byte_alphabet, op12_token_alignment

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(text, coders):
    """(id, bytes) of both, or two empty lists."""
    a, b = coders
    alphabet = byte_alphabet()
    own = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    other = [(i, bytes([int(p[3:5], 16)]) if (p := b.id_to_piece(i)).startswith("<0x") else p.replace("▁", " ").encode()) for i in b.encode(text)]
    want = (" " + text).encode()
    return (own, other) if text and b"".join(x for _, x in own) == want == b"".join(x for _, x in other) else ([], [])


def brute(rows, coders):
    found = []
    for d, text in rows:
        own, other = tokens(text or "", coders)
        ends = []
        for side in (own, other):
            at, out = 0, []
            for _, x in side:
                at += len(x)
                out.append(at)
            ends.append(out)
        groups, before = [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(t[0]) for t, e in zip(side, es, strict=True) if before < e <= end) for side, es in zip((own, other), ends, strict=True)))
            before = end
        at = defaultdict(list)
        for (i, _), e in zip(own, ends[0], strict=True):
            at[e].append(i)
        links = [(i, j) for (j, _), e in zip(other, ends[1], strict=True) for i in at[e]]
        found.append((d, len(own), len(other), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if own else ""))
    count = Counter(x for f in found for x in f[4])
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return sorted(((d, a, b, g, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha) for d, a, b, g, links, sha in found), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


ODD = [
    "a é\U0001f600 ﷽ x\n\ny  z", "trail ", "trail   ", " ", "   ", "   three  \n  x \t y", "▁ in a text", "a ▁", "", None, "\x00", "a\x85 b  c\x1c d", "é" * 50 + " " + "\U0001f468‍\U0001f469", "<|endoftext|> <s> </s> <unk> <0x41>",
    "don't  can't I'm we're", "１２ ﬁ 　 x 　y", "x" * 3000, "word " * 3000, "ẞ﷽ẞ ﷽﷽ ทดสอบ ภาษาไทย 日本語 テスト", "\r\n\r\n a\r b", "a  b   c", "123456789 3.14 -- !!! ???", "�", "\U000e0001 tags",
]


@pytest.mark.parametrize("hot", [1, 20, 200_000])
def test_equals_whole_texts(spark, coders, hot):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "same id"), (None, "no id"), (None, None)] + [(100 + i, "a copy of one text") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("pairs", F.lit("clash"))
    assert got(align_tokens(docs, hot=hot)) == brute(rows, coders)


def test_memory_that_starts_anew(spark, coders, monkeypatch):
    monkeypatch.setattr(token_alignment, "REMEMBERED", 8)
    aligner = Aligner()
    memory, sizes = token_alignment._Memory(aligner), []
    for _ in range(3):
        for text in [*ODD, *ODD[:3], "a a b b", "a b c", "b b b d"]:
            (n, digest, pairs), own = next(memory.texts([text])), tokens(text or "", coders)
            fresh = next(token_alignment._Memory(aligner).texts([text]))
            assert n[:2] == [len(own[0]), len(own[1])] and (n, digest, pairs.tolist()) == (fresh[0], fresh[1], fresh[2].tolist())
            sizes.append(len(memory.groups))
    assert min(sizes[3:]) < max(sizes) / 4


def test_ends_from_offsets_are_those_of_decoded_bytes(coders):
    aligner = Aligner()
    for text in ODD:
        for stretch in [*_CUT.split(" " + text), " " + text] if text and "▁" not in text else []:
            for ids, ends, whole, known in ((*aligner.a_ends(stretch, stretch.encode()), aligner.a_bytes), (*aligner.b_ends(stretch, stretch.encode()), aligner.b_bytes)):
                assert whole and ends.tolist() == [sum(len(known[i]) for i in ids[: k + 1]) for k in range(len(ids))], stretch


def test_stretches_together_are_those_one_by_one():
    aligner = Aligner()
    stretches = list(dict.fromkeys(s for t in ODD if t for s in _CUT.split(" " + t) if not s[-1].isspace()))
    assert any("▁" in s for s in stretches)
    groups, counts, pairs = aligner.align(stretches)
    each = [aligner.align([s]) for s in stretches]
    assert groups == [e[0][0] for e in each] and counts.tolist() == [e[1][0].tolist() for e in each] and pairs.tolist() == [x for e in each for x in e[2].tolist()]
    assert sum(counts[:, 4]) >= 1


def test_byte_alphabet(coders):
    alphabet = byte_alphabet()
    assert sorted(alphabet.values()) == list(range(256)) and set(alphabet) <= set(coders[0].get_vocab())
    assert ByteLevel().decode([c for c, b in alphabet.items() if b < 128]) == "".join(chr(b) for b in alphabet.values() if b < 128)


def test_edge_rows_and_empty_table(spark, coders, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    assert got(align_tokens(edge_docs)) == brute(rows, coders)
    assert got(align_tokens(no_docs)) == []


def test_query_equals_brute_force(spark, small, coders):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op12_token_alignment(spark, small)) == brute(rows, coders)


def test_stretches_are_met_once_and_tokenized_in_large_parts():
    words = ["a\x85 b", "c  d", "e  f　 g", "h  i", "j  k  l", "m” n— o", "p\x1c q\x7f r", "\U0001f600 s  t ", " u", "é v", "x\t y\n z", "0", " "]
    texts = [*words, " ".join(words), *ODD]
    met, which, begin = token_alignment._stretches(pa.array([t for t in texts if t], pa.large_string()))
    parts = [[met[i].as_py() for i in which[a:b]] for a, b in zip(begin, [*begin[1:], len(which)], strict=True)]
    assert parts == [_CUT.split(" " + t) for t in texts if t] and len(met) == len(set(met.to_pylist()))
    aligner, calls = Aligner(), []
    memory, align = token_alignment._Memory(aligner), aligner.align
    aligner.align = lambda part: calls.append(len(part)) or align(part)
    list(memory.texts([" ".join(f"w{i} w{i}" for i in range(2000))]))
    assert sum(calls) == 2000 and len(calls) == 2
