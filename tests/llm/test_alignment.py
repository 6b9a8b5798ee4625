"""Alignment of two tokenizers, against offsets in plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from inkwell.llm import alignment as A
from inkwell.llm import queries as Q

FIRST, SECOND = Q.tokenizer_path("byte_bpe_50k.json"), Q.tokenizer_path("piece_bpe_32k.model")
HARD = [
    None, "", " ", "  two  spaces ", "one", "The quick brown fox, isn't it?", "<|endoftext|> is text, so are <s> and </s> and <0x41>.",
    "▁ is given back as a space", "😀😀 日本語のテキスト é ﬁ ſ", "tabs\t\tand\n\n\nlines\r\n", "=" * 300, "a" * 5000, "\x00\x01\x7f",
    "same same same same same", "same same same same same", "𝒳" * 40, "word " * 3000, "Ａｂｃ ㎏ ½",
]


def brute(texts):
    first, second = A.tokenizer_of(FIRST), A.tokenizer_of(SECOND)
    docs = []
    for text in texts:
        out = {"n_a": 0, "n_b": 0, "n_groups": 0, "links": Counter(), "groups": ""}
        if text:
            ids = [first.tokenizer.encode(" " + text, add_special_tokens=False).ids, second.model.encode(text)]
            joined = [[t.pieces[i] for i in x] for t, x in zip((first, second), ids, strict=True)]
            if all(b"".join(j) == (" " + text).encode() for j in joined):
                ends = []
                for j in joined:
                    at, own = 0, []
                    for p in j:
                        at += len(p)
                        own.append(at)
                    ends.append(own)
                cuts = sorted(set(ends[0]) & set(ends[1]))
                pieces, before = [], 0
                for cut in cuts:
                    parts = [[i for i, e in zip(x, own, strict=True) if before < e <= cut] for x, own in zip(ids, ends, strict=True)]
                    pieces.append("|".join(",".join(map(str, p)) for p in parts))
                    for a in parts[0]:
                        for b in parts[1]:
                            out["links"][a, b] += 1
                    before = cut
                out |= {"n_a": len(ids[0]), "n_b": len(ids[1]), "n_groups": len(cuts), "groups": hashlib.sha256(";".join(pieces).encode()).hexdigest()}
        docs.append(out)
    count = Counter(p for d in docs for p in d["links"])
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return [
        (d["n_a"], d["n_b"], d["n_groups"], sum(d["links"].values()), sum(n for p, n in d["links"].items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in d["links"].items()), d["groups"])
        for d in docs
    ]


def seen(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(HARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, pairs int, n_a string")


@pytest.mark.parametrize("hot", [0, 3, 100_000])
def test_hard_texts_whatever_is_broadcast(spark, hard, hot):
    assert seen(A.link_documents(hard, FIRST, SECOND, hot=hot)) == dict(enumerate(brute(HARD)))


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert seen(Q.op11_token_alignment(spark, sf)) == dict(zip([r.doc_id for r in rows], brute([r.text for r in rows]), strict=True))


def test_ids_by_rank_are_the_library_s(spark):
    """Over all different words of a table, with what stands before them."""
    one = A.tokenizer_of(FIRST)
    assert one.ranks is not None
    words = set()
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect():
        words.update(re.findall(r"\s?\S+", r.text or ""))
    words = sorted(words)
    for i in range(0, len(words), 50_000):
        own = words[i : i + 50_000]
        assert one.encode(own) == [e.ids for e in one.tokenizer.encode_batch([" " + w for w in own], add_special_tokens=False)]


def test_links_in_small_runs_and_long_groups(spark, hard, monkeypatch):
    one, two = A.tokenizer_of(FIRST), A.tokenizer_of(SECOND)
    good, a, b, sizes = A._kept_ids([t or "" for t in HARD], one, two)
    x = A.aligned(a, b, sizes, *(np.array([len(p) for p in t.pieces]) for t in (one, two)))
    want = A.linked_pairs(x, 16)
    for limit in (1, 2, 7, 100):
        monkeypatch.setattr(A, "LINKS", limit)
        assert all(np.array_equal(p, q) for p, q in zip(A.linked_pairs(x, 16), want, strict=True))


def test_detail_gives_tokens_and_cuts(spark, hard):
    one, two = A.tokenizer_of(FIRST), A.tokenizer_of(SECOND)
    rows = {r.doc_id: r for r in A.align_documents(hard, FIRST, SECOND, detail=True).collect()}
    for i, text in enumerate(HARD):
        r = rows[i]
        assert len(r.a_ids) == r.n_a and len(r.b_ids) == r.n_b and len(r.cuts) == len(r.a_ends) == len(r.b_ends) == r.n_groups
        before = (0, 0, 0)
        for cut, a, b in zip(r.cuts, r.a_ends, r.b_ends, strict=True):
            raw = (" " + text).encode()[before[0] : cut]
            assert raw == b"".join(one.pieces[k] for k in r.a_ids[before[1] : a]) == b"".join(two.pieces[k] for k in r.b_ids[before[2] : b])
            before = (cut, a, b)


def test_repeated_rows_null_ids_and_no_rows(spark, hard):
    rows = [(1, "one two"), (1, "one two"), (None, "one two"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([(r.n_a, r.n_links, r.n_best, r.count_sum) for r in A.link_documents(df, FIRST, SECOND).collect()])
    assert got == [(0, 0, 0, 0)] + [(2, 2, 2, 6)] * 3
    assert A.link_documents(df.limit(0), FIRST, SECOND).count() == 0
