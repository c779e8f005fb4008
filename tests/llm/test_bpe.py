import hashlib
import random

import numpy as np

from loomspan.llm import bpe
from tests_llm_helpers import library

TEXTS = ["", "a", "Hello world's  end\n\n  x", "  ", "\n", "tabs\t\there \n ", "naïve café 123 ½ ², x²", "日本語 and العربية 12٣", "it's we'll I'D", "e\u0301 \u00a0 \u2003z", "<|endoftext|> x", "😀😀 zz", "a" * 3000]


def naive(word, table):
    parts = [bytes([b]) for b in word]
    while True:
        found = [(table[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in table]
        if not found:
            return [table[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_as_a_naive_loop_and_the_library():
    table, enc, rng = bpe.ranks(bpe.tokenizer_path()), library(), random.Random(9)
    words = [b"a", b"hello", b" antidisestablishmentarianism", b"\xff\xfe\x00", b"ab" * 400, "日本語の文章".encode() * 30]
    words += [bytes(rng.choice(b" etaoinshrdlu") for _ in range(rng.randrange(1, 300))) for _ in range(150)] + [rng.randbytes(rng.randrange(1, 200)) for _ in range(60)]
    for w in words:
        assert bpe.merge(w, table) == naive(w, table) == ([table[w]] if w in table else bpe._merge_long(w, table))
    for w in ("hello", "antidisestablishmentarianism" * 9, "ß" * 200):
        assert bpe.merge(w.encode(), table) == enc.encode_ordinary(w)


def test_equal_words_meet(spark):
    """All blocks' copies of a word are in one bucket, and blocks and words come from one shuffle."""
    rows = [(i, "unlikelyword" * 2 + f" own{i}x ") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    dealt = bpe._dealt(bpe.blocks_of(docs).repartition("block"), 16).collect()
    held = [r.bucket for r in dealt if b"unlikelyword" * 2 in bpe._listed(*bpe._expand(bytes(r.data))[1:])]
    assert len(held) > 1 and len(set(held)) == 1
    plan = bpe.encode_documents(docs)
    plan.collect()
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()


def test_pretokens_and_ids_as_the_library():
    import regex

    import public_tokenizers

    every = regex.compile(public_tokenizers.PATTERN)
    for t in TEXTS:
        assert bpe.pretokens(t) == every.findall(t)
        enc = library()
        assert enc.encode_ordinary(t) == [x for w in bpe.pretokens(t) for x in enc.encode_ordinary(w)]


def test_pack():
    x = np.array([0, 1, 127, 128, 300, 1 << 14, 1 << 21, 1 << 28, (1 << 32) - 1])
    assert (bpe.unpack(bpe.pack(x)) == x).all() and len(bpe.unpack(bpe.pack(x[:0]))) == 0


def test_round_trip(spark, docs, corpus, empty, odd):
    rows = [(1000 + i, t) for i, t in enumerate(TEXTS)] + corpus
    enc = library()
    got = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), keep_ids=True)
    by = {r.doc_id: r for r in got.collect()}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        r = by[i]
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), t or "")
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(empty).collect() == [] and bpe.encode_documents(odd).count() == 6


def test_equal_blocks(spark):
    rows = [(7, "some unlikelywords in equal blocks")] * 4
    got = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), keep_ids=True).collect()
    assert [r.ids for r in got] == [library().encode_ordinary(rows[0][1])] * 4
