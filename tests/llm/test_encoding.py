"""Token ids against the public library, and on edge cases."""

import os
import random

import pytest

from loomrecall.llm import encoding as E

pytestmark = pytest.mark.skipif(not os.path.isdir(E.TOKENIZERS), reason="no vocabulary files here")

TEXTS = ["", "  ", None, "<|endoftext|> a", "a" * 5000, "=-" * 4000, "ab" * 333 + "​́" * 99, "日本語のメモ" * 300, " \n\n\t x  " * 50, "aaaaaaa" * 37, "x" * 65, "don't I'LL 123456789" * 20, "🚀👩‍💻 naïve", "퟿￿", "a" * 200_000]


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{E.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_same_as_library():
    random.seed(0)
    texts = TEXTS + ["".join(random.choice("abcdef ghij é日‍\n0'") for _ in range(random.randrange(200))) for _ in range(400)]
    e = E.Encoder(E.load_vocabulary())
    got = [x for a, b in E.portions(texts, 50_000) for x in e.encode(texts[a:b]).to_pylist()]
    assert got == reference(texts)


def test_cache_overflow(monkeypatch):
    monkeypatch.setattr(E, "CACHE", 10)
    e = E.Encoder(E.load_vocabulary())
    texts = [f"word{i} other{i}" for i in range(60)]
    assert [e.encode([t]).to_pylist()[0] for t in texts] == reference(texts)


def test_table(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS[:6])] + [(0, "", "again")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in E.encode_corpus(df).collect())
    assert got == sorted([*enumerate(reference(TEXTS[:6])), (0, [])])
    assert E.encode_corpus(df.limit(0)).count() == 0
