"""Links and carried labels against brute force over all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from loomrecall.llm import residue as R


def similar(a, b):
    both = len(np.intersect1d(a, b))
    return 9 * both >= 4 * (len(a) + len(b))


def components(keys, links):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def brute(texts):
    grams = {k: R.shingles(R.judge(t)[0]) for k, t in texts.items()}
    keys = sorted(texts)
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if similar(grams[a], grams[b])]
    return pairs, components(keys, pairs)


def changed(words, n, rnd):
    out = list(words)
    for i in rnd.sample(range(len(out)), n):
        out[i] = "y" + "".join(rnd.choice("abcdef") for _ in range(8))
    return out


def test_links_have_full_recall(spark):
    rnd = random.Random(7)
    texts = {}
    for c in range(25):
        words = [rnd.choice("abcdefghij") * 2 + rnd.choice("klmnopqrst") for _ in range(rnd.choice((7, 100, 300)))]
        for _ in range(4):
            texts[len(texts)] = " ".join(changed(words, round(len(words) * rnd.choice((0, 0.01, 0.02))), rnd))
            words = changed(words, round(len(words) * 0.02), rnd) if rnd.random() < 0.5 else words
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    judged = R.judged_documents(docs, R.frequent_shingles(docs, "doc_id", "text")).cache()
    node = {r.doc_id: bytes(r.node) for r in judged.select("doc_id", "node").collect()}
    pairs, want = brute(texts)
    assert len(pairs) > 50
    for step in (3, 7):
        seeds = {want[k] for k in texts if k % step == 0}
        marked = judged.withColumn("trusted", F.col("doc_id") % step == 0)
        got = {bytes(r.node) for r in R.reached_nodes(docs, marked).collect()}
        assert got == {node[k] for k in texts if want[k] in seeds}


def test_hot_keys_are_cut_and_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(R, "CELL", 5)
    rnd = random.Random(3)
    head = [f"h{chr(97 + i)}" for i in range(20)]
    texts = {i: " ".join(head + ["z" + "".join(rnd.choice("abc") for _ in range(2)) for _ in range(4)]) for i in range(60)}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    none = np.zeros(0, np.uint64)
    judged = R.judged_documents(docs, none).cache()
    node = {r.doc_id: bytes(r.node) for r in judged.select("doc_id", "node").collect()}
    some = judged.where("doc_id % 3 = 0")
    near = {frozenset((bytes(r.a), bytes(r.b))) for r in R.all_candidates(some, judged.unionByName(judged)).collect()}
    pairs, _ = brute(texts)
    assert pairs and {frozenset((node[a], node[b])) for a, b in pairs if node[a] != node[b] and (a % 3 == 0) != (b % 3 == 0)} <= near


def test_labels_reach_by_any_similar_pair(spark):
    """Jaccard similarity is not transitive: a label goes from a to c over b, where a and c are not similar."""
    rnd = random.Random(11)
    texts, trusted = {}, set()
    for _ in range(12):
        words = ["".join(rnd.choice("bcdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(3)) for _ in range(200)]
        trusted.add(len(texts))
        texts[len(texts)] = "Access denied. " + " ".join(words)
        for _ in range(3):
            words = changed(words, 3, rnd)
            texts[len(texts)] = "Denied access. " + " ".join(words)
    pairs, parts = brute(texts)
    assert any((a, a + 2) not in pairs and (a, a + 1) in pairs and (a + 1, a + 2) in pairs for a in trusted)
    seeds = {parts[k] for k in trusted}
    want = {k: k not in trusted for k in texts if parts[k] in seeds}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.propagated for r in R.find_residue(docs).collect()} == want
