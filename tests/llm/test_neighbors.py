"""IVF-PQ against brute force, with ties, copies, odd rows and empty tables."""

import datetime as dt

import numpy as np

from loomrecall.llm import neighbors as N

SCHEMA = "record_id string, provider_key string, model string, dimension int, configured_dimension int, embedding array<float>, status string, updated_at timestamp_ntz, vec string, cell int"


def row(i, v, p="a", s="ready", t=0, d=None, c=None):
    d = len(v) if d is None and v is not None else (d or 0)
    return (i, p, "m", d, d if c is None else c, None if v is None else [float(x) for x in v], s, dt.datetime(2025, 1, 1) + dt.timedelta(minutes=t), "x", 1)


def brute(rows, k=5, floor=0.8):
    out = set()
    for p in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == p), key=lambda r: r[0])
        x = np.array([r[5] for r in own], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x @ x.T
        for a in range(len(own)):
            order = sorted((b for b in range(len(own)) if b != a and s[a, b] >= floor), key=lambda b: (-round(s[a, b], 9), own[b][0]))[:k]
            out |= {tuple(sorted((own[a][0], own[b][0]))) for b in order}
    return out


def test_recall(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(60):
        base = rng.normal(size=32)
        rows += [row(f"r{c:03d}-{j:02d}", base + rng.normal(size=32) * rng.choice([0.05, 0.5]), p="ab"[c % 2]) for j in range(20)]
    want = brute(rows)
    got = {tuple(r) for r in N.similar_pairs(N.similar_vectors(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_copies_ties_and_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [row(f"c{i}", v) for i in range(9)] + [row("d", [1.0, 2.0, 3.1]), row("e", [1.0, 2.0, 3.1]), row("far", [-3.0, 1.0, 0.0]), row("solo", v, p="other")]
    odd = [row("n1", None, d=3), row("n2", []), row("n3", [0, 0, 0]), row("n4", [float("nan"), 1, 1]), row("n5", [float("inf"), 1, 1]), row("n6", v, s="failed"), row("n7", v, c=4), row("n8", v, d=4, c=4), row("c0", [9, 9, -9], t=-5), row("old", v, t=0), row("old", v, s="failed", t=1), (None, *row("x", v)[1:])]
    got = {tuple(r) for r in N.similar_pairs(N.similar_vectors(spark.createDataFrame(rows + odd + rows[:3], SCHEMA))).collect()}
    want = set()
    for q in [f"c{i}" for i in range(9)]:
        want |= {tuple(sorted((q, b))) for b in [f"c{i}" for i in range(9) if f"c{i}" != q][:5]}
    want |= {("d", "e")} | {tuple(sorted((q, f"c{i}"))) for q in "de" for i in range(4)}
    assert got == want
    assert N.similar_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lists_grow():
    assert [N.list_count(n, 64) for n in (10**4, 10**6, 10**8)] == [400, 4000, 40_000] and N.list_count(10**12, 1536) == 5208
    assert N.block_rows(64) == 65_536 and N.block_rows(1536) == 5208


def test_quantizer_bounds():
    rng = np.random.default_rng(1)
    x = N._unit(rng.normal(size=(500, 20))).astype(np.float32)
    m = N.train(x, 500)
    near = (x @ m["coarse"].T).argmax(1)
    codes, err = N.encode(x, near, m)
    parts = np.concatenate([m["books"][i][codes[:, i]] for i in range(len(m["books"]))], axis=1)[:, :20]
    approx = m["coarse"][near] + parts
    q = N._unit(rng.normal(size=(50, 20)))
    assert (np.abs(q @ x.T - q @ approx.T) <= err[None, :] + 1e-5).all()


def test_hot_classes_many_models_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 3)
    monkeypatch.setattr(N, "MODEL_BYTES", 9_000)
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [row(f"{p}{i:03d}", rng.normal(size=6), p=p) for p in "abc" for i in range(60)]
    rows += [row(f"hot{i:02d}", rows[5][5], p="a") for i in range(40)] + [row("none1", rows[3][5], p=None), row("none2", rows[3][5], p=None)]
    got = {tuple(r) for r in N.similar_pairs(N.similar_vectors(spark.createDataFrame(rows, SCHEMA), probes=64)).collect()}
    want = brute([r for r in rows if r[1]]) | {("none1", "none2")}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert {x for x in got if x[0].startswith("hot") and x[1].startswith("hot")} == {x for x in want if x[0].startswith("hot") and x[1].startswith("hot")}
