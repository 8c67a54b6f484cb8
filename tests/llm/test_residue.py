"""Residue on hand-made documents, the links against brute force, and edge cases."""

import random

from loomrecall.llm import residue as R

REAL = "The poller counts late rows. It took 9 ms to drain the queue. We decided to keep the audit trail because the order was unstable. See the notes."
CASES = [
    (f"{REAL} The rollout of {{{{ version }}}} starts soon.", "field"), (f"{REAL}\nContact: @@OWNER@@", "field"), ("# ${REGION_NAME}\n" + REAL, "field"), (f"{REAL} by ____________", "field"),
    (f"{REAL} The renderer replaces `{{{{ goal }}}}` with the value.", None), (f"{REAL}\n```\n# {{% team %}}\nowner: <name goes here>\n```\nAll fields are filled.", None), ("# Plan\n\nLorem ipsum dolor sit amet velit erat massa.", "body"),
    ("The importer dropped 9 pages that held only lorem ipsum text, as agreed. " + REAL, None), ("Menu  Projects  Graph\n503 Service Unavailable\ncode=503", "body"), (f'{REAL} We saw "503 Service Unavailable" 47 times in the log.', None),
    ("Skip to content\nThis dashboard needs JavaScript to run.\nLoading...", "body"), ("To use the panel, enable JavaScript in the view first. " + REAL, None), ("Seite nicht gefunden (Fehler 404)\nDie angeforderte Seite existiert nicht mehr.", "body"),
    ("Summary: TBD\nRisks: TBD\nNext: to be written", "body"), ("foo bar blah asdf qwer test test xxx", "body"), ('{"error":{"status":429,"message":"too many requests"}}', "body"), (REAL, None), ("", None), ("   \n", None), (None, None), (REAL * 900, None),
]


def test_cases_and_edges(spark):
    rows = [(i, t, "clash", "c") for i, (t, _) in enumerate(CASES)] + [(900, CASES[8][0], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, kind string")
    got = {r.doc_id: r.kind for r in R.find_residue(df).collect()}
    assert got == {**{i: k for i, (_, k) in enumerate(CASES) if k}, 900: "body"}
    assert R.find_residue(df.limit(0)).count() == 0


def test_propagation(spark):
    seed = "Access denied. the quick page about " + " ".join(f"w{i}" for i in range(60))
    near = seed.replace("Access denied.", "Denied access.")
    df = spark.createDataFrame([(1, "Access denied."), (2, seed), (3, near), (4, REAL)], "doc_id long, text string")
    got = {r.doc_id: r.propagated for r in R.find_residue(df).collect()}
    assert got[1] is False and got.get(2) is not None and 4 not in got
    assert 3 not in got or got[3] is True


def test_tables_hold_all_prints_within_hamming(spark):
    random.seed(4)
    sims = [random.getrandbits(64) - (1 << 63) for _ in range(40)]
    sims += [s ^ (1 << random.randrange(63)) ^ (1 << random.randrange(63)) ^ (1 << random.randrange(63)) for s in sims] + sims[:3]
    df = spark.createDataFrame([(bytearray(str(i).encode()), s) for i, s in enumerate(sims)], "node binary, sim long")
    got = {bytes(r.b) for r in R.print_candidates(df.where("node < '2'"), df).collect()}
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3
    assert got == {str(i).encode() for i, s in enumerate(sims) if any(near(s, x) for k, x in enumerate(sims) if str(k) < "2")}


def test_simhash_is_the_majority_of_bits():
    grams = R.shingles("a b c d e f g h".split())
    bits = [sum(int(g) >> k & 1 for g in grams) * 2 > len(grams) for k in range(64)]
    assert R.simhash(grams) & (2**64 - 1) == sum(b << k for k, b in enumerate(bits))
