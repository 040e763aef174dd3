"""Rows that repeat an id with other texts, and rows without an id, in every operator that removes or changes rows."""

import random

from tessera.llm import near_duplicates, private_data
from tests.llm.test_contexts import settled


def frame(spark, rows):
    return spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int").coalesce(1)


def words(seed, n=40):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))


def test_links_of_rows_that_share_an_id(spark):
    a, b = words(1), words(2)
    df = frame(spark, [(1, a), (1, b), (2, f"{b} z"), (3, f"{a} z")])
    assert {(r.doc_id, r.component_id) for r in near_duplicates.near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert sorted(r.k for r in near_duplicates.without_copies(df).collect()) == [0, 1]


def test_links_of_rows_without_an_id(spark):
    a, b = words(3), words(4)
    df = frame(spark, [(None, a), (None, f"{a} z"), (None, b), (7, f"{b} z"), (None, None), (8, ""), (8, b), (8, b)])
    made = near_duplicates.near_duplicates(df).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in made)  # also where both are null
    got = {(r.doc_id, r.n_shingles > 0, r.component_id) for r in made}
    assert (7, True, 7) in got and (8, True, 7) in got and (None, True, 7) in got and (None, True, None) in got
    assert sorted(r.k for r in near_duplicates.without_copies(df).collect()) == [0, 3, 4, 5]


def test_only_the_own_spans_are_masked(spark):
    texts = [(i, f"please call +49 30 12345{i:03d} now") for i in range(10)] + [(50, "please call 030 7654321 now"), (50, "z" * 40), (None, "please call 030 7654399 now"), (None, "z" * 40)]
    out = {r.k: r.text for r in private_data.redacted_documents(frame(spark, texts)).collect()}
    assert out[10] == out[12] == "please call <phone> now" and out[11] == out[13] == "z" * 40


def spans_by_force(texts):
    edges, open_spans = [], []
    for row, t in enumerate(texts):
        base = private_data.fixed_spans(t)
        for s, k, e in base:
            edges += [(p, t[s:e], k, "") for p in private_data.contexts(t, s, e)]
        for s, e, allowed, pats in private_data.unknowns(t, base):
            edges += [(p, t[s:e], -1, allowed) for p in pats]
            open_spans.append((row, s, e, allowed.split(","), pats))
    good = settled(edges)
    out = {row: [] for row in range(len(texts))}
    for row, s, e, allowed, pats in open_spans:
        hits = [(c, -k) for (p, k), c in good.items() if p in pats and private_data.KINDS[k] in allowed]
        if hits:
            out[row].append((s, -max(hits)[1], e))
    return {row: sorted(private_data.fixed_spans(t) + out[row]) for row, t in enumerate(texts)}


def test_added_spans_by_force(spark):
    rng = random.Random(5)
    before, behind = ["please call", "ring", "card", "host", "write to", "it cost"], ["now", "today", "x", ""]
    entity = [lambda: f"+49 30 {rng.randrange(10**6, 10**7)}", lambda: f"030 {rng.randrange(10**6, 10**7)}", lambda: f"10.0.0.{rng.randrange(200)}", lambda: f"u{rng.randrange(40)}(at)example", lambda: f"u{rng.randrange(40)}@example.org"]
    texts = []
    for _ in range(400):
        k = rng.randrange(6)
        made = entity[rng.choice([0, 1]) if k < 2 else rng.choice([3, 4]) if k == 4 else 2 if k == 3 else rng.randrange(5)]()
        texts.append(f"{before[k]} {made} {rng.choice(behind)}")
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in private_data.found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = spans_by_force(texts)
    assert got == want and any(len(want[i]) > len(private_data.fixed_spans(t)) for i, t in enumerate(texts))


def test_contexts_reach_as_far_as_their_words():
    far = "call" + " " * 500 + "x" * 300 + ":"
    text = f"please {far} 030 7654321" + " " * 200 + "now then"
    s = text.index("030")
    assert private_data.contexts(text, s, s + 11) == ["x" * 300, "call " + "x" * 300, "x" * 300 + " _ now"]
    long = "a" * 200
    assert [x[:2] for x in private_data.unknowns(f"write {long}(at)host", [])] == [(6, 6 + 200 + 8)]
    spans = [(k, 0, k + 1) for k in range(10)]
    assert private_data.unknowns("030 7654321 more", [(0, 3, 11), *[(k, 0, k + 1) for k in range(1, 9)]]) == [] and spans
