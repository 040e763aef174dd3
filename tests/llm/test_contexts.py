"""Contexts that found identifiers bring in, and confidences, against plain iteration."""

import random

import pytest

from tessera.llm import private_data

EDGES = "pattern string, instance string, kind int, allowed string"


def settled(edges, support=5, confidence=0.8, doubt=0.1):
    """Plain rounds until no pattern is added; edges as (pattern, instance, kind, allowed)."""
    links = sorted({(p, i, k, tuple(x for x in a.split(",") if x)) for p, i, k, a in edges})
    known, unknown, seeds, good = {}, {}, {}, {}
    for p, _, k, _ in links:
        of = known if k >= 0 else unknown
        of[p] = of.get(p, 0) + 1
        if k >= 0:
            seeds[p, k] = seeds.get((p, k), 0) + 1
    free = [(p, i, private_data.KINDS.index(x)) for p, i, k, a in links if k < 0 for x in a]
    while True:
        believed = dict.fromkeys(seeds, 0)
        for p, i, k in free:
            others = any(o != p and (o, k) in good for o, j, m in free if j == i and m == k)
            believed[p, k] = believed.get((p, k), 0) + others
        new = {}
        for (p, k), b in believed.items():
            have = seeds.get((p, k), 0) + b
            share = have / (known.get(p, 0) + b + doubt * (unknown.get(p, 0) - b) + 1)
            if have >= support and share >= confidence:
                new[p, k] = share
        if new.keys() == good.keys():
            return new
        good = new


def confident(spark, edges):
    return {(r.pattern, r.kind): r.confidence for r in private_data.confident_patterns(spark.createDataFrame(edges, EDGES)).collect()}


@pytest.mark.parametrize(("seeds", "unknown"), [(10, 10), (1000, 1000), (1000, 9000)])
def test_scores_settle(spark, seeds, unknown):
    """Unknown instances do not make a pattern sure by themselves, however many stand behind it."""
    edges = [("call", f"s{i}", 3, "") for i in range(seeds)] + [("call", f"u{i}", -1, "card,phone") for i in range(unknown)]
    share = seeds / (seeds + 0.1 * unknown + 1)
    assert confident(spark, edges) == pytest.approx({("call", 3): share} if share >= 0.8 else {}, abs=1e-9)


@pytest.mark.parametrize("seed", range(3))
def test_scores_by_plain_iteration(spark, seed):
    rng = random.Random(seed)
    edges = []
    for p in range(12):
        edges += [(f"p{p}", f"s{rng.randrange(60)}", 3 if rng.random() < 0.97 else 2, "") for _ in range(rng.choice([0, 0, 12, 40]))]
        edges += [(f"p{p}", f"u{rng.randrange(40)}", -1, "phone" if p % 4 else "card,phone") for _ in range(rng.choice([5, 15, 40]))]
    # the shape belongs to the string
    shape = {}
    edges = [(p, i, k, shape.setdefault(i, a) if k < 0 else a) for p, i, k, a in edges]
    want = settled(edges)
    assert want and confident(spark, edges) == pytest.approx(want, abs=1e-9)


def test_found_identifiers_bring_in_contexts(spark, docs):
    texts = [f"please call +49 30 12345{i:02d} now" for i in range(10)] + [f"please call 030 76543{i:02d} now" for i in range(10)]
    texts += [f"or ring 030 76543{i:02d} now" for i in range(10)] + ["or ring 040 1112223 now", "it cost 040 1112223 now"]
    rows = {r.doc_id: r.spans for r in private_data.found(docs(texts)).collect()}
    assert [(s.kind, s.start, s.end) for s in rows[30]] == [(3, 8, 19)] and rows[31] == []
    assert all(len(rows[i]) == 1 for i in range(30))
