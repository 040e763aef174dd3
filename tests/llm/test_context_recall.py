"""How many planted identifiers without a fixed pattern the contexts find, and how many look-alikes they leave alone."""

import random

import pytest

from tessera.llm import private_data

ASKING = ["please call", "ring me at", "my number is", "text us on"]
OTHER = ["it cost", "order number", "see item", "weighs about", "the"]


def digits(rng, n):
    return "".join(rng.choice("0123456789") for _ in range(n))


def planted(seed, n=2500):
    """Texts, the spans that contexts should add and those of look-alikes. Known numbers stand in asking contexts; unknown ones, in
    national form, in the same; the same form also stands behind words that no known number has, and behind "the", which both have."""
    rng = random.Random(seed)
    filler = [f"w{k}" for k in range(400)]
    texts, true, decoys = [], set(), set()
    for i in range(n):
        kind, words = i % 5, rng.choices(filler, k=rng.randrange(3, 30))
        if kind == 0:
            lead, number = rng.choice(ASKING), f"+{rng.randrange(30, 60)} {digits(rng, 3)} {digits(rng, 7)}"
        elif kind == 1:
            lead, number = rng.choice(ASKING), f"0{digits(rng, 2)} {digits(rng, 7)}"
        elif kind == 2:
            lead, number = rng.choice(OTHER), f"0{digits(rng, 2)} {digits(rng, 7)}"
        elif kind == 3:
            lead, number = "the", f"+{rng.randrange(30, 60)} {digits(rng, 3)} {digits(rng, 7)}" if rng.random() < 0.1 else f"0{digits(rng, 2)} {digits(rng, 7)}"
        else:
            texts.append(" ".join(words))
            continue
        cut = rng.randrange(len(words))
        before = " ".join([*words[:cut], lead])
        texts.append(" ".join([before, number, *words[cut:]]))
        span = (i, len(before) + 1, len(before) + 1 + len(number))
        if not number.startswith("+"):
            (true if kind == 1 else decoys).add(span)
    return texts, true, decoys


@pytest.mark.parametrize("seed", range(3))
def test_planted_contexts(spark, docs, seed):
    texts, true, decoys = planted(seed)
    rows = private_data.found(docs(texts)).collect()
    added = {(r.doc_id, s.start, s.end) for r in rows for s in r.spans if s.kind == 3 and not texts[r.doc_id][s.start : s.end].startswith("+")}
    recall, precision = len(added & true) / len(true), len(added & true) / max(1, len(added))
    print(f"seed {seed}: {len(true)} planted, {len(decoys)} look-alikes, recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.95 and precision >= 0.98
