"""Duplicates, rules, personal data, toxicity and scores, against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup, multi_index, near_duplicates, partial_matching, private_data, quality_rules, queries, toxic_spans

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def copies(seed=3, groups=12):
    """Texts with exact copies, near copies at many distances, and unrelated ones."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(8, 120))]
        out += [" ".join(base)] * 2
        for edits in (1, 1, 2, 3, 5):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            out.append(" ".join(t).upper() if edits == 3 else " ".join(t))
    return out


def components_by_force(texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(texts)))
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("blocks", [False, True])
def test_near_duplicates(spark, docs, edges, monkeypatch, blocks):
    if blocks:  # every group is hot, and nodes branch
        monkeypatch.setattr(near_duplicates, "BLOCK_CLASSES", 3)
    texts = edges + copies()
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(docs(texts, True), small=2 if blocks else 128).collect()}
    for i, (n, c) in enumerate(components_by_force(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, i == c)


def test_near_duplicates_of_nothing(spark, docs):
    assert near_duplicates.near_duplicates(docs([])).count() == 0
    assert near_duplicates.near_duplicates(docs([None, ""])).where("kept").count() == 2


def lines_by_force(texts, t=80):
    seen, out = [], []
    for text in texts:
        keep = []
        for line in (text or "").split("\n"):
            s = set(words(line))
            if s:
                hit = any(100 * len(s & o) >= t * len(s | o) for o in seen)
                seen.append(s)
                if hit:
                    continue
            keep.append(line)
        out.append(None if text is None else "\n".join(keep))
    return out


@pytest.mark.parametrize("first", [4, 0])
def test_line_dedup(spark, docs, edges, monkeypatch, first):
    monkeypatch.setattr(line_dedup, "FIRST", first)  # with 0 all goes the long way
    c = copies(7, 8)
    rng = random.Random(1)
    texts = edges + ["\n".join(rng.sample(c, 3) + ["short", ""]) for _ in range(25)]
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(docs(texts, True)).collect()}
    assert got == dict(enumerate(lines_by_force(texts)))


def test_line_dedup_keeps_columns_and_empty_tables(spark, docs):
    df = docs(["a b c d e f"], True)
    assert line_dedup.deduplicated(df).columns == df.columns
    assert line_dedup.deduplicated(docs([])).count() == 0


def rules_by_force(t):
    t = t or ""
    w = WORD.findall(t)
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hot = {j for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(hot) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hot), failed


def test_quality_signals(spark, docs, edges):
    texts = edges + ["a b c d e f a b c d e", "a a a a a a a", "x\ny\nx\n \nx", "#*$ %&| <>é"] + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r for r in quality_rules.signals(docs(texts, True)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules_by_force(t), i


def test_cutoffs_hold_the_risk(spark):
    for n, k, p in ((100, 3, 0.05), (40, 0, 0.02), (1000, 12, 0.01)):
        want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        assert spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0] == pytest.approx(want, rel=1e-9)


def test_verdicts_of_the_bound(spark):
    """As the exact tail says around n p, and without its terms where all of a large stratum is rejected."""
    p, level = 0.005, 0.0005
    cases = [(k, n) for n in (0, 1, 199, 2000, 3000, 9000) for k in range(0, min(n, 60) + 1, 3)]
    large = [(10**9, 10**9), (5 * 10**6, 10**9)]
    rows = spark.createDataFrame(cases + large, "k long, n long")
    rare = quality_rules.surely_rare(F.col("k"), F.col("n"), p, F.lit(level))
    got = {(r.k, r.n): r.rare for r in rows.select("k", "n", rare.alias("rare")).collect()}
    want = {(k, n): sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) <= level for k, n in cases}
    assert got == want | dict.fromkeys(large, False)
    assert any(want.values())
    docs = spark.createDataFrame([(i, ("word " * 9 + f"other{i} ") + ("### " * 5 if i >= 2900 else ""), "en") for i in range(3000)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 2905)) for i in range(3000)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_rules.judged(docs.withColumn("text", F.concat_ws(" ", *[F.md5(F.concat("doc_id", F.lit(k)).cast("binary")) for k in range(12)], F.when(F.col("doc_id") >= 2900, F.lit("### *** $$$ %%% &&& ||| <<< >>> " * 4)))), labels).collect()}
    assert all(kept[i] for i in range(2900)) and not any(kept[i] for i in range(2905, 3000))


def test_quality_of_nothing(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.judged(docs([]), none).count() == 0
    assert [r.kept for r in quality_rules.judged(docs([None, "a"]), none).collect()] == [False, False]


def spans_by_force(t):
    out = []
    kinds = {
        0: (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        1: (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        2: (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub("[^0-9]", "", s)) <= 19 and private_data.luhn(re.sub("[^0-9]", "", s))),
        3: (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    for k, (p, good) in kinds.items():
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t) if good(m[0])]
    return sorted(out)


def test_fixed_spans():
    rng = random.Random(2)
    parts = ["a@b.com", "x@y", "@", "+49 30 1234567", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", ".", "é", "001.002.003.255", "a.b%c@d-e.f.g@h.i", "+1"]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        assert private_data.fixed_spans(t) == spans_by_force(t), t


def test_contexts_discover_unseen_identifiers(spark, docs, edges):
    texts = [f"please call +49 30 12345{i:03d} now" for i in range(10)] + ["please call 030 7654321 now", "it cost 030 7654321 now"] + edges
    rows = {r.doc_id: r for r in private_data.found(docs(texts, True)).collect()}
    assert [(s.kind, s.start, s.end) for s in rows[10].spans] == [(3, 12, 23)] and rows[10].n_phone == 0 and rows[11].spans == []
    out = {r.doc_id: r.text for r in private_data.redacted_documents(docs(texts, True)).collect()}
    assert out[3] == "please call <phone> now" == out[10] and out[11] == texts[11] and out[12] is None
    assert rows[0].base_sha256 == hashlib.sha256(b"phone:12:27").hexdigest()
    assert private_data.found(docs([])).count() == 0


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    for n, first in ((1, [0, 1]), (7, [0, 3, 3, 7]), (10, [0, 10])):
        gain, trans = rng.normal(size=n), rng.normal(size=(2, 2))
        p, pairs = toxic_spans.marginals(gain, np.array(first), trans, pairs=True)
        want_pairs = np.zeros((2, 2))
        for a, b in zip(first[:-1], first[1:], strict=True):
            total, sums, two = 0.0, np.zeros(b - a), np.zeros((2, 2))
            for y in itertools.product((0, 1), repeat=b - a):
                w = math.exp(sum(gain[a + i] for i in range(b - a) if y[i]) + sum(trans[y[i], y[i + 1]] for i in range(b - a - 1)))
                total += w
                sums += w * np.array(y)
                for i in range(b - a - 1):
                    two[y[i], y[i + 1]] += w
            if b > a:
                assert np.allclose(p[a:b], sums / total)
                want_pairs += two / total
        assert np.allclose(pairs, want_pairs)


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op7_toxic_spans(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    clean = [r for r in held if not r.toxic]
    toxic = [r for r in held if r.toxic]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean) and sum(r.predicted for r in toxic) >= 0.5 * len(toxic)


def test_toxic_spans_and_edges(spark, docs, edges):
    texts = [f"lorem ipsum dolor {i} sit amet" for i in range(60)] + [f"lorem you vermin {i} amet" for i in range(30)] + edges
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(90)], "doc_id long, toxic int")
    df = docs(texts, True)
    model = toxic_spans.fit(df, labels, F.col("doc_id") % 3 != 0)
    rows = {r.doc_id: r for r in toxic_spans.scored(df, model).collect()}
    assert {texts[63][s.start : s.end] for s in rows[63].spans} >= {"vermin"} or {texts[63][s.start : s.end] for s in rows[63].spans} == {"you"}
    assert all(rows[i].predicted == int(60 <= i < 90) for i in range(len(texts)))
    kept = toxic_spans.without_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == 60 + len(edges)
    nothing = toxic_spans.fit(docs([]), labels.limit(0), F.lit(True))
    assert toxic_spans.scored(df, nothing).where("score > 1 or score < 0").count() == 0


def ppm_by_force(train, texts, order):
    counts = defaultdict(Counter)
    symbols = lambda t: [257] * order + list((t or "").encode()) + [256]
    for t in train:
        x = symbols(t)
        for i in range(order, len(x)):
            for k in range(order + 1):
                counts[tuple(x[i - k : i])][x[i]] += 1
    out = []
    for t in texts:
        x, total = symbols(t), 0.0
        for i in range(order, len(x)):
            p, banned = 1.0, set()
            for k in range(order, -1, -1):
                seen = {s: n for s, n in counts.get(tuple(x[i - k : i]), {}).items() if s not in banned}
                if not seen:
                    continue
                size = sum(seen.values())
                if x[i] in seen:
                    p *= (seen[x[i]] - 0.5) / size
                    break
                p *= len(seen) / (2 * size)
                banned |= set(seen)
            else:
                p /= 257 - len(banned)
            total += math.log10(p)
        out.append(total)
    return out


def test_partial_matching_by_force(spark, docs, edges, monkeypatch):
    monkeypatch.setattr(partial_matching, "CHUNK", 400)
    texts = ["abracadabra abracadabra", "the cat sat on the mat", "The dog", "a cadabra the", "zzz é", "abra", ""] + [t for t in edges if not t or len(t) < 100]
    held = F.col("doc_id") % 3 == 0
    rows = {r.doc_id: r for r in partial_matching.scored(docs(texts, True), held, order=3).collect()}
    train = [t for i, t in enumerate(texts) if i % 3]
    c = Counter(w for t in train for w in [*words(t), None])
    total, kinds = sum(c.values()), len(c)
    for i, (t, want) in enumerate(zip(texts, ppm_by_force(train, texts, 3), strict=True)):
        r, w = rows[i], [*words(t), None]
        assert r.score == pytest.approx(want, rel=1e-5)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 3 == 0, len(w), sum(c[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w))
    assert partial_matching.scored(docs([]), held).count() == 0
    alone = partial_matching.scored(docs(["ab"]), F.lit(True)).first()
    assert alone.score == pytest.approx(-3 * math.log10(257)) and alone.train_tokens == 0


def test_nearest_neighbours_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in queries.op1_multi_index(spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    hits = 0
    for q in ids[ids % 50 == 0].tolist():
        s = u @ u[ids == q][0]
        s[ids == q] = -9
        hits += len({r.vec_id for r in got[q]} & set(ids[np.argsort(-s)[:5]].tolist()))
        assert [r.rank for r in got[q]] == [1, 2, 3, 4, 5]
        assert all(r.score == pytest.approx(s[ids == r.vec_id][0], abs=1e-12) for r in got[q])
    assert hits >= 0.9 * 5 * len(got)


def test_nearest_neighbours_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, None]), (5, [2.0, 0.0]), (6, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [1.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multi_index.search(df, F.col("vec_id") == 0, bucket_rows=2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(5, 1.0), (6, 1.0), (7, 0.0)]
    assert multi_index.search(df.limit(0), F.lit(True)).count() == 0


def test_cells_come_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(9), rng.random(7)
    order = list(multi_index.cells_in_order(a, b))
    sums = [a[i] + b[j] for i, j in order]
    assert len(set(order)) == 63 and sums == sorted(sums)


def test_pieces_of_arrow_arrays():
    s, first = near_duplicates.shingle_sets(pa.array(["a b c d e f", None, "A b"]).slice(0, 3))
    assert first.tolist() == [0, 2, 2, 3] and len(s) == 3
