"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters, lower-cased (ASCII). Features of a token are its whole form and its beginnings of 3 to 6
bytes, as 64-bit hashes; the model knows the accepted ones and the FREQUENT most frequent of each kind. Documents are labelled as a whole, so token labels are induced: features are
accepted one after another, each the one that explains most toxic documents of the sample not yet explained and occurs in
(almost) no clean one; in toxic documents the tokens with an accepted feature are the toxic ones. The field (features
of the token, and the transitions) is trained on these token labels. Forward-backward marginals give the offending
offsets, and the document's score is a logistic function of the (weighted) expected number of toxic tokens.

The field is fitted on a bounded sample of labelled rows (SAMPLE of the labels 0 and 1 by a hash of the id), whole texts of
any length; every document is scored whole. Null and empty texts have no tokens and get the base score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import column, mixed, runs, span_hashes, text_bytes

SAMPLE = (2500, 1000)
FREQUENT = 2000
#: Added to the expected number before its logarithm is taken: less than this many toxic tokens are none.
FLOOR = 0.02
PREFIXES = (3, 4, 5, 6)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class Tokens:
    """Letter runs of a batch of texts: doc of each, byte spans, and the table slots of their features (whole form first)."""

    def __init__(self, texts: pa.Array):
        self.body, self.offsets = text_bytes(texts)
        self.starts, self.ends = runs(_LETTER[self.body], self.offsets[:-1])
        self.first = np.searchsorted(self.starts, self.offsets)

    def features(self) -> Iterator[np.ndarray]:
        """The hashes of all tokens' features, one kind after another."""
        whole = span_hashes(self.body, self.starts, self.ends, True)
        yield whole
        for k, n in enumerate(PREFIXES, 1):
            long = self.ends - self.starts > n
            h = whole.copy()
            h[long] = span_hashes(self.body, self.starts[long], self.starts[long] + n, True)
            yield mixed(h + np.uint64(k))

    def known(self, table: np.ndarray) -> np.ndarray:
        """Of each kind and token the place of its feature in the sorted table; its length if it is not there."""
        return np.stack([_places(table, h) for h in self.features()])


def _places(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, h).astype(np.int32)
    if len(table):
        at[table[np.minimum(at, len(table) - 1)] != h] = len(table)
    return at


def marginals(gain: np.ndarray, first: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """P(toxic) of each token, and with pairs the expected number of each transition (from, to) within documents. gain: log-odds of its features; first: where each document's tokens begin (one more at the
    end); trans: 2 x 2 log weights. All tokens are one stream in which a document's first token forgets what precedes it;
    the stream is cut into lanes that advance together: lane products, then their chain, then the lanes with known ends."""
    n = len(gain)
    if not n:
        return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
    steps = max(1, int(np.sqrt(n)))
    lanes = -(-n // steps)
    size = lanes * steps
    e = np.ones(size)
    e[:n] = np.exp(np.clip(gain, -40, 40))
    fresh = np.zeros(size, bool)
    fresh[first[:-1][first[:-1] < n]] = True
    fresh[n:] = True
    w = np.exp(trans)
    e, fresh = e.reshape(lanes, steps), fresh.reshape(lanes, steps)
    # the step into a token: rows from the state before, columns the new state; a first token's rows are alike
    a00, a10 = np.where(fresh, 1.0, w[0, 0]), np.where(fresh, 1.0, w[1, 0])
    a01, a11 = np.where(fresh, 1.0, w[0, 1]) * e, np.where(fresh, 1.0, w[1, 1]) * e

    def forward(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        kept = np.empty((lanes, steps))
        for t in range(steps):
            x, y = x * a00[:, t] + y * a10[:, t], x * a01[:, t] + y * a11[:, t]
            z = x + y
            x, y = x / z, y / z
            kept[:, t] = y
        return kept

    def backward(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        kept = np.empty((lanes, steps))
        for t in range(steps - 1, -1, -1):
            kept[:, t] = y
            x, y = a00[:, t] * x + a01[:, t] * y, a10[:, t] * x + a11[:, t] * y
            z = x + y
            x, y = x / z, y / z
        return kept

    def chain(order_steps, order_lanes, forward: bool) -> np.ndarray:
        # what each lane makes of the two pure states, with the weight that each keeps
        ends, logs = [], []
        for pure in ((1.0, 0.0), (0.0, 1.0)):
            x, y, log = np.full(lanes, pure[0]), np.full(lanes, pure[1]), np.zeros(lanes)
            for t in order_steps:
                if forward:
                    x, y = x * a00[:, t] + y * a10[:, t], x * a01[:, t] + y * a11[:, t]
                else:
                    x, y = a00[:, t] * x + a01[:, t] * y, a10[:, t] * x + a11[:, t] * y
                z = x + y
                x, y, log = x / z, y / z, log + np.log(z)
            ends.append((x, y))
            logs.append(log)
        state = np.empty((lanes, 2))
        now = np.array([0.5, 0.5])
        for i in order_lanes:
            state[i] = now
            top = max(logs[0][i], logs[1][i])
            a, b = now[0] * np.exp(logs[0][i] - top), now[1] * np.exp(logs[1][i] - top)
            now = np.array([a * ends[0][0][i] + b * ends[1][0][i], a * ends[0][1][i] + b * ends[1][1][i]])
            now /= now.sum()
        return state

    fwd, bwd = range(steps), range(steps - 1, -1, -1)
    s = chain(fwd, range(lanes), True)
    alpha = forward(s[:, 0], s[:, 1])
    s = chain(bwd, range(lanes - 1, -1, -1), False)
    beta = backward(s[:, 0], s[:, 1])
    up = alpha * beta
    p = (up / (up + (1 - alpha) * (1 - beta))).reshape(-1)[:n]
    if not pairs:
        return p
    before, after, own = alpha.reshape(-1)[: n - 1], beta.reshape(-1)[1:n], e.reshape(-1)[1:n]
    joint = np.array([[(1 - before) * w[0, 0] * (1 - after), (1 - before) * w[0, 1] * own * after], [before * w[1, 0] * (1 - after), before * w[1, 1] * own * after]])
    return p, (joint / joint.sum((0, 1)) * ~fresh.reshape(-1)[1:n]).sum(-1)


def induced(t: Tokens, toxic: np.ndarray, support: int, purity: float = 0.98) -> tuple[np.ndarray, np.ndarray]:
    """The accepted features, and these with the frequent ones (sorted). toxic: which texts are."""
    docs = np.repeat(np.arange(len(toxic)), np.diff(t.first)).astype(np.int32)
    ours = toxic[docs]
    scale = max(1.0, toxic.sum() / max(1, (~toxic).sum()))
    doc, feature, frequent = [], [], []
    for h in t.features():
        names, count = np.unique(h, return_counts=True)
        frequent.append(names[np.argsort(-count, kind="stable")[:FREQUENT]])

        def present(mask: np.ndarray) -> np.ndarray:
            return np.unique(docs[mask].astype(np.int64) << 32 | _places(names, h[mask]))  # noqa: B023

        here = present(ours)
        pos = np.bincount(here & 0xFFFFFFFF, minlength=len(names))
        some = pos >= support
        neg = np.bincount(present(~ours) & 0xFFFFFFFF, minlength=len(names))
        pure = some & (pos >= purity * (pos + neg * scale))
        here = here[pure[here & 0xFFFFFFFF]]
        doc.append(here >> 32)
        feature.append(names[here & 0xFFFFFFFF])
    doc, feature = np.concatenate(doc), np.concatenate(feature)
    names, place = np.unique(feature, return_inverse=True)
    open_doc, chosen = toxic.copy(), []
    while len(names):
        n = np.bincount(place[open_doc[doc]], minlength=len(names))
        best = int(np.argmax(n))
        if n[best] < support:
            break
        chosen.append(names[best])
        open_doc[doc[place == best]] = False
    accepted = np.array(chosen, np.uint64)
    return accepted, np.unique(np.concatenate([accepted, *frequent]))


def train(known: np.ndarray, first: np.ndarray, y: np.ndarray, size: int, rounds: int = 40, rate: float = 1.0, decay: float = 1e-6) -> tuple[np.ndarray, float, np.ndarray]:
    """Feature weights, bias and transitions by AdaGrad on the field's log-likelihood. The gradient is summed over slices of documents."""
    w, g2 = np.zeros(size + 1), np.full(size + 1, 1e-2)
    bias, trans = -7.0, np.zeros((2, 2))
    b2, t2 = 1e-2, np.full((2, 2), 1e-2)
    n = max(1, int(y.sum()))
    cuts = np.unique(np.searchsorted(first, np.arange(0, len(y) + 250_000, 250_000)).clip(0, len(first) - 1))
    slices = [(int(first[a]), int(first[b]), first[a : b + 1] - first[a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for _ in range(rounds):
        grad, gb, gt = np.zeros(size + 1), 0.0, np.zeros((2, 2))
        for lo, hi, own in slices:
            gain = w[known[:, lo:hi]].sum(0) + bias
            p, expected = marginals(gain, own, trans, pairs=True)
            part = y[lo:hi]
            d = (part - p) / n
            for k in range(len(known)):
                grad += np.bincount(known[k, lo:hi], weights=d, minlength=size + 1)
            gb += d.sum()
            linked = np.ones(max(0, hi - lo - 1), bool)
            linked[own[(own > 0) & (own < hi - lo)] - 1] = False
            at = (2 * part[:-1] + part[1:]).astype(np.int64)[linked]
            gt += (np.bincount(at, minlength=4).reshape(2, 2) - expected) / n
        grad -= decay * w
        grad[size] = 0.0  # what is not known weighs nothing
        g2 += grad**2
        w += rate * grad / np.sqrt(g2)
        b2 += gb**2
        bias += rate * gb / np.sqrt(b2)
        gt -= 1e-3 * trans
        t2 += gt**2
        trans = np.clip(trans + 0.2 * rate * gt / np.sqrt(t2), -4, 4)
    return w, float(bias), trans


class Model:
    def __init__(self, table: np.ndarray, weights: np.ndarray, bias: float, trans: np.ndarray):
        self.table, self.weights, self.bias, self.trans, self.a, self.b = table, weights, bias, trans, 1.0, 0.0

    def tokens(self, t: Tokens) -> np.ndarray:
        gain = np.full(len(t.starts), self.bias)
        for h in t.features():
            gain += self.weights[_places(self.table, h)]
        return marginals(gain, t.first, self.trans)

    def expected(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each document: the expected number of toxic tokens, each weighted by the square of its own probability, so
        that the background of a long document does not add up to a toxic token."""
        sums = np.concatenate([[0.0], np.cumsum(p * p * p)])
        return sums[first[1:]] - sums[first[:-1]]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * np.log(x + FLOOR) + self.b, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, float]:
    """Slope and intercept by Newton steps, halved until the penalised likelihood rises."""
    mean, scale = float(x.mean()), max(float(x.std()), 1e-6)
    z = np.stack([(x - mean) / scale, np.ones(len(x))])
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w = np.array([0.0, np.log(share / (1 - share))])
    value = lambda w: (y * (w @ z) - np.logaddexp(0, w @ z)).sum() - 0.5 * ridge * w[0] ** 2
    now = value(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ z, -30, 30)))
        g = z @ (y - p) - np.array([ridge * w[0], 0.0])
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-9)) @ z.T + np.diag([ridge, 1e-6]), g)
        while np.abs(step).max() > 1e-8 and value(w + step) <= now:
            step = step / 2
        if np.abs(step).max() <= 1e-8:
            break
        w = w + step
        now = value(w)
    a = float(w[0]) / scale
    return a, float(w[1]) - a * mean


def fit(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """training: which documents' labels may be used."""
    text = F.col(text_col)
    marks = labels.select(F.col("doc_id").alias(id_col), F.col("toxic").cast("int").alias("_toxic")).where(F.col(id_col).isNotNull() & F.col("_toxic").isin(0, 1)).groupBy(id_col).agg(F.max("_toxic").alias("_toxic"))
    # ids and labels are joined without texts; then the sample's texts are fetched by its at most sum(SAMPLE) ids
    rows = docs.where(training & text.isNotNull()).select(id_col).join(marks, id_col)
    hashed = rows.select(F.xxhash64(id_col).alias("h"), id_col, "_toxic")
    picked = [r for toxic in (0, 1) for r in hashed.where(F.col("_toxic") == toxic).orderBy("h", id_col).limit(SAMPLE[toxic]).select(id_col, "_toxic").collect()]
    ids = docs.sparkSession.createDataFrame([(r[0], r[1]) for r in picked], f"{id_col} long, _toxic int").dropDuplicates([id_col])
    got = [(r[text_col], r["_toxic"]) for r in docs.select(id_col, text_col).join(F.broadcast(ids), id_col).where(text.isNotNull()).orderBy(id_col, text_col).select(text_col, "_toxic").collect()]
    got = list(dict.fromkeys(got))  # copies teach nothing
    y = np.array([t for _, t in got], bool)
    t = Tokens(pa.array([x for x, _ in got], pa.string()))
    accepted, table = induced(t, y, support=max(3, int(y.sum()) // 60))
    known = t.known(table)
    toxic_token = np.append(np.isin(table, accepted), False)[known].any(0) & y[np.repeat(np.arange(len(y)), np.diff(t.first))]
    model = Model(table, *train(known, t.first, toxic_token.astype(float), len(table)))
    del known
    if len(y):
        x = np.log(np.concatenate([model.expected(model.tokens(part := Tokens(pa.array([x for x, _ in got[k : k + 500]], pa.string()))), part.first) for k in range(0, len(got), 500)]) + FLOOR)
        model.a, model.b = _logistic(x, y.astype(float))
    return model


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def scored(docs: DataFrame, model: Model, threshold: float = 0.3, token_threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, and spans of the offending tokens in code points. Extra columns of docs are not kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                t = Tokens(column(part, text_col))
                p = model.tokens(t)
                score = model.score(model.expected(p, t.first))
                spans: list[list] = [[] for _ in range(part.num_rows)]
                hits = np.flatnonzero(p >= token_threshold)
                if len(hits):
                    points = np.concatenate([[0], np.cumsum((t.body & 0xC0) != 0x80)])
                    owner = np.searchsorted(t.first, hits, side="right") - 1
                    base = points[t.offsets[owner]]
                    for d, s, e in zip(owner.tolist(), (points[t.starts[hits]] - base).tolist(), (points[t.ends[hits]] - base).tolist(), strict=True):
                        spans[d].append({"start": s, "end": e})
                yield pa.RecordBatch.from_arrays(
                    [column(part, id_col).cast(pa.int64()), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(spans, pa.list_(_SPAN))],
                    names=["doc_id", "score", "predicted", "spans"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int, spans array<struct<start:long,end:long>>")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                t = Tokens(column(part, text_col))
                yield part.filter(pa.array(model.score(model.expected(model.tokens(t), t.first)) < threshold))

    return docs.mapInArrow(run, docs.schema)
