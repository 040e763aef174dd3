"""Language-model scores by prediction by partial matching.

The model is a trie of byte contexts up to `order` bytes, trained on some of the documents: counts of every byte (and of
the end of a text) after every context. A byte is coded in the longest context known; if that context has never seen it,
an escape is coded (half a count for each distinct symbol, which gives up the other half: method D) and the next shorter context is asked,
without the symbols that the longer one had already offered (symbol exclusion); last, all symbols left are alike.
Because every symbol of a context is also a symbol of its shorter contexts, what is excluded depends on the longer context
alone, so all code lengths follow from sums over the trie's nodes and need no walk a byte.

The trie is never in one place. Texts are gathered in chunks of about CHUNK bytes; a chunk asks for its distinct
(context, symbol) pairs and words with their training counts; pairs are dealt out by their last two context bytes and words
by their hash, so that a range has whole branches of the trie; each range adds up the counts of all chunks and answers every
chunk with the code lengths of just its pairs. Only the counts of single bytes after single bytes (257 x 258 at most) are
sent to everyone.

Null and empty texts are scored as the end alone. Without training documents all symbols are alike. Words are told apart
by 63-bit hashes. Repeated rows are repeated documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Words, column, new_path, text_bytes

#: Six symbols of nine bits, and a flag.
ORDER = 5
CHUNK = 24_000_000
#: Texts are handled in pieces of about so many bytes.
PIECE = 1_000_000
END, START, SYMBOLS = 256, 257, 257
_FIELD = np.uint64(9)
TEXT, PAIRS, WORDS, SHORT = range(4)
_SCHEMA = "kind int, chunk long, doc_id long, held boolean, text string, part int, keys binary, counts binary"


def _pieces(sizes: np.ndarray) -> list[slice]:
    """Consecutive texts of about PIECE bytes together."""
    group = np.cumsum(sizes) // PIECE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def pair_codes(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end of the texts its code: the context bytes, the last one highest, then the symbol. And of each
    text where its codes begin (one more at the end)."""
    body, off = text_bytes(texts)
    n = np.diff(off)
    first = off + np.arange(len(off)) * (order + 1)  # each text has its starts before it and an end behind it
    stream = np.full(int(first[-1]), START, np.uint64)
    owner = np.repeat(np.arange(len(n)), n)
    stream[np.arange(len(body)) + owner * (order + 1) + order] = body
    stream[first[1:] - 1] = END
    at = np.arange(len(stream))
    coded = (at - np.repeat(first[:-1], np.diff(first))) >= order
    at = at[coded]
    code = stream[at].copy()
    for k in range(1, order + 1):
        code |= stream[at - k] << (_FIELD * np.uint64(order + 1 - k))
    return code, np.concatenate([[0], np.cumsum(n + 1)])


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True) if len(keys) else (keys, np.zeros(0, np.int64))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
    n = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begin], np.add.reduceat(n, begin)


def _split(flagged: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From keys that end in the training flag: keys, and their training counts (0 if seen elsewhere only)."""
    keys = flagged >> np.uint64(1)
    return _merged([(keys, np.where(flagged & np.uint64(1), n, 0))])


def _packed(keys: np.ndarray) -> bytes:
    """Byte planes of sorted keys: the shuffle's compression finds the equal ones."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def word_keys(w: Words) -> np.ndarray:
    return w.hashes() >> np.uint64(1)


def _spread(x: np.ndarray, parts: int) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def _gather(order: int, parts: int, id_col: str, text_col: str):
    def requests(ids: list, held: list, texts: list) -> Iterator[tuple]:
        col = pa.array(texts, pa.large_string())
        train = ~np.array(held, bool)
        sizes = np.array([len(t) if t else 1 for t in texts])
        pairs, words = [], []
        for piece in _pieces(sizes):
            part, own = col[piece.start : piece.stop], train[piece].astype(np.uint64)
            code, first = pair_codes(part, order)
            pairs.append(_counted(code << np.uint64(1) | np.repeat(own, np.diff(first))))
            w = Words(part, lower=True)
            words.append(_counted(word_keys(w) << np.uint64(1) | np.repeat(own, np.diff(w.first))))
        keys, n = _split(*_merged(pairs))
        low = np.uint64(511)
        short = (keys >> (_FIELD * np.uint64(order))) << _FIELD | keys & low
        yield SHORT, 0, *_merged([(short[n > 0], n[n > 0])])
        branch = _spread(keys >> (_FIELD * np.uint64(order - 1)), parts)
        for p in np.unique(branch).tolist():
            yield PAIRS, p, keys[branch == p], n[branch == p]
        keys, n = _split(*_merged(words))
        branch = _spread(keys, parts)
        for p in np.unique(branch).tolist():
            yield WORDS, p, keys[branch == p], n[branch == p]

    def flush(chunk: int, ids: list, held: list, texts: list) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("kind", pa.int32()), ("chunk", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("text", pa.string()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]
        )
        none = [None] * len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([TEXT] * len(ids), [chunk] * len(ids), ids, held, texts, none, none, none), schema.types, strict=True)], schema=schema)
        rows = [dict(kind=k, chunk=chunk, part=p, keys=_packed(keys), counts=_packed(n)) for k, p, keys, n in requests(ids, held, texts)]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, size = TaskContext.get().partitionId(), 0, 0
        ids, held, texts = [], [], []
        for b in batches:
            for i, h, t in zip(column(b, id_col).to_pylist(), column(b, "held").to_pylist(), (x.as_py() for x in column(b, text_col)), strict=True):
                ids.append(i)
                held.append(h)
                texts.append(t)
                size += len(t.encode()) if t else 0
                if size >= CHUNK:
                    yield from flush(task << 32 | made, ids, held, texts)
                    ids, held, texts, size, made = [], [], [], 0, made + 1
        if ids:
            yield from flush(task << 32 | made, ids, held, texts)

    return run


def code_lengths(keys: np.ndarray, n: np.ndarray, order: int, short: np.ndarray) -> np.ndarray:
    """log10 probability of each pair. keys: distinct, sorted, with all training pairs of their last two context bytes;
    n: training counts; short: 258 x 257 training counts of symbols after single bytes."""
    logp, done, begun = np.zeros(len(keys)), np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    symbol = (keys & np.uint64(511)).astype(np.int64)
    longer_d = longer_e = np.zeros(len(keys))
    level_keys, level_n, to_level = keys, n.astype(np.float64), np.arange(len(keys))
    zero = short.sum(0).astype(np.float64)
    last = (keys >> (_FIELD * np.uint64(order))).astype(np.int64)
    for k in range(order, -1, -1):
        if k >= 2:
            context = level_keys >> _FIELD
            begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
            group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(context))))
            total, distinct = np.bincount(group, level_n), np.bincount(group, level_n > 0)
            t, d, own = total[group][to_level], distinct[group][to_level], level_n[to_level]
            # counts that the next shorter context has for this one's symbols
            if k > 2:
                shorter = (context >> _FIELD) << _FIELD | level_keys & np.uint64(511)
                next_keys, inverse = np.unique(shorter, return_inverse=True)
                next_n = np.bincount(inverse, level_n)
                there = next_n[inverse]
            else:
                there = short[(context >> _FIELD).astype(np.int64), (level_keys & np.uint64(511)).astype(np.int64)]
            e = np.bincount(group, there * (level_n > 0))[group][to_level]
        elif k == 1:
            t, d, own = short.sum(1)[last], (short > 0).sum(1)[last], short[last, symbol]
            e = ((short > 0) * zero).sum(1)[last]
        else:
            t, d, own, e = np.full(len(keys), zero.sum()), np.full(len(keys), (zero > 0).sum()), zero[symbol], np.zeros(len(keys))
        live = ~done & (t > 0)
        left_t, left_d = t - np.where(begun, longer_e, 0), d - np.where(begun, longer_d, 0)
        hit = live & (own > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            logp += np.where(hit, np.log10((own - 0.5) / left_t), np.where(live & (left_d > 0), np.log10(0.5 * left_d / left_t), 0.0))
        done |= hit
        begun |= live
        longer_d, longer_e = np.where(t > 0, d, 0), np.where(t > 0, e, 0)
        if k > 2:
            to_level = inverse[to_level]
            level_keys, level_n = next_keys, next_n
    return logp + np.where(done, 0.0, -np.log10(np.maximum(1, SYMBOLS - (zero > 0).sum())))


def _answers(order: int, short: np.ndarray):
    sent = short

    def run(_key, table):
        kind = table.column("kind")[0].as_py()
        chunks = table.column("chunk").to_pylist()
        keys = [_unpacked(x.as_py()) for x in table.column("keys")]
        counts = [_unpacked(x.as_py()).astype(np.int64) for x in table.column("counts")]
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
        value = code_lengths(every, n, order, sent) if kind == PAIRS else n.astype(np.float64)
        value = value.astype("<f4" if kind == PAIRS else "<f8")[inverse]
        at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        known = [int((n > 0).sum()) if kind == WORDS else 0] + [0] * (len(keys) - 1)
        return pa.table(
            {"chunk": pa.array(chunks, pa.int64()), "kind": pa.array([kind] * len(keys), pa.int32()), "keys": pa.array([_packed(k) for k in keys], pa.binary()), "answers": pa.array([value[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), "distinct": pa.array(known, pa.int64())}
        )

    return run


def _scores(order: int, train_docs: int, total: int, distinct: int):
    def lookup(answers: pa.Table, kind: int, of: str) -> tuple[np.ndarray, np.ndarray]:
        rows = [(k.as_py(), a.as_py()) for k, a, x in zip(answers.column("keys"), answers.column("answers"), answers.column("kind").to_pylist(), strict=True) if x == kind]
        if not rows:
            return np.zeros(0, np.uint64), np.zeros(0)
        keys, values = np.concatenate([_unpacked(k) for k, _ in rows]), np.concatenate([np.frombuffer(a, of) for _, a in rows]).astype(np.float64)
        at = np.argsort(keys, kind="stable")
        return keys[at], values[at]

    def run(texts, answers):
        pair_keys, pair_values = lookup(answers, PAIRS, "<f4")
        keys, counts = lookup(answers, WORDS, "<f8")
        table = texts.combine_chunks()
        col = table.column("text").combine_chunks().cast(pa.large_string())
        sizes = np.array([len(x) if x else 1 for x in col.to_pylist()])
        score, base, n_tokens, n_known = [], [], [], []
        bottom = np.log10(total + 0.1 * (distinct + 1))
        for piece in _pieces(sizes):
            part = col[piece.start : piece.stop]
            code, first = pair_codes(part, order)
            score.append(np.add.reduceat(pair_values[np.searchsorted(pair_keys, code)], first[:-1]))
            w = Words(part, lower=True)
            c = counts[np.searchsorted(keys, word_keys(w))] if len(w.starts) else np.zeros(0)
            sums = np.concatenate([[0.0], np.cumsum(np.log10(c + 0.1) - bottom)])
            known = np.concatenate([[0], np.cumsum(c > 0)])
            n_tokens.append(np.diff(w.first) + 1)
            n_known.append(known[w.first[1:]] - known[w.first[:-1]] + (train_docs > 0))
            base.append(sums[w.first[1:]] - sums[w.first[:-1]] + np.log10(train_docs + 0.1) - bottom)
        joined = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "held_out": table.column("held"),
                "n_tokens": joined(n_tokens, pa.int64()),
                "n_known": joined(n_known, pa.int64()),
                "train_tokens": pa.array([total] * table.num_rows, pa.int64()),
                "base_score": joined(base, pa.float64()),
                "score": joined(score, pa.float64()),
            }
        )

    return run


def scored(docs: DataFrame, held_out: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability of the text) of each row."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    size = source.agg(F.sum(F.octet_length("text")), F.sum((~F.col("held")).cast("int"))).first()
    parts, train_docs = max(12, int((size[0] or 0) // (2 * CHUNK)) + 1), int(size[1] or 0)
    path = new_path(spark, "matching")
    source.mapInArrow(_gather(order, parts, "doc_id", "text"), _SCHEMA).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    # the schema is named so that a kind without rows does not matter
    table = spark.read.schema(_SCHEMA).parquet(path)
    counted = table.where(F.col("kind") == SHORT).mapInArrow(_exploded, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    short = np.zeros((258, SYMBOLS))
    for r in counted:  # at most 258 x 257
        short[r["key"] >> 9, r["key"] & 511] = r["n"]
    asked = table.where(F.col("kind").isin(PAIRS, WORDS)).select("kind", "part", "chunk", "keys", "counts")
    out = new_path(spark, "matching-answers")
    answer = "chunk long, kind int, keys binary, answers binary, distinct long"
    asked.groupBy("kind", "part").applyInArrow(_answers(order, short), answer).write.option("compression", "zstd").parquet(out)
    answers = spark.read.schema(answer).parquet(out)
    distinct = int(answers.agg(F.sum("distinct")).first()[0] or 0) + (train_docs > 0)
    words = table.where(F.col("kind") == WORDS).mapInArrow(_exploded_sum, "n long").agg(F.sum("n")).first()[0]
    total = int(words or 0) + train_docs
    texts = table.where(F.col("kind") == TEXT).select("chunk", "doc_id", "held", "text")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scores = _scores(order, train_docs, total, distinct)
    return texts.groupBy("chunk").cogroup(answers.select("chunk", "kind", "keys", "answers").groupBy("chunk")).applyInArrow(scores, schema)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k, n in zip(column(b, "keys").to_pylist(), column(b, "counts").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(_unpacked(k).astype(np.int64)), pa.array(_unpacked(n).astype(np.int64))], names=["key", "n"])


def _exploded_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = sum(int(_unpacked(x).sum()) for x in column(b, "counts").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])
