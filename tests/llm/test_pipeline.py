"""Each stage of the pipeline on what its predecessor wrote, against brute force."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.llm.test_documents import components_by_force, lines_by_force, spans_by_force
from tessera.llm import private_data

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    made = []
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        made.append(docs)
    assert [n for n, _ in C.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup", "PII", "best-fit packing"]
    assert all(d.columns == names for d in made[:4])
    first, lines, near, private, packed = ({r.doc_id: r for r in d.collect()} for d in made)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    clean = {i for i, t in labels.items() if not t}
    assert len(clean & first.keys()) >= 0.98 * len(clean)

    ids = sorted(first)
    assert {i: lines[i].text for i in ids} == dict(zip(ids, lines_by_force([first[i].text for i in ids]), strict=True))
    assert all(r.n_chars == len(r.text) for r in lines.values())

    kept = {ids[k] for k, (_, c) in enumerate(components_by_force([lines[i].text for i in ids])) if c == k}
    assert near.keys() == kept

    for i, r in near.items():
        spans = spans_by_force(r.text)
        masked = private_data.redacted(r.text, spans)
        assert private[i].text == masked or len(private[i].text.split("<")) > len(masked.split("<"))  # contexts may add spans

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces, fill = defaultdict(list), defaultdict(list)
    for r in made[4].collect():
        pieces[r.doc_id].append(r)
        fill[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == private.keys()
    for i, own in pieces.items():
        tokens = np.array([*tok.encode(private[i].text, add_special_tokens=False).ids, 1], "<u4")
        assert sum(r.length for r in own) == len(tokens)
        assert all(r.ids_crc32 == zlib.crc32(tokens[r.start : r.start + r.length]) for r in own)
    for s in fill.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096


def test_stages_keep_columns_of_any_name(spark, docs, edges):
    """Columns named as the working ones, in full after each stage but the last."""
    texts = [*edges, "one two three four five six\nmail a@b.co now", "one two three four five six\nmail a@b.co now"]
    df = docs(texts, True)
    for name, stage in C.STAGES[1:4]:
        out = stage(spark, df, FOLDER)
        assert out.columns == df.columns, name
        rows = out.collect()
        assert rows and all(v == "x" for r in rows for c, v in r.asDict().items() if c not in ("doc_id", "text", "lang", "source", "n_chars")), name
        assert len(rows) == len(texts) or name.startswith("MinHash")
    assert C.STAGES[4][1](spark, df, FOLDER).select("doc_id").distinct().count() == len(texts)


def test_empty_documents_pass_through(spark, tmp_path):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
