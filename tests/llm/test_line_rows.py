"""Lines of any number of words, against brute force, by the query and by the pipeline's stage."""

import hashlib
import random

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import line_dedup, queries, sql
from tests.llm.test_documents import copies, lines_by_force


def short_lines(edges):
    rng = random.Random(4)
    c = copies(7, 4)
    # four words and the same four with a fifth have a similarity of 0.8, three and four do not
    short = ["menu", "Menu", "read more", "more  read", "a b c", "a b c d", "p q r s", "p q r s t", "v w x y z", "v w x y", "", " "]
    return edges + ["\n".join(rng.sample(short, 5) + rng.sample(c, 1)) for _ in range(12)]


@pytest.mark.parametrize("first", [4, 0])
def test_short_lines_of_query_and_stage(spark, docs, edges, monkeypatch, tmp_path, first):
    monkeypatch.setattr(line_dedup, "FIRST", first)
    texts = short_lines(edges)
    want = lines_by_force(texts)
    df = docs(texts)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text_sha256 for r in queries.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(want)}
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, df, "").collect()} == dict(enumerate(want))


@pytest.mark.parametrize("first", [4, 0])
def test_rows_without_an_id_or_with_the_same(spark, docs, edges, monkeypatch, first):
    monkeypatch.setattr(line_dedup, "FIRST", first)
    ids = [None, -1, None, 7, 7, 3, None, -(2**63), 7]
    texts = ["one two\nthree four\nfive six", "own line\nanother own", "seven\none two\neight", "a b c d e\nnine", "ten\nnine", "ten\nfive six\nq", None, "seven", "ten\nq"]
    rows = [(i, t, k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int").coalesce(1)
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, k))
    want = dict(zip(order, lines_by_force([texts[k] for k in order]), strict=True))
    assert {r.k: r.text for r in line_dedup.deduplicated(df).collect()} == want
    assert want[2] == "seven\neight" and want[1] == texts[1]


def test_lines_by_bands_and_in_wide_groups(spark, docs, monkeypatch):
    """All tokens count as frequent, and all groups as too wide to meet by size."""
    monkeypatch.setattr(line_dedup, "FREQUENT", 1)
    monkeypatch.setattr(line_dedup, "WINDOW", 0)
    texts = short_lines([]) + copies(9, 6)
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(docs(texts)).collect()}
    assert got == dict(enumerate(lines_by_force(texts)))


def test_sql_twin(spark, docs, edges, tmp_path):
    """The SQL, the query and brute force give the same texts."""
    texts = short_lines(edges) + copies(5, 9)
    docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    twin = con.sql(sql.SQL["op4_line_dedup"])
    got = queries.op4_line_dedup(spark, str(tmp_path))
    assert got.columns == twin.columns
    want = {(i, len(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(lines_by_force(texts))}
    assert set(twin.fetchall()) == want == {tuple(r) for r in got.collect()}
