"""Lines of files that many tasks read, against the files read whole."""

import gzip
import random
from pathlib import Path

import pytest
from pyspark.sql import types as T

from tessera.sources import lines as L
from tessera.sources import readers as R


def by_force(path):
    raw = path.read_bytes().decode()
    rows = raw.split("\n")
    if rows[-1] == "":
        rows.pop()
    return [r.removesuffix("\r") for r in rows]


@pytest.fixture
def small_ranges(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in held:
        spark.conf.set(k, "97")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def made(folder: Path):
    rng = random.Random(5)
    word = lambda: rng.choice(["", "é" * 9, "x" * rng.randrange(40), "日本語", " a\tb ", "q" * 700])
    texts = {
        "a.txt": "\n".join(word() for _ in range(300)),
        "b.txt": "\r\n".join(word() for _ in range(200)) + "\r\n",
        "c.txt": "\n\n\n",
        "d.txt": "",
        "e.x.txt": "one",
        "f.txt": "z" * 5000 + "\nend\n",
        "g.txt": "a\rb\nc\r\r\n",
    }
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode())
    return {folder / n: by_force(folder / n) for n in texts}


@pytest.mark.parametrize("sent", [100_000, 0])
def test_lines_of_many_ranges(spark, tmp_path, small_ranges, monkeypatch, sent):
    monkeypatch.setattr(L, "SENT_RANGES", sent)
    want = {(p.name, p.stem, k + 1, t) for p, rows in made(tmp_path).items() for k, t in enumerate(rows)}
    got = R.lines(spark, str(tmp_path), start=1)
    rows = [(r.file.rpartition("/")[2], r.stem, r.line, r.text) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    scan = L.scanned(spark, f"{tmp_path}/a.txt")
    assert scan.rdd.getNumPartitions() > 10 and L.ranges(scan).count() > 10  # one file, many tasks
    assert [r.text for r in R.line_slice(spark, f"{tmp_path}/a.txt", 100, 103).orderBy("line").collect()] == by_force(tmp_path / "a.txt")[100:103]


def test_a_compressed_file_is_one_range(spark, tmp_path, small_ranges):
    (tmp_path / "a.txt.gz").write_bytes(gzip.compress("\n".join(map(str, range(1000))).encode()))
    assert [(r.line, r.text) for r in R.lines(spark, str(tmp_path)).orderBy("line").collect()] == [(k, str(k)) for k in range(1000)]


def test_the_last_line_of_a_key_wins_over_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(6)
    rows = [(f"k{rng.randrange(40)}", n) for n in range(500)]
    (tmp_path / "a.jsonl").write_text("".join(f'{{"id":"{k}","n":{n}}}\n' for k, n in rows))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    assert [tuple(r) for r in R.jsonl_keyed(spark, f"{tmp_path}/a.jsonl", schema, "id").collect()] == sorted(dict(rows).items())


def test_no_files_with_lines(spark, tmp_path):
    (tmp_path / "empty.txt").write_text("")
    assert R.lines(spark, str(tmp_path)).count() == 0
