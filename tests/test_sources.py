import io
import json
import tarfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import readers as R
from tessera.sources import sinks as K

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])


def test_json_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "007", "n": 1}, {"id": "008"}], indent=1))
    assert [tuple(r) for r in R.json_array(spark, f"{tmp_path}/a.json", SCHEMA).collect()] == [("007", 1), ("008", None)]
    (tmp_path / "m.json").write_text(json.dumps({"1": {"n": 5}, "2": {"n": 6}}))
    got = R.json_map(spark, f"{tmp_path}/m.json", T.StructType([T.StructField("n", T.LongType())])).collect()
    assert sorted(map(tuple, got)) == [("1", 5), ("2", 6)]
    (tmp_path / "c.json").write_text(json.dumps({"annotations": [{"image_id": 3, "caption": "x"}]}))
    assert tuple(R.annotations(spark, f"{tmp_path}/c.json").first()) == (3, "x")


def test_jsonl_last_key_wins_and_bad_lines_count(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"b","n":1}\n{"id":"a","n":2}\n{"id":"b","n":3}\n')
    assert [tuple(r) for r in R.jsonl_keyed(spark, f"{tmp_path}/a.jsonl", SCHEMA, "id").collect()] == [("a", 2), ("b", 3)]
    (tmp_path / "bad.jsonl").write_text('{"id":"b","n":1}\n{"id": oops\n\n')
    good, bad = R.jsonl_tolerant(spark, f"{tmp_path}/bad.jsonl", SCHEMA)
    assert [tuple(r) for r in good.collect()] == [("b", 1)] and bad.count() == 1


def test_lines_keep_their_order(spark, tmp_path):
    (tmp_path / "color.txt").write_text("x\n\ny\n")
    (tmp_path / "shape.txt").write_text("z")
    rows = R.category_lines(spark, str(tmp_path), ["color", "shape"]).orderBy("category", "idx").collect()
    assert [tuple(r) for r in rows] == [("color", "x", 0), ("color", "", 1), ("color", "y", 2), ("shape", "z", 0)]
    assert [r["stem"] for r in R.documents_per_file(spark, f"{tmp_path}/*.txt").orderBy("idx").collect()] == ["color", "shape"]


def test_tables_with_quotes_and_base64(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('a\tb\n1\t"two\nlines"\n')
    assert tuple(R.table_text(spark, f"{tmp_path}/t.tsv", "a int, b string").first()) == (1, "two\nlines")
    with pytest.raises(ValueError):
        R.read_by_extension(spark, "x.foo")


def test_tar_shards(spark, tmp_path):
    with tarfile.open(tmp_path / "s.tar", "w") as t:
        for name, body in (("k1.jpg", b"J"), ("k1.txt", b"one"), ("k2.PNG", b"P")):
            i = tarfile.TarInfo(name)
            i.size = len(body)
            t.addfile(i, io.BytesIO(body))
    (tmp_path / "broken.tar").write_bytes(b"no tar at all")
    rows = R.tar_samples(spark, f"{tmp_path}/*.tar")
    got = {r["__key__"]: (bytes(r["image"]), r["txt"]) for r in rows.where("error is null").select("__key__", R.first_of("parts", ["jpg", "png", "jpeg", "webp"]).alias("image"), F.element_at("parts", "txt").cast("string").alias("txt")).collect()}
    assert got == {"k1": (b"J", "one"), "k2": (b"P", None)} and rows.where("error is not null").count() == 1


def test_arrays_and_folders(spark, tmp_path):
    np.savez(tmp_path / "a.npz", arr_0=np.arange(10).reshape(5, 2))
    assert [r["values"] for r in R.npz_rows(spark, f"{tmp_path}/a.npz", batch=2).orderBy("row").collect()][4] == [8.0, 9.0]
    for name, shape in (("x", (24, 24)), ("y", (3, 3))):
        np.save(tmp_path / f"{name}.npy", np.ones(shape))
    errors = {r["path"][-5]: r["error"] for r in R.npy_masks(spark, f"{tmp_path}/*.npy").collect()}
    assert errors["x"] is None and "3" in errors["y"]
    for c in ("cat", "ant"):
        (tmp_path / "img" / c).mkdir(parents=True)
        (tmp_path / "img" / c / "0.PNG").write_bytes(b"x")
    assert {(r["class"], r["label"]) for r in R.class_folders(spark, f"{tmp_path}/img").collect()} == {("ant", 0), ("cat", 1)}
    (tmp_path / "masks" / "layout" / "1000001").mkdir(parents=True)
    (tmp_path / "masks" / "layout" / "1000001" / "00_mask.pt").write_bytes(b"x")
    assert tuple(R.mask_index(spark, f"{tmp_path}/masks").first()) == ("layout", "1000001", "00")


def test_braces_and_shards(spark):
    assert R.braces("a{08..10}.tar::b{x,y}") == ["a08.tar", "a09.tar", "a10.tar", "bx", "by"]
    assert R.shards(spark, "a{0..1}::b", [2.0, 3.0]).count() == 3


def test_gathered_sorts_as_numbers_unless_one_is_none(spark):
    a = spark.createDataFrame([("10", 0, "a"), ("9", 1, "a")], "item_id string, seq int, v string")
    b = spark.createDataFrame([("9", 0, "b"), ("2", 1, "b")], "item_id string, seq int, v string")
    assert [(r.item_id, r.v) for r in K.gathered([a, b]).collect()] == [("2", "b"), ("9", "a"), ("10", "a")]
    c = spark.createDataFrame([("x", 0, "c")], "item_id string, seq int, v string")
    assert [r.item_id for r in K.gathered([a, c]).collect()] == ["10", "9", "x"]


def test_blobs_are_written_once(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"0" * 8
    df = spark.createDataFrame([(1, png), (2, png), (3, None), (4, b"short")], "id int, image binary")
    out, blobs = K.externalised(df, ["image"], f"file://{tmp_path}/blobs")
    assert K.write_blobs(blobs) == 2 and K.write_blobs(blobs) == 0
    paths = [r.image for r in out.orderBy("id").collect()]
    assert paths[0] == paths[1] and paths[0].endswith(".png") and paths[2] is None and paths[3].endswith(".bin")


def test_small_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id int, v string")
    assert K.json_array(df.orderBy("id"), f"file://{tmp_path}/x.json") == 2
    assert json.loads((tmp_path / "x.json").read_text()) == [{"id": 1, "v": "a"}, {"id": 2, "v": "b"}]
    K.text_lines(df, "v", f"file://{tmp_path}/x.txt", ["id"])
    assert (tmp_path / "x.txt").read_text() == "a\nb"
    assert K.counted_name(df, "n") == "n_2"
    assert json.loads(K.key_value_object(df, F.concat(F.lit("v1_"), "id"), F.col("v")).first()[0]) == {"v1_1": "a", "v1_2": "b"}
    with pytest.raises(ValueError):
        K.exactly(df, 3)


def test_roots_and_arrow_folders(spark, tmp_path):
    for folder, name, n in [("b", "1.jsonl", 1), ("b", "0.jsonl", 2), ("a", "5.jsonl", 3)]:
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(json.dumps({"id": "x", "n": n}))
    got = R.jsonl_roots(spark, f"{tmp_path}/b^^{tmp_path}/a", SCHEMA).orderBy("root", "file").collect()
    assert [(r.root, r.file, r.n) for r in got] == [(0, "0.jsonl", 2), (0, "1.jsonl", 1), (1, "5.jsonl", 3)]
    rows = pa.table({"n": pa.array([1, 2, 3], pa.int64()), "more": ["x", "y", None], "id": ["a", None, "c"]})
    (tmp_path / "saved").mkdir()
    for name, writer in [("data-0.arrow", pa.ipc.new_stream), ("data-1.arrow", pa.ipc.new_file)]:
        with writer(f"{tmp_path}/saved/{name}", rows.schema) as w:
            w.write_table(rows, max_chunksize=2)
    (tmp_path / "saved" / "state.json").write_text("{}")
    got = R.arrow_folder(spark, f"{tmp_path}/saved", "id string, n long").collect()
    assert sorted((r.n, r.id) for r in got) == [(1, "a"), (1, "a"), (2, None), (2, None), (3, "c"), (3, "c")]


def test_values_of_any_form(spark):
    df = spark.createDataFrame(
        [(b"x", "p", {"bytes": b"y", "path": None}, ["p", None], [{"path": "q"}], 5), (None, None, None, None, None, None)],
        "b binary, s string, d struct<bytes:binary,path:string>, l array<string>, a array<struct<path:string>>, other int",
    )
    got, empty = df.select(*[K.normalised_values(df, c).alias(c) for c in df.columns]).collect()
    want = {"b": [(b"x", None)], "s": [(None, "p")], "d": [(b"y", None)], "l": [(None, "p"), None], "a": [(None, "q")]}
    for c, values in want.items():
        assert [x and (x["bytes"] and bytes(x["bytes"]), x["path"]) for x in got[c]] == values
    assert got["other"] == 5 and all(v is None for v in empty)
