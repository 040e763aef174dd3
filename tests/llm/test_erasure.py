"""The files that an erasure leaves, against a version that sorts and cuts in plain Python."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.llm import erasure
from tessera.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"
MONEY = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def key_crc(k):
    return zlib.crc32(("" if k is None else str(k)).encode())


def by_force(tables, divisor=200, files=250):
    """Of each final file: what the query returns but the path, and its rows. tables: name -> (columns, rows)."""
    at = {t: {c: i for i, c in enumerate(cs)} for t, (cs, _) in tables.items()}
    get = lambda t, c: (lambda r: r[at[t][c]])
    client_of = {}
    for s in tables["sales"][1]:
        i, c = get("sales", "sale_id")(s), get("sales", "client_id")(s)
        if i is not None and c is not None:
            client_of[i] = min(c, client_of.get(i, c))
    clicks = Counter(map(get("clicks", "client_id"), tables["clicks"][1]))
    of = defaultdict(set)
    for r in tables["clients"][1]:
        if (m := get("clients", "master_id")(r)) is not None:
            of[m].add(get("clients", "client_id")(r))
    gone = {m for m in of if key_crc(m) % divisor == 0}
    if of:
        gone.add(min(of, key=lambda m: (-sum(clicks[c] for c in of[m] if c is not None), m)))
    people = {c for m in gone for c in of[m]} - {None}
    theirs = {get("sales", "sale_id")(s) for s in tables["sales"][1] if get("sales", "client_id")(s) in people} - {None}
    key = {"clients": get("clients", "client_id"), "clicks": get("clicks", "client_id"), "sales": get("sales", "client_id"), "sale_lines": lambda r: client_of.get(get("sale_lines", "sale_id")(r))}
    victim = {"clients": lambda r: get("clients", "master_id")(r) in gone, "clicks": lambda r: key["clicks"](r) in people, "sales": lambda r: key["sales"](r) in people, "sale_lines": lambda r: get("sale_lines", "sale_id")(r) in theirs}
    out, held = {}, {}
    for t, (cs, rows) in tables.items():
        rows = sorted(rows, key=lambda r: (key_crc(key[t](r)), [(v is not None, v) for v in r]))
        size = 1 + len(rows) // files
        for k in range(math.ceil(len(rows) / size)):
            part = rows[k * size : (k + 1) * size]
            left = [r for r in part if not victim[t](r)]
            if left:
                money = [r[at[t][MONEY[t]]] for r in left]
                cents = sum(math.floor(100 * x + 0.5) for x in money if x is not None and math.isfinite(x))
                sha = hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in left).encode()).hexdigest()
                out[t, k] = (len(left), len(part) - len(left), cents, len(left) < len(part), sha, ",".join(cs))
                held[t, k] = left
    return out, held


def read(folder):
    made = {t: pq.read_table(f"{folder}/{t}.parquet") for t in MONEY}
    return {t: (d.column_names, list(zip(*[c.to_pylist() for c in d.columns], strict=True))) for t, d in made.items()}


def compared(rows, tables, **k):
    want, held = by_force(tables, **k)
    got = {(r.table_name, r.file_no): (r.n_rows, r.n_erased, r.cents, r.rewritten, r.ids_sha256, r["columns"]) for r in rows}
    assert got == want and len(rows) == len(want)
    paths = {(r.table_name, r.file_no): re.sub("^file:/+", "/", r.path) for r in rows}
    for at, path in paths.items():
        file = pq.ParquetFile(path)
        made = file.read()
        assert made.column_names == tables[at[0]][0]
        assert repr(list(zip(*[c.to_pylist() for c in made.columns], strict=True))) == repr(held[at])  # NaN is no equal of itself
        for g in range(file.num_row_groups):  # what footers know
            stats = file.metadata.row_group(g).column(0).statistics
            ids = [r[0] for r in held[at] if r[0] is not None]
            if stats and stats.has_min_max:
                assert stats.min >= min(ids) and stats.max <= max(ids)
    if paths:
        top = os.path.dirname(os.path.dirname(os.path.dirname(next(iter(paths.values())))))
        there = {f"{d}/{f}" for d, _, fs in os.walk(top) for f in fs if not f.startswith((".", "_"))}
        assert there == set(paths.values())
    return want


def test_query(spark):
    rows = queries()["op11_erasure"](spark, FOLDER).collect()
    want = compared(rows, read(FOLDER))
    assert {t for t, _ in want} == set(MONEY) and any(w[3] for w in want.values()) and not all(w[3] for w in want.values())
    assert {type(rows[0][c]) for c in ("file_no", "n_rows", "n_erased", "cents")} == {int}


def test_untouched_files_stay_as_they_were(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "id % 10 AS k")
    laid = erasure.lay_out(df, "t", f"file://{tmp_path}", files=10)
    before = {f: (os.stat(f).st_mtime_ns, open(f, "rb").read()) for f in (f"{d}/{x}" for d, _, fs in os.walk(tmp_path / "t") for x in fs) if f.endswith(".parquet")}
    assert len(before) == 10
    taken = erasure.erase(laid, "id", spark.range(105, 406).toDF("key"))
    assert taken == {1: 97, 2: 101, 3: 101, 4: 2}
    after = {f: (os.stat(f).st_mtime_ns, open(f, "rb").read()) for f in (f"{d}/{x}" for d, _, fs in os.walk(tmp_path / "t") for x in fs) if f.endswith(".parquet")}
    for f in before.keys() & after.keys():
        assert before[f] == after[f]
    numbers = lambda fs: sorted(int(f.split("file_no=")[1].split("/")[0]) for f in fs)
    assert numbers(before.keys() - after.keys()) == sorted(taken) and len(after) == 10 - sum(n == 101 for n in taken.values())
    assert erasure.erase(laid, "id", spark.range(105, 406).toDF("key")) == {}  # a second run has nothing to do
    assert sorted(r.id for r in laid.read().collect()) == [*range(105), *range(406, 1000)]


NO_ROWS = {
    "clients": "client_id long, master_id long, balance double, file_no string, place string, hit string, gone_key string, at string",
    "clicks": "click_id long, client_id long, value double, file_no string",
    "sales": "sale_id long, client_id long, total double, n string, of_client string",
    "sale_lines": "sale_id long, amount double, of_client string, of_sale string, _part string",
}


@pytest.mark.parametrize("full", [False, True])
def test_odd_rows(spark, full):
    """Nulls in any column, repeated rows, ties, clashing names, long and empty texts, empty tables."""
    long = "é" * 50_000
    rows = {
        "clients": [(1, 7, 1.005, "a", "", None, long, "x"), (2, 7, None, None, "b", "", "", "x"), (3, 9, float("nan"), "a", "", "", "", ""), (None, 7, 2.5, "a", "", "", "", ""), (4, None, -0.125, "", "", "", "", ""), (2, 7, None, None, "b", "", "", "x")],
        "clicks": [(i, [1, 2, 3, None][i % 4], [1.0, None, float("inf"), 0.005][i % 4], "f") for i in range(20)] + [(None, None, None, None), (None, 1, None, None), (0, 1, 1.0, "f")],
        "sales": [(1, 1, 5.0, "", None), (1, 3, 6.0, "", None), (2, 3, 1.0, "", None), (None, 1, 1.0, "", None), (3, None, 1.0, None, None), (4, 3, 2.0, "", "")],
        "sale_lines": [(s, float(s or 0), "c", "d", long) for s in (1, 1, 2, 2, 3, 4, None, 77, 4)],
    }
    made = {t: spark.createDataFrame(rows[t] if full else [], s) for t, s in NO_ROWS.items()}
    out = erasure.erasure(made["clients"], made["clicks"], made["sales"], made["sale_lines"], divisor=1000, files=4).collect()
    if full:
        compared(out, {t: (made[t].columns, rows[t]) for t in rows}, divisor=1000, files=4)
    else:
        assert out == []


def test_a_hot_client(spark, tmp_path):
    """A third of the clicks, and of the lines one sale's, are of one client; the most clicked master goes with its files."""
    n = 3000
    clients = spark.range(50).selectExpr("id AS client_id", "id % 20 AS master_id", "cast(id AS double) AS balance")
    clicks = spark.range(n).selectExpr("id AS click_id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 50 END AS client_id", "id / 7 AS value")
    sales = spark.range(200).selectExpr("id AS sale_id", "CASE WHEN id = 5 THEN 7 ELSE id % 50 END AS client_id", "id / 3 AS total")
    lines = spark.range(n).selectExpr("CASE WHEN id % 3 = 0 THEN 5 ELSE id % 230 END AS sale_id", "1.5D AS amount")
    made = {"clients": clients, "clicks": clicks, "sales": sales, "sale_lines": lines}
    for t, d in made.items():
        pq.write_table(pa.Table.from_pandas(d.toPandas()), f"{tmp_path}/{t}.parquet")
    want = compared(erasure.erasure(*made.values()).collect(), read(tmp_path))
    assert {t for t, _ in want} == set(made) and sum(w[0] for (t, _), w in want.items() if t == "clicks") <= n - n // 3
