"""Tar shards and npz arrays that several tasks read, whole and broken ones."""

import io
import random
import tarfile

import numpy as np
import pytest

from tessera.sources import archives as A


def tar(path, members, fmt=tarfile.PAX_FORMAT):
    with tarfile.open(path, "w", format=fmt) as t:
        for name, body in members:
            i = tarfile.TarInfo(name)
            i.size = len(body)
            t.addfile(i, io.BytesIO(body))


def samples_by_force(members):
    """Runs of one key; an extension that comes again begins a new sample."""
    out, key, parts = [], None, {}
    for name, body in members:
        folder, _, base = name.rpartition("/")
        stem, dot, ext = base.partition(".")
        if not dot or not stem:
            continue
        stem = f"{folder}/{stem}" if folder else stem
        if stem != key or ext.lower() in parts:
            if parts:
                out.append((key, parts))
            key, parts = stem, {}
        parts[ext.lower()] = body
    return [*out, (key, parts)] if parts else out


def got(rows):
    rows = [(r["__key__"], {k: bytes(v) for k, v in (r["parts"].items() if isinstance(r["parts"], dict) else [(x.key, x.value) for x in r["parts"]])}, r["error"]) for r in rows.collect()]
    order = lambda x: (x[0], sorted(x[1].items()))
    return sorted([(k, p) for k, p, e in rows if e is None], key=order), sorted(e for _, _, e in rows if e)


def members(seed, n=60):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        key = f"{'d/' if k % 7 == 0 else ''}s{k:03d}" + ("é" * 60 if k % 11 == 0 else "") + ("x" * 120 if k % 13 == 0 else "")
        out += [(f"{key}.{e}", rng.randbytes(rng.choice([0, 1, 511, 512, 513, 3000]))) for e in rng.sample(["jpg", "TXT", "seg.png", "json"], rng.randrange(1, 5))]
    return [*out, ("no_extension", b"?"), ("s.jpg", b"1"), ("s.jpg", b"2"), ("s.txt", b"3"), (".hidden", b"4")]


@pytest.mark.parametrize("fmt", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT])
def test_one_shard_is_read_by_many_tasks(spark, tmp_path, fmt):
    made = members(1)
    tar(tmp_path / "a.tar", made, fmt)
    want = sorted(samples_by_force(made), key=lambda x: (x[0], sorted(x[1].items())))
    ranges = list(A.tar_ranges(f"file://{tmp_path}/a.tar", 4096))
    assert len(ranges) > 10 and ranges[0][1] == 0 and all(a[2] == b[1] for a, b in zip(ranges, ranges[1:], strict=False))
    for chunk in (1, 4096, 1 << 30):
        assert got(A.tar_samples(spark, f"{tmp_path}/*.tar", chunk)) == (want, [])
    A.register(spark)
    source = spark.read.format("tessera_tar").option("chunk", 4096).load(f"{tmp_path}/*.tar")
    assert source.rdd.getNumPartitions() == len(ranges) and got(source) == (want, [])


def test_broken_members_are_rows(spark, tmp_path):
    made = members(2, 20)
    tar(tmp_path / "a.tar", made)
    raw = bytearray((tmp_path / "a.tar").read_bytes())
    with tarfile.open(tmp_path / "a.tar") as t:
        at = [m for m in t if m.name.startswith("s01")]
    hurt = at[6]
    raw[hurt.offset : hurt.offset + 512] = b"\x01" * 512  # a header that is none
    (tmp_path / "b.tar").write_bytes(raw)
    left = [m for m in made if m[0] != hurt.name]
    found, errors = got(A.tar_samples(spark, f"{tmp_path}/b.tar", 2048))
    assert [e.split(":")[0] for e in errors] == [f"byte {hurt.offset}"]
    flat = lambda samples: sorted((k, e, b) for k, p in samples for e, b in p.items())
    assert flat(found) == flat(samples_by_force(left))

    tar(tmp_path / "c.tar", [("k1.jpg", b"J" * 1000), ("k2.jpg", b"K" * 5000)])
    (tmp_path / "c.tar").write_bytes((tmp_path / "c.tar").read_bytes()[:3000])  # cut within a member
    assert got(A.tar_samples(spark, f"{tmp_path}/c.tar")) == ([("k1", {"jpg": b"J" * 1000})], ["k2.jpg: 952 of 5000 bytes"])
    (tmp_path / "d.tar").write_bytes(b"no tar at all")
    (tmp_path / "e.tar").write_bytes(b"")
    tar(tmp_path / "f.tar", [])
    samples, errors = got(A.tar_samples(spark, f"{tmp_path}/[def].tar"))
    assert samples == [] and errors in (["byte 0: truncated header"], ["byte 0: empty file", "byte 0: truncated header"])  # empty files may not be listed


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_rows_of_arrays(spark, tmp_path, save):
    """Ranges of rows, the last one and the last batch shorter; other types and shapes; broken files."""
    a = np.random.default_rng(1).normal(size=(1003, 3, 4)).astype(np.float32)
    save(tmp_path / "a.npz", arr_0=a, other=np.arange(7, dtype=np.int16))
    save(tmp_path / "b.npz", arr_0=np.zeros((0, 5)))
    want = [(k, v.reshape(-1).astype(float).tolist()) for k, v in enumerate(a)]
    for chunk, batch in ((48 * 100, 64), (1, 10), (1 << 30, 1024)):
        rows = A.npz_rows(spark, f"{tmp_path}/*.npz", batch=batch, chunk=chunk)
        assert [(r.row, r["values"]) for r in rows.orderBy("row").collect()] == want
    ranges = list(A.npz_ranges(f"file://{tmp_path}/a.npz", chunk=48 * 100))
    assert len(ranges) == (11 if save is np.savez else 1)
    sizes = [b.num_rows for b in A.npz_read(f"file://{tmp_path}/a.npz", 0, 1003, batch=100)]
    assert sizes == [100] * 10 + [3]
    A.register(spark)
    source = spark.read.format("tessera_npz").option("array", "other").option("chunk", 4).load(f"{tmp_path}/a.npz")
    assert [r["values"] for r in source.orderBy("row").collect()] == [[float(k)] for k in range(7)]
    assert source.rdd.getNumPartitions() == (4 if save is np.savez else 1)
    (tmp_path / "c.npz").write_bytes((tmp_path / "a.npz").read_bytes()[:2000])
    np.savez(tmp_path / "d.npz", arr_0=np.asfortranarray(a[:, :, 0]))
    rows = A.npz_rows(spark, f"{tmp_path}/[cd].npz").collect()
    assert sorted(r.file[-5] for r in rows if r.error) == ["c", "d"] and len(rows) == 2


def test_a_source_over_no_files(spark, tmp_path):
    A.register(spark)
    assert spark.read.format("tessera_tar").load(f"{tmp_path}/*.tar").count() == 0
