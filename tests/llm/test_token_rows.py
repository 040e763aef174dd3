"""Token files of rows without an id, and of many rows of one id."""

import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tessera.llm import bit_packing


def test_rows_without_an_id_come_first(spark, edges, monkeypatch):
    monkeypatch.setattr(bit_packing, "FILE_IDS", 40)
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = [(None if k % 3 else k % 4, t) for k, t in enumerate(edges + [f"some text {i}" for i in range(40)])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in bit_packing.token_files(df, path, 50_257).collect())
    want, before = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((before, i, len(ids), zlib.crc32(ids.tobytes())))
        before += len(ids)
    assert got == want and sum(i is None for _, i, _, _ in got) > 20


def test_a_file_tells_a_missing_id_from_0():
    f = bit_packing.BitFile(bit_packing.file_image(np.array([0, 0, 5]), np.array([1, 2, 1]), np.arange(4, dtype=np.uint32), 16, 1))
    assert (f.nulls, f.n_docs, f.document(1).tolist()) == (1, 3, [1, 2])
