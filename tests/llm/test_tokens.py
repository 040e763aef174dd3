"""Encoding, packing and files, against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tessera.llm import bit_packing, packing, sentence_pieces
from tessera.llm.tokens import Encoder

PARTS = [*"abZé.,'1 \n\t!İßΩ日\r<", "don't", " the ", "\x1c", "\xa0", "▁", "\0"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=20).map("".join)
FILES = {"words": "word_bpe_49k.json", "spaces": "byte_bpe_50k.json"}
ENC = {k: Encoder(P.path(f), k) for k, f in FILES.items()}
CODER = sentence_pieces.PieceCoder(P.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("kind", FILES)
@given(text=TEXT)
@settings(max_examples=300, deadline=None)
def test_encoder_is_exact(kind, text):
    assert ENC[kind](text).tolist() == ENC[kind].tok.encode(text, add_special_tokens=False).ids


@given(text=TEXT)
@settings(max_examples=300, deadline=None)
def test_pieces_are_exact_and_cover_the_text(text):
    ids, ends = CODER.encode(text)
    assert ids.tolist() == CODER.sp.encode(text)
    assert not len(ids) or (ends[-1] == len(text.encode()) and (np.diff(ends) >= 0).all())
    if "\0" not in text and "▁" not in text:
        raw = text.encode()
        spans = zip(np.concatenate([[0], ends[:-1]]), ends, strict=True) if len(ids) else []
        assert b"".join(raw[a:b] for a, b in spans) == raw


def test_longest_prefix_through_a_character_map():
    class Map(sentence_pieces.CharacterMap):
        def __init__(self):
            self.rules = {b"ab": b"X", b"a": b"y"}

        def longest(self, text, at):
            return next(((n, self.rules[text[at : at + n]]) for n in (2, 1) if text[at : at + n] in self.rules), None)

    out, align = sentence_pieces.normalised("abac", Map(), dummy=False, squeeze=False)
    assert out == "Xyc" and align.tolist() == [0, 2, 3, 4]


def test_piece_digests(spark, docs, edges):
    sp = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in sentence_pieces.digests(docs(edges, True), P.path("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(edges):
        ids = sp.encode(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((sp.decode(ids) if ids else "").encode()).hexdigest()


@given(st.lists(st.integers(0, 2**17 - 1), max_size=60), st.integers(17, 20))
@settings(max_examples=100, deadline=None)
def test_bits_round_trip(ids, bits):
    ids = np.array(ids, np.uint32)
    data = bit_packing.pack(ids, bits)
    assert len(data) == (len(ids) * bits + 7) // 8
    for first in range(0, len(ids), 7):
        assert (bit_packing.unpack(data, first, len(ids) - first, bits) == ids[first:]).all()


def test_file_gives_any_document(monkeypatch):
    monkeypatch.setattr(bit_packing, "BLOCK", 5)
    lengths = np.array([3, 1, 9, 4])
    ids = np.arange(17) * 3001 % 50257
    f = bit_packing.BitFile(bit_packing.file_image(np.array([2, 4, 6, 9]), lengths, ids.astype(np.uint32), 16))
    ends = np.cumsum(lengths)
    for k in (2, 0, 3, 1):
        assert f.document(k).tolist() == ids[ends[k] - lengths[k] : ends[k]].tolist()


def test_token_files(spark, docs, edges):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    before = 0
    got = bit_packing.token_files(docs(edges, True), P.path("byte_bpe_50k.json"), 50_257).orderBy("doc_id").collect()
    for r, t in zip(got, edges, strict=True):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)
    assert bit_packing.token_files(docs([]), P.path("byte_bpe_50k.json"), 50_257).count() == 0


def unpacked(plan):
    out = {}
    for r in plan:
        for t in range(r["n"]):
            out.setdefault(int(r["sequence"] + t // r["each"]), []).append((int(r["offset"] + t % r["each"] * r["length"]), int(r["length"])))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_gapless_and_near_the_bound(seed):
    rng = random.Random(seed)
    lengths = [min(256, max(1, int(rng.lognormvariate(3.5, 1.2)))) for _ in range(rng.choice([0, 1, 30, 2000]))]
    counts = np.bincount(lengths, minlength=257) if lengths else np.zeros(257, np.int64)
    sequences = unpacked(packing.packing_plan(counts, 256, groups=64))
    assert sorted(x for s in sequences.values() for _, x in s) == sorted(lengths)
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 256
    if len(lengths) > 1000:
        assert len(sequences) <= 1.02 * sum(lengths) / 256 + 1


def test_packed_documents(spark, docs, edges):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = packing.packed(docs(edges, True), P.path("word_bpe_49k.json"), capacity=512).collect()
    by, filled = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(edges):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            part = ids[r.start : r.start + r.length]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, 512 * k, len(part), zlib.crc32(part.tobytes()))
        assert sum(r.length for r in by[i]) == len(ids)
    for s in filled.values():
        assert sorted(s)[0][0] == 0 and sum(n for _, n in s) <= 512
    assert packing.packed(docs([]), P.path("word_bpe_49k.json")).count() == 0


def model_of(tmp_path, charsmap=b"", rules=None, squeeze=False, dummy=True):
    """A model of merges with a compiled character map, as a file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 2, True
    m.normalizer_spec.name = "user_defined" if charsmap else "identity"
    m.normalizer_spec.precompiled_charsmap = charsmap
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = dummy, squeeze, True
    for piece, kind in [("<unk>", 2), ("<s>", 3), ("</s>", 3)] + [(f"<0x{k:02X}>", 6) for k in range(256)]:
        m.pieces.add(piece=piece, score=0, type=kind)
    for k, piece in enumerate(["▁a", "ab", "▁ab", "abc", "bc", "ss", "s", "▁▁", "X", "Xa", "a", "b", "c", "▁", "é", "▁Xab"]):
        m.pieces.add(piece=piece, score=-k, type=1)
    path = f"{tmp_path}/m.model"
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    return path


def double_array(rules):
    """A compiled map: a double-array trie of the keys, then the replacements, each ended by a zero byte."""
    trie = {}
    texts, places = b"", {}
    for key, value in rules.items():
        places[key] = len(texts)
        texts += value + b"\0"
        node = trie
        for byte in key:
            node = node.setdefault(byte, {})
        node[None] = places[key]
    units, used = {0: 0}, {0}
    todo = [(0, trie)]
    while todo:
        at, node = todo.pop(0)
        labels = [0 if k is None else k for k in node]
        # children stand at base ^ label, with base = at ^ offset; offsets below 2**21 are written as they are
        offset = next(o for o in range(1, 1 << 16) if all((at ^ o ^ b) not in used for b in labels) and (at ^ o) not in used)
        units[at] = units[at] | offset << 10 | (256 if None in node else 0)
        for k, child in node.items():
            place = at ^ offset ^ (0 if k is None else k)
            used.add(place)
            if k is None:
                units[place] = 1 << 31 | child
            else:
                units[place] = k
                todo.append((place, child))
        used.add(at ^ offset)
    size = (max(used) // 256 + 2) * 256
    words = np.zeros(size, "<u4")
    for k, v in units.items():
        words[k] = v
    return (4 * size).to_bytes(4, "little") + words.tobytes() + texts


RULES = {b"A": b"a", "ß".encode(): b"ss", b"ab": b"X", "ﬁ".encode(): b"c", b"abc": b"abc", " ".encode(): b" ", b"\t": b" "}


@pytest.mark.parametrize(("squeeze", "dummy", "mapped"), [(False, True, True), (True, True, True), (False, False, True), (True, True, False), (False, True, False), (False, False, False)])
def test_segments_of_models_equal_the_library(tmp_path, squeeze, dummy, mapped):
    coder = sentence_pieces.PieceCoder(model_of(tmp_path, double_array(RULES) if mapped else b"", squeeze=squeeze, dummy=dummy))
    rng = random.Random(8)
    for _ in range(1500):
        text = "".join(rng.choice([*"abcAs \tß", "ﬁ", " ", "  ", "é", "zz", "abc", "\n", "日"]) for _ in range(rng.choice([0, 1, 5, 12, 90])))
        ids, ends = coder.encode(text)
        assert ids.tolist() == coder.sp.encode(text), text
        assert not len(ends) or (np.diff(ends) >= 0).all() and ends[-1] <= len(text.encode())


def test_longest_keys_of_a_compiled_map():
    found = sentence_pieces.CharacterMap(double_array(RULES))
    for text in (b"abc", b"abd", b"Aab", "ßx".encode(), b"zz", b"a"):
        want = max((k for k in RULES if text.startswith(k)), key=len, default=None)
        assert found.longest(text, 0) == (None if want is None else (len(want), RULES[want]))
