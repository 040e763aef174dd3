"""SentencePiece encoding and decoding with byte offsets.

Normalisation follows the model's own compiled character map: at each position the longest prefix found in its trie is
replaced, and every normalised byte remembers the source bytes that it stands for. Pieces are then found on the
normalised text by the model's own merges, and projected through that alignment to spans of the original bytes. A model
without a map (identity) keeps each character; its texts are cut into segments that no piece crosses, and what a segment
gives is remembered. White space becomes the model's escape mark, and a mark is put before the text if the model says so.
The library reads the model file and decodes; that the ids are its own is tested.

Null and empty texts have no pieces and decode to the empty string. Rows without an id or with the same id are rows of their
own; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.shared import column

MARK = "▁"
CACHE_SEGMENTS = 300_000
CACHE_CHARS = 48
#: Characters from which on merges are found by a heap.
LONG = 48


class CharacterMap:
    """Longest-prefix replacement by a compiled map: a double-array trie, then the replacements, each ended by a zero byte."""

    def __init__(self, compiled: bytes):
        self.units = np.zeros(0, np.uint32)
        self.texts = b""
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.units = np.frombuffer(compiled, np.uint32, size // 4, 4)
            self.texts = compiled[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that begins at `at`, and what replaces it."""
        if not len(self.units):
            return None
        offset = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
        found = None
        node = offset(int(self.units[0]))
        for k in range(at, len(text)):
            byte = text[k]
            node ^= byte
            unit = int(self.units[node])
            if unit & 0x800000FF != byte:
                break
            node ^= offset(unit)
            if (unit >> 8) & 1:
                value = int(self.units[node]) & 0x7FFFFFFF
                found = k + 1 - at, self.texts[value : self.texts.index(b"\0", value)]
        return found


def normalised(text: str, char_map: CharacterMap, dummy: bool, squeeze: bool) -> tuple[str, np.ndarray]:
    """The normalised text, and for each of its UTF-8 bytes the source byte at which it begins; one more entry for the end."""
    raw = text.encode()
    out, align = bytearray(), []
    mark = MARK.encode()
    at = 0

    def put(piece: bytes, source: int) -> None:
        for ch in piece.decode(errors="replace"):
            made = mark if ch == " " else ch.encode()
            if squeeze and made == mark and (not out or out.endswith(mark)):
                continue
            out.extend(made)
            align.extend([source] * len(made))

    if dummy and raw:
        out.extend(mark)
        align.extend([0] * len(mark))
    while at < len(raw):
        hit = char_map.longest(raw, at)
        if hit:
            put(hit[1], at)
            at += hit[0]
        else:
            width = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
            put(raw[at : at + width], at)
            at += width
    if squeeze:
        while out.endswith(mark):
            del out[-len(mark) :], align[-len(mark) :]
    return out.decode(), np.array([*align, len(raw)], np.int64)


class PieceCoder:
    """Normalisation by the model's map, then the model's merges; the library only reads the model and decodes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        model.ParseFromString(self.sp.serialized_model_proto())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not spec.escape_whitespaces:
            raise ValueError("only models of merges with escaped white space are segmented here")
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not segmented here")
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        pieces = [p.piece for p in model.pieces]
        self.id_of = {p.piece: k for k, p in enumerate(model.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.byte_id = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == 6}
        #: Bytes of the source that a piece stands for where each character is kept: a mark is one blank.
        self.source_bytes = np.array([1 if p.type == 6 else len(p.piece.replace(MARK, " ").encode()) for p in model.pieces], np.int64)
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == 2)
        # segments can be told apart where no piece crosses: before a mark, and before a line end
        self.splits = not len(self.map.units) and not self.squeeze and bool(self.byte_id) and not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
        self.parts = re.compile(r"(?: +|\n)[^ \n]*")
        self.cache: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a normalised text: of neighbours that make a piece, the best score is joined first, the first of equals."""
        parts = list(text)
        if len(parts) > LONG:
            return self._merged_by_heap(parts)
        get, none = self.score.get, -inf
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while scores:
            best = max(scores)
            if best == none:
                break
            at = scores.index(best)
            joined = parts[at] + parts.pop(at + 1)
            parts[at] = joined
            del scores[at]
            if at:
                scores[at - 1] = get(parts[at - 1] + joined, none)
            if at < len(scores):
                scores[at] = get(joined + parts[at + 1], none)
        return parts

    def _merged_by_heap(self, parts: list) -> list[str]:
        """The same for long texts, with a heap of neighbours and links between what is left."""
        n, get = len(parts), self.score.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (x := get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-x, i, j, len(parts[i]) + len(parts[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def _ids(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a normalised text, and where each ends in its bytes. Unknown characters become their bytes, or one unknown id a run."""
        ids, ends, at, was_unknown = [], [], 0, False
        for p in self.merged(text):
            known = self.id_of.get(p)
            if known is not None:
                at += len(p.encode())
                ids.append(known)
                ends.append(at)
            elif self.byte_id:
                for byte in p.encode():
                    at += 1
                    ids.append(self.byte_id[byte])
                    ends.append(at)
            else:
                at += len(p.encode())
                if was_unknown:
                    ends[-1] = at
                else:
                    ids.append(self.unknown)
                    ends.append(at)
            was_unknown = known is None and not self.byte_id
        return ids, ends

    def _coded(self, text: str, first: bool) -> tuple[bytes, bytes]:
        """Ids of a text, or of a segment in its midst, and where each ends in its source bytes by the recorded alignment."""
        out, source = normalised(text, self.map, self.dummy and first, self.squeeze)
        ids, ends = self._ids(out)
        return np.array(ids, np.int32).tobytes(), source[np.array(ends, np.int64)].astype(np.int64).tobytes()

    def _segment(self, piece: str, first: bool = False) -> bytes:
        """Ids of the text's beginning, or of a space or line end and what follows it; without a map each character is kept."""
        text = piece.replace(" ", MARK)
        parts = self.merged(MARK + text if first and self.dummy else text)
        try:
            ids = [self.id_of[p] for p in parts]
        except KeyError:
            ids = self._ids("".join(parts))[0]
        made = np.array(ids, np.int32).tobytes()
        if len(piece) <= CACHE_CHARS and not first:
            if len(self.cache) > CACHE_SEGMENTS:
                self.cache.clear()
            self.cache[piece] = made
        return made

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and where in the text's UTF-8 bytes each ends (it begins where the one before ends)."""
        if not text:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if not self.splits or MARK in text:
            ids, ends = self._coded(text, True)
            return np.frombuffer(ids, np.int32), np.frombuffer(ends, np.int64)
        head = re.match(r" *\n?[^ \n]*", text)[0]
        get, make = self.cache.get, self._segment
        parts = [self._segment(head, True)]
        parts += [get(p) or make(p) for p in self.parts.findall(text, len(head))]
        ids = np.frombuffer(b"".join(parts), np.int32)
        # each character is aligned with itself: a piece stands for its own bytes, the mark put before the text for none
        return ids, np.maximum(np.cumsum(self.source_bytes[ids]) - int(self.dummy), 0)

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist()) if len(ids) else ""


_coders: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ids array<int>, starts and ends array<long> (byte spans) of each document, and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            for at in range(0, b.num_rows, 64):  # long texts: few at a time
                part = b.slice(at, 64)
                made = [c.encode(t) for t in column(part, text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        column(part, id_col).cast(pa.int64()),
                        pa.array([i for i, _ in made], pa.list_(pa.int32())),
                        pa.array([np.concatenate([[0], e[:-1]]).astype(np.int64) if len(e) else e for _, e in made], pa.list_(pa.int64())),
                        pa.array([e for _, e in made], pa.list_(pa.int64())),
                        pa.array([c.decode(i) for i, _ in made], pa.string()),
                    ],
                    names=["doc_id", "ids", "starts", "ends", "decoded"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, starts array<long>, ends array<long>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the count and hash of its ids, the hash of the decoded text, and the source bytes that its pieces cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            rows = []
            for doc, t in zip(column(b, id_col).to_pylist(), (x.as_py() for x in column(b, text_col)), strict=True):
                ids, ends = c.encode(t)
                rows.append(
                    (doc, len(ids), hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest(), int(ends[-1]) if len(ends) else 0)
                )
            ids_, n, h, d, cov = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids_, pa.int64()), pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(d, pa.string()), pa.array(cov, pa.int64())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")
