"""Whole-text encoding with public tokenizers, each distinct segment once: the segments are cut where no token can cross.

The caches hold a bounded number of segments a Python worker, so memory does not follow the input.
"""

from __future__ import annotations

import os
import re
import string
from array import array

import numpy as np

#: Segments of a cache's generation. The last one is kept beside the new one, so that what is in use is not encoded again.
#: "words" has less room: the pipeline's executors hold the workers of other stages too.
CACHE_SEGMENTS = {"spaces": 200_000, "words": 100_000}
#: Marks by which a cache knows what it was asked for before; two segments with one mark only fill it sooner.
CACHE_MARKS = 1 << 21
#: Longer segments are encoded each time.
CACHE_CHARS = 48
#: Control characters that Python and the tokenizers treat differently.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: All other white space but space and line end. One search a sign is quicker than the set of a text's characters.
BLANKS = "\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
DOUBLED = ("  ", "\n\n", " \n", "\n ")
#: Signs that make one unit after letters; the apostrophe may belong to what follows.
SIGNS = string.punctuation.replace("'", "")
#: Latin letters behind which signs begin a unit of their own; the dotted capital I is two characters in lower case.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: Stands before signs that were cut off the word before them; texts that hold it are encoded whole.
CUT_OFF = SEPARATORS[0]


class _Segments(dict):
    """segment -> its ids as bytes. Most segments come once: after the first generation, one is kept from its second time on."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.last, self.asked = encode, {}, None

    def __missing__(self, piece):
        made = self.last.get(piece)
        if made is None:
            made = self.encode(piece)
            if self.asked is not None:
                mark = hash(piece) % CACHE_MARKS
                if not self.asked[mark]:
                    self.asked[mark] = 1
                    return made
        if len(piece) <= CACHE_CHARS:
            self[piece] = made
        return made

    def age(self):
        """What has not been asked for since the last call is dropped."""
        self.last, self.asked = dict(self), bytearray(CACHE_MARKS)
        self.clear()


class Encoder:
    """Ids of whole texts, exactly as the tokenizers library gives them without special tokens being added.

    kind "spaces": byte-level pieces, cut before a space that a non-blank follows. kind "words": white space is dropped
    by the tokenizer, so any white space cuts. Texts with anything for which these cuts might not hold (the strings of
    special tokens, separators on which Python and the tokenizer differ) are encoded whole. A segment of Latin letters
    and then ASCII signs other than the apostrophe is one or two units of the merging model, which then is asked directly.
    Such signs are cut off their words beforehand, so that a word is encoded and kept once, whatever follows it.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.kind = kind
        self.cut = re.compile(r" (?=\S)")
        # signs between a letter and white space; that the first sign is sought makes the search quick
        signs, behind = re.escape(SIGNS), r"\S" if kind == "words" else r"[^ \n]"
        self.signs = re.compile(rf"([{signs}](?<=[{LETTERS}].)[{signs}]*)(?!{behind})")
        self.heads, self.spaced = _Segments(lambda w: self._one(w, "")), _Segments(lambda w: self._one(w, " "))
        self.tails = _Segments(self._whole)
        self.line_end = self._whole("\n")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        # byte-level tokenizers write each byte as a visible character
        self.visible = {**{b: b for b in shown}, **{b: 256 + k for k, b in enumerate(hidden)}}
        self.space = " ".translate(self.visible)

    def _whole(self, piece: str) -> bytes:
        return array("I", self.tok.encode(piece, add_special_tokens=False).ids).tobytes()

    def _plain(self, letters: str) -> bool:
        """Latin letters, which stay letters in lower case."""
        return letters.isascii() or (max(letters) < "\u0250" and (self.kind == "spaces" or "\u0130" not in letters))

    def _one(self, word: str, space: str) -> bytes:
        """Ids of a segment; space is what stands before it."""
        if not word.isalpha():
            if word.startswith(CUT_OFF):
                return self.tails[word[1:]]
            core = word.rstrip(SIGNS)
            if len(core) < len(word) and core.isalpha() and self._plain(core):
                return (self.spaced if space else self.heads)[core] + self.tails[word[len(core) :]]
            return self._whole(space + word)
        if len(word) > CACHE_CHARS or not self._plain(word):
            return self._whole(space + word)
        if self.kind == "words" and (low := word.lower()) != word:
            return self.heads[low]
        unit = word if word.isascii() else word.encode().decode("latin-1")
        if not unit.isprintable():  # of the bytes of letters, just those that are not shown as themselves
            unit = unit.translate(self.visible)
        return array("I", [t.id for t in self.model.tokenize(self.space + unit if space else unit)]).tobytes()

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if "<|" in text or any(c in text for c in SEPARATORS):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
        for cache in (self.heads, self.spaced, self.tails):
            if len(cache) > CACHE_SEGMENTS[self.kind]:
                cache.age()
        head, spaced = self.heads.__getitem__, self.spaced.__getitem__
        if self.kind == "words":
            made = b"".join(map(head, self.signs.sub(r" \1", text).split()))
        elif not any(d in text for d in DOUBLED) and not any(c in text for c in BLANKS):
            # single spaces and line ends only: a line end between other characters is a piece of its own
            lines = (line.split(" ") for line in self.signs.sub(rf" {CUT_OFF}\1", text).split("\n"))
            made = self.line_end.join([b"".join([head(first), *map(spaced, rest)]) for first, *rest in lines])
        else:
            first, *rest = self.cut.split(text)
            made = b"".join([head(first), *map(spaced, rest)])
        return np.frombuffer(made, np.uint32)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """This worker's encoder; loaded once."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
