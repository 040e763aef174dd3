"""Signs behind a word are cut off before it is looked up, and what comes once does not fill a cache."""

import random

import public_tokenizers
import pytest

from tessera.llm import tokens

FILES = {"spaces": "byte_bpe_50k.json", "words": "word_bpe_49k.json"}
PARTS = ["word", "é", "ÀB", "ß", "İ", "I", "ı", "Ǆ", "ƻ", "ª", "×", "é", "́", "日", "я", "7", "²", "'s", "'", "don't", ",", ".", "...", '."', ").", "-", "_", "<", "|", " ", " ", " ", "\n", "\t", "\xa0", "\x1c"]


@pytest.mark.parametrize("kind", FILES)
def test_ids_with_signs(kind):
    enc = tokens.Encoder(public_tokenizers.path(FILES[kind]), kind)
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 14))) for _ in range(6000)]
    texts += [f"{a}{s}{b}" for a in PARTS for s in (",", "),", ".'", "'.") for b in ("", " ", " x", "\n", "\nx", "\tx", "́", " ́")]
    for text in texts:
        assert enc(text).tolist() == enc.tok.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("kind", FILES)
def test_a_word_is_kept_once(kind):
    enc = tokens.Encoder(public_tokenizers.path(FILES[kind]), kind)
    enc("a word, a word. a word! (a word) word?\na word;")
    assert [k for k in (*enc.heads, *enc.spaced) if "word" in k] == ["word"]


def test_what_comes_once_is_not_kept():
    cache = tokens._Segments(str.encode)
    assert cache["first"] == b"first" and "first" in cache  # a first generation keeps all
    cache.age()
    for k in range(100):
        assert cache[f"rare {k}"] == f"rare {k}".encode() and cache["first"] == b"first"
    assert len(cache) < 10
    assert cache["rare 5"] == b"rare 5" and "rare 5" in cache
