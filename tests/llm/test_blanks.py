"""White space is found by searches for each of its signs, in texts of any of them."""

import sys

import public_tokenizers
import pytest

from tessera.llm import tokens


def test_no_white_space_is_missed():
    assert {c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()} == {" ", "\n", *tokens.SEPARATORS, *tokens.BLANKS}


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "spaces"), ("word_bpe_49k.json", "words")])
def test_ids_with_each_blank(name, kind):
    enc = tokens.Encoder(public_tokenizers.path(name), kind)
    for c in tokens.SEPARATORS + tokens.BLANKS:
        for text in (f"one{c}two three", f"one {c} two\n{c}three", f"{c}one", f"一 é{c}{c}two, "):
            assert enc(text).tolist() == enc.tok.encode(text, add_special_tokens=False).ids
