from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gritsieve.llm import tokens

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
PLAIN = {name: Tokenizer.from_file(public_tokenizers.path(name)) for name in NAMES}
TEXTS = [
    "", " ", "\n", "a", " a", "a ", "  a  b", " \n b  c\n\n", "x y", "a\tb \n", "a\nb c\nd", "a\n b", "a \nb",
    "<|endoftext|> hi", "a<|startoftext|>b", "don't 's  'll 12 ab12", "\n\n\n  x  \n ", "\0a b", "é é ́x",
    "ÀB​c 　d", "日本 語", "\x85a", "a\x1cb c",
]


@pytest.mark.parametrize("name", NAMES)
def test_ids_are_those_of_whole_texts(name, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PARTS", 5)
    encoder = tokens.Encoder(public_tokenizers.path(name), 1)
    for texts in (TEXTS, TEXTS[::-1], TEXTS * 2):
        expected = [PLAIN[name].encode(x, add_special_tokens=False).ids + [1] for x in texts]
        assert [x.tolist() for x in encoder.encode(texts)] == expected


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sA1,. \n\t é́|<>\0"), max_size=40), max_size=5))
def test_ids_of_any_text(texts):
    for name in NAMES:
        encoder = tokens.encoder(public_tokenizers.path(name), 1)
        expected = [PLAIN[name].encode(x, add_special_tokens=False).ids + [1] for x in texts]
        assert [x.tolist() for x in encoder.encode(texts)] == expected


def test_case_and_what_follows_a_word_make_no_new_parts():
    encoder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), 1)
    texts = ["Word word, WORD.%%% word", "it's IT'S (Word) word,", "H\u0331 h\u0331 A\u030a I\u0307 <\u0338 Word,", "ßa, ÀB. Éa', ab12, zzz!''s"]
    plain = PLAIN["word_bpe_49k.json"]
    assert [x.tolist() for x in encoder.encode(texts)] == [plain.encode(x, add_special_tokens=False).ids + [1] for x in texts]
    assert set(encoder.known) >= {"word", ",", ".%%%", "it", "'s"}
    assert not {"Word", "word,", "WORD.%%%", "it's", "IT'S"} & set(encoder.known)
