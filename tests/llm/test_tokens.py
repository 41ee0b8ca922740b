"""Pieces of texts against the tokenizers library on whole texts, and how many texts the library is given."""

import os
import sys

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from keystride.llm.tokens import PieceEncoder, worker_encoder

BYTE_BPE, WORD_BPE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def reference_ids(path, texts):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def encoded(encoder, texts):
    ids, ends = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist())]


def test_marks_after_a_dotted_capital_i():
    texts = ["\u0130\u0338", "a\u0130\u0345. \u0130&& x", "B \u0130."]
    assert encoded(PieceEncoder(WORD_BPE, False, True), texts) == reference_ids(WORD_BPE, texts)


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **named):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **named)


def test_unknown_words_are_encoded_many_to_a_call():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeñöß"), rng.integers(5, 30))) for _ in range(4000)]
    texts = [f"{' '.join(words[i:i + 9])}&&& {words[i + 9]}." for i in range(0, 4000, 10)]
    encoder = PieceEncoder(WORD_BPE, False, True)
    encoder.tokenizer = Counting(encoder.tokenizer)
    assert encoded(encoder, texts) == reference_ids(WORD_BPE, texts)
    assert encoder.tokenizer.texts < 50


def test_words_of_letters_that_the_tokenizer_does_not_know():
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha() and not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"{a}{b}" for a, b in zip(letters[i:i + 500], letters[i + 1:i + 501])) for i in range(0, len(letters), 500)]
    assert encoded(PieceEncoder(WORD_BPE, False, True), texts) == reference_ids(WORD_BPE, texts)


def test_signs_after_a_letter():
    signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    texts = [f"x{a}{b} ñ{a}{b} re'{a} 's{a} \u00d7{b} e\u0301{a} {a}s{b}" for a in signs for b in ("", *signs)]
    for path, opens in ((BYTE_BPE, True), (WORD_BPE, False)):
        assert encoded(PieceEncoder(path, opens, not opens), texts) == reference_ids(path, texts)


def test_a_worker_encodes_without_threads(monkeypatch):
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "")  # so that it is as before afterwards
    monkeypatch.delenv("TOKENIZERS_PARALLELISM")
    monkeypatch.setitem(vars(sys), "_keystride_encoders", {})
    worker_encoder(WORD_BPE, False, True)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
