"""Decoding by the pieces' bytes beside the library's decoder."""

import random

import pytest

from spanloom.llm import pieces
from spanloom.llm.pieces import MODEL, _tools, _verified, encode_texts


def test_same_as_the_decoder():
    with open(MODEL, "rb") as f:
        model, tokenizer, reference = _tools(f.read())
    rng = random.Random(6)
    texts = ["", " ", "  a", "a ", "\x00\x01", "<0x41>", "<unk>", "</s> <s>", "\u2581", "a\u2581b", "\ufffd", "\U0001f9e0\u0301 x", "\t\n"]
    texts += ["".join(rng.choice("ab é日\U00010348 \u2581\n<>") for _ in range(rng.randint(1, 30))) for _ in range(400)]
    ids, same, back = _verified(model, tokenizer, reference, texts)
    assert ids == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert back == [a == b for a, b in zip(texts, tokenizer.decode_batch(ids, skip_special_tokens=False), strict=True)]
    assert same == [a == b for a, b in zip(ids, reference.encode(texts), strict=True)]


@pytest.mark.parametrize("odd", ["", "\u2581", " ", "\x00", "\t\n", "</s>"])
def test_new_words_are_encoded_together(odd, monkeypatch):
    with open(MODEL, "rb") as f:
        data = f.read()
    rng = random.Random(len(odd))
    texts = [" ".join("".join(rng.choice("abcé日\U00010348.") for _ in range(rng.randint(1, 9))) for _ in range(60)) + odd + "x" for _ in range(30)] + [odd, None]
    met = []
    monkeypatch.setattr(pieces, "KNOWN", 100)
    monkeypatch.setattr(pieces, "_verified", lambda m, t, r, some: met.extend(some) or _verified(m, t, r, some))
    reference = _tools(data)[2]
    for some in (texts, texts[::-1]):
        ids, same, back = encode_texts(data, some)
        assert ids == reference.encode([t or "" for t in some]) and all(same)
        assert back == [odd != "\u2581" or not t for t in some]
    assert len(met) < 300


def test_words_of_a_group_that_differs_are_told_apart(monkeypatch):
    with open(MODEL, "rb") as f:
        data = f.read()

    def verified(m, t, r, some):
        ids, same, back = _verified(m, t, r, some)
        return ids, [s and "badger" not in x for s, x in zip(same, some)], [b and "lossy" not in x for b, x in zip(back, some)]

    monkeypatch.setattr(pieces, "_verified", verified)
    pieces._known.cache_clear()
    texts = ["one badger two", "three lossy", "one two three", None]
    want = _tools(data)[2].encode([t or "" for t in texts])
    assert encode_texts(data, texts) == (want, [False, True, True, True], [True, False, True, True])
    pieces._known.cache_clear()
