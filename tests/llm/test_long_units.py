"""Texts without spaces: equal to the library, and in a time that grows with their length."""

import random
import time

import pytest

from vitrina.llm import piece_codec, queries


@pytest.fixture(scope="module")
def codec():
    return piece_codec.PieceCodec(queries.piece_model())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())


def equal(codec, library, texts):
    ids, counts, decoded = codec.run(texts)
    for text, row, count, back in zip(texts, ids, counts, decoded):
        want = library.encode(text)
        assert row == ",".join(map(str, want)) and count == len(want) and back == library.decode(want)


def test_long_units_equal_the_library(codec, library):
    rng = random.Random(5)
    alphabets = ["ab", "abcdefghijklmnopqrstuvwxyz", "the and ing tion".replace(" ", ""), "éèàçñüß", "日本語中文", "á😀", "0123456789.,"]
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (2047, 2048, 2049, 9000)]
    texts += ["a" * 5000, "ab" * 3000, "x" * 2049 + " y " + "thing" * 2000, "😀" * 3000]
    equal(codec, library, texts)


def test_short_units_through_the_heap(codec, library, monkeypatch):
    monkeypatch.setattr(piece_codec, "LONG_UNIT", 1)
    rng = random.Random(6)
    words = ["the", "conversation", "straße", "niño", "ação", "12345", "über", "don't", "日本", "aaaaaa", "ab"]
    fresh = piece_codec.PieceCodec(queries.piece_model())
    equal(fresh, library, [" ".join(rng.choice(words) + rng.choice(["", "s", "ing", "!"]) for _ in range(40)) for _ in range(50)])


def test_a_million_letters_without_a_space(codec, library):
    rng = random.Random(7)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    codec.run(["warm" * 1000])
    started = time.perf_counter()
    ids, counts, _ = codec.run([text])
    assert time.perf_counter() - started < 10  # about 3 seconds on one core
    assert ids[0] == ",".join(map(str, library.encode(text)))
