"""Ids by chunk against the library's ids of whole texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from clickrank.llm import tokens

FILES = [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)]
ODD = [
    None, "", " ", "\n", "  ", "a", " a", "a ", "a\n", "\na", "a\n\nb", "a \nb", "a\n b", "a  b", "don't stop", "it's", "'s", "x's.", "rock'n'roll,",
    "word.", "word..", "word...end", "a.b", "(word)", "word!?\nnext", "%%% ###", "a%%% b###", "3.14", "b7db7aa4", "2024-01-02", "user@mail.com",
    "×", "a×b", "a×", "÷ x", "a÷.", "É", "É.", "École, été!", "ÀÉ\nñ.", "ß ẞ", "日本語 text", "text 日本語.", "éte", "a b", "tab\there", "a\x00b", "cr\r\nlf",
    "_under_ __x__", "~tilde~", "`code`", "emoji 😀 end", "ɐɿ.", "ʀ", "İstanbul", "ŉ", "UPPER Case", "word " * 300 + "end", "x" * 500, "é" * 100 + ".", "a" * 70 + " " + "a" * 70,
]


def library(encoder, text):
    return encoder.whole.tokenizer.encode(text or "", add_special_tokens=False).ids


def ids(found):
    return [np.frombuffer(x, "<u4").tolist() for x in found]


@pytest.mark.parametrize("name, dropped", FILES)
@pytest.mark.parametrize("table", [tokens.TABLE, 7])
def test_odd_texts(name, dropped, table):
    encoder = tokens.ChunkEncoder(tokens.public_file(name), dropped, table)
    want = [library(encoder, t) for t in ODD]
    for _ in range(2):  # unknown, then known
        assert ids(encoder.encode_column(pa.array(ODD))) == want
    assert ids([encoder.encode(t or "") for t in ODD]) == want
    assert encoder.encode_column(pa.array([], pa.string())) == []
    assert ids(encoder.encode_column(pa.array(["zz"] + ODD).slice(1))) == want


@pytest.mark.parametrize("name, dropped", FILES)
def test_random_texts_with_a_table_that_overflows(name, dropped):
    rng = random.Random(3)
    letters = "abcdeéüßñABÇ"
    words = ["".join(rng.choices(letters, k=rng.randint(1, 9))) + rng.choice(["", "", "", ".", ",", "!?", "'s", "7", "%%%"]) for _ in range(900)]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n"]) for _ in range(rng.randint(1, 60)))[: rng.choice([-1, None])] for _ in range(400)]
    encoder = tokens.ChunkEncoder(tokens.public_file(name), dropped, 100)
    want = [library(encoder, t) for t in texts]
    for part in (slice(0, 130), slice(130, 400), slice(0, 400)):
        assert ids(encoder.encode_column(pa.array(texts[part]))) == want[part]
    assert encoder.table.n <= 100


def test_a_full_table_keeps_what_was_met():
    table = tokens._Table(8)
    hashes = np.arange(1, 200, dtype=np.uint64) << np.uint64(60)  # they all want few slots
    hashes += np.arange(1, 200, dtype=np.uint64)
    one = lambda a, b: (hashes[a:b], np.full(b - a, 2), np.repeat(np.arange(a, b, dtype=np.uint32), 2))
    table.add(*one(0, 6))
    assert (table.find(hashes[:6]) >= 0).all() and (table.find(hashes[6:]) == -1).all()
    table._clear()
    table.add(*one(0, 6))
    table.find(hashes[[1, 4]])
    table.add(*one(6, 10))
    place = table.find(hashes[:12])
    assert (place >= 0).tolist() == [False, True, False, False, True, False, True, True, True, True, False, False]
    known = place[place >= 0]
    assert tokens.gathered(table.ids, table.starts[known], table.sizes[known]).tolist() == [1, 1, 4, 4, 6, 6, 7, 7, 8, 8, 9, 9]
    table.add(*one(20, 60))
    assert table.n == 8


def test_a_text_longer_than_a_piece():
    encoder = tokens.ChunkEncoder(tokens.public_file("word_bpe_49k.json"), True)
    text = "some words, again and again. " * 60_000
    assert ids(encoder.encode_column(pa.array([text, "b"]))) == [library(encoder, text), library(encoder, "b")]


def test_generations_keep_what_is_met(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN", 8)
    encoder = tokens.ChunkEncoder(tokens.public_file("word_bpe_49k.json"), True)
    chunks, asked = encoder.whole, []
    plain = tokens._Chunks._ids
    monkeypatch.setattr(tokens._Chunks, "_ids", lambda self, chunk: asked.append(chunk) or plain(self, chunk))
    for i in range(40):
        chunks["frequent"]
        chunks[f"rare{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}"]
    assert asked.count("frequent") == 1 and len(chunks) + len(chunks.old) <= 8
