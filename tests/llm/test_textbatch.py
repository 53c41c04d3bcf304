import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from clickrank.llm import textbatch as tb

TEXT = st.text(st.sampled_from(" \t\n\x0b\x0c\rabABé中\U0001f600 "), max_size=60)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=6))
def test_words_of_rows(texts):
    column = pa.array(texts, pa.string())
    found = []
    for first, end, data, offsets in tb.pieces(column, 20):
        starts, ends, words = tb.word_spans(data, offsets)
        hashes = tb.word_hashes(data, starts, ends)
        for i in range(end - first):
            raw = [data[s:e].tobytes().decode() for s, e in zip(starts[words[i] : words[i + 1]], ends[words[i] : words[i + 1]])]
            found.append(raw)
            for w, h in zip(raw, hashes[words[i] : words[i + 1]]):
                one = np.frombuffer(w.encode(), np.uint8)
                assert tb.word_hashes(one, np.array([0]), np.array([len(one)]))[0] == h
    assert found == [re.findall(r"[^\x20\x09-\x0d]+", t or "") for t in texts]


def test_lower_folds_ascii_only():
    data = np.frombuffer("ABC abc É é".encode(), np.uint8)
    starts, ends, _ = tb.word_spans(data, np.array([0, len(data)]))
    a, b, c, d = tb.word_hashes(data, starts, ends, lower=True)
    assert a == b and c != d
    assert len(set(tb.word_hashes(data, starts, ends).tolist())) == 4


def test_long_word_and_sliced_column():
    long = "x" * (tb.PIECE + 5)
    column = pa.array(["skip", long + " y", None, "y"]).slice(1)
    seen = []
    for _, _, data, offsets in tb.pieces(column):
        starts, ends, words = tb.word_spans(data, offsets)
        seen += tb.word_hashes(data, starts, ends).tolist()
    assert len(seen) == 3 and seen[1] == seen[2] != seen[0]


def test_short_document_is_one_shingle():
    words = np.arange(3, dtype=np.uint64)
    assert len(tb.shingle_set(words, 5)) == 1 and len(tb.shingle_set(words[:0], 5)) == 0
    assert len(tb.shingle_set(np.zeros(9, np.uint64), 5)) == 1
