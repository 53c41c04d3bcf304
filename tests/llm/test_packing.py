import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clickrank.llm import packing as p
from clickrank.llm import tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 512), min_size=1, max_size=120))
def test_windows_hold_every_block_once(lengths):
    lengths = np.array(lengths, np.int64)
    sets = p.windows(lengths)
    assert sorted(i for s in sets for i in s) == list(range(len(lengths)))
    assert all(0 < lengths[s].sum() <= 2048 for s in sets)


def test_windows_are_near_equal():
    lengths = np.random.default_rng(0).integers(1, 513, 1024)
    sums = [lengths[s].sum() for s in p.windows(lengths)]
    assert max(sums) - min(sums) < 40 and sum(sums) / len(sums) > 0.99 * 2048


def test_cuts():
    for n in (1, 511, 512, 513, 2047, 2048, 2049, 5000):
        cuts = p.cuts(n)
        assert [s for s, _ in cuts] == [0, *np.cumsum([m for _, m in cuts])[:-1].tolist()] and sum(m for _, m in cuts) == n


ODD = [
    "", "  a  b\n\nc <|endoftext|> d e\t f", "x'́ ́y \x1c z\x0bq", " lead\n\ntrail \n", "don't  I'LL 　x", "a b ​ c",
    "İ Σς ﬁ ǅ", "1234 5 ... !!", "<|startoftext|>", "\n", " ", "a \n b", "word\nWord\n", "é\né 가",
]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(ODD) | st.text(st.sampled_from("ab'sZé́ \n\t\x0b  1.<|>中"), max_size=25))
def test_chunks_give_the_ids_of_the_whole_text(text):
    for name, dropped in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        path = tokens.public_file(name)
        encoder = tokens.encoder(path, dropped)
        want = encoder.whole.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want


ROWS = [(1, "a b c"), (2, None), (3, ""), (None, "x"), (4, "word " * 5000), (5, "y " * 700), (5, "y " * 700), (6, "z " * 511)]


def test_pieces_against_brute_force(table):
    rows = p.pack(table(ROWS), with_ids=True).collect()
    tokenizer = Tokenizer.from_file(tokens.public_file(p.VOCABULARY))
    want = sorted((-1 if i is None else i, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in ROWS)
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[-1 if r.doc_id is None else r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for i, ids in want:
        mine = sorted(pieces[i], key=lambda r: r.start)
        assert all(r.doc_tokens == len(ids) for r in mine)
        repeats = sum(j == i for j, _ in want)
        every = sorted((r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in mine)
        assert every == sorted((s, ids[s : s + n]) for s, n in p.cuts(len(ids))) if repeats == 1 else len(every) == repeats * len(p.cuts(len(ids)))
    for members in windows.values():
        members.sort(key=lambda r: r.offset)
        assert [r.offset for r in members] == [0, *np.cumsum([r.length for r in members])[:-1].tolist()]
        assert sum(r.length for r in members) <= 2048


def test_small_groups_and_empty(table):
    rows = p.pack(table(ROWS), group=3).collect()
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
    assert p.pack(table([])).count() == 0
