import hashlib
import random
import re

import numpy as np

from clickrank.llm import substring_dedup as d
from clickrank.llm.fm_index import FMIndex


def brute(rows, window=13):
    docs = [(i, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for j in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[j : j + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in docs:
        gone = {j + k for j in range(len(w) - window + 1) for k in range(window) if i is not None and first[tuple(w[j : j + window])] < i}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["a", "b", "c", "É"] + [f"w{i}" for i in range(30)]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(11, 40))] for _ in range(5)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(r.randint(0, 4)):
            words += [r.choice(vocabulary) for _ in range(r.randint(0, 25))] + (r.choice(passages) if r.random() < 0.7 else [])
        rows.append((i * 3 % 61, r.choice((" ", "  ", "\n\t")).join(words)))
    return rows + [(100, rows[3][1]), (101, rows[3][1] + "  "), (102, "a b " * 30), (103, "a b " * 30 + "c"), (50, rows[5][1])]


def test_against_brute_force(table):
    for seed in (1, 2):
        rows = corpus(seed)
        assert found(d.deduplicate(table(rows))) == brute(rows)


def test_frequent_anchors_and_other_windows(table):
    rows = corpus(3)
    assert found(d.deduplicate(table(rows), frequent=1)) == brute(rows)
    assert found(d.deduplicate(table(rows), window=6, anchor=2)) == brute(rows, 6)


def test_defined_cases(table):
    long = " ".join(f"v{i}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "few words"), (5, long), (6, long), (7, "x " + long), (None, long), (8, long), (8, long)]
    assert found(d.deduplicate(table(rows))) == brute(rows)
    assert d.deduplicate(table([])).count() == 0
    texts = {r.doc_id: r.kept_text for r in d.deduplicate(table(rows), with_text=True).collect()}
    assert texts[7] == "x" and texts[6] == "" and texts[5] == long


def test_matching_statistics_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(40):
        lengths = rng.integers(1, 30, rng.integers(1, 12))
        text = rng.integers(0, 4, lengths.sum()).astype(np.uint64) * 7
        index, parts = FMIndex(text, lengths), np.split(text, np.cumsum(lengths)[:-1])
        query = rng.integers(0, 5, 40).astype(np.uint64) * 7
        reached, low, high = index.matching(np.append(-1, index.encode(query)), np.arange(2, 42), 13)
        for end, n, a, b in zip(range(1, 41), reached, low, high):
            counts = [sum(p[i : i + m].tolist() == query[end - m : end].tolist() for p in parts for i in range(len(p) - m + 1)) for m in range(1, min(13, end) + 1)]
            assert n == sum(c > 0 for c in counts)
            assert not n or b - a == counts[n - 1]


def test_the_threshold_decides_which_windows_the_smaller_ids_hold(monkeypatch):
    """Contents that share words but not whole windows fail the threshold in the index of the smaller ids."""
    rng = np.random.default_rng(5)
    failed = []
    matching = FMIndex.matching

    def seen(self, symbols, ends, most):
        reached, low, high = matching(self, symbols, ends, most)
        failed.append(int((reached < most).sum()))
        return reached, low, high

    monkeypatch.setattr(FMIndex, "matching", seen)
    for n in (1, 2, 3, 9, 30):
        contents = [rng.integers(0, 3, rng.integers(5, 25)).astype(np.uint64) for _ in range(n)]
        holders = rng.integers(0, max(2, n // 2), n).astype(np.int64)
        window = 5
        least = d.earliest(contents, holders, window)
        for mine, got in zip(contents, least):
            windows = [mine[i : i + window].tolist() for i in range(len(mine) - window + 1)]
            want = [min(h for c, h in zip(contents, holders) if any(c[j : j + window].tolist() == w for j in range(len(c) - window + 1))) for w in windows]
            assert got.tolist() == want
    assert sum(failed) > 0
