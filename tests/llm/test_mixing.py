import re
from collections import defaultdict

import pytest

from clickrank.llm import mixing as m


def brute_targets(sizes, weights=(5, 2, 1), epochs=3):
    """Shares by weight; what is above a source's limit is shared again until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if budget * weight[s] / total > epochs * sizes[s]]
        if not over:
            target |= {s: budget * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = float(epochs * sizes[s])
            open_.discard(s)
        budget = sum(sizes.values()) - sum(target.values())
    return target


def texts(n, words):
    return " ".join(f"t{n}w{i}" for i in range(words))


ROWS = (
    [(i, texts(i, 10 + i % 7), "b") for i in range(60)] + [(100 + i, texts(i, 3), "a") for i in range(5)]
    + [(200 + i, texts(i, 40), None) for i in range(9)] + [(300, None, "c"), (301, "", "c"), (302, " \n", "d"), (303, texts(1, 2000), "é")]
    + [(None, texts(400, 8), "a"), (7, texts(7, 10), "b"), (7, texts(7, 10), "b")]
)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))


def test_targets_and_cuts(table):
    rows = m.mix(table(ROWS)).collect()
    sizes = defaultdict(int)
    for _, t, s in ROWS:
        sizes[s] += size(t)
    want = brute_targets(sizes)
    taken = defaultdict(int)
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert taken == {s: int(want[s] + 1e-9) for s in sizes}


def test_reruns_agree(table, spark):
    first = sorted((str(r.doc_id), r.taken) for r in m.mix(table(ROWS)).collect())
    assert first == sorted((str(r.doc_id), r.taken) for r in m.mix(table(ROWS[::-1]).repartition(7)).collect())
    assert first != sorted((str(r.doc_id), r.taken) for r in m.mix(table(ROWS), seed=1).collect())


def test_a_source_is_spread(table, spark):
    """One source holds nearly all rows and is still numbered over several parts."""
    rows = [(i, texts(i, 5), "hot") for i in range(500)] + [(1000, texts(1, 5), "cold")]
    found = m.mix(table(rows)).collect()
    hot = [r for r in found if r.source == "hot"]
    whole, rest = divmod(int(hot[0].target), 2500)
    assert sum(r.taken for r in hot) == int(hot[0].target)
    partial = [r for r in hot if r.taken not in (whole * 5, whole * 5 + 5)]
    assert len(partial) <= 1 and rest >= 0


def test_documents_are_repeated_and_cut(table):
    docs = table(ROWS)
    found = m.mixed_documents(docs)
    assert found.columns == docs.columns
    words, want = defaultdict(int), defaultdict(int)
    whole = {t for _, t, _ in ROWS}
    for r in found.collect():
        words[r.source] += size(r.text)
        assert r.text in whole or any(t and t.startswith(r.text) for t in whole)
    for r in m.mix(docs).collect():
        want[r.source] += r.taken
    assert words == {s: n for s, n in want.items() if n}


def test_empty(table):
    assert m.mix(table([])).count() == 0 and m.mixed_documents(table([])).count() == 0
    assert [r.taken for r in m.mix(table([(1, None), (2, "")])).collect()] == [0, 0]
