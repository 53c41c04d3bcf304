"""News vectors that depend on the user, against plain arithmetic."""

import numpy as np
import pytest

from clickrank.functions.dense import PersonalizedWeights
from clickrank.operators import pages
from clickrank.operators import personal_news as personal
from clickrank.plans.evaluation import evaluate_personal_news
from clickrank.schema import EMPTY_NEWS_ID

BEHAVIORS = "impression_id long, user_idx long, history array<string>, impressions array<struct<news_id: string, clicked: int>>"
rng = np.random.default_rng(11)
NEWS = PersonalizedWeights(rng.normal(size=(3, 2)), rng.normal(size=2), rng.normal(size=(2, 4)), rng.normal(size=4))
HISTORY = PersonalizedWeights(rng.normal(size=(3, 2)), rng.normal(size=2), rng.normal(size=(2, 4)), rng.normal(size=4))
USERS = {1: rng.normal(size=3), 2: rng.normal(size=3)}
SEGMENTS = {"N1": rng.normal(size=(3, 4)), "N2": rng.normal(size=(1, 4)), "N3": rng.normal(size=(2, 4))}
ROWS = [
    (10, 1, ["N1", "N2", "N1"], [("N3", 1), ("N1", 0), ("N1", 0)]),
    (11, 2, ["N3", "gone"], [("N1", 0), ("gone", 1)]),
    (12, 1, None, [("N2", 1)]),
    (13, 9, ["N1"], [("N3", 0), ("N2", 1)]),  # no vector of this user
    (14, 2, [], []),
]


def query(user, w):
    if user not in USERS:
        return np.zeros(4)
    return np.tanh(np.maximum(USERS[user] @ w.w1 + w.b1, 0) @ w.w2 + w.b2)


def pool(x, q):
    e = np.exp(x @ q)
    return e @ x / e.sum()


def news_vector(user, news):
    return pool(SEGMENTS[news], query(user, NEWS)) if news in SEGMENTS else np.zeros(4)


def user_vector(user, history, size, mask):
    known = [n for n in (history or [])[:size] if n in SEGMENTS or not mask]
    items = [news_vector(user, n) for n in known] + [np.zeros(4)] * (0 if mask else size - len((history or [])[:size]))
    return pool(np.array(items), query(user, HISTORY)) if items else None


@pytest.fixture(scope="module")
def tables(spark):
    segments = [(n, i, x.tolist()) for n, rows in SEGMENTS.items() for i, x in enumerate(rows)]
    return (
        spark.createDataFrame(ROWS, BEHAVIORS).repartition(3),
        spark.createDataFrame(segments, "news_id string, segment int, vec array<double>").repartition(3),
        spark.createDataFrame([(k, v.tolist()) for k, v in USERS.items()], "user_idx long, vec array<double>"),
    )


def test_pairs_of_histories_and_candidates(spark, tables):
    got = {tuple(r) for r in personal.user_news_pairs(tables[0], 2).collect()}
    assert got == {(1, "N1"), (1, "N2"), (1, "N3"), (2, "N3"), (2, "gone"), (2, "N1"), (9, "N1"), (9, "N3"), (9, "N2")}
    assert personal.user_news_pairs(tables[0], 2).count() == len(got)


def test_a_pair_is_pooled_once(spark, tables):
    behaviors, segments, users = tables
    found = personal.personal_news_vectors(personal.user_news_pairs(behaviors, 5), segments, users, NEWS).collect()
    got = {(r["user_idx"], r["news_id"]): r["vec"] for r in found}
    assert len(got) == len(found) == 8 and (2, "gone") not in got
    for (user, news), vec in got.items():
        assert vec == pytest.approx(news_vector(user, news))
    assert got[9, "N1"] == pytest.approx(SEGMENTS["N1"].mean(axis=0))  # weighs all segments alike
    assert got[1, "N1"] != pytest.approx(got[2, "N1"])


@pytest.mark.parametrize("mask", [False, True])
def test_scores(spark, tables, mask):
    behaviors, segments, users = tables
    scored = personal.score_personal_news(behaviors, segments, users, NEWS, HISTORY, 3, mask)
    assert scored.columns == ["impression_id", "pos", "news_id", "clicked", "score"]
    got = {(r["impression_id"], r["pos"]): (r["news_id"], r["score"]) for r in scored.collect()}
    n = 0
    for i, user, history, shown in ROWS:
        vec = user_vector(user, history, 3, mask)
        for pos, news in enumerate([n for n, _ in shown] + [EMPTY_NEWS_ID]):
            want = None if vec is None else pytest.approx(float(news_vector(user, news) @ vec), abs=1e-8)
            assert got[i, pos] == (news, want)
            n += 1
    assert len(got) == n


def test_evaluation(spark, tables):
    means = evaluate_personal_news(*tables, NEWS, HISTORY, history_size=3).first()
    assert means["impressions"] == 5 and means["with_positive"] == 4
    empty = tables[0].limit(0), *tables[1:]
    assert evaluate_personal_news(*empty, NEWS, HISTORY, history_size=3).first()["impressions"] == 0


def expected(rows, vectors, mask, size=3, fill=0.5):
    """Scores of each candidate; a user has a row for each of its vectors, and news vectors for each."""
    found = {}
    for i, user, history, shown in rows:
        asks = [[np.tanh(np.maximum(v @ w.w1 + w.b1, 0) @ w.w2 + w.b2) for w in (NEWS, HISTORY)] for v in vectors.get(user, [])] or [[np.zeros(4)] * 2]
        known = lambda n: [pool(SEGMENTS[n], a) for a, _ in asks] if n in SEGMENTS else []  # noqa: B023, E731
        used = (history or [])[:size]
        items = [v for n in used for v in known(n) or [np.full(4, fill)] * (not mask)] + [np.full(4, fill)] * (0 if mask else size - len(used))
        users = [None] if user is None or not items else [pool(np.array(items), b) for _, b in asks]
        for pos, (news, clicked) in enumerate([*shown, (EMPTY_NEWS_ID, 0)]):
            scores = [np.nan if u is None else float(v @ u) for u in users for v in known(news) or [np.full(4, fill)]]
            found.setdefault((i, pos, news, clicked), []).extend(scores)
    return found


def test_repeated_users_and_rows(spark, tables, monkeypatch):
    """Pages over several bundles; a user known twice asks twice, of news as of histories; without a number there is no score."""
    behaviors, segments, users = tables
    more = [(20, None, ["N1"], [("N3", 1), (None, 0)]), (21, 9, None, []), (22, 2, ["N3", None], [("N1", 1)])]
    rows = behaviors.union(spark.createDataFrame([*more, more[2]], BEHAVIORS)).coalesce(1)
    other = rng.normal(size=3)
    twice = users.union(spark.createDataFrame([(1, other.tolist())], users.schema))
    monkeypatch.setattr("clickrank.operators.pages.bundled", lambda df, _plain=pages.bundled: _plain(df, bits=1))
    for mask in (False, True):
        found = {}
        for *key, score in personal.score_personal_news(rows, segments, twice, NEWS, HISTORY, 3, mask, empty=[0.5] * 4).collect():
            found.setdefault(tuple(key), []).append(np.nan if score is None else score)
        want = expected([*ROWS, *more, more[2]], {1: [USERS[1], other], 2: [USERS[2]]}, mask)
        assert found.keys() == want.keys() and len(want[10, 0, "N3", 1]) == 4
        for key, scores in want.items():
            assert np.allclose(sorted(found[key]), sorted(scores), atol=1e-8, equal_nan=True), key


def test_pages_do_not_move_a_vector_for_each_item(spark, tables, monkeypatch):
    """Segments come once for a bundle of pages, queries once for each of its users."""
    from clickrank.operators import bundles

    _, segments, users = tables
    log = spark.createDataFrame([(i, 1, ["N1", "N2"], [("N1", 1), ("N3", 0)]) for i in range(40)], BEHAVIORS).coalesce(1)
    met = []

    def recording(fact, *args, _plain=bundles.lookup, **kwargs):
        met.append(fact)
        return _plain(fact, *args, **kwargs)

    monkeypatch.setattr(bundles, "lookup", recording)
    assert personal.score_personal_news(log, segments, users, NEWS, HISTORY, 3).count() == 120
    assert personal.user_vector_personal_news(log, segments, users, NEWS, HISTORY, 3).count() == 1
    asked, pairs = met[0], met[1]
    bundled = pairs.select("_of").distinct().count()
    assert len(met) == 4 and asked.count() == bundled and pairs.count() <= 4 * bundled < 40
