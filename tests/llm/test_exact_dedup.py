import re
from collections import defaultdict

from clickrank.llm import exact_dedup as e

ROWS = [
    (5, "a b"), (3, "ab"), (9, "a  b"), (7, "a\t b"), (2, None), (1, ""), (4, " \n"), (None, "ab"), (8, "é中"), (6, "É中"),
    (11, "z" * 100_000), (12, "z" * 99_999 + " z"), (13, "same"), (13, "same"), (None, "lonely"),
]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((i, t or ""))
    keep = {k: min(v, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)) for k, v in groups.items()}
    return {k: (keep[k][0], len(v)) for k, v in groups.items()}


def test_groups_against_brute_force(spark, table, by_id):
    want = brute(ROWS)
    for i, found in by_id(e.deduplicate(table(ROWS), e.new_index(spark, 4))).items():
        texts = [t for j, t in ROWS if j == i]
        assert sorted((r["keep_id"] or -1, r["group_size"]) for r in found) == sorted(
            (want[re.sub(r"[\x20\x09-\x0d]", "", t or "")][0] or -1, want[re.sub(r"[\x20\x09-\x0d]", "", t or "")][1]) for t in texts
        )
        assert all(r["kept"] == (r["keep_id"] == i) for r in found)


def test_index_is_persistent_and_appending(spark, table, tmp_path):
    path = f"file://{tmp_path}/index"
    index = e.DigestIndex(spark, path, "digests_first", 4)
    first = e.deduplicate(table([(5, "x"), (6, "y")]), index)
    assert {r.doc_id: r.kept for r in first.collect()} == {5: True, 6: True}
    index.drop()
    again = e.DigestIndex(spark, path, "digests_second", 4)
    second = e.deduplicate(table([(1, "x  "), (2, "z"), (3, "z")]), again)
    assert {r.doc_id: r.keep_id for r in second.collect()} == {1: 5, 2: 2, 3: 2}
    repeated = e.deduplicate(table([(1, "x  "), (2, "z"), (3, "z")]), again)
    assert {r.doc_id: r.keep_id for r in repeated.collect()} == {1: 5, 2: 2, 3: 2}
    assert again.read().count() == 3


def test_index_side_is_not_shuffled(spark, table, executed_plan):
    index = e.new_index(spark, 4)
    index.append(e.digests(table([(1, "x")])))
    new = e.digests(table([(2, "y")])).groupBy("digest").count()
    plan = executed_plan(new.repartition(4, "digest").join(index.read().select("digest").hint("merge"), "digest", "left_anti"))
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_rows_that_stay(spark, table):
    docs = table(ROWS)
    kept = e.drop_duplicates(docs, e.new_index(spark, 4))
    assert kept.columns == docs.columns
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect())
    assert ids == sorted([-1, 13, 13, 6, 8, 12, 4, 7])
    empty = e.drop_duplicates(table([]), e.new_index(spark, 4))
    assert empty.count() == 0


def test_one_row_of_each_repeated_id_and_text_stays(spark, table):
    rows = [*ROWS, *[(13, "same")] * 20, (13, "s a m e"), (13, "other"), (None, "lonely"), (14, "same"), (5, "a b"), (9, "a  b")]
    docs = table(rows)
    kept = e.drop_duplicates(docs, e.new_index(spark, 4), repeats=False)
    assert kept.columns == docs.columns
    found = sorted((-1 if r.doc_id is None else r.doc_id, re.sub(r"[\x20\x09-\x0d]", "", r.text or "")) for r in kept.collect())
    assert found == sorted((-1 if keep is None else keep, key) for key, (keep, _) in brute(rows).items())
    assert "s a m e" in [r.text for r in kept.collect()]
    assert e.drop_duplicates(table([]), e.new_index(spark, 4), repeats=False).count() == 0
