import hashlib
from collections import defaultdict

from clickrank.llm import line_dedup as l

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "This line is long enough to be removed everywhere É"
OTHER = "another line that has at least forty code points ok"


def brute(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(UP)
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        me = -1 if i is None else i
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and me < max(holders[key(x)]))]
        out.append((me, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in df.selectExpr("doc_id", "_lines.*").collect())


ROWS = (
    [(i, f"own {i}\n {LONG.upper() if i % 2 else LONG}\t\nshort") for i in range(6)]
    + [(10 + i, f"{OTHER}\n{OTHER}") for i in range(4)] + [(14, OTHER + "x"), (15, None), (16, ""), (17, "\n\n"), (None, LONG)]
    + [(3, f"own 3\n {LONG.upper()}\t\nshort")] + [(20, "\n".join([f"l{i}" if i % 3 else LONG for i in range(3000)]))]
)


def test_against_brute_force(table):
    assert found(l.drop_lines(table(ROWS))) == brute(ROWS)
    assert found(l.drop_lines(table(ROWS), min_docs=4)) == brute(ROWS, min_docs=4)
    assert found(l.drop_lines(table([]))) == []


def test_a_line_that_fills_many_parts(spark, table):
    """One line in most rows, and documents whose lines reach over the borders of parts."""
    rows = [(i, "\n".join([LONG] * (1 + 40 * (i % 7 == 0)))) for i in range(120)] + [(None, LONG)] * 30 + [(200 + i, OTHER) for i in range(4)] * 9
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 13, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert found(l.drop_lines(table(rows))) == brute(rows)
            assert found(l.drop_lines(table(rows), min_docs=4)) == brute(rows, min_docs=4)
            assert found(l.drop_lines(table(rows), min_docs=1)) == brute(rows, min_docs=1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_border_lines_are_counted_once_for_each_document(spark):
    """Documents 9 and 7 of line b lie in two parts each, and part 1 holds nothing else."""
    rows = [("a", 5, 0, 0), ("b", 9, 1, 0), ("b", 9, 2, 1), ("b", 7, 3, 1), ("b", 7, 4, 2), ("b", None, 5, 2), ("c", 1, 6, 2)]
    placed = spark.createDataFrame(rows, "line string, doc_id long, row long, part long")
    counted = placed.withColumn("docs", l.F.when((l.F.col("line") == "b") & (l.F.col("part") > 0), 2).otherwise(1))
    got = {r["line"]: (r["keeper"], r["docs"]) for r in l._border_lines(counted, placed).collect()}
    assert got == {"a": (5, 1), "b": (9, 3), "c": (1, 1)}


def test_more_documents_than_are_broadcast(table):
    assert found(l.drop_lines(table(ROWS), limit=2)) == brute(ROWS)


def test_bitmaps_hold_no_text_and_no_full_words(table):
    bitmaps = {r.doc_id: r for r in l.dropped_lines(table(ROWS + [(21, "keeper\n" + LONG)])).collect()}
    assert set(bitmaps) == {None, 0, 1, 2, 3, 4, 5, 20}
    assert bitmaps[0].words == [(0, 2)] and bitmaps[20].n_dropped == 1000
    bits = {w * 64 + b for w, x in bitmaps[20].words for b in range(64) if (x >> b) & 1}
    assert bits == set(range(0, 3000, 3))


def test_native_plan(table, executed_plan):
    plan = executed_plan(l.drop_lines(table(ROWS)))
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
