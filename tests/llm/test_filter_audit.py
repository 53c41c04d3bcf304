"""The audit of five filters against a walk through all orders, and the masks against definitions."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from clickrank.llm import filter_audit as fa

DOCS = "doc_id long, text string, lang string, quality int, prefix string, step string, _mask string"
LABELS = "doc_id long, quality int, toxic int, text string"


def mask_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = (
        len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        bool(re.search("[#$%&*|]", text)),
    )
    return sum(1 << i for i, f in enumerate(fails) if f)


def brute(docs, labels):
    good, toxic = ({i for i, *flags in labels if i is not None and flags[at] == 1} for at in (0, 1))
    texts = defaultdict(list)
    for i, text, _ in docs:
        texts[text or ""].append(i)
    parts = defaultdict(list)
    for i, text, lang in docs:
        later = i is not None and any(j is not None and j < i for j in texts[text or ""])
        parts[lang or ""].append((mask_of(text or "") | 16 * later, i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        shapley, steps = Counter(), []
        for order in permutations("ABCDE"):
            left = rows
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [r for r in left if r[0] & bit]
                left = [r for r in left if not r[0] & bit]
                failing = sum(bool(m & bit) for m, *_ in rows)
                shapley[letter] += len(gone)
                steps.append((
                    part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(m == bit for m, *_ in rows),
                    sum(g for _, g, _ in gone), sum(x for *_, x in gone), letter,
                ))
        out += [(*s[:9], shapley[s[9]]) for s in steps]
    return sorted(out)


def audited(spark, docs, labels):
    rows = spark.createDataFrame([(i, x, lang, 1, "clash", "clash", "clash") for i, x, lang in docs], DOCS).repartition(3)
    found = fa.audit_documents(rows, spark.createDataFrame([(*r, "clash") for r in labels], LABELS))
    assert found.columns == [
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    ]
    return sorted(tuple(r) for r in found.collect())


LONG = " ".join(f"word{i}" for i in range(200))


def test_all_orders_with_nulls_ties_and_repeats(spark):
    docs = [
        (1, LONG, "en"), (2, LONG, "de"), (2, LONG, "de"), (3, LONG + " x", "en"), (4, "a " * 300, "en"), (5, "a " * 300, None),
        (6, None, "en"), (7, "", ""), (8, "AAA #", "fr"), (9, LONG.upper(), "fr"), (10, LONG + " |", "fr"), (None, LONG, "en"),
        (None, None, None), (12, "\x0b\x1c été", "fr"), (13, LONG + " È" * 50, "en"), (14, "short", "en"), (-1, "short", "fr"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (4, 0, 1), (4, 1, None), (8, None, 1), (99, 1, 1), (None, 1, 1), (9, 2, 0)]
    got = audited(spark, docs, labels)
    assert len(got) == 600 * 4
    assert got == brute(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], []) == []
    assert len(audited(spark, [(1, "a", "en")], [])) == 600


def test_a_very_long_text_and_a_hot_text(spark):
    docs = [(i, "same text", "en") for i in range(200)] + [(1000, "word " * 300_000 + "end", "en")]
    assert audited(spark, docs, [(3, 1, 1)]) == brute(docs, [(3, 1, 1)])


def test_masks_of_texts(spark):
    texts = [LONG, LONG + " $", "A" * 4 + "b" * 96, "A" * 3 + "b" * 97, "a b a b c", "a a a b", " \t\n", "é" * 100 + "ABC", None, LONG + "\n" + LONG + " z"]
    found = fa.fail_masks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("x")))
    got = {r["_id"]: r["_mask"] for r in found.collect()}
    assert got == {i: mask_of(t or "") for i, t in enumerate(texts)}


@pytest.mark.parametrize("letters", ["A", "AB", "ABCD"])
def test_any_number_of_filters(spark, letters):
    judged = spark.range(40).select(F.lit("p").alias("_part"), (F.col("id") % (1 << len(letters))).cast("int").alias("_mask"), F.lit(0).alias("_good"), F.lit(1).alias("_toxic"))
    rows = fa.audit(judged, letters).collect()
    orders = list(permutations(letters))
    assert len(rows) == len(orders) * len(letters)
    assert {r["filter_order"] for r in rows} == {"".join(o) for o in orders}
    assert all(r["removed"] == r["toxic_lost"] for r in rows)
    first = {r["filter_order"][0]: r["removed"] for r in rows if r["step"] == 1}
    assert first == {x: sum(bool(i % (1 << len(letters)) >> at & 1) for i in range(40)) for at, x in enumerate(letters)}


def test_the_session_keeps_its_limit(spark):
    name = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(name, "77")
    try:
        audited(spark, [(i, "x", f"lang{i}") for i in range(3)], [])
        assert spark.conf.get(name) == "77"
    finally:
        spark.conf.unset(name)
