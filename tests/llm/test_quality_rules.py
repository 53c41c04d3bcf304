import re
from collections import Counter

from clickrank.llm import quality_rules as q
from pyspark.sql import functions as F


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j + k for j in range(len(words) - 2) if grams[tuple(words[j : j + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines))


TEXTS = [
    None, "", "  \n\t ", "one", "a b c a b c", "x y z " * 40, "é中 ü# " * 60, "same line here\nother\nsame line here\n \nsame line here",
    " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}$$" for i in range(60)), "long " * 3 + "w" * 200_000,
]


def test_ledger_against_brute_force(table, by_id):
    found = by_id(q.ledger(table(list(enumerate(TEXTS)))))
    for i, text in enumerate(TEXTS):
        assert tuple(found[i][0][m] for m in q.MEASURES) == brute(text), i


def test_policies_and_filter(table, spark):
    docs = table([(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[8]), (8, TEXTS[8])])
    kept = q.filter_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.select("doc_id").toPandas().doc_id.fillna(-1).astype(int)) == [-1, 8, 8]
    assert q.filter_documents(docs, "v1").count() == 4  # the text of symbols too
    assert q.filter_documents(table([])).count() == 0 and q.ledger(table([])).count() == 0


def test_clashing_struct_name(table):
    docs = table([(1, TEXTS[8])]).withColumn("_ledger", F.lit("mine"))
    assert q.filter_documents(docs).first()["_ledger"] == "mine"


def test_ablations(table):
    ledger = q.ledger(table(list(enumerate(TEXTS))))
    rows = {r.rule: r for r in q.ablations(ledger).collect()}
    bits = [r.fail_bits for r in ledger.collect()]
    policy = q.POLICIES[q.DEFAULT_POLICY]
    mask = q.mask_of(policy.strict)
    for name in policy.strict:
        bit = q.mask_of([name])
        assert rows[name].failed == sum(bool(b & bit) for b in bits)
        assert rows[name].kept == sum(not b & mask for b in bits)
        assert rows[name].kept_without == sum(not b & mask & ~bit for b in bits)
    assert q.ablations(q.ledger(table([]))).where("failed != 0 OR kept != 0").count() == 0


def test_lenient_policy_tolerates(spark):
    rows = spark.createDataFrame([(0,), (8,), (24,), (1,)], "fail_bits long")
    assert [r.k for r in rows.select(q.keeps(F.col("fail_bits"), "v2-lenient").alias("k")).collect()] == [True, True, False, False]
