"""Every stage of the pipeline against brute force, on its own input, and the whole run."""

from collections import Counter, defaultdict

import numpy as np
import pytest
import test_exact_dedup
import test_mixing
import test_ngram_join
import test_quality_rules
from tokenizers import Tokenizer

import corpus_pipeline
from clickrank.llm import ngram_join, packing, tokens


@pytest.fixture(scope="module")
def folder(spark, small, tmp_path_factory):
    """The smallest documents, some of them again under other ids, edited, repeated, null and with a clashing column."""
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumnRenamed("n_chars", "_ledger")
    rows = [tuple(r) for r in docs.collect()]
    words = rows[2][1].split(" ")
    rows += [(10_000 + i, r[1], *r[2:]) for i, r in enumerate(rows[:8])] + [rows[1], rows[1]]
    rows += [(20_000, " ".join(words[:30] + ["edited"] + words[31:]), "en", None, 5), (20_001, None, None, None, None), (20_002, "", "en", "src1", 0)]
    rows += [(None, " ".join(f"null{i}" for i in range(80)), "en", "src1", 1)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, docs.schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Input and output rows of each stage."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found, columns = [], docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(f"{folder}/stage-{i}")
        before, docs = docs, spark.read.parquet(f"{folder}/stage-{i}")
        found.append((before.collect(), docs.collect()))
    return found


def ids(rows):
    return Counter(r.doc_id for r in rows)


def test_quality(stages):
    before, after = stages[0]

    def kept(text):
        n, chars, symbols, same, repeated, lines = test_quality_rules.brute(text)
        return n >= 50 and 2 * repeated <= n and 2 * same <= lines and 10 * symbols <= n and 2 * n <= chars <= 15 * n

    assert ids(after) == ids(r for r in before if kept(r.text)) and len(after) < len(before)


def test_exact(stages):
    before, after = stages[1]
    keep = test_exact_dedup.brute([(r.doc_id, r.text) for r in before])
    key = lambda t: "".join(t.split())  # noqa: E731  the texts of this stage have ASCII white space only
    assert ids(after) == ids(r for r in before if keep[key(r.text)][0] == r.doc_id)


def test_near(stages):
    before, after = stages[2]
    labels = test_ngram_join.brute([(r.doc_id, r.text) for r in before], ngram_join.Similarity(5, 80, 100))
    smallest = {i: c for i, _, c in labels}
    assert ids(after) == ids(r for r in before if r.doc_id is None or smallest[r.doc_id] == r.doc_id)
    assert 20_000 in ids(before) and 20_000 not in ids(after)


def test_mixture(stages):
    before, after = stages[3]
    sizes, words = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += test_mixing.size(r.text)
    for r in after:
        words[r.source] += test_mixing.size(r.text)
    assert words == {s: int(t + 1e-9) for s, t in test_mixing.brute_targets(sizes).items() if int(t)}


def test_packed(stages):
    before, after = stages[4]
    tokenizer = Tokenizer.from_file(tokens.public_file(packing.VOCABULARY))
    want = Counter((r.doc_id, len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1) for r in before)
    got, fill = Counter(), defaultdict(int)
    for r in after:
        fill[r.sequence_id] += r.length
        if r.start == 0:
            got[r.doc_id, r.doc_tokens] += 1
    assert got == want and max(fill.values()) <= packing.SIZE
    assert sum(fill.values()) == sum(n * k for (_, n), k in want.items())
    assert np.mean(list(fill.values())) > 0.97 * packing.SIZE


def test_run(spark, folder, stages):
    found = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in found) == Counter((r.doc_id, r.start, r.ids_crc32) for r in stages[4][1])
