"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are applied to the stored bits.

``annotate`` adds one struct of measurements and ``fail_bits`` to each row. A policy is a version, a mask of rules and
a number of tolerated failures; changing it never reads a text again. ``ablations`` aggregates the bit patterns.

Defined cases: a null or empty text has no words and fails ``few_words``; repeated rows and ties are judged row by
row; a null id is kept as it is; an empty table gives an empty ledger; columns of any name pass through untouched
because the ledger is one struct under a name the caller can choose. Texts are read whole, one piece of memory per
document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickrank.llm import textbatch as tb

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rule:
    """One named bit; ``fails`` maps the struct of measurements to a boolean."""

    name: str
    fails: Callable[[Column], Column]


#: Bit i belongs to rule i. Rules are only ever appended, so stored ledgers stay readable.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("repeated_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", lambda m: m["word_chars"] > 15 * m["n_words"]),
)


@dataclass(frozen=True)
class Policy:
    """Keeps a row when at most ``tolerated`` rules of ``rules`` fail and none of ``strict``."""

    version: str
    strict: tuple[str, ...]
    rules: tuple[str, ...] = ()
    tolerated: int = 0


BASE = ("few_words", "repeated_words")
POLICIES = {
    p.version: p
    for p in (
        Policy("v1", BASE),
        Policy("v2", (*BASE, "repeated_lines", "symbols", "short_words", "long_words")),
        Policy("v2-lenient", BASE, ("repeated_lines", "symbols", "short_words", "long_words"), 1),
    )
}
DEFAULT_POLICY = "v2"


def mask_of(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    known = [r.name for r in rules]
    return sum(1 << known.index(n) for n in names)


def _repeated(grams: np.ndarray, n_words: int, width: int = 3) -> int:
    """Words inside a window that occurs twice or more."""
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _duplicate_lines(raw: bytes) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier one)."""
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines), len(lines) - len(set(lines))


def measure_column(column: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of every text of a column."""
    out = {m: np.zeros(len(column), np.int64) for m in MEASURES}
    for first, end, data, offsets in tb.pieces(column):
        starts, ends, words = tb.word_spans(data, offsets)
        out["n_words"][first:end] = np.diff(words)
        out["word_chars"][first:end] = tb.row_sums(((data & 0xC0) != 0x80) & ~tb._SPACE[data], offsets)
        out["n_symbols"][first:end] = tb.row_sums(_SYMBOL[data], offsets)
        grams = tb.gram_hashes(tb.word_hashes(data, starts, ends), 3)
        for i in range(end - first):
            a, b = int(words[i]), int(words[i + 1])
            out["n_repeat_words"][first + i] = _repeated(grams[a : max(a, b - 2)], b - a)
            n_lines, n_same = _duplicate_lines(data[offsets[i] : offsets[i + 1]].tobytes())
            out["n_lines"][first + i] = n_lines
            out["n_dup_lines"][first + i] = n_same
    return out


def annotate(docs: DataFrame, text: str = "text", name: str = "_ledger", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with the struct ``name`` of all measurements and ``fail_bits``; one pass, no exchange."""
    measured = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, measured)])
    kind = pa.struct([(m, pa.int64()) for m in MEASURES])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure_column(batch.column(text))
            column = pa.StructArray.from_arrays([pa.array(found[m]) for m in MEASURES], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])

    m = F.col(name)
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(rule.fails(m), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return docs.mapInArrow(measure, schema).withColumn(name, m.withField("fail_bits", bits))


def ledger(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, the measurements and ``fail_bits``, to be stored."""
    narrow = docs.select(F.col(id_col), F.col(text).alias("_text"))
    return annotate(narrow, "_text").select(F.col(id_col), "_ledger.*")


def keeps(bits: Column, policy: Policy | str = DEFAULT_POLICY) -> Column:
    """Verdict of a policy on stored bits."""
    policy = POLICIES[policy] if isinstance(policy, str) else policy
    strict, counted = mask_of(policy.strict), mask_of(policy.rules)
    return (bits.bitwiseAND(F.lit(strict).cast("long")) == 0) & (
        F.bit_count(bits.bitwiseAND(F.lit(counted).cast("long"))) <= policy.tolerated
    )


def filter_documents(docs: DataFrame, policy: Policy | str = DEFAULT_POLICY, text: str = "text") -> DataFrame:
    """The rows that the policy keeps, with the columns they came with."""
    name = "_ledger"
    while name in docs.columns:
        name += "_"
    judged = annotate(docs, text, name)
    return judged.where(keeps(judged[name]["fail_bits"], policy)).select(*[F.col(f"`{c}`") for c in docs.columns])


def ablations(ledger_rows: DataFrame, policy: Policy | str = DEFAULT_POLICY, rules: Sequence[Rule] = RULES) -> DataFrame:
    """What each rule of a policy costs: rows failing it, rows only it rejects, rows kept without it.

    Rows are counted per bit pattern first, combined on the map side; the patterns are few.
    """
    policy = POLICIES[policy] if isinstance(policy, str) else policy
    patterns = ledger_rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("rows"))
    kept = F.sum(F.when(keeps(F.col("fail_bits"), policy), F.col("rows")).otherwise(0))
    rows = None
    for name in (*policy.strict, *policy.rules):
        bit = mask_of([name], rules)
        has = F.col("fail_bits").bitwiseAND(F.lit(bit).cast("long")) != 0
        without = F.col("fail_bits").bitwiseAND(F.lit(~bit).cast("long"))
        part = patterns.agg(
            F.coalesce(F.sum(F.when(has, F.col("rows"))), F.lit(0)).alias("failed"),
            F.coalesce(kept, F.lit(0)).alias("kept"),
            F.coalesce(F.sum(F.when(keeps(without, policy), F.col("rows")).otherwise(0)), F.lit(0)).alias("kept_without"),
        ).select(F.lit(policy.version).alias("policy"), F.lit(name).alias("rule"), "*")
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumn("rejected_only_by_it", F.col("kept_without") - F.col("kept"))
