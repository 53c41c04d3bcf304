"""Quotation linking: conversations in reply order, without quotes. Built-in functions only.

A line that begins with ``>`` marks is quoted, at the level of their number. Passages are the non-empty lines below the
marks and the sentences of blocks, folded to lower case and single spaces, and hashed; a passage that is both counts once.
A block is a run of non-empty lines of one level, joined over line ends, so that a sentence is found that was quoted out of
a longer line or wrapped anew; a line ``... wrote:`` is a block of its own. A message replies to the earlier message of its
conversation that last wrote most of the passages it quotes at its lowest level with a known passage (ties: the later
message); a message that quotes nothing known replies to the one before it. Depth counts messages from the first one
along replies, and the reply order is by depth, then original order, so that a message follows what it replies to.

The last earlier writer of a passage is a running maximum, not a join of all pairs, and numbering within a conversation
uses distributed prefix sums, so neither a long conversation nor a frequent line meets in one task. Depths of branches
(maximal runs of messages that reply to the one before) are summed by pointer jumping, in rounds logarithmic in the
nesting of branches.

Defined cases: a null or empty text has no quotes and stays empty; a null conv_id is a conversation of its own; a null
turn comes first; rows that tie in turn are ordered by role and text, and repeated rows follow each other; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickrank.llm.tables import prefix_sums
from clickrank.session import stage

MARKS = r"^[\x20\t]*(?:>[\x20\t]?)+"
SPACE = r"[\x20\x09-\x0D]+"


WROTE = r"wrote:[\x20\t\r]*$"
SENTENCE_END = r"(?<=[.!?\u2026][\"')\]\u201d\u2019]{0,3})\x20|(?<=[\u3002\uff01\uff1f])\x20?"


def quote_level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.char_length(marks) - F.char_length(F.translate(marks, ">", ""))


def plain_line(line: Column) -> Column:
    """The normalised line below its marks."""
    return F.lower(F.btrim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), SPACE, " ")))


def blocks(text: Column) -> Column:
    """Array of ``level TAB text`` of the runs of lines of one level, normalised; empty lines end a run."""
    lines = F.split(text, "\n", -1)
    before = F.slice(F.concat(F.array(F.lit("")), lines), F.lit(1), F.size(lines))

    def placed(line: Column, last: Column) -> Column:
        same = (quote_level(line) == quote_level(last)) & (plain_line(last) != "") & ~line.rlike(WROTE) & ~last.rlike(WROTE)
        return F.concat(F.when(same, F.lit(" ")).otherwise(F.concat(F.lit("\n"), quote_level(line).cast("string"), F.lit("\t"))), plain_line(line))

    return F.filter(F.split(F.array_join(F.zip_with(lines, before, placed), ""), "\n", -1), lambda x: x != "")


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, idx, level, passage): hashes of the lines and of the sentences of blocks, each once; level 0 is own text."""
    lines = messages.select("conv_id", "idx", F.explode(F.split("text", "\n", -1)).alias("line"))
    lines = lines.select("conv_id", "idx", quote_level(F.col("line")).alias("level"), plain_line(F.col("line")).alias("plain"))
    runs = messages.select("conv_id", "idx", F.explode(blocks(F.col("text"))).alias("run"))
    level, run = F.substring_index("run", "\t", 1).cast("int"), F.substring_index("run", "\t", -1)
    sentences = runs.select("conv_id", "idx", level.alias("level"), F.explode(F.split(run, SENTENCE_END, -1)).alias("plain"))
    found = lines.unionByName(sentences.withColumn("plain", F.btrim("plain"))).where("plain != ''")
    return found.select("conv_id", "idx", "level", F.unhex(F.md5("plain")).alias("passage")).distinct()


def own_text(text: Column) -> Column:
    """The text without quoted lines and without a line ``... wrote:`` right before a quote."""
    lines = F.split(text, "\n", -1)
    quoted = F.transform(lines, lambda x: x.rlike(MARKS))
    own = F.filter(
        F.arrays_zip(lines.alias("line"), quoted.alias("quoted"), F.slice(F.concat(quoted, F.array(F.lit(False))), F.lit(2), F.size(lines)).alias("next")),
        lambda x: ~x["quoted"] & ~(x["next"] & x["line"].rlike(WROTE)),
    )
    joined = F.array_join(F.transform(own, lambda x: x["line"]), "\n")
    return F.when(F.exists(quoted, lambda q: q), F.btrim(joined, F.lit(" \t\n\x0b\f\r"))).otherwise(text)


def _numbered(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``idx``, the place in the conversation from 0."""
    rows = messages.select("conv_id", "turn", "role", "text", F.lit(1).cast("long").alias("_one"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text")]
    return stage(prefix_sums(rows, ["conv_id"], order, "_one", "idx").drop("_one"), "messages")


def quote_parents(numbered: DataFrame) -> DataFrame:
    """(conv_id, idx, parent): the message that each quoting message replies to."""
    quoted = stage(passages(numbered.where(F.col("text").contains(">"))).where("level > 0"), "quoted")
    asked = quoted.select(F.col("conv_id").alias("_conv"), F.col("passage").alias("_passage")).distinct()
    own = passages(numbered).where("level = 0").drop("level")
    own = own.join(asked, own["conv_id"].eqNullSafe(asked["_conv"]) & (own["passage"] == asked["_passage"]), "left_semi")
    both = quoted.withColumn("writer", F.lit(None).cast("long")).unionByName(
        own.select("conv_id", "idx", F.lit(None).cast("int").alias("level"), "passage", F.col("idx").alias("writer"))
    )
    # at the same message its quotes come first, so that it is no writer of what it quotes itself
    order = [F.col("idx"), F.col("level").asc_nulls_last()]
    found = prefix_sums(both, ["conv_id", "passage"], order, "writer", "last_writer", how=F.max)
    votes = found.where("level IS NOT NULL AND last_writer IS NOT NULL").groupBy("conv_id", "idx", "level", "last_writer").agg(
        F.count(F.lit(1)).alias("votes")
    )
    best = F.max_by("last_writer", F.struct(-F.col("level"), F.col("votes"), F.col("last_writer")))
    return votes.groupBy("conv_id", "idx").agg(best.alias("parent"))


def _branch_depths(branches: DataFrame) -> DataFrame:
    """(conv_id, branch, base): summed lengths along the ancestors of each branch, by pointer jumping."""
    branches = stage(branches.select("conv_id", "branch", "above", F.col("length").alias("base")), "branches")
    while not branches.where("above > 0").isEmpty():
        up = branches.select(
            F.col("conv_id").alias("_conv"), F.col("branch").alias("_branch"), F.col("above").alias("_above"), F.col("base").alias("_base")
        )
        met = branches.join(up, branches["conv_id"].eqNullSafe(up["_conv"]) & (branches["above"] == up["_branch"]), "left")
        branches = stage(
            met.select("conv_id", "branch", F.coalesce("_above", F.lit(0)).cast("long").alias("above"),
                       (F.col("base") + F.coalesce("_base", F.lit(0))).alias("base")),
            "branches",
        )
    return branches.select("conv_id", "branch", "base")


def _beside(left: DataFrame, right: DataFrame, on: dict[str, str], how: str = "left") -> DataFrame:
    """Join on conv_id (nulls equal) and on pairs of columns; the right side's keys are dropped."""
    names = {c: f"_r_{c}" for c in right.columns}
    right = right.select(*[F.col(c).alias(n) for c, n in names.items()])
    match = left["conv_id"].eqNullSafe(right["_r_conv_id"])
    for a, b in on.items():
        match = match & (left[a] == right[names[b]])
    keep = [c for c in names if c != "conv_id" and c not in on.values()]
    return left.join(right, match, how).select(left["*"], *[right[names[c]].alias(c) for c in keep])


def reply_order(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, position (from 0, in reply order), depth, reply_to (a turn), text, n_quoted_lines."""
    numbered = _numbered(messages)
    parents = stage(quote_parents(numbered), "parents")
    rows = _beside(numbered.select("conv_id", "idx", "turn"), parents, {"idx": "idx"})
    rows = rows.withColumn("jump", F.col("parent").isNotNull().cast("long"))
    rows = prefix_sums(rows, ["conv_id"], [F.col("idx")], "jump", "before")
    rows = stage(rows.withColumn("branch", F.col("before") + F.col("jump")), "branched")
    begins = rows.groupBy("conv_id", "branch").agg(F.min("idx").alias("begin"))
    jumps = rows.where("jump = 1").select("conv_id", "branch", F.col("parent").alias("at"))
    above = rows.select("conv_id", F.col("idx").alias("at"), F.col("branch").alias("above"))
    jumps = _beside(_beside(jumps, above, {"at": "at"}), begins.select("conv_id", F.col("branch").alias("above"), F.col("begin").alias("_b")), {"above": "above"})
    bases = _branch_depths(jumps.withColumn("length", F.col("at") - F.col("_b") + 1))
    placed = _beside(_beside(rows, begins, {"branch": "branch"}), bases, {"branch": "branch"})
    placed = placed.select(
        "conv_id", "idx", F.coalesce("parent", F.col("idx") - 1).alias("parent"),
        (F.coalesce("base", F.lit(0)) + F.col("idx") - F.col("begin")).cast("long").alias("depth"), F.lit(1).cast("long").alias("_one"),
    )
    ordered = prefix_sums(placed, ["conv_id"], [F.col("depth"), F.col("idx")], "_one", "position")
    turns = numbered.select("conv_id", F.col("idx").alias("parent"), F.col("turn").alias("reply_to"))
    ordered = _beside(ordered.select("conv_id", "idx", "parent", "depth", "position"), turns, {"parent": "parent"})
    found = _beside(numbered, ordered.select("conv_id", "idx", "depth", "position", "reply_to"), {"idx": "idx"})
    quoted = F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(MARKS)))
    return found.select(
        "conv_id", "turn", "role", "position", "depth", "reply_to",
        F.coalesce(own_text(F.col("text")), F.lit("")).alias("text"), F.greatest(F.coalesce(quoted, F.lit(0)), F.lit(0)).cast("long").alias("n_quoted_lines"),
    )
