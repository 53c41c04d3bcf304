import re
from collections import Counter, defaultdict

import pytest

from clickrank.llm import chat_quotes as c

SCHEMA = "conv_id long, turn long, role string, text string, depth int, idx int, parent string"
MARK = re.compile(r"^[ \t]*(?:>[ \t]?)+")


def level(line):
    m = MARK.match(line)
    return m[0].count(">") if m else 0


def plain(line):
    return re.sub(r"[\x20\x09-\x0d]+", " ", MARK.sub("", line)).strip(" ").lower()


def brute(rows):
    """(conv, turn, position, depth, reply_to) by following replies one by one."""
    out, groups = [], defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    for conv, members in groups.items():
        members = sorted(members, key=lambda r: (r[1] is not None, r[1] or 0))
        depth, parents = [], []
        for i, r in enumerate(members):
            quoted = {(level(x), plain(x)) for x in (r[3] or "").split("\n") if level(x) and plain(x)}
            votes = Counter()
            for lv, q in quoted:
                writers = [j for j in range(i) if any(not level(y) and plain(y) == q for y in (members[j][3] or "").split("\n"))]
                if writers:
                    votes[(lv, writers[-1])] += 1
            if votes:
                low = min(lv for lv, _ in votes)
                parent = max(((n, j) for (lv, j), n in votes.items() if lv == low))[1]
            else:
                parent = i - 1
            parents.append(parent)
            depth.append(depth[parent] + 1 if parent >= 0 else 0)
        order = sorted(range(len(members)), key=lambda i: (depth[i], i))
        for p, i in enumerate(order):
            reply = members[parents[i]][1] if parents[i] >= 0 else None
            out.append((conv, members[i][1], p, depth[i], reply))
    return sorted(out, key=str)


ROWS = [
    (1, 0, "u", "Hello there\nHow are you?"), (1, 1, "a", "> How are you?\nFine"), (1, 2, "u", "On Mon x wrote:\n> hello  THERE\nback to first"),
    (1, 3, "a", "continuing"), (1, 4, "u", "> Fine\n>> how are you?\nbranch of 1"), (1, 5, "a", ">> back to first\ndeep only"),
    (1, 6, "u", "> branch of 1\nx"), (1, 7, "a", "> deep only\n> unknown\nx"), (1, 8, "u", "> x\ny"), (1, 9, "a", "> \n>\nno passage"),
    (2, 0, "u", "> hello there\nother conversation"), (2, 1, "a", None), (2, 2, "u", ""), (None, None, "u", "null"), (None, 3, None, "> null\nreply"), (3, 5, "u", "alone"),
]


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame([(*r, 9, 9, "clash") for r in rows], SCHEMA).repartition(3)


def test_order_against_brute_force(frame):
    found = c.reply_order(frame(ROWS)).collect()
    assert sorted(((r.conv_id, r.turn, r.position, r.depth, r.reply_to) for r in found), key=str) == brute(ROWS)
    text = {(r.conv_id, r.turn): r.text for r in found}
    assert text[1, 2] == "back to first" and text[1, 4] == "branch of 1" and text[1, 0] == "Hello there\nHow are you?" and text[2, 1] == ""
    assert {(r.conv_id, r.turn): r.n_quoted_lines for r in found}[1, 4] == 2


def test_nested_branches(frame):
    """Each message quotes the last but one, so that branches nest as deep as the conversation is long."""
    rows = [(1, i, "u", (f"> m{i - 2}\n" if i > 1 else "") + f"m{i}") for i in range(20)]
    found = c.reply_order(frame(rows)).collect()
    assert sorted(((r.conv_id, r.turn, r.position, r.depth, r.reply_to) for r in found), key=str) == brute(rows)


def test_repeated_rows_and_empty(frame):
    found = c.reply_order(frame([(1, 0, "u", "a"), (1, 0, "u", "a"), (1, 1, "a", "> a\nb")])).collect()
    assert sorted((r.turn, r.position, r.depth) for r in found) == [(0, 0, 0), (0, 1, 1), (1, 2, 2)]
    assert c.reply_order(frame(ROWS).limit(0)).count() == 0


def test_sentences_out_of_lines_and_over_line_ends(frame):
    """Each quoting message replies to message 0 or 1, not to the one before it."""
    rows = [
        (1, 0, "u", "First point. Could you send the old table?  It is needed. Bye"), (1, 1, "a", "It comes in two parts and the second\none is long (see below.) Then we\nare done!"),
        (1, 2, "u", "Other things."), (1, 3, "a", "> Could you send the old table?\nYes"),              # out of a longer line
        (1, 4, "u", "> First point. Could you send the\n> old table? It is needed. Bye\nNo"),             # wrapped anew
        (1, 5, "a", "So.\nOn Monday a wrote:\n>> it comes in two parts\n>> and the second one is long (see below.)\n>> Then we are done!\nWell"),
        (1, 6, "u", "> could you send the\n>\n> old table?\nnot over an empty line"), (1, 7, "a", "> could you send the\n>> old table?\nnor over levels"),
        (2, 0, "u", "\u4f60\u597d\u3002\u518d\u89c1\u3002"), (2, 1, "a", "x"), (2, 2, "u", "> \u518d\u89c1\u3002\ny"), (3, 0, "u", "So. On it"), (3, 1, "a", "z"), (3, 2, "u", "> So.\nw"),
    ]
    found = {(r.conv_id, r.turn): r.reply_to for r in c.reply_order(frame(rows)).collect()}
    assert [found[1, i] for i in range(8)] == [None, 0, 1, 0, 0, 1, 5, 6]
    assert (found[2, 2], found[3, 2]) == (0, 0)


def test_native_plan(frame, executed_plan):
    plan = executed_plan(c.reply_order(frame(ROWS)))
    assert "Python" not in plan and "Arrow" not in plan
