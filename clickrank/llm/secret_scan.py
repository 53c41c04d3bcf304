"""Secret scan: fixed patterns, and the guess cost of values that stand in a credential context.

The patterns are searched on UTF-8 bytes (all their characters are ASCII) and reported in code points. A value after a
credential word is segmented at minimum cost, by dynamic programming over its characters, into words of the same
document, of the corpus or of a short list, dates, repeats, keyboard walks and brute-force spans; its guess cost in bits
decides, also for digits only and letters of one case. ``word_ranks`` ranks every word that the documents hold twice or more,
outside of values in a credential context; a word costs as many guesses as its best rank says. The ranked words stay a table:
a document meets those of them that are part of its own values. A value of letters only may be prose, so frequent words of
English are words of the list for it, and after ' is ' it is not reported if it is written as prose is: in small letters,
with or without a capital first, or all in capitals after ' IS '.

Defined cases: null and empty texts have no spans; repeated rows are scanned each; null ids are kept; an empty table
gives an empty result; other columns are ignored; a long text is scanned whole, and a long value costs time in
proportion to its length because every kind of segment but repeats and walks has a bounded width.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickrank.operators.scale import dense_index, lookup
from clickrank.session import stage

KINDS = ("assign", "access", "hex", "guess")
MIN_BITS = 36.0
LISTED = 1 << 16     # words of a list for callers who send one to the tasks: some MB
HELD = 1 << 19       # different words that a task counts before it passes its counts on
BATCH = 1 << 15      # rows of a batch that a task passes on
WIDEST = 512         # characters of a block and its repetition

ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")   # a run of 18 or more with the prefix; shorter runs hold no longer one
HEX = re.compile(rb"[0-9a-f]{16,}")          # likewise
CONTEXT = re.compile(
    rb"(?:password|passwd|passphrase|passcode|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key)"
    rb"[\"']?(?:\x20*[:=]\x20*|\x20+(?P<verb>is)\x20+)[\"']?(?P<value>[^\x00-\x20\"'<>,;]+)", re.I,
)

#: Every match of ``ASSIGN`` and ``CONTEXT`` holds one of these.
_KEYWORDS = (b"passw", b"passp", b"passc", b"pwd", b"secret", b"token", b"credential", b"apikey", b"api_key", b"api-key", b"accesskey",
             b"access_key", b"access-key", b"privatekey", b"private_key", b"private-key", b"authkey", b"auth_key", b"auth-key")

#: Frequent parts of chosen passwords, most frequent first.
COMMON = ("password", "pass", "admin", "root", "user", "test", "love", "secret", "welcome", "login", "master", "hello")
#: Frequent English words, for values of letters only; each costs as many guesses as the list has words.
PROSE = frozenset("""
about above according account across action after again against almost along already also although always among another
answer anything around available away back because become been before being below best better between both call called
change check come common complete could data date different does doing done down each either else email empty enough
even every everything example false field file find first following found from full general give given good great group
hand hard have head here high home house however idea important inside instead into invalid item just keep kept kind know
known large last later least left less life light like line list little long look made main make many mean might missing
money more most much must name need never next none nothing number often only open optional order other over part people
place please point possible present private problem public question rather read really required right said same seen
shall short should show since small some someone something soon still such system take tell than that their them then
there these they thing things think this those though through time today together true type under undefined unknown until
upon used useful using value very want water well were what when where whether which while whole will with within without
word words work world would write wrong year your yourself
""".split())
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
_DATE = re.compile(r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
_LEET = str.maketrans("01345$@7", "oleassat")


def _neighbours() -> dict[str, str]:
    """Keys beside or across from each key."""
    near: dict[str, str] = {}
    for r, row in enumerate(_ROWS):
        for c, key in enumerate(row):
            across = [other[c + d] for k, other in ((r - 1, _ROWS[r - 1] if r else ""), (r + 1, (*_ROWS, "")[r + 1])) for d in (-1, 0, 1) if 0 <= c + d < len(other)]
            near[key] = "".join(row[max(0, c - 1) : c] + row[c + 1 : c + 2]) + "".join(across)
    return near


_NEAR = _neighbours()


def _class_bits(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    return math.log2(26) if c.isalpha() else math.log2(33)


def least_length(min_bits: float) -> int:
    """Shorter values cannot cost ``min_bits``, whatever their characters."""
    return max(1, math.ceil(min_bits / math.log2(33)))


_WORD = re.compile(r"[^\W\d_]{3,}")


class Ranks(dict):
    """Word to rank from 1, for words in order or with their ranks."""

    def __init__(self, words: Sequence[str] | dict[str, int] = ()):
        super().__init__(words if isinstance(words, dict) else ((w, i + 1) for i, w in enumerate(words)))
        self.longest = max(map(len, words), default=0)


def _is_keyed(folded: bytes) -> bool:
    return any(w in folded for w in _KEYWORDS)


def guess_bits(value: str, words: dict[str, int], widest: int = WIDEST) -> float:
    """Least log2 of guesses over all segmentations; ``words`` maps a lower-case word to its rank from 1.

    A segment costs its own guesses; every further segment doubles them, as its place has to be guessed too.
    """
    n = len(value)
    lengths = sorted({len(w) for w in words if 3 <= len(w) <= n})
    halves = np.arange(1, min(widest, n) // 2 + 1)
    same = np.zeros(len(halves), np.int64)  # characters up to here that equal the one so far before, by distance
    low = value.lower()
    if len(low) != n:  # a letter whose small form has two characters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    codes = np.array([ord(c) for c in low], np.int64)
    keys = low.translate(_SHIFTED)
    plain = low.translate(_LEET)
    best = [0.0] + [math.inf] * n
    walk, turns, repeat = 0, 0, 0
    for end in range(1, n + 1):
        i = end - 1
        best[end] = best[i] + _class_bits(value[i])
        # the longest walk and the longest repeat that end here
        if i and keys[i] in _NEAR.get(keys[i - 1], ""):
            walk += 1
            turns += walk > 1 and _NEAR[keys[i - 1]].index(keys[i]) != _NEAR[keys[i - 2]].index(keys[i - 1])
        else:
            walk = turns = 0
        repeat = repeat + 1 if i and low[i] == low[i - 1] else 0
        if walk >= 3:
            best[end] = min(best[end], best[end - walk - 1] + 1 + math.log2(47 * (walk + 1)) + 2.3 * turns)
        if repeat >= 2:
            best[end] = min(best[end], best[end - repeat - 1] + 1 + _class_bits(value[i]) + math.log2(repeat + 1))
        for width in lengths[: bisect_right(lengths, end)]:
            start = end - width
            for form, extra in ((low, 0.0), (plain, 1.0)):
                rank = words.get(form[start:end])
                if rank:
                    part = value[start:end]
                    upper = 0.0 if part == part.lower() else 1.0 if part[1:] == part[1:].lower() or part == part.upper() else width * 0.5
                    best[end] = min(best[end], best[start] + 1 + math.log2(rank + 1) + upper + extra)
        far = min(i, len(halves))
        same[:far] = np.where(codes[i - far : i][::-1] == codes[i], same[:far] + 1, 0)
        for half in halves[1:far][same[1:far] >= halves[1:far]].tolist():
            best[end] = min(best[end], best[end - half] + 2)
        for width in (4, 8, 10):
            if width <= end and _DATE.fullmatch(value[end - width : end]):
                best[end] = min(best[end], best[end - width] + 1 + (math.log2(119) if width == 4 else math.log2(365 * 119) + (width == 10)))
    return best[n]


def _is_prose(value: str, verb: bytes | None) -> bool:
    """After ' is ': letters only, in the case of a sentence around them."""
    plain = value.strip("(-_")
    return verb is not None and plain.isalpha() and (plain[1:] == plain[1:].lower() or verb == b"IS" and plain.isupper())


def _batches(rows: Iterable[tuple], names: Sequence[str], types: Sequence[pa.DataType]) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while some := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*some), types)], names)


def word_counts(docs: DataFrame, text: str = "text", held: int = HELD) -> DataFrame:
    """``(word, n)``: every word in lower case and how often all documents have it, outside of values, if twice or more."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for one in batch.column("text").cast(pa.large_binary()):
                raw = one.as_py() or b""
                if _is_keyed(raw.lower()):
                    raw = CONTEXT.sub(b" ", raw)
                counts.update(_WORD.findall(raw.decode(errors="ignore").lower()))
                if len(counts) > held:
                    yield from counts.items()
                    counts.clear()
        yield from counts.items()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(counted(batches), ("word", "n"), (pa.string(), pa.int64()))

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")


def word_ranks(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, rank)`` of all words of ``word_counts``, the most frequent first from 1, ties in code point order."""
    return dense_index(word_counts(docs, text), [F.col("n").desc(), F.col("word").asc()], "rank").select("word", "rank")


def corpus_words(docs: DataFrame, text: str = "text", listed: int = LISTED) -> list[str]:
    """The first words of ``word_ranks`` as a list: at most ``listed`` of them, and none whose count is as high, within a power
    of two, as that of a word left out."""
    summed = stage(word_counts(docs, text), "corpus-words")
    # The least count of which there are few enough, from a histogram of powers of two.
    least, total = None, 0
    for power, n in sorted(summed.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect(), reverse=True):
        total += n
        if total > listed:
            break
        least = 1 << power
    kept = summed.where(F.col("n") >= least).collect() if least else []
    return [r["word"] for r in sorted(kept, key=lambda r: (-r["n"], r["word"]))]


def _forms(value: str) -> set[str]:
    return {value.lower(), value.lower().translate(_LEET)}


def value_words(docs: DataFrame, ranks: DataFrame, min_bits: float = MIN_BITS, text: str = "text") -> DataFrame:
    """``(key, known)``: per distinct text, by its SHA-256, the ranked words inside its values, with their ranks.

    Parts of a value are looked up where they are letters only and as long as some ranked word.
    """
    lengths = sorted(r[0] for r in ranks.select(F.length("word")).distinct().collect())

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
        for batch in batches:
            for one in batch.column("text").cast(pa.large_binary()):
                raw = one.as_py() or b""
                values = _values(raw, _base_spans(raw), min_bits)
                if not values:
                    continue
                key = hashlib.sha256(raw).hexdigest()
                for run in {run for _, v in values for form in _forms(v) for run in _WORD.findall(form)}:
                    for width in lengths[: bisect_right(lengths, len(run))]:
                        yield from ((key, run[a : a + width]) for a in range(len(run) - width + 1))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(parts(batches), ("key", "word"), (pa.string(), pa.string()))

    found = docs.select(F.col(text).alias("text")).mapInArrow(find, "key string, word string").distinct()
    return lookup(found, ranks, "word", "inner", derived=True).groupBy("key").agg(F.collect_list(F.struct("word", "rank")).alias("known"))


def _ranked_words(text: str, values: list[str], corpus: Ranks) -> dict[str, int]:
    """Ranks of the words of the list and the document's own, the frequent ones first, and of the corpus; a value's own place
    does not count."""
    counts: dict[str, int] = {}
    for w in _WORD.findall(text.lower()):
        counts[w] = counts.get(w, 0) + 1
    for value in values:
        for w in _WORD.findall(value.lower()):
            if w in counts:
                counts[w] -= 1
    own = sorted((w for w, n in counts.items() if n > 0), key=lambda w: (-counts[w], w))
    ranks = {w: i + 1 for i, w in reversed(list(enumerate([*COMMON, *own])))}
    ranks = {w: min(rank, corpus.get(w, rank)) for w, rank in ranks.items()}
    # Of the corpus, only words within the values can be segments of them.
    forms = {form for value in values for form in _forms(value)}
    inside = {v[a:b] for v in forms for a in range(len(v)) for b in range(a + 3, min(len(v), a + corpus.longest) + 1)}
    return {w: corpus[w] for w in inside if w in corpus} | ranks


def _meets(spans: list[tuple[int, int, str]]) -> Callable[[int, int], bool]:
    """Does a span from start to end meet one of ``spans``?"""
    spans = sorted(spans)
    starts, ends = [s for s, _, _ in spans], list(accumulate((e for _, e, _ in spans), max))

    def meets(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return before > 0 and ends[before - 1] > start

    return meets


def _base_spans(raw: bytes) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 12] if _is_keyed(raw.lower()) else []
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(raw)]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(raw)]


def _values(raw: bytes, base: list[tuple[int, int, str]], min_bits: float) -> list[tuple[int, str]]:
    """(start, value) of what stands in a credential context, meets no base span, is long enough and no prose."""
    shortest = least_length(min_bits)
    if not _is_keyed(raw.lower()):
        return []
    values = [(*m.span("value"), m["verb"]) for m in CONTEXT.finditer(raw) if len(m["value"]) >= shortest]
    meets = _meets(base)
    values = [(a, b, verb) for a, b, verb in values if not meets(a, b)]
    values = [(a, raw[a:b].rstrip(b".:!?)").decode(), verb) for a, b, verb in values]
    return [(a, v) for a, v, verb in values if len(v) >= shortest and not _is_prose(v, verb)]


def find_spans(raw: bytes, min_bits: float = MIN_BITS, widest: int = WIDEST, corpus: Ranks = Ranks()) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start, then kind as listed."""
    found = _base_spans(raw)
    values = _values(raw, found, min_bits)
    if values:
        words = _ranked_words(raw.decode(), [v for _, v in values], corpus)
        lettered = {w: min(len(PROSE), words.get(w, len(PROSE))) for w in PROSE}
        costs = [guess_bits(v, words | lettered if v.strip("(-_").isalpha() else words, widest) for _, v in values]
        found += [(a, a + len(v.encode()), "guess") for (a, v), bits in zip(values, costs) if bits >= min_bits]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _code_points(raw: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    if not spans or raw.isascii():
        return spans
    firsts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [(int(np.searchsorted(firsts, a)), int(np.searchsorted(firsts, b)), k) for a, b, k in spans]


def scan(
    docs: DataFrame, min_bits: float = MIN_BITS, id_col: str = "doc_id", text: str = "text", widest: int = WIDEST, words: Sequence[str] = (),
    ranks: DataFrame | None = None,
) -> DataFrame:
    """Per row: doc_id, the numbers of base spans, their sha256, and all spans, as ``kind:start:end`` in code points.

    ``words`` are dictionary words in the order of their frequency, as from ``corpus_words``; ``ranks`` is a table of any size
    instead, as from ``word_ranks``, of which a row gets the words inside its own values.
    """
    shared = docs.sparkSession.sparkContext.broadcast(list(words))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = Ranks(shared.value)
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            base, every = [], []
            own = batch.column("known").to_pylist() if "known" in batch.schema.names else [None] * len(batch)
            for one, known in zip(batch.column("text").cast(pa.large_binary()), own):
                raw = one.as_py() or b""
                ranked = Ranks({w["word"]: w["rank"] for w in known}) if known else corpus
                spans = _code_points(raw, find_spans(raw, min_bits, widest, ranked))
                for k in KINDS:
                    counts[k].append(sum(s[2] == k for s in spans))
                written = [f"{k}:{a}:{b}" for a, b, k in spans]
                every.append(",".join(written))
                base.append(hashlib.sha256(",".join(w for w in written if w[:5] != "guess").encode()).hexdigest())
            columns = [batch.column("doc_id"), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(base, pa.string()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if ranks is not None:
        known = stage(value_words(docs, ranks, min_bits, text), "value-words")
        rows = lookup(rows.withColumn("key", F.sha2("text", 256)), known, "key").select("doc_id", "text", "known")
    return rows.mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")
