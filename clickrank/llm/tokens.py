"""Encoding with a public tokenizer of the tokenizers library, one call per distinct chunk.

Byte-pair encoders of this kind never merge over a boundary between a visible character and a following space or line
break. A text is therefore cut there, every distinct chunk is encoded once by the library, and the ids of the chunks
are joined. Ids are little-endian unsigned 32-bit, which is also how they are hashed and written.

``encode_column`` does so for all plain texts of a column at once: chunks are 64-bit hashes, looked up in a table of known
chunks, and ids are gathered from flat arrays. Texts with anything but visible ASCII, Latin letters, single spaces and
line breaks go through ``encode`` one by one.

What is known lives as long as a Python worker and is bounded: the table by ``TABLE`` chunks (some 20 MB), of which those
not met since the last time go when it is full; the chunks of ``encode`` by two generations of ``KNOWN // 2``, of which a
full young one becomes the old one.
"""

from __future__ import annotations

import re
import sys
from array import array

import numpy as np
import pyarrow as pa

from clickrank.llm import textbatch as tb

TABLE = 1 << 19
KNOWN = 20_000
LONGEST = 64  # longer chunks are not remembered
_VISIBLE = "!-~À-ɏ"
_SAFE_CUT = re.compile(rf"(?<=[{_VISIBLE}])(?=[ \n][{_VISIBLE}])")

_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Letters and what follows them up to the end, without digits, letters and apostrophes.
_MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)").fullmatch


def _packed(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class _Chunks(dict):
    """Chunk to its ids as bytes; ``prefix`` is put before a chunk to be encoded.

    A chunk of letters is one piece for the tokenizer's splitter, so the library's model encodes it without splitter and
    normaliser. Marks after letters are a piece of their own.
    """

    def __init__(self, tokenizer, lower: bool, prefix: str = "", marks: dict | None = None):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.old: dict[str, bytes] = {}
        self.tokenizer, self.model, self.prefix, self.lower = tokenizer, tokenizer.model, prefix, lower
        self.marks = self if marks is None else marks
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(32, 256)) if c == " " or c.isalpha()}
        self.written_prefix = prefix.translate(self.written)

    def _ids(self, chunk: str) -> bytes:
        plain = chunk.isascii()
        if chunk.isalpha() if plain else _LETTERS(chunk):
            text = chunk.lower() if self.lower else chunk
            written = self.written_prefix + (text if plain else text.translate(self.written))
            return _packed([t.id for t in self.model.tokenize(written)])
        marked = _MARKED(chunk)
        if marked:
            return self[marked[1]] + self.marks[marked[2]]
        text = chunk if chunk[:1] == "\n" else self.prefix + chunk
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self._ids(chunk)
            if len(chunk) >= LONGEST:
                return ids
        if len(self) >= KNOWN // 2:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


class _Table:
    """Ids of known chunks by their hashes: open addressing over flat arrays, looked up for many chunks at once."""

    def __init__(self, capacity: int):
        self.capacity, self.bits = capacity, max(1, int(capacity).bit_length())
        self._clear()

    def _clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.hashes = np.zeros(self.capacity, np.uint64)
        self.met = np.zeros(self.capacity, bool)
        self.starts, self.sizes = np.zeros(self.capacity, np.int32), np.zeros(self.capacity, np.int16)
        self.ids, self.n, self.filled = np.zeros(4 * self.capacity, np.uint32), 0, 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of chunks in the table, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int32)
        left = np.arange(len(hashes))
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            place = self.slots[at[left]]
            taken = place >= 0
            same = taken & (self.hashes[place] == hashes[left])
            out[left[same]] = place[same]
            left = left[taken & ~same]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
        self.met[out[out >= 0]] = True
        return out

    def add(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """New chunks, each once; no more than fit are taken."""
        if self.n + len(hashes) > self.capacity:
            kept = np.flatnonzero(self.met[: self.n])
            if 2 * len(kept) > self.capacity:
                kept = kept[:0]
            old = self.hashes[kept], self.sizes[kept].astype(np.int64), gathered(self.ids, self.starts[kept], self.sizes[kept])
            self._clear()
            self._put(*old)
        room = min(len(hashes), self.capacity - self.n)
        self._put(hashes[:room], sizes[:room], ids[: int(sizes[:room].sum())])

    def _put(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        end = self.n + len(hashes)
        if self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.filled], np.zeros(2 * (self.filled + len(ids)) - self.filled, np.uint32)])
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.hashes[self.n : end], self.sizes[self.n : end] = hashes, sizes
        self.starts[self.n : end] = self.filled + np.cumsum(sizes, dtype=np.int64) - sizes
        left = np.arange(len(hashes))
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            # Of the chunks at one free slot the first gets it.
            _, first = np.unique(at[left], return_index=True)
            first = first[self.slots[at[left[first]]] < 0]
            self.slots[at[left[first]]] = self.n + left[first]
            left = np.delete(left, first)
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
        self.n, self.filled = end, self.filled + len(ids)


def gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``ids[start : start + size]`` of all pairs, one after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return ids[np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


#: Bytes of plain texts: space, line break, visible ASCII, and UTF-8 of U+00C0 to U+027F.
_PLAIN = np.zeros(256, bool)
_PLAIN[[0x0A, 0x20]] = _PLAIN[0x21:0x7F] = _PLAIN[0x80:0xC0] = _PLAIN[0xC3:0xCA] = True
#: Bytes of letters and of marks, apostrophes left out; the signs in _NO_LETTERS are the two of U+00C0 to U+027F that are none.
_LETTER, _MARK = np.zeros((2, 256), bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:0xC0] = _LETTER[0xC3:0xCA] = True
_MARK[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_NO_LETTERS = ("×".encode(), "÷".encode())
_AFTER = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)  # of a space, of a line break


class ChunkEncoder:
    """``encode`` gives the ids of a whole text as bytes, equal to the library's ids of the whole text.

    ``spaces_dropped`` says that the tokenizer drops white space and folds case, so that words can be encoded alone.
    """

    def __init__(self, path: str, spaces_dropped: bool, table: int = TABLE):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.spaces_dropped = spaces_dropped
        self.whole = _Chunks(tokenizer, spaces_dropped)
        self.spaced = _Chunks(tokenizer, spaces_dropped, " ", self.whole)
        self.table = _Table(table)

    def encode(self, text: str) -> bytes:
        flat = text.replace("\n", " ")
        if self.spaces_dropped:
            return b"".join(map(self.whole.__getitem__, flat.split(" ")))
        if flat.isprintable() and "  " not in flat and flat[:1] != " ":
            first, *rest = text.replace("\n", " \n").split(" ")
            return self.whole[first] + b"".join(map(self.spaced.__getitem__, rest))
        return b"".join(map(self.whole.__getitem__, _SAFE_CUT.split(text)))

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """``encode`` of every text; null is empty."""
        out: list[bytes] = []
        for _, _, data, offsets in tb.pieces(column):
            out += self._encode_piece(data, offsets)
        return out

    def _plain_rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        odd = ~_PLAIN[data]
        if not self.spaces_dropped:
            # A cut keeps its space or line break with the chunk behind it: none may stand alone.
            alone = np.zeros(len(data) + 1, bool)
            alone[:-1] = (data == 0x20) | (data == 0x0A)
            border = np.zeros(len(data) + 1, bool)
            border[offsets] = True
            odd |= alone[:-1] & (alone[1:] | border[:-1] | border[1:])
        return tb.row_sums(odd, offsets) == 0

    def _unmarked(self, data: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length of the letters, length of the marks) of chunks that are letters with marks behind them, else 0 marks."""
        letter = _LETTER[data]
        for sign in _NO_LETTERS:
            at = raw.find(sign)
            while at >= 0:
                letter[at : at + 2] = False
                at = raw.find(sign, at + 2)
        letters, marks = np.zeros((2, len(data) + 1), np.int32)
        np.cumsum(letter, out=letters[1:])
        np.cumsum(_MARK[data], out=marks[1:])
        n_letters, n_marks = letters[ends] - letters[starts], marks[ends] - marks[starts]
        cut = starts + n_letters
        split = (n_letters > 0) & (n_marks > 0) & (n_letters + n_marks == ends - starts) & (letters[cut] - letters[starts] == n_letters)
        return n_letters, np.where(split, n_marks, 0)

    def _new(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, after: np.ndarray) -> list[bytes]:
        """Ids of chunks that are not known; ``after`` is 0 at the start of a text, 1 after a space, 2 after a line break."""
        whole, spaced, found = self.whole, self.spaced, []
        for start, end, behind in zip(starts.tolist(), ends.tolist(), after.tolist()):
            chunk = raw[start:end].decode()
            found.append(whole._ids(chunk) if not behind else spaced._ids(chunk if behind == 1 else "\n" + chunk))
        return found

    def _encode_piece(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        raw = data.tobytes()
        plain = self._plain_rows(data, offsets)
        starts, ends, words = tb.word_spans(data, offsets)
        if not plain.all():
            used = np.repeat(plain, np.diff(words))
            starts, ends = starts[used], ends[used]
        after = np.zeros(len(starts), np.int64)
        if not self.spaces_dropped:
            after = np.where(np.isin(starts, offsets), 0, np.where(data[np.maximum(starts, 1) - 1] == 0x20, 1, 2))
        # Marks behind letters are a chunk of their own, without what comes before.
        letters, marks = self._unmarked(data, raw, starts, ends)
        parts = 1 + (marks > 0)
        counts = np.where(plain, np.diff(words), 0)
        borders = np.concatenate([[0], np.cumsum(parts)])[np.concatenate([[0], np.cumsum(counts)])]
        second = np.zeros(int(parts.sum()), bool)
        second[(np.cumsum(parts) - 1)[marks > 0]] = True
        of = np.repeat(np.arange(len(starts)), parts)
        cut = np.where(marks > 0, starts + letters, ends)
        starts, ends = np.where(second, cut[of], starts[of]), np.where(second, ends[of], cut[of])
        after = np.where(second, 0, after[of])
        hashes = tb.word_hashes(data, starts, ends)
        for kind in (1, 2):
            hashes = np.where(after == kind, tb.mixed(hashes ^ _AFTER[kind - 1]), hashes)
        place = self.table.find(hashes)
        known = place >= 0
        unknown, first, which = np.unique(hashes[~known], return_index=True, return_inverse=True)
        first = np.flatnonzero(~known)[first]
        new = self._new(raw, starts[first], ends[first], after[first])
        new_sizes = np.array([len(x) // 4 for x in new], np.int64)
        new_ids = np.frombuffer(b"".join(new), "<u4").astype(np.uint32)

        sizes = np.zeros(len(starts), np.int64)
        sizes[known] = self.table.sizes[place[known]]
        sizes[~known] = new_sizes[which]
        flat = np.zeros(int(sizes.sum()), "<u4")
        mine = np.repeat(known, sizes)
        flat[mine] = gathered(self.table.ids, self.table.starts[place[known]], sizes[known])
        flat[~mine] = gathered(new_ids, (np.cumsum(new_sizes) - new_sizes)[which], sizes[~known])
        kept = ends[first] - starts[first] < LONGEST
        self.table.add(unknown[kept], new_sizes[kept], new_ids[np.repeat(kept, new_sizes)])

        before = np.concatenate([[0], np.cumsum(sizes)])[borders]
        return [
            flat[before[i] : before[i + 1]].tobytes() if fast else self.encode(raw[offsets[i] : offsets[i + 1]].decode())
            for i, fast in enumerate(plain.tolist())
        ]


_open: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, spaces_dropped: bool) -> ChunkEncoder:
    """The encoder of a file, opened once in a worker."""
    key = (path, spaces_dropped)
    if key not in _open:
        _open[key] = ChunkEncoder(path, spaces_dropped)
    return _open[key]


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
