"""Splitting whole texts into the pre-tokens of byte-level BPE with array operations, and a bounded word memo.

The split gives exactly the matches of ``public_tokenizers.PATTERN``.  It works on the class of each code point
(letter, number, space, other white space, anything else): where a match starts depends only on the classes of the
character and its two neighbours, apart from the English contractions, which are mended afterwards.
"""

from __future__ import annotations

import codecs
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.common import slices_by_bytes

OTHER, LETTER, NUMBER, BLANK, SPACE, NONE = 0, 1, 2, 3, 4, 9
#: Bytes of text that are split at a time; the more, the fewer words are looked up again, and the more memory it takes.
CHUNK_BYTES = 2 << 20
#: A memo forgets beyond so many words or bytes of words and values.
MEMO_WORDS, MEMO_BYTES = 600_000, 96 << 20


@functools.cache
def class_table() -> np.ndarray:
    """Class of each code point, as the ``regex`` module's Unicode properties have it."""
    import regex

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, at = "".join(map(chr, points)), np.array(points)
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, text):
            table[at[m.start() : m.end()]] = kind
    table[32] = SPACE
    return table


@functools.cache
def low_classes() -> bytes:
    """The part of the table that most texts need."""
    return class_table()[:256].tobytes()


def string_buffers(column: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Offsets (int64, rows + 1) into the returned UTF-8 buffer; null texts count as empty.  Texts aren't copied."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(1, np.int64), pa.py_buffer(b"")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64), data if data is not None else pa.py_buffer(b"")


def code_points(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each starts."""
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(raw):
        return points, np.arange(len(raw), dtype=np.int64)
    return points, np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)


def pretoken_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Positions at which the matches of the pattern start.  doc_starts: first position of each non-empty text."""
    kind = np.frombuffer(bytearray(points.astype(np.uint8)).translate(low_classes()), np.uint8)
    wide = np.flatnonzero(points > 255)
    kind[wide] = class_table()[points[wide]]
    n = len(kind)
    before, after = np.empty(n, np.uint8), np.empty(n, np.uint8)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[doc_starts] = NONE
    after[doc_starts[1:] - 1] = NONE
    after[-1] = NONE
    blank, before_blank = kind >= BLANK, (before == BLANK) | (before == SPACE)
    start = np.where(blank, ~before_blank | (after < BLANK), (kind != before) & (before != SPACE))
    quotes = np.flatnonzero((points == 39) & start & (after == LETTER))
    if len(quotes):
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        inner = np.concatenate([before, np.full(3, NONE, np.uint8)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        pair &= inner[quotes + 2] != NONE
        hit = short | pair
        ends = (quotes + np.where(pair, 3, 2))[hit]
        start[quotes[hit] + 1] = False
        start[ends[ends < n]] = True
    return np.flatnonzero(start)


class Chunk:
    """A run of texts with its distinct pre-tokens.

    words: distinct pre-tokens (bytes); codes: index into words of each pre-token; doc_tokens: for each text the index
    of its first pre-token, and the total at the end.
    """

    def __init__(self, rows: range, words: list[bytes], codes: pa.Array, doc_tokens: np.ndarray):
        self.rows, self.words, self.codes, self.doc_tokens = rows, words, codes, doc_tokens

    def gather(self, values: list[bytes]) -> tuple[np.ndarray, memoryview]:
        """Values of all pre-tokens, end to end; offsets: where each text's start, and the end."""
        if not len(self.codes):
            return np.zeros(len(self.rows) + 1, np.int64), memoryview(b"")
        taken = pa.array(values, pa.large_binary()).take(self.codes)
        _, offsets, data = taken.buffers()
        return np.frombuffer(offsets, np.int64)[taken.offset :][self.doc_tokens], memoryview(data if data is not None else b"")


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a column in runs of bounded size, each split into pre-tokens."""
    offsets, data = string_buffers(column)
    view = memoryview(data)
    for first, last in slices_by_bytes(np.diff(offsets), size):
        raw = bytes(view[offsets[first] : offsets[last]])
        texts = offsets[first : last + 1] - offsets[first]
        if not raw:
            yield Chunk(range(first, last), [], pa.array([], pa.int32()), np.zeros(last - first + 1, np.int64))
            continue
        points, at = code_points(raw)
        doc_starts = np.unique(np.searchsorted(at, texts[:-1][np.diff(texts) > 0]))
        starts = pretoken_starts(points, doc_starts)
        bounds = np.append(at[starts], len(raw)).astype(np.int64)
        tokens = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
        coded = tokens.dictionary_encode()
        yield Chunk(range(first, last), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices, np.searchsorted(bounds, texts))


class Memo:
    """Values of words already met in this worker; bounded: when full, only words that are being asked for stay."""

    def __init__(self, compute: Callable[[list[bytes]], list]):
        self.compute, self.known, self.size = compute, {}, 0

    def values(self, words: list[bytes]) -> list:
        found = list(map(self.known.get, words))
        if len(self.known) > MEMO_WORDS or self.size > MEMO_BYTES:
            self.known = {w: value for w, value in zip(words, found, strict=True) if value is not None}
            self.size = 6 * sum(map(len, self.known))
        places = [k for k, value in enumerate(found) if value is None]
        if places:
            new = [words[k] for k in places]
            values = self.compute(new)
            self.known.update(zip(new, values, strict=True))
            self.size += 6 * sum(map(len, new))
            for k, value in zip(places, values, strict=True):
                found[k] = value
        return found


@functools.cache
def library_tokenizer(path: str):
    """A tokenizer file of the ``tokenizers`` library; special-token strings in a text are ordinary text."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


@functools.cache
def byte_letters() -> dict[int, str]:
    """The letter that byte-level models use for each byte: visible Latin-1 characters stand for themselves, the others
    get the code points from 256 on, in order."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


def library_memo(path: str) -> Memo:
    """Little-endian 32-bit ids of each pre-token by the ``tokenizers`` library.

    A pre-token's ids don't depend on its neighbours, so the library's model encodes each distinct one once, not once
    for each time it stands in a text.
    """
    encode, letters = library_tokenizer(path).model.tokenize, byte_letters()
    table = "".join(letters[b] for b in range(256))

    def compute(words: list[bytes]) -> list[bytes]:
        text, at, ids, ends = codecs.charmap_decode(b"".join(words), "strict", table)[0], 0, [], [0]
        for w in words:
            end = at + len(w)
            ids += [t.id for t in encode(text[at:end])]
            ends.append(len(ids))
            at = end
        raw = np.array(ids, "<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)]

    return Memo(compute)
