"""Vectorised scanning of text batches: words, pre-tokens and distinct values, as numpy arrays over Arrow buffers.

Every operator that reads texts in Python works on slices of an Arrow batch of a few megabytes, so that memory
follows the slice and not the table. A slice becomes one byte array; word and pre-token borders are found with
array comparisons, and each distinct word is looked at once.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Tokens:
    """The tokens of some texts: values[codes[k]] is token k; text i has tokens offsets[i] to offsets[i + 1]."""

    values: pa.Array
    codes: np.ndarray
    offsets: np.ndarray

    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of each slice hold about `limit` bytes; one longer text is a slice alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (one more for the end); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.binary())
    if texts.null_count:
        texts = texts.cast(pa.binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct byte strings, and which of them each one is."""
    if len(offsets) < 2:
        return pa.array([], pa.binary()), np.zeros(0, np.int32)
    coded = binary_array(data, offsets).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def words(texts: pa.Array, separator: np.ndarray = _SEPARATOR, lower: bool = True) -> Tokens:
    """Maximal runs of bytes that are no separators, lower-cased A-Z; words never cross texts."""
    data, bounds = flat(texts)
    if lower:
        data = lowered(data)
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(data)]
    first[heads] |= inside[heads]
    starts = np.flatnonzero(first)
    kept = np.concatenate(([0], np.cumsum(inside)))
    offsets = np.append(kept[starts], kept[-1])
    values, codes = distinct(data[inside], offsets)
    return Tokens(values, codes, np.searchsorted(starts, bounds))


@functools.cache
def char_classes() -> np.ndarray:
    """Letter, number, white space or other of every code point, as the regular expressions of tokenizers see them."""
    from tokenizers import Regex, pre_tokenizers

    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    text, table, at = "".join(map(chr, points)), np.full(0x110000, OTHER, np.uint8), np.array(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            table[at[a:b]] = kind
    return table


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each character of UTF-8 bytes begins, its first byte, and its class."""
    table = char_classes()
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    kinds = table[:128][lead & 0x7F]
    wide = np.flatnonzero(lead >= 0x80)
    if len(wide):
        padded = np.concatenate((data, np.zeros(4, np.uint8)))
        p, b = at[wide], lead[wide].astype(np.uint32)
        c1, c2, c3 = (padded[p + k].astype(np.uint32) & 0x3F for k in (1, 2, 3))
        points = np.where(b < 0xE0, (b & 0x1F) << 6 | c1, np.where(b < 0xF0, (b & 0x0F) << 12 | c1 << 6 | c2, (b & 0x07) << 18 | c1 << 12 | c2 << 6 | c3))
        kinds[wide] = table[np.minimum(points, 0x10FFFF)]
    return at, lead, kinds


def _contractions(lead: np.ndarray, kinds: np.ndarray, edge: np.ndarray, change: np.ndarray, first: np.ndarray) -> None:
    """Marks in `first` what 's 't 're 've 'm 'll 'd split off, where a match can begin at the apostrophe."""
    n = len(lead)
    at = np.flatnonzero((lead == 0x27) & change & first)
    at = at[at + 1 < n]
    at = at[(kinds[at + 1] == LETTER) & ~edge[at + 1]]
    if not len(at):
        return
    one = lead[at + 1]
    has_two = at + 2 < n
    two = np.where(has_two, lead[np.minimum(at + 2, n - 1)], 0)
    two = np.where(has_two & ~edge[np.minimum(at + 2, n - 1)], two, 0)
    size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, 0)
    for pair in (b"re", b"ve", b"ll"):
        size = np.where((size == 0) & (one == pair[0]) & (two == pair[1]), 2, size)
    at, size = at[size > 0], size[size > 0]
    first[at + 1] = False
    rest = at + 1 + size
    rest = rest[rest < n]
    rest = rest[(kinds[rest] == LETTER) & ~edge[rest]]
    first[rest] = True


def _edges(at: np.ndarray, n_bytes: int, bounds: np.ndarray) -> np.ndarray:
    edge = np.zeros(len(at) + 1, bool)
    edge[np.searchsorted(at, bounds)] = True
    return edge[: len(at)]


def spaced_pretokens(data: np.ndarray, bounds: np.ndarray, whole: np.ndarray | None = None) -> Tokens:
    """Pre-tokens that keep one blank before a word (the pattern of byte-level vocabularies); they tile the texts.

    bounds: where texts begin, and the end. whole: (begin, end) rows of special strings, each one pre-token."""
    at, lead, kinds = _characters(data)
    n = len(at)
    cuts = bounds if whole is None or not len(whole) else np.union1d(bounds, whole.ravel())
    edge = _edges(at, len(data), cuts)
    change = edge.copy()
    if n:
        change[0] = True
        change[1:] |= kinds[1:] != kinds[:-1]
    first = change.copy()
    runs = np.flatnonzero(change)
    follow = runs[1:]
    after = follow[(kinds[follow - 1] == SPACE) & ~edge[follow]] if n else follow
    first[after - 1] = True
    first[after[lead[after - 1] == 0x20]] = False
    _contractions(lead, kinds, edge, change, first)
    if whole is not None:
        for a, b in np.searchsorted(at, whole).reshape(-1, 2):
            first[a] = True
            first[a + 1 : b] = False
    starts = at[np.flatnonzero(first)]
    values, codes = distinct(data, np.append(starts, len(data)))
    return Tokens(values, codes, np.searchsorted(starts, bounds))


def bare_pretokens(data: np.ndarray, bounds: np.ndarray, whole: np.ndarray | None = None) -> Tokens:
    """Pre-tokens without white space: runs of letters, single digits, runs of other characters, contractions."""
    at, lead, kinds = _characters(data)
    n = len(at)
    cuts = bounds if whole is None or not len(whole) else np.union1d(bounds, whole.ravel())
    edge = _edges(at, len(data), cuts)
    change = edge.copy()
    if n:
        change[0] = True
        change[1:] |= kinds[1:] != kinds[:-1]
    first = change | (kinds == NUMBER)
    _contractions(lead, kinds, edge, change, first)
    inside = kinds != SPACE
    if whole is not None:
        for a, b in np.searchsorted(at, whole).reshape(-1, 2):
            first[a] = True
            first[a + 1 : b] = False
            inside[a:b] = True
    first &= inside
    sizes = np.diff(np.append(at, len(data)))
    kept = np.concatenate(([0], np.cumsum(np.where(inside, sizes, 0))))
    chosen = np.flatnonzero(first)
    values, codes = distinct(data[np.repeat(inside, sizes)], np.append(kept[chosen], kept[-1]))
    return Tokens(values, codes, np.searchsorted(at[chosen], bounds))


def spread(values: list[bytes], codes: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """values[codes] one after the other, and where each begins (one more for the end)."""
    out = pa.array(values, pa.binary()).take(pa.array(codes))
    data, offsets = flat(out)
    return memoryview(np.ascontiguousarray(data)), offsets


def by_slice(make: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text", limit: int = SLICE_BYTES) -> Callable:
    """For mapInArrow: applies `make` to slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (out for part in slices(batches, column, limit) if (out := make(part)) is not None)

    return run


class Recent:
    """A cache of bounded size: what was asked for lately stays, older entries go a generation at a time."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value

    def many(self, keys: list, make: Callable[[list], list]) -> list:
        """The values of all keys; `make` gives those of the missing ones."""
        got = list(map(self.new.get, keys))
        missing = []
        for k in [k for k, v in enumerate(got) if v is None]:
            if (v := self.old.get(keys[k])) is not None:
                got[k] = v
                self.put(keys[k], v)
            else:
                missing.append(k)
        if missing:
            for k, v in zip(missing, make([keys[k] for k in missing]), strict=True):
                got[k] = v
                self.put(keys[k], v)
        return got


def chunked(items: list, size: int) -> Iterator[list]:
    it = iter(items)
    while part := list(itertools.islice(it, size)):
        yield part
