"""Byte-pair vocabularies: merging by a heap over a linked list, counting by a prefix table, and encoded batches.

A vocabulary file of the tokenizers library is read for its symbols, merges and special tokens; nothing is trained.
The driver reads the file once and broadcasts its bytes (a few megabytes, whatever the corpus), so executors need
no copy of it. A batch is cut into pre-tokens by array operations, each distinct pre-token is merged once, and a
cache of bounded size keeps what recurs.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
import sys
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa

from . import scan

CACHE_WORDS = 150_000
_WIDTH = 20


@functools.cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    shown = set(plain)
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Symbols and merges of one file. ids() and count() are exact for any pre-token."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.lowers = "Lowercase" in json.dumps(spec.get("normalizer"))
        self.has_decoder = spec.get("decoder") is not None
        self.names: dict[int, str] = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        vocab, signs = model["vocab"], byte_symbols()
        self.inner = [vocab.get(s) for s in signs]
        self.last = [vocab.get(s + self.suffix) for s in signs]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << _WIDTH | vocab[b], (rank, vocab[a + b]))
        back = {s: b for b, s in enumerate(signs)}
        self.special_bytes = {s.encode(): i for s, i in self.special.items()}
        self.bytes_of: dict[int, bytes] = {}
        self.whole: dict[bytes, int] = {}
        if not self.suffix:
            for s, i in vocab.items():
                self.bytes_of[i] = b = bytes(back[c] for c in s)
                self.whole[b] = i
            self.longest = max(map(len, self.whole))
        self._agree: dict[int, bool] = {}

    def symbols(self, word: bytes) -> list[int]:
        """The first symbols of a pre-token, a byte each; bytes without a symbol are dropped."""
        out = [self.inner[b] for b in word[:-1]]
        if word:
            out.append(self.last[word[-1]] if self.suffix else self.inner[word[-1]])
        return [x for x in out if x is not None]

    def merged(self, ids: list[int]) -> list[int]:
        """Merges of lowest rank first, leftmost on ties: a heap of (rank, place) over a doubly linked list.

        An entry is stale, and skipped, when the pair at its place is no longer the one that it was made for."""
        n = len(ids)
        if n < 2:
            return ids
        merges, ids = self.merges, list(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for k in range(n - 1):
            if found := merges.get(ids[k] << _WIDTH | ids[k + 1]):
                heap.append((found[0], k, found[1]))
        heapq.heapify(heap)
        while heap:
            rank, k, new = heapq.heappop(heap)
            if ids[k] < 0 or (m := after[k]) >= n:
                continue
            found = merges.get(ids[k] << _WIDTH | ids[m])
            if found is None or found[0] != rank:
                continue
            ids[k], ids[m] = new, -1
            after[k] = far = after[m]
            if far < n:
                before[far] = k
                if found := merges.get(new << _WIDTH | ids[far]):
                    heapq.heappush(heap, (found[0], k, found[1]))
            if (p := before[k]) >= 0 and (found := merges.get(ids[p] << _WIDTH | new)):
                heapq.heappush(heap, (found[0], p, found[1]))
        return [x for x in ids if x >= 0]

    def ids(self, word: bytes) -> list[int]:
        if word in self.special_bytes:
            return [self.special_bytes[word]]
        return self.merged(self.symbols(word))

    def agree(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are what their joined bytes encode to."""
        key = left << _WIDTH | right
        found = self._agree.get(key)
        if found is None:
            if len(self._agree) > 2_000_000:
                self._agree.clear()
            found = self._agree[key] = self.merged(self.symbols(self.bytes_of[left] + self.bytes_of[right])) == [left, right]
        return found

    def prefix_tables(self, words: list[bytes]) -> list[list[int]]:
        """For each pre-token, the token count of each of its prefixes (of 0 bytes, 1 byte, ...).

        The last token of a prefix is the one that agrees with the last token of what stands before it, and the
        prefix has one token more than that. Words are taken in sorted order: common beginnings keep their entries."""
        out: list[list[int]] = [[]] * len(words)
        ends, counts, prior = [-1], [0], b""
        for k in sorted(range(len(words)), key=words.__getitem__):
            word = words[k]
            if word in self.special_bytes:
                out[k] = [0] + [1] * len(word)
                continue
            same, most = 0, min(len(word), len(prior))
            while same < most and word[same] == prior[same]:
                same += 1
            del ends[same + 1 :], counts[same + 1 :]
            for i in range(same + 1, len(word) + 1):
                for j in range(max(0, i - self.longest), i):
                    token = self.whole.get(word[j:i])
                    if token is not None and (j == 0 and self.merged(self.symbols(word[j:i])) == [token] or j and self.agree(ends[j], token)):
                        ends.append(token)
                        counts.append(counts[j] + 1)
                        break
                else:
                    raise ValueError("a byte has no symbol")
            prior = word
            out[k] = counts[: len(word) + 1]
        return out

    def decoded(self, ids: list[int]) -> str:
        """Vocabulary strings one after the other: bytes where the file names a byte-level decoder, else the
        strings as they are with a blank between them."""
        names = [self.names[i] for i in ids]
        if not self.has_decoder:
            return " ".join(names)
        back = {s: b for b, s in enumerate(byte_symbols())}
        return b"".join(n.encode() if n in self.special else bytes(back[c] for c in n) for n in names).decode("utf-8", "replace")

    def _normal(self, text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower() if self.lowers else text

    def pretokens(self, texts: pa.Array) -> scan.Tokens:
        """Special strings stand alone and untouched; what lies between is normalised and cut."""
        data, bounds = scan.flat(texts)
        whole = None
        marks = list(self.special_bytes)
        raw = data.tobytes()
        if self.lowers or any(m in raw for m in marks):
            docs, spans, at, starts = [], [], 0, [0]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for piece, special in self._pieces(raw[a:b], marks):
                    made = piece if special or not self.lowers else piece.lower() if piece.isascii() else self._normal(piece.decode("utf-8", "replace")).encode()
                    if special:
                        spans.append((at, at + len(made)))
                    docs.append(made)
                    at += len(made)
                starts.append(at)
            data, bounds = np.frombuffer(b"".join(docs), np.uint8), np.array(starts, np.int64)
            whole = np.array(spans, np.int64).reshape(-1, 2) if spans else None
        return (scan.bare_pretokens if self.suffix else scan.spaced_pretokens)(data, bounds, whole)

    @staticmethod
    def _pieces(text: bytes, marks: list[bytes]):
        at = 0
        while True:
            found = min(((p, m) for m in marks if (p := text.find(m, at)) >= 0), default=None)
            if found is None:
                yield text[at:], False
                return
            yield text[at : found[0]], False
            yield found[1], True
            at = found[0] + len(found[1])


def library_merger(voc: Vocabulary):
    """tiktoken's merging of one pre-token with the same vocabulary; None where ids don't follow the merges."""
    made = [new for _, new in voc.merges.values()]
    if voc.suffix or sys.byteorder != "little" or array("I").itemsize != 4 or any(a >= b for a, b in itertools.pairwise(made)) or max(voc.inner) > min(made):
        return None
    import tiktoken

    core = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=voc.whole, special_tokens={})._core_bpe
    return core.encode_single_piece


class Encoder:
    """Encodes Arrow columns of texts with one vocabulary; what recurs is kept in caches of bounded size."""

    def __init__(self, raw: bytes, library: bool = False):
        """library: merge with the tiktoken library where the file's ids stand in the order of its merges."""
        self.vocabulary = Vocabulary(raw)
        self._piece = library_merger(self.vocabulary) if library else None
        self._blobs, self._counts = scan.Recent(CACHE_WORDS), scan.Recent(CACHE_WORDS)
        self._shown = scan.Recent(CACHE_WORDS)

    def _ids(self, words: list[bytes]) -> list[bytes]:
        if self._piece:
            special = self.vocabulary.special_bytes
            return [array("I", [special[w]] if w in special else self._piece(w)).tobytes() for w in words]
        return [np.array(self.vocabulary.ids(w), "<u4").tobytes() for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin (one more for the end)."""
        tokens = self.vocabulary.pretokens(texts)
        blobs = self._blobs.many(tokens.values.to_pylist(), self._ids)
        data, at = scan.spread(blobs, tokens.codes)
        return np.frombuffer(data, "<u4"), at[tokens.offsets] // 4

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text, by the prefix tables of its pre-tokens."""
        tokens = self.vocabulary.pretokens(texts)
        make = lambda words: [t[-1] for t in self.vocabulary.prefix_tables(words)]
        each = np.array(self._counts.many(tokens.values.to_pylist(), make), np.int64)
        sums = np.concatenate(([0], np.cumsum(each[tokens.codes]))) if len(tokens.codes) else np.zeros(1, np.int64)
        return np.diff(sums[tokens.offsets])

    def prefix_counts(self, text: str) -> np.ndarray:
        """Entry i: tokens of the text's first i bytes as a text of its own; -1 where they end inside a character.

        For vocabularies that keep a blank before a word. Where a prefix ends, its last pre-token can end otherwise than
        in the whole text: white space at the end is one pre-token, a contraction that is cut falls apart, and so does
        a special string."""
        voc, raw = self.vocabulary, text.encode()
        tokens = voc.pretokens(pa.array([text]))
        values = tokens.values.to_pylist()
        tables = voc.prefix_tables(values)
        out, at, cut = [0], 0, []
        for code in tokens.codes.tolist():
            word, table, base = values[code], tables[code], out[-1]
            out += [base + n for n in table[1:]]
            if word in voc.special_bytes:
                cut += range(at + 1, at + len(word))
            elif len(word) == 3 and word[:1] == b"'" and word[1:].isalpha():
                out[at + 2] = base + 2
            at += len(word)
        blank = "".join("s" if k == scan.SPACE else "x" for k in scan.char_classes()[[ord(c) for c in text]].tolist())
        for run in re.finditer("s+", blank):
            a, word = len(text[: run.start()].encode()), text[run.start() : run.end()].encode()
            table = voc.prefix_tables([word])[0]
            out[a + 1 : a + len(table)] = [out[a] + n for n in table[1:]]
        counts = np.array(out, np.int64)
        counts[1:][(np.frombuffer(raw + b" ", np.uint8)[1:] & 0xC0) == 0x80] = -1
        for k in cut:
            if counts[k] >= 0:
                counts[k] = self.count(pa.array([raw[:k].decode()]))[0]
        return counts

    def shown(self, texts: pa.Array) -> tuple[list[int], list[bytes], list[bytes]]:
        """Of each text: token count, decimal ids joined by one blank, and decoded text, in UTF-8."""
        voc, tokens = self.vocabulary, self.vocabulary.pretokens(texts)

        def make(words: list[bytes]) -> list[tuple[int, bytes, bytes]]:
            out = []
            for w in words:
                ids = voc.ids(w)
                names = b"".join(voc.names[i].encode() + b" " for i in ids) if not voc.has_decoder else b"".join(voc.bytes_of.get(i) or voc.names[i].encode() for i in ids)
                out.append((len(ids), "".join(f"{i} " for i in ids).encode(), names))
            return out

        rows = self._shown.many(tokens.values.to_pylist(), make)
        sizes, ids, names = zip(*rows, strict=True) if rows else ((), (), ())
        total = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64)[tokens.codes]))) if rows else np.zeros(1, np.int64)
        id_data, id_at = scan.spread(list(ids), tokens.codes)
        name_data, name_at = scan.spread(list(names), tokens.codes)
        id_at, name_at = id_at[tokens.offsets].tolist(), name_at[tokens.offsets].tolist()
        drop = 0 if voc.has_decoder else 1
        n = np.diff(total[tokens.offsets]).tolist()
        shown_ids = [bytes(id_data[a : max(a, b - 1)]) for a, b in zip(id_at[:-1], id_at[1:], strict=True)]
        texts_out = [bytes(name_data[a : max(a, b - drop)]) for a, b in zip(name_at[:-1], name_at[1:], strict=True)]
        if voc.has_decoder:
            texts_out = [t.decode("utf-8", "replace").encode() for t in texts_out]
        return n, shown_ids, texts_out


@functools.cache
def _encoder(packed: bytes, library: bool) -> Encoder:
    return Encoder(zlib.decompress(packed), library)


class Shared:
    """An encoder for executors: the file's bytes travel in a broadcast, the tables are built once a worker."""

    def __init__(self, spark, path: str, library: bool = False):
        self.library = library
        with open(path, "rb") as f:
            self.packed = spark.sparkContext.broadcast(zlib.compress(f.read(), 1))

    def get(self) -> Encoder:
        return _encoder(self.packed.value, self.library)
