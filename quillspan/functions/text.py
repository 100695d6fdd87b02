"""Text columns with exact code-point offsets: covers, sentence units, tokens, clauses, pattern matches, boundaries.

A cover is an array of pieces that tile a text; offsets are prefix sums of their lengths, taken in blocks, so that a
text with n pieces costs about n operations a block and no shuffle. All functions are column expressions and stay in
the JVM.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_BLOCK = 32
MARK = "\ufdd0"
SPACE = r"[\s  -   　]"
NOT_PLAIN = r"[^\x00-\x0A\x0C-\x7F]"  # vertical tabs are white space to Java and not to RE2
OPENING_LEFT = "^[,;:)\\]}”’\"']+"
CLOSING_RIGHT = "[,;:(\\[{“‘\"']+$"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once; without it, lambdas would compute it again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0), lambda a, x: a + F.length(x))


def _starts(pieces: Column) -> Column:
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _BLOCK).cast("int")), lambda b: F.slice(pieces, b * _BLOCK + 1, F.lit(_BLOCK)))

    def placed(blocks: Column) -> Column:
        def with_sums(sums: Column) -> Column:
            bases = F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), lambda a, x: a + x))
            return F.flatten(F.zip_with(blocks, bases, lambda block, base: F.transform(block, lambda _, k: base + _total(F.slice(block, F.lit(1), k)))))

        return let(F.transform(blocks, _total), with_sums)

    return F.when(F.size(pieces) <= 0, F.array().cast("array<int>")).otherwise(let(blocks, placed))


def starts(pieces: Column) -> Column:
    """Offset of each piece of a cover."""
    return let(pieces, _starts)


def spans_of(pieces: Column) -> Column:
    """array<struct<start, end, text>> of a cover."""
    return let(pieces, lambda p: F.zip_with(_starts(p), p, lambda s, t: F.struct(s.alias("start"), (s + F.length(t)).alias("end"), t.alias("text"))))


def cover(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


# Possessive: the parts share no character, so that nothing is tried again; Java would keep a frame for each repetition.
WORD = r"[\p{L}\p{N}_]++(?:[-\x{2019}'][\p{L}\p{N}_]++)*+"
_NOT_SPACE = "[^" + SPACE[1:]


def tokens(text: Column) -> Column:
    """Words joined by hyphen or apostrophe, and single signs, with offsets."""
    pieces = cover(text, rf"(?s){WORD}|{SPACE}+|.")
    return F.filter(spans_of(pieces), lambda t: F.left(t["text"], F.lit(1)).rlike(_NOT_SPACE))


_edges: dict[str, np.ndarray] = {}


def word_edges(spark: SparkSession) -> np.ndarray:
    """The code points at which runs of letters, digits and _ begin and end, by the engine that runs tokens(); they are asked
    for once an application."""
    app = spark.sparkContext.applicationId
    if app not in _edges:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        same = spark.createDataFrame([(every,)], "t string").select(F.regexp_replace("t", r"[\p{L}\p{N}_]", "_")).head()[0]
        word = np.zeros(0x110001, bool)
        for low, high, at in ((0, 0xD800, 0), (0xE000, 0x110000, 0xD800)):
            word[low:high] = [c == "_" for c in same[at : at + high - low]]
        _edges[app] = np.flatnonzero(np.diff(word, prepend=False))
    return _edges[app]


def token_places(texts: pa.Array, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """tokens() for Arrow batches: the code points of all texts one behind the other, the end of each text among them, and
    start and end of every token there. edges: word_edges(). Null texts have no tokens."""
    points = np.frombuffer("".join(t or "" for t in texts.to_pylist()).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    n = len(points)
    kinds = np.zeros(0x110000, np.uint8)  # 0 a sign, 1 of a word, 2 white space, 3 what joins words
    for low, high in edges.reshape(-1, 2):
        kinds[low:high] = 1
    kinds[[ord(c) for c in _SPACES]] = 2
    kinds[[ord(c) for c in "-\u2019'"]] = 3
    kind, first = kinds[points], np.zeros(n + 1, bool)
    first[np.concatenate([[0], ends])] = True
    word = kind == 1
    inner = np.flatnonzero(kind == 3)
    inner = inner[(inner > 0) & (inner < n - 1)]
    word[inner[word[inner - 1] & word[inner + 1] & ~first[inner] & ~first[inner + 1]]] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:n]
    stops = word.copy()
    stops[:-1] &= ~word[1:] | first[1:n]
    sign = ~word & (kind != 2)
    return points, ends, np.flatnonzero(begins | sign), np.flatnonzero(stops | sign) + 1


def token_count(text: Column) -> Column:
    """How many tokens a text has, without their offsets."""
    return F.regexp_count(text, F.lit(rf"{WORD}|{_NOT_SPACE}"))


def trimmed(span: Column, left: str, right: str) -> Column:
    """A span without what `left` and `right` match at its ends."""

    def cut(s: Column) -> Column:
        head = F.length(F.regexp_extract(s["text"], left, 0))

        def tail_of(rest: Column) -> Column:
            return let(F.left(rest, F.length(rest) - F.length(F.regexp_extract(rest, right, 0))), lambda kept: _span(s["start"] + F.length(s["text"]) - F.length(rest), kept))

        return let(F.substring(s["text"], head + 1, F.length(s["text"])), tail_of)

    return let(span, cut)


def _span(start: Column, text: Column) -> Column:
    return F.struct(start.alias("start"), (start + F.length(text)).alias("end"), text.alias("text"))


def trim_space(span: Column) -> Column:
    return trimmed(span, rf"^{SPACE}+", rf"(?d){SPACE}+\z")


def trim_span(span: Column) -> Column:
    """White space off both ends, then closing signs off the left and opening ones off the right."""
    return trimmed(trim_space(span), OPENING_LEFT, CLOSING_RIGHT.replace("$", r"\z"))


def source_units(text: Column) -> Column:
    """Sentences with offsets and identifiers S0001, ...: they end at .!? before white space, at blank lines, at the end."""
    pieces = cover(text, rf"(?ds).+?(?:[.!?](?={SPACE}+|$)|\n{{2,}}|$)")
    found = F.filter(F.transform(spans_of(pieces), trim_space), lambda u: u["end"] > u["start"])
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("text")))
    units = let(found, lambda kept: F.when((F.size(kept) == 0) & (F.length(text) > 0), whole).otherwise(kept))
    return F.transform(units, lambda u, k: F.struct(F.format_string("S%04d", k + 1).alias("sentence_id"), u["start"].alias("start"), u["end"].alias("end"), u["text"].alias("text")))


def clauses(span: Column, signs: str = ".;:", trim: bool = True) -> Column:
    """Clauses of a span between signs, with offsets in the same text."""
    pieces = cover(span["text"], rf"(?s)[^{signs}]+|[{signs}]")
    parts = F.filter(spans_of(pieces), lambda c: ~c["text"].rlike(rf"^([{signs}]|{SPACE}+)$"))
    moved = F.transform(parts, lambda c: _span(c["start"] + span["start"], c["text"]))
    return F.filter(F.transform(moved, trim_span), lambda c: c["end"] > c["start"]) if trim else moved


def marked(text: Column, pattern: str, flags: str = "(?is)") -> Column:
    """Gaps and matches of a text by turns, from one pass of the pattern: matches stand between two marks.

    The mark is no character of any text; where a text holds it all the same, it counts as another sign."""
    return F.split(F.regexp_replace(F.translate(text, MARK, "\ufffd"), flags + pattern, f"{MARK}$0{MARK}"), MARK, -1)


def matches(text: Column, pattern: str, flags: str = "(?is)") -> Column:
    """All non-overlapping matches with offsets: gaps and matches alternate, so their lengths give the places."""

    def placed(pieces: Column) -> Column:
        none = F.array().cast("array<struct<start:int,end:int,text:string>>")
        found = F.filter(spans_of(pieces), lambda _, k: k % 2 == 1)
        return F.when(F.size(pieces) > 1, F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.substring(text, m["start"] + 1, m["end"] - m["start"]).alias("text")))).otherwise(none)

    return let(marked(text, pattern, flags), placed)


_SPACES = "".join(c for c in map(chr, range(0x3001)) if re.fullmatch(SPACE, c, re.ASCII))
_LEFT, _RIGHT = ",;:)]}\u201d\u2019\"'", ",;:([{\u201c\u2018\"'"  # those of OPENING_LEFT and CLOSING_RIGHT


def marked_spans(marked: pa.Array, own: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For Arrow batches of texts whose matches stand between two marks: row, start and text of each match.

    own: the texts as they were where they hold the mark themselves, else null."""
    lists = pc.split_pattern(marked, MARK)
    many = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    size = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first, row = np.concatenate([[0], np.cumsum(size)]), np.cumsum(many) - many, np.repeat(np.arange(len(many)), many)
    odd = np.flatnonzero((np.arange(len(row)) - first[row]) % 2 == 1)
    start, found = ends[odd] - ends[first[row[odd]]], flat.take(pa.array(odd))
    if own.null_count < len(own):
        texts = own.to_pylist()
        there = [t if texts[r] is None else texts[r][s : s + n] for t, r, s, n in zip(found.to_pylist(), row[odd].tolist(), start.tolist(), size[odd].tolist(), strict=True)]
        found = pa.array(there, pa.string())
    return row[odd], start, found


def _without(texts: pa.Array, left: str, right: str) -> tuple[np.ndarray, pa.Array]:
    cut = pc.utf8_ltrim(texts, left)
    return pc.subtract(pc.utf8_length(texts), pc.utf8_length(cut)).to_numpy(zero_copy_only=False), pc.utf8_rtrim(cut, right)


def without_space(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """trim_space() for Arrow batches: how much goes at the left, and what is left."""
    return _without(texts, _SPACES, _SPACES)


def without_signs(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """What trim_span() does after trim_space(), for Arrow batches."""
    return _without(texts, _LEFT, _RIGHT)


def longest_match(text: Column, patterns: list[str], flags: str = "(?is)") -> Column:
    """The longest match of any pattern, the earliest of equals; null where there is none."""
    every = F.concat(*(matches(text, p, flags) for p in patterns))
    ranked = F.transform(every, lambda m: F.struct((m["end"] - m["start"]).alias("size"), (-m["start"]).alias("back"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text")))
    return let(F.array_max(ranked), lambda best: F.when(best.isNotNull(), F.struct(best["start"].alias("start"), best["end"].alias("end"), best["text"].alias("text"))))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?"))


def clean(text: Column) -> Column:
    """White space collapsed."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def normalized(text: Column) -> Column:
    """Clean, lower-case, without signs at the ends."""
    return F.regexp_replace(F.lower(clean(text)), r"^[ .,:;()\[\]{}]+|[ .,:;()\[\]{}]+$", "")


def annotated(text: Column) -> Column:
    """An annotation's text with escaped newlines as newlines."""
    return F.replace(text, F.lit("\\n"), F.lit("\n"))


def comparable(text: Column) -> Column:
    """For comparing annotations: no-break space, blanks and newlines squeezed, outer signs off."""
    text = F.regexp_replace(F.translate(text, "\u00a0", " "), r"[ \t\r\f\x0B]+", " ")
    return F.regexp_replace(F.regexp_replace(text, rf"{SPACE}*\n{SPACE}*", "\n"), r"^[ \n\t.;]+|[ \n\t.;]+$", "")


def boundary_normalized(text: Column) -> Column:
    """Lower-case, collapsed, without outer signs and heading prefixes."""
    out = F.regexp_replace(F.lower(clean(text)), r"^[ .,:;-]+|[ .,:;-]+$", "")
    for head in ("study design", "design", "statistical analysis", "analysis"):
        out = F.regexp_replace(out, f"^{head}[ :.-]+", "")
    return out


def safe_name(name: Column) -> Column:
    """Letters, digits and -._ stay, others become _; at most 180 characters; empty becomes record."""
    cut = F.left(F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_"), F.lit(180))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("record"))


def section_of(text: Column, start: Column) -> Column:
    """results, methods or unknown, by the first marker of each section."""
    methods, results = (F.locate(f"=== {name} ===", text) - 1 for name in ("METHODS", "RESULTS"))
    return F.when((results >= 0) & (start >= results), "results").when((methods >= 0) & (start >= methods), "methods").otherwise("unknown")


def excerpt(text: Column, most: int, marker: str = " [...] ") -> Column:
    """Head and tail around a marker when a text is too long."""
    half = (most - len(marker)) // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit(marker), F.right(text, F.lit(half))))


def context(text: Column, start: Column, end: Column, width: int = 180) -> Column:
    """A span in its surroundings, marked."""
    left = F.greatest(start - width, F.lit(0))
    return F.concat(F.substring(text, left + 1, start - left), F.lit("<<"), F.substring(text, start + 1, end - start), F.lit(">>"), F.substring(text, end + 1, F.lit(width)))


def flexible_pattern(text: Column) -> Column:
    """A regular expression (as a column) for a literal text in which white space may differ."""
    quoted = F.regexp_replace(text, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    return F.regexp_replace(F.trim(quoted), r"\s+", r"\\s+")


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where den is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def f_scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1, each 0 where it has no denominator."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)).alias("f1")]


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap by hull."""
    hull = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return ratio(overlap(a_start, a_end, b_start, b_end), hull)


def any_cue(text: Column, cues: list[str]) -> Column:
    """Whether a lower-cased text holds any cue."""
    return F.lower(text).rlike("|".join(re.escape(c.lower()) for c in cues))


def cue_regex(cues: list[str]) -> str:
    return r"\b(?:" + "|".join(re.escape(c) for c in cues) + r")\b"


def offset_distance(a: Column, b: Column) -> Column:
    """Absolute difference, 0 where one is missing."""
    return F.coalesce(F.abs(a - b), F.lit(0))


def rough_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")
