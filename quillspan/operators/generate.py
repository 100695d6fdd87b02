"""Generators of spans: sentence units, tokens, clauses, pattern matches, cue clauses. One row a span.

All offsets are computed inside a row, so that nothing is shuffled before spans are needed as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import intervals as I
from ..functions import labels as L
from ..functions import rules as R
from ..functions import text as T


def _rows(docs: DataFrame, spans: Column, key: str, extra: list[Column] | None = None) -> DataFrame:
    made = docs.select(F.col(key), *(extra or []), F.posexplode(spans).alias("ord", "s"))
    return made.select(key, *(c for c in made.columns if c not in (key, "ord", "s")), "ord", "s.*")


def units(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ord, sentence_id, start, end, text of every sentence unit."""
    return _rows(docs, T.source_units(F.col(text)), key)


def tokens(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ord, start, end, text of every token."""
    return _rows(docs, T.tokens(F.col(text)), key)


def token_arrays(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, tokens: each text's tokens as one array of start and end."""
    return docs.select(key, F.transform(T.tokens(F.col(text)), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("tokens"))


def clauses(units_of: DataFrame, key: str = "doc_id") -> DataFrame:
    """Clauses of units, numbered inside each unit."""
    span = F.struct(F.col("start"), F.col("end"), F.col("text"))
    return _rows(units_of, T.clauses(span), key, [F.col("sentence_id")])


def _found(text: Column, label: str, name: str, pattern: str) -> Column:
    """array<struct<label, start, end, text, method>> of a pattern's trimmed matches."""
    spans = F.filter(F.transform(T.matches(text, pattern), T.trim_span), lambda s: s["end"] > s["start"])
    return F.transform(spans, lambda s: F.struct(F.lit(label).alias("label"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.lit(name).alias("method")))


_FOUND = "label string, start int, end int, text string, method string"
_Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]  # of each span: row, pattern, start, end, text


def _searched(docs: DataFrame, wanted: list[tuple[str, str, str]], text: str, key: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], Iterator[_Found]]]:
    """Rows of texts to be searched, `_which` saying by which pattern (-1: all), and what finds spans in a batch of them.

    Texts of plain ASCII are searched in Arrow batches by an engine that takes time in proportion to the text, whatever the
    pattern (RE2); there it finds what Java finds. Any other text, where the two differ on letters and white space, becomes
    one row for each pattern, so that Java runs each pattern over it once. Offsets and trimmed ends come from the marked
    texts by Arrow batches. Nothing is shuffled."""
    held = F.contains(F.col(text), F.lit(T.MARK))
    bare = F.when(held, F.translate(F.col(text), T.MARK, "\ufffd")).otherwise(F.col(text)).alias("_text")
    which = F.when(F.col(text).rlike(T.NOT_PLAIN), F.array(*(F.lit(k) for k in range(len(wanted))))).otherwise(F.array(F.lit(-1)))
    rows = docs.select(F.col(key), bare, F.when(held, F.col(text)).alias("_own"), F.explode(which).alias("_which"))
    marks = F.when(F.col("_which") == -1, F.col("_text"))
    for k, (_, _, p) in enumerate(wanted):
        marks = marks.when(F.col("_which") == k, F.regexp_replace("_text", "(?is)" + L.possessive(p), f"{T.MARK}$0{T.MARK}"))

    def spans(rows: np.ndarray, which: np.ndarray, marked: pa.Array, own: pa.Array) -> _Found:
        row, start, found = T.marked_spans(marked, own)
        left = T.without_space(found)
        kept = T.without_signs(left[1])
        start, size = start + left[0] + kept[0], pc.utf8_length(kept[1]).to_numpy(zero_copy_only=False)
        some = np.flatnonzero(size > 0)
        return rows[row[some]], which[row[some]], start[some], (start + size)[some], kept[1].take(pa.array(some))

    def found(part: pa.RecordBatch) -> Iterator[_Found]:
        which = part["_which"].to_numpy()
        rest, plain = np.flatnonzero(which != -1), np.flatnonzero(which == -1)
        if len(rest):
            yield spans(rest, which[rest], part["_marked"].take(pa.array(rest)), part["_own"].take(pa.array(rest)))
        marked, own = part["_marked"].take(pa.array(plain)), part["_own"].take(pa.array(plain))
        for k, (_, _, p) in enumerate(wanted if len(plain) else []):
            cut = pc.replace_substring_regex(marked, "(?is)" + p, f"{T.MARK}\\0{T.MARK}")
            hit = pc.greater(pc.binary_length(cut), pc.binary_length(marked)).fill_null(False)
            some = plain[hit.to_numpy(zero_copy_only=False)]
            yield spans(some, np.full(len(some), k), cut.filter(hit), own.filter(hit))

    return rows.select(key, "_which", marks.alias("_marked"), "_own"), found


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return I.sliced(batches, lambda b: pc.binary_length(b["_marked"]).fill_null(0).to_numpy(zero_copy_only=False), 4_000_000)


def _wanted(labels: list[str] | None, strict_units: bool) -> list[tuple[str, str, str]]:
    return [(x, n, p) for x, found in L.patterns(strict_units).items() if labels is None or x in labels for n, p in found]


def pattern_spans(docs: DataFrame, labels: list[str] | None = None, strict_units: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, label, start, end, text, method: trimmed matches of the generating patterns, one row for each match."""
    wanted = _wanted(labels, strict_units)
    rows, found = _searched(docs, wanted, text, key)
    names, methods = pa.array([x for x, _, _ in wanted], pa.string()), pa.array([n for _, n, _ in wanted], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            for row, which, start, end, texts in found(part):
                of = pa.array(which)
                columns = [part[key].take(pa.array(row)), names.take(of), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), texts, methods.take(of)]
                yield pa.RecordBatch.from_arrays(columns, [key, "label", "start", "end", "text", "method"])

    return rows.mapInArrow(run, StructType([docs.schema[key], *StructType.fromDDL(_FOUND).fields]))


def numbered_spans(docs: DataFrame, labels: list[str] | None = None, strict_units: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """deduplicated(pattern_spans(docs)) with `number`, 1 and more by start and end inside a document's label.

    docs hold each key once, so that all spans of a key come from one text: they are sorted where they are found, and
    nothing is shuffled. Rows come by document, label and number."""
    wanted = _wanted(labels, strict_units)
    rows, found = _searched(docs, wanted, text, key)
    names, methods = pa.array([x for x, _, _ in wanted], pa.string()), pa.array([n for _, n, _ in wanted], pa.string())
    label_of, rank_of = (np.unique([w[k] for w in wanted], return_inverse=True)[1] for k in (0, 1))

    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text's rows, one for each pattern, stand one after the other; they are kept together."""
        kept: list[pa.RecordBatch] = []
        for part in parts:
            last = np.flatnonzero(np.isin(part["_which"].to_numpy(), (-1, len(wanted) - 1)))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from pa.Table.from_batches([*kept, part.slice(0, cut)]).combine_chunks().to_batches()
                kept = []
            if cut < part.num_rows:
                kept.append(part.slice(cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole(_parts(batches)):
            each = list(found(part))
            row, which, start, end = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in each)]) for k in range(4))
            if not len(row):
                continue
            document, label = np.cumsum(part["_which"].to_numpy() <= 0)[row], label_of[which]
            order = np.lexsort((rank_of[which], end, start, label, document))
            group = np.stack([document, label])[:, order]
            new = np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(axis=0)])
            place = np.stack([start, end])[:, order]
            once = new | np.concatenate([[True], (place[:, 1:] != place[:, :-1]).any(axis=0)])
            taken, first = order[once], np.flatnonzero(new[once])
            number = np.arange(1, len(taken) + 1) - np.repeat(first, np.diff(np.append(first, len(taken))))
            of, texts = pa.array(which[taken]), pa.concat_arrays([f[4] for f in each]).take(pa.array(taken))
            numbers = [pa.array(x.astype(np.int32)) for x in (start[taken], end[taken], number)]
            columns = [part[key].take(pa.array(row[taken])), names.take(of), *numbers[:2], texts, methods.take(of), numbers[2]]
            yield pa.RecordBatch.from_arrays(columns, [key, "label", "start", "end", "text", "method", "number"])

    return rows.mapInArrow(run, StructType([docs.schema[key], *StructType.fromDDL(_FOUND + ", number int").fields]))


def _different(data: np.ndarray, at: np.ndarray, to: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Whether a text is another one than the bytes of data from `at` to `to`."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    other = to - at != size
    ends = np.cumsum(np.where(other, 0, size))
    same = texts.filter(pa.array(~other))
    if len(same):
        begin, until = np.frombuffer(same.buffers()[1], np.int32)[[same.offset, same.offset + len(same)]]
        own = np.frombuffer(same.buffers()[2] or b"", np.uint8)[begin:until]
        there = data[np.arange(len(own)) + np.repeat(at[~other] - (ends - size)[~other], size[~other])]
        wrong = np.concatenate([[0], np.cumsum(own != there)])
        other[~other] = (wrong[ends] - wrong[ends - np.where(other, 0, size)])[~other] > 0
    return other


def judged_pieces(texts: pa.Array, edges: np.ndarray) -> Iterator[tuple[str, np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """T.clauses() and T.tokens() of whole texts as pieces: kind, and of each piece its row, its text and what R.misplaced()
    says of the offsets that it has in its row's text. edges: T.word_edges()."""
    points, ends, start, end = T.token_places(texts, edges)
    before, size = np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
    byte_at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))])
    joined = "".join(t or "" for t in texts.to_pylist()).encode()
    data = np.frombuffer(joined, np.uint8)

    def cut(start: np.ndarray, end: np.ndarray) -> pa.Array:
        """Stretches in their order: they and the gaps between them tile the bytes."""
        offsets = byte_at[np.stack([start, end], axis=1).ravel()].astype(np.int32)
        every = pa.StringArray.from_buffers(max(0, len(offsets) - 1), pa.py_buffer(offsets), pa.py_buffer(joined))
        return every.take(pa.array(np.arange(0, len(every), 2)))

    def judged(row: np.ndarray, start: np.ndarray, end: np.ndarray, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        outside = (start < 0) | (end <= start) | (end > size[row])
        low, high = (byte_at[before[row] + np.clip(x, 0, size[row])] for x in (start, end))
        return outside, _different(data, low, high, found)

    inner = ~np.isin(points, [ord(c) for c in ".;:"])
    text_first = np.zeros(len(points) + 1, bool)
    text_first[np.concatenate([[0], ends])] = True
    c_start = np.flatnonzero(inner & (text_first[:-1] | ~np.concatenate([[False], inner[:-1]])))
    c_end = np.flatnonzero(inner & (text_first[1:] | ~np.concatenate([inner[1:], [False]]))) + 1
    whole = cut(c_start, c_end)
    space = T.without_space(whole)
    signs = T.without_signs(space[1])
    long, cut_to = (pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (whole, signs[1]))
    # White space before a line's end alone counts as blank; these ends are no white space to trim.
    blank = pc.is_in(space[1], pa.array(["\u0085", "\u2028", "\u2029"])).to_numpy(zero_copy_only=False) & (space[0] > 0) & (space[0] + 1 == long)
    kept = np.flatnonzero((cut_to > 0) & ~blank)
    row = np.searchsorted(ends, c_start[kept], "right")
    begin, found = (c_start + space[0] + signs[0])[kept] - before[row], signs[1].take(pa.array(kept))
    yield "clause", row, found, *judged(row, begin, begin + cut_to[kept], found)
    row, found = np.searchsorted(ends, start, "right"), cut(start, end)
    yield "token", row, found, *judged(row, start - before[row], end - before[row], found)


def piece_counts(docs: DataFrame, labels: dict[str, str], by: str, text: str = "text") -> DataFrame:
    """by, label, text, outside, other, n: how often a piece of a text (labels: of its kind) stands in the texts of each value
    of a column, and what judged_pieces() says of its offsets. A piece stands once for some megabytes of texts, so that
    it comes in several rows; nothing is shuffled."""
    edges = T.word_edges(docs.sparkSession)
    keys = [by, "label", "text", "outside", "other"]

    def summed(held: list[pa.Table]) -> pa.Table:
        made = pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([("n", "sum")])
        return made.rename_columns([{"n_sum": "n"}.get(c, c) for c in made.column_names]).select([*keys, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for part in I.sliced(batches, lambda b: pc.binary_length(b[text]).fill_null(0).to_numpy(zero_copy_only=False), 2_000_000):
            for kind, row, found, outside, other in judged_pieces(part[text], edges):
                ones = pa.array(np.ones(len(row), np.int64))
                columns = [part[by].take(pa.array(row)), pa.array([labels[kind]]).take(pa.array(np.zeros(len(row), np.int64))), found, pa.array(outside), pa.array(other), ones]
                held.append(summed([pa.table(columns, [*keys, "n"])]))
            if sum(t.nbytes for t in held) >= 16_000_000:
                yield from summed(held).to_batches()
                held = []
        if held:
            yield from summed(held).to_batches()

    rows = docs.select(F.col(by), F.col(text))
    return rows.mapInArrow(run, StructType([docs.schema[by], *StructType.fromDDL("label string, text string, outside boolean, other boolean, n long").fields]))


def cue_clauses(docs: DataFrame, labels: list[str] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Clauses of cue-bearing units that hold a cue themselves and have a fitting length."""
    parts = clauses(units(docs, text, key), key)
    held = F.explode(F.array_compact(F.array(*(F.when(F.col("text").rlike("(?is)" + T.cue_regex(L.CUES[name])), F.lit(name)) for name in (labels or L.LABELS))))).alias("label")
    rows = parts.select(key, held, "start", "end", "text", F.lit("cue_clause_boundary").alias("method"))
    return rows.filter(R.length_ok(F.col("label"), F.col("text")))


def inner_spans(candidates: DataFrame, least: int = 45, strict_units: bool = False, key: str = "doc_id") -> DataFrame:
    """Pattern matches and cue clauses inside long candidates, other than the candidates themselves."""
    long = candidates.filter(F.length("text") >= least).select(key, "label", F.col("start").alias("s0"), F.col("end").alias("e0"), "text")
    whole = F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("text"))

    def inside(name: str) -> Column:
        cue = "(?is)" + T.cue_regex(L.CUES[name])
        parts = F.filter(T.clauses(whole), lambda c: c["text"].rlike(cue) & R.length_ok(F.lit(name), c["text"]))
        method = F.lit("candidate_clause_boundary_alternative")
        cut = F.transform(parts, lambda c: F.struct(F.lit(name).alias("label"), c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text"), method.alias("method")))
        return F.concat(*(_found(F.col("text"), name, "candidate_internal_boundary_alternative", p) for _, p in L.patterns(strict_units).get(name, [])), cut)

    rows = None
    for name in L.CUES:
        rows = F.when(F.col("label") == name, inside(name)) if rows is None else rows.when(F.col("label") == name, inside(name))
    rows = long.select(key, "label", "s0", "e0", F.explode(rows).alias("s")).withColumn("method", F.col("s.method"))
    moved = rows.select(key, "label", (F.col("s0") + F.col("s.start")).alias("start"), (F.col("s0") + F.col("s.end")).alias("end"), F.col("s.text").alias("text"), "method", "s0", "e0")
    return moved.filter("NOT (start = s0 AND end = e0)").drop("s0", "e0")


def deduplicated(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each label and span, with the smallest method name."""
    return spans.groupBy(key, "label", "start", "end").agg(F.min("text").alias("text"), F.min("method").alias("method"))


def deterministic_spans(docs: DataFrame, registry: DataFrame, labels: list[str] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, label, start, end, text, method: pattern matches, cue clauses and inner alternatives of the core labels."""
    wanted = labels or L.PRE_EXPANSION_LABELS
    inner = inner_spans(registry.filter(F.col("label").isin(wanted)), key=key)
    return deduplicated(pattern_spans(docs, wanted, text=text, key=key).unionByName(cue_clauses(docs, wanted, text, key)).unionByName(inner), key)


def heading_sections(paragraphs: DataFrame, key: str = "file", order: str = "ord", text: str = "text") -> DataFrame:
    """Paragraphs with the last heading before them (a short line that ends in a colon or is all capitals)."""
    from pyspark.sql import Window

    line = F.trim(F.col(text))
    heading = F.when((F.length(line) <= 80) & (line.rlike(r"^[A-Z][A-Za-z /-]*:$") | line.rlike(r"^[A-Z][A-Z /-]+$")), F.rtrim(F.translate(line, ":", "")))
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return paragraphs.withColumn("heading", F.last(heading, ignorenulls=True).over(upto))
