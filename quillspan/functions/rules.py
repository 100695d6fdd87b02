"""Rules on candidates: validation, boundary repair, label filters, weak fragments, qualities. Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import labels as L
from . import text as T

PUNCTUATION = r"^[!-/:-@\[-`{-~]+$"


def _by_label(label: Column, cases: dict[str, Column], other: Column) -> Column:
    out = None
    for name, value in cases.items():
        out = F.when(label == name, value) if out is None else out.when(label == name, value)
    return out.otherwise(other)


def stripped(text: Column) -> Column:
    """What reason() judges: a text without white space at its ends."""
    return F.regexp_replace(text, rf"^{T.SPACE}+|{T.SPACE}+$", "")


def words_of(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit("[A-Za-z]+(?:-[A-Za-z]+)?"), 0)


def boundary_issue(label: Column, text: Column, made: tuple[Column, Column, Column] | None = None) -> Column:
    """Why a text's borders look wrong, null when they don't; the first rule that holds.

    made: T.clean(text), the same in lower case and words_of() that, where they are columns already."""
    plain, low, words = made or (T.clean(text), F.lower(T.clean(text)), words_of(F.lower(T.clean(text))))
    statistical = label == "StatisticalAnalysis"
    method = T.any_cue(low, L.METHOD_CUES)
    return (
        F.when(plain == "", "whitespace_only")
        .when(plain.rlike("^[)\\]}”’\"',;:]"), "starts_with_closing_punctuation")
        .when(low.rlike("^(?:ure|ation|tion|ment|ness|ing|ed|ly)-") & (F.size(F.split(plain, " ")) <= 4), "possible_midword_start")
        .when((F.size(words) > 0) & F.element_at(words, F.greatest(F.size(words), F.lit(1))).isin(L.TRAILING_WORDS), "incomplete_trailing_word")
        .when(statistical & plain.rlike("^[A-Za-z]{2,5}$") & ~low.isin(L.METHOD_CUES), "short_statistical_fragment")
        .when(statistical & (F.size(words) < 3) & ~method, "insufficient_statistical_evidence")
    )


def validation(source: Column, label: Column, text: Column, start: Column, end: Column) -> Column:
    """accepted, or the first reason against a candidate."""
    return reason(label, text, *misplaced(source, text, start, end))


def misplaced(source: Column, text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Whether offsets lie outside the source, and whether another text stands there."""
    return (start < 0) | (end <= start) | (end > F.length(source)), F.substring(source, start + 1, end - start) != text


def reason(label: Column, text: Column, outside: Column, other: Column, plain: Column | None = None, issue: Column | None = None) -> Column:
    """validation() from what misplaced() says: candidates of equal label and text have equal reasons.

    plain, issue: stripped(text) and boundary_issue(), where their parts are columns already and are not to be made anew
    for each rule."""
    plain = stripped(text) if plain is None else plain
    issue = boundary_issue(label, text) if issue is None else issue
    lines = F.transform(F.split(plain, "\n"), lambda x: F.length(F.trim(x)))
    digits = plain.rlike(r"^\p{N}+$")
    return (
        F.when(~label.isin(L.LABELS), "unsupported_label")
        .when(outside, "invalid_offsets")
        .when(other, "text_offset_mismatch")
        .when(plain == "", "whitespace_only")
        .when(plain.rlike(PUNCTUATION), "punctuation_only")
        .when(F.lower(plain).isin(L.STOPWORDS), "isolated_stopword")
        .when((F.length(plain) == 1) & plain.rlike(r"^\p{L}$"), "one_character_alphabetic_fragment")
        .when(plain.rlike("^##") | plain.rlike(r"^[-\x{2010}-\x{2015}]?[A-Za-z]{1,2}[-\x{2010}-\x{2015}]?$") | ((F.length(plain) <= 20) & plain.rlike(r"^[A-Za-z]{2,}[-\x{2010}-\x{2015}]$")), "broken_subword_fragment")
        .when(
            ((F.length(plain) <= 2) & ~digits)
            | ((F.length(plain) <= 50) & plain.rlike(r"[A-Za-z]-\s+[A-Za-z]") & (F.size(F.split(T.clean(plain), " ")) <= 6))
            | ((F.regexp_count(plain, F.lit("\n")) >= 3) & (F.array_max(lines) <= 3)),
            "malformed_pdf_fragment",
        )
        .when((label == "SampleSize") & plain.rlike(r"^\(\s*[Nn]\s*=") & ~plain.endswith(")"), "incomplete_sample_size_parenthesis")
        .otherwise(F.coalesce(issue, F.lit("accepted")))
    )


def severity(reason: Column) -> Column:
    errors = ["unsupported_label", "invalid_offsets", "text_offset_mismatch", "whitespace_only", "punctuation_only", "isolated_stopword", "one_character_alphabetic_fragment"]
    return F.when(reason == "accepted", "info").when(reason.isin(errors), "error").otherwise("warning")


def repaired(label: Column, span: Column) -> Column:
    """A candidate's span with boundaries set by its label: number phrase, comparator, design, method, or no verb before it."""

    def by_label(outer: Column) -> Column:
        def inner(match: Column, trim: bool) -> Column:
            def moved(found: Column) -> Column:
                place = F.struct((outer["start"] + found["start"]).alias("start"), (outer["start"] + found["end"]).alias("end"), found["text"].alias("text"))
                return F.when(found.isNull(), outer).otherwise(T.trim_span(place) if trim else place)

            return T.let(match, moved)

        cases = {"SampleSize": inner(T.longest_match(outer["text"], L.NUMBER_BOUNDARIES), False)}
        cases |= {name: inner(T.longest_match(outer["text"], [p]), True) for name, p in L.CUE_BOUNDARIES.items()}
        return _by_label(label, cases, T.trim_span(T.trimmed(outer, "(?i)" + L.INTRO_VERBS, r"\z")))

    return T.let(T.trim_span(span), by_label)


def length_ok(label: Column, text: Column) -> Column:
    """Whether a generated span has as many words as its label allows."""
    n = T.word_count(text)
    cases = {"SampleSize": n.between(1, 18) & text.rlike(r"\d"), "Outcome": n.between(2, 18), "Intervention": n.between(2, 24), "Participant": n.between(2, 22)}
    return _by_label(label, cases, F.lit(True))


def _comparison(low: Column) -> Column:
    bare = F.regexp_replace(low, r"^[ .,:;()\[\]{}]+|[ .,:;()\[\]{}]+$", "")
    return ~bare.isin(L.WEAK_COMPARISON) & T.any_cue(low, L.FILTER_CUES["ComparisonGroup"])


def _sample_size(plain: Column, low: Column) -> Column:
    shapes = plain.rlike(L.COUNT_SHAPES_CASED[0])
    for p in L.COUNT_SHAPES:
        shapes = shapes | low.rlike(p)
    return plain.rlike(r"\d") & ~low.rlike(L.NUMBER_REJECTS) & ~plain.rlike(r"^\d+(?:\.\d+)?%$") & shapes


def _outcome(low: Column) -> Column:
    rejected = F.lit(False)
    for p in L.OUTCOME_REJECTS:
        rejected = rejected | low.rlike(p)
    return ~rejected & T.any_cue(low, L.FILTER_CUES["Outcome"])


def passes_filter(label: Column, text: Column) -> Column:
    """Whether a text looks like its label."""
    plain = T.clean(text)
    low = F.lower(plain)
    cases = {name: T.any_cue(low, L.FILTER_CUES[name]) for name in ("StatisticalAnalysis", "DesignDescription", "Participant")}
    cases |= {
        "SampleSize": _sample_size(plain, low),
        "Outcome": _outcome(low),
        "ComparisonGroup": _comparison(low),
        "Intervention": ~(_comparison(low) & ~low.rlike(L.INTERVENTION_WORDS)) & T.any_cue(low, L.FILTER_CUES["Intervention"]),
    }
    return (plain != "") & _by_label(label, cases, F.lit(True))


def proposed_by_anchor(experts: Column) -> Column:
    return F.exists(experts, lambda e: F.lower(e) == L.ANCHOR)


def expert_support(experts: Column) -> Column:
    return F.size(F.array_distinct(F.transform(experts, F.lower)))


def weak_fragment(label: Column, text: Column, experts: Column) -> Column:
    """Single words that say too little for their label."""
    n, low = T.word_count(T.clean(text)), T.normalized(text)
    cases = {
        "Outcome": (n <= 1) & low.isin(L.WEAK_OUTCOME),
        "SampleSize": ~text.rlike(r"\d") | ((n == 1) & ~proposed_by_anchor(experts)),
        "ComparisonGroup": (n <= 1) | low.isin(L.WEAK_COMPARISON),
    }
    return _by_label(label, cases, F.lit(False))


def quality(label: Column, text: Column) -> Column:
    """Additive score of a text for the strict labels, 0 for others."""
    low = F.lower(T.clean(text))
    cases = {}
    for name, parts in L.QUALITY.items():
        score = F.lit(0)
        for pattern, points in parts:
            score = score + points * low.rlike(pattern).cast("int")
        if name != "SampleSize":
            score = score + (T.word_count(low) >= 2).cast("int")
        cases[name] = score
    return _by_label(label, cases, F.lit(0))


def rescue(label: Column, text: Column, experts: Column, keeps: Column) -> Column:
    """Whether a strict-label candidate may stay without agreement: one keep vote, or high quality in few words."""
    n, q = T.word_count(text), quality(label, text)
    good = _by_label(label, {"SampleSize": q >= 2, "ComparisonGroup": (q >= 2) & (n <= 8), "Outcome": (q >= 2) & (n <= 10)}, F.lit(False))
    return label.isin(L.STRICT_LABELS) & ~weak_fragment(label, text, experts) & ((keeps >= 1) | good)


def boundary_score(label: Column, text: Column, start: Column, experts: Column) -> Column:
    """Struct that orders candidates by how well their borders fit: score, distance to the usual length, length, start."""
    plain = T.clean(text)
    n = T.word_count(plain)
    strict = label.isin(L.STRICT_LABELS)
    usual = _by_label(label, {k: F.lit(v) for k, v in L.PREFERRED_WORDS.items()}, F.lit(L.OTHER_PREFERRED_WORDS))
    whole = (plain != "") & ~plain.rlike(r"^[,;:.)\]}]") & ~plain.rlike(r"[,;:(\[{]$")
    score = (
        10 * passes_filter(label, text).cast("int")
        + 2 * whole.cast("int")
        - 8 * weak_fragment(label, text, experts).cast("int")
        + quality(label, text)
        - F.when(strict & (n > 14), n - 14).otherwise(0)
        + F.when(strict & n.between(2, 8), 2).otherwise(0)
    )
    return F.struct(score.alias("score"), (-F.abs(n - usual)).alias("fit"), (-F.length(plain)).alias("size"), (-start).alias("place"))


def quoted(words: list[str]) -> str:
    """Words as an SQL list."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def cue_pattern(cues: list[str]) -> str:
    return "|".join(re.escape(c) for c in cues)
