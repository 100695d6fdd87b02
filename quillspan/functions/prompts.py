"""Texts that reviewers are shown, and how much of them fits: excerpts, candidate lines, token budgets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Characters and sentences by context window (up to 8192, up to 16384, larger).
WINDOWS = (8192, 16384)
DOCTOR_UNITS, DOCTOR_UNIT_CHARS = (3, 4, 6), (220, 280, 420)
META_UNITS, META_UNIT_CHARS, META_CHARS = (6, 8, 12), (300, 360, 700), (8000, 12000, 28000)
CONTEXT_LIMITS = r"(?is)maximum context length is\s+(\d+)\s+tokens.*?request has\s+(\d+)\s+input tokens"
SNIPPET_CHARS, CUT_MARK = 1400, " ...[truncated]"


def by_window(sizes: tuple[int, int, int], window: int) -> int:
    return sizes[sum(window > w for w in WINDOWS)]


def doctor_role(expert: Column, label: Column) -> Column:
    return F.concat(expert, F.lit("_"), label, F.lit("_DoctorAgent"))


def meta_role(label: Column) -> Column:
    return F.concat(label, F.lit("_MetaAgent"))


def candidate_line(c: Column, source: Column) -> Column:
    """Identifier, label, offsets, experts with confidences, text and context of a candidate struct."""
    pairs = F.concat_ws(", ", F.transform(F.map_entries(c["confidence_by_expert"]), lambda e: F.format_string("%s: %s", e["key"], e["value"].cast("string"))))
    head = F.format_string("%s [%s] offsets=%d:%d experts=%s confidence={%s}", c["candidate_id"], c["label"], c["start"], c["end"], F.concat_ws(",", c["proposed_by_experts"]), pairs)
    return F.concat_ws("\n", head, F.concat(F.lit("text_excerpt="), T.excerpt(c["text"], 900)), F.concat(F.lit("boundary_context="), T.context(source, c["start"], c["end"])))


def unit_lines(units: Column, most: int) -> Column:
    """One line a sentence: identifier, offsets, bounded text."""
    lines = F.transform(units, lambda u: F.concat(F.format_string("%s %d:%d ", u["sentence_id"], u["start"], u["end"]), T.excerpt(u["text"], most)))
    return F.when(F.size(units) == 0, "(no compact source units available)").otherwise(F.concat_ws("\n", lines))


def candidate_budgets(n: Column, total: int) -> tuple[Column, Column]:
    """Characters for the text and for the context of each of n candidates."""
    each = F.greatest(F.lit(120), F.least(F.lit(1100), F.floor(F.lit(total) / F.greatest(n, F.lit(1)))))
    text = F.greatest(F.lit(70), F.floor(each * 0.58))
    return text.cast("int"), F.greatest(F.lit(50), each - text).cast("int")


def completion_budget(system: Column, user: Column, most: int, window: int, reserve: int, least: int) -> Column:
    """Tokens left for an answer, between least and most; an error where the prompt leaves less than least."""
    prompt = T.rough_tokens(system) + T.rough_tokens(user) + 32
    left = F.lit(window) - prompt - F.lit(reserve)
    short = F.raise_error(F.format_string("a prompt of about %d tokens leaves %d of %d for the answer", prompt, left, F.lit(window))).cast("int")
    return F.when(left < least, short).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), left)))


def context_limits(message: Column) -> Column:
    """Struct of the context's and the prompt's tokens that an error message tells, null where it tells none."""
    window, used = (F.regexp_extract(message, CONTEXT_LIMITS, k) for k in (1, 2))
    return F.when(window != "", F.struct(window.cast("int").alias("window"), used.cast("int").alias("prompt")))


def limits_of(message: str) -> tuple[int, int] | None:
    """context_limits() of one message in Python."""
    found = re.search(CONTEXT_LIMITS, message)
    return (int(found[1]), int(found[2])) if found else None


def snippet(text: Column, most: int = SNIPPET_CHARS) -> Column:
    """A text, or its head with a mark where it is too long."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(most - 18))), F.lit(CUT_MARK)))


def local_snippet(name: Column, text: Column) -> Column:
    return F.concat(F.lit("[local guideline: "), name, F.lit("] "), snippet(text))


def batch_of(place: Column, size: int) -> Column:
    """Number of the fixed-size batch that a place (from 0) falls into."""
    return F.floor(place / max(1, size)).cast("int")


def review_prompt(role: Column, label: Column, guidelines: Column, candidates: Column, units: Column) -> tuple[Column, Column]:
    """System and user text by which a reviewer decides on each candidate of a label. All arguments are texts."""
    system = F.concat(F.lit("You are "), role, F.lit(". Decide keep or reject for every listed candidate of the label. Use only listed ids. You may propose exact quotes of the shown sentences."))
    user = F.concat_ws("\n\n", F.concat(F.lit("LABEL: "), label), F.concat(F.lit("GUIDELINES:\n"), guidelines), F.concat(F.lit("CANDIDATES:\n"), candidates), F.concat(F.lit("SENTENCES:\n"), units))
    return system, user


def meta_prompt(role: Column, label: Column, guidelines: Column, candidates: Column, units: Column, votes: Column, round_: Column, allow_expansion: bool = True) -> tuple[Column, Column]:
    """System and user text by which a meta agent selects candidates, with the votes; no requests in a last round."""
    system = F.concat(F.lit("You are "), role, F.lit(". Select from the listed candidates and prove each by an exact quote of a shown sentence. Write no spans of your own."))
    last = [] if allow_expansion else [F.lit("This is the last pass: return no expansion requests.")]
    user = F.concat_ws("\n\n", F.concat(F.lit("LABEL: "), label), F.concat(F.lit("GUIDELINES:\n"), guidelines), F.concat(F.lit("CANDIDATES:\n"), candidates), F.concat(F.lit("SENTENCES:\n"), units), F.concat(F.lit("VOTES:\n"), votes), F.concat(F.lit("ROUND: "), round_.cast("string")), *last)
    return system, user
