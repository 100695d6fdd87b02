"""JSON schemas that answers of models are held to: of reviewers, label and global decisions, and summaries.

Schemas are made for given ids: values() of them bound a field to what was shown. For whole tables, schema columns come
from the same functions: a schema is made once with marks in it, and Spark replaces the marks in each row.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import labels as L

# What answers may say, and bounds of lists and texts.
DECISIONS = ["keep", "reject"]
ISSUES = ["wrong_label", "boundary_too_short", "boundary_too_long", "incomplete_phrase", "malformed_pdf_text", "duplicate", "unsupported", "missing_span", "acceptable"]
OPERATIONS = ["split_by_sentence", "split_by_clause", "trim_leading_stopword", "trim_trailing_incomplete_clause", "expand_to_sentence_start", "expand_to_sentence_end", "generate_number_centered_span", "search_missing_label", "exact_quote_proposal"]
SEARCHES = ["search_missing_label", "verify_consensus", "repair_boundary"]
MOST_EXPANSIONS, MOST_SEARCHES, MOST_CUES = 5, 3, 8
COMMENT, RATIONALE, REASON, QUOTE, CUE = 240, 360, 300, 1000, 80


def text(most: int | None = None, among: list | None = None) -> dict:
    """A text; without anything to choose from it is free."""
    return {"type": "string"} | ({"maxLength": most} if most else {}) | ({"enum": among} if among else {})


def listed(item: dict, most=None, least=None) -> dict:
    return {"type": "array", "items": item} | ({} if most is None else {"maxItems": most}) | ({} if least is None else {"minItems": least})


def fields(needed: dict, optional: dict | None = None) -> dict:
    return {"type": "object", "properties": needed | (optional or {}), "required": list(needed)}


def by_name(item: dict) -> dict:
    return {"type": "object", "additionalProperties": item}


def _unlike(values) -> list:
    return list(dict.fromkeys(values))


def expansion(label: list, sentences: list | None = None, parents: list | None = None) -> dict:
    return fields({"label": text(among=label), "requested_operation": text(among=OPERATIONS), "justification": text(COMMENT)}, {"parent_candidate_id": text(among=parents), "proposed_text": text(), "sentence_id": text(among=sentences)})


def review(ids: list[str], label: str | None = None, count=None) -> dict:
    """A review that decides each given candidate once. count: how many they are, where ids are marks."""
    ids = _unlike(ids)
    n = len(ids) if count is None else count
    one = fields({"candidate_id": text(among=ids), "decision": text(among=DECISIONS), "issue_type": text(among=ISSUES), "justification": text(COMMENT)})
    asked = expansion(L.LABELS if label is None else [label])
    return fields({"decisions": listed(one, n, n), "expansion_requests": listed(asked, MOST_EXPANSIONS), "missing_label": {"type": "boolean"}, "comment": text(COMMENT)})


def label_decision(ids: list[str], sentences: list[str], label: str, allow_expansion: bool = True, count=None) -> dict:
    """A decision on a label's candidates; when expansion is over, lists of requests are to be empty."""
    ids, sentences = _unlike(ids), _unlike(sentences)
    n = len(ids) if count is None else count
    named = listed(text(among=ids), n)
    proof = fields({
        "candidate_id": text(among=ids), "evidence_sentence_id": text(among=sentences), "evidence_quote": text(QUOTE), "label_fit_rationale": text(RATIONALE),
        "boundary_rationale": text(RATIONALE), "why_not_other_labels": by_name(text(COMMENT)), "counterevidence_checked": {"type": "boolean"},
    })
    search = fields({"label": text(among=[label]), "reason": text(REASON), "search_cues": listed(text(CUE), MOST_CUES), "requested_operation": text(among=SEARCHES)})
    expansions, searches = (most if allow_expansion else 0 for most in (MOST_EXPANSIONS, MOST_SEARCHES))
    return fields({
        "selected_candidate_ids": named, "rejected_candidate_ids": named, "expansion_requests": listed(expansion([label], sentences, ids), expansions), "unresolved_candidate_ids": named,
        "consensus_proof": listed(proof, n), "source_search_requests": listed(search, searches), "rationale": text(),
    })


def global_decision() -> dict:
    return fields({"final_candidate_ids_by_label": by_name(listed(text())), "cross_label_conflicts": listed({"type": "object"}), "unresolved_candidates": listed(text()), "rationale": text()})


def summary() -> dict:
    return fields({"summaries_by_label": by_name(text()), "overall_summary": text()})


_IDS, _SENTENCES, _LABEL, _COUNT = "@ids@", "@sentences@", "@label@", "@count@"


def _filled(made: dict, marks: dict[str, Column]) -> Column:
    """A schema as JSON text, with the JSON text of a column in the place of each mark."""
    out = F.lit(json.dumps(made, separators=(",", ":")))
    for mark, value in marks.items():
        out = F.replace(out, F.lit(mark), value)
    return out


def _enumerated(make: Callable[[list, list], dict], ids: Column, sentences: Column, label: Column) -> Column:
    """Lists without values leave their fields free, so that there is a schema for each case."""
    quoted = F.regexp_replace(F.to_json(F.array(label)), r"^\[|\]$", "")
    # Ids and sentence ids are the engine's own and hold no marks; a label comes last, so that it may hold any text.
    marks = {f'"{_COUNT}"': F.size(ids).cast("string"), f'["{_IDS}"]': F.to_json(ids), f'["{_SENTENCES}"]': F.to_json(sentences), f'"{_LABEL}"': quoted}
    some_i, some_s = F.size(ids) > 0, F.size(sentences) > 0
    cases = F.when(some_i & some_s, _filled(make([_IDS], [_SENTENCES]), marks)).when(some_i, _filled(make([_IDS], []), marks)).when(some_s, _filled(make([], [_SENTENCES]), marks))
    return F.when(label.isNotNull(), cases.otherwise(_filled(make([], []), marks)))


def _clean(values: Column) -> Column:
    """Distinct values without nulls; a null list has none."""
    return F.array_distinct(F.array_compact(F.coalesce(values, F.array().cast("array<string>"))))


def review_column(ids: Column, label: Column) -> Column:
    """review() of each row as JSON text: ids an array of texts, label a text. Null where the label is."""
    return _enumerated(lambda i, _: review(i, _LABEL, _COUNT), _clean(ids), F.array().cast("array<string>"), label)


def label_decision_column(ids: Column, sentences: Column, label: Column, allow_expansion: bool = True) -> Column:
    """label_decision() of each row as JSON text. Null where the label is."""
    return _enumerated(lambda i, s: label_decision(i, s, _LABEL, allow_expansion, _COUNT), _clean(ids), _clean(sentences), label)
