"""JSON objects from text that models write: fences, text around, trailing commas, cut ends. Arrow-batched.

A text is marked once: where its unescaped quotes, brackets, commas and colons stand. From the marks follow the ends of
containers, the commas that close nothing, and the heads of fields, which are colons behind a quoted name. What is asked
of a broken text is then a walk over its heads; no pattern is searched in the text.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CLOSING = {"{": "}", "[": "]"}
CONTEXT = 240

# What stands for words that could not be kept.
LOST_REASON = "Decision recovered from malformed JSON; original justification omitted."
LOST_COMMENT = "Malformed DoctorAgent JSON salvaged deterministically."
DOUBTFUL = "unsupported"


class Marks:
    """The marks of a text. Offsets are those of its characters."""

    def __init__(self, text: str):
        self.text = text
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.arange(len(points))
        plain = points != ord("\\")
        run = at - np.maximum.accumulate(np.where(plain, at, -1)) if len(points) else at
        escaped = np.append(0, run[:-1])[: len(points)] % 2 == 1
        self.quotes = np.flatnonzero((points == ord('"')) & ~escaped).tolist()
        self.signs = np.flatnonzero(np.isin(points, [ord(c) for c in '"{}[],:']) & ~escaped).tolist()

    def _outside(self, at: int):
        """Signs from an offset on that stand in no string, when the offset itself stands in none."""
        inside = False
        for k in range(bisect_left(self.signs, at), len(self.signs)):
            c = self.text[self.signs[k]]
            if c == '"':
                inside = not inside
            elif not inside:
                yield self.signs[k], c

    def end(self, at: int) -> int | None:
        """Behind the bracket that closes the one at an offset; only brackets of its kind count."""
        opening, depth = self.text[at], 0
        for k, c in self._outside(at):
            if c == opening:
                depth += 1
            elif c == CLOSING[opening]:
                depth -= 1
                if not depth:
                    return k + 1
        return None

    def tidy(self, start: int, end: int) -> str:
        """A part of the text without the commas that stand before a closing bracket."""
        out, at, comma = [], start, None
        for k, c in self._outside(start):
            if k >= end:
                break
            if comma is not None and c in "]}" and not self.text[comma + 1 : k].strip():
                out.append(self.text[at:comma])
                at = comma + 1
            comma = k if c == "," else None
        return "".join(out) + self.text[at:end]

    def _name(self, colon: int) -> tuple[int, str] | None:
        """Where the quoted name before a colon begins, and the name."""
        k = bisect_left(self.quotes, colon) - 1
        if k < 1 or self.text[self.quotes[k] + 1 : colon].strip():
            return None
        return self.quotes[k - 1], self.text[self.quotes[k - 1] + 1 : self.quotes[k]]

    @cached_property
    def heads(self) -> list[tuple[int, str, int]]:
        """Offset, name and offset of the value of every field, in the text's order."""
        out = []
        for k in self.signs:
            if self.text[k] == ":" and (found := self._name(k)):
                value = k + 1
                while value < len(self.text) and self.text[value].isspace():
                    value += 1
                out.append((*found, value))
        return out

    def raw(self, at: int) -> str | None:
        """What stands between quotes at an offset."""
        if self.text[at : at + 1] != '"':
            return None
        k = bisect_left(self.quotes, at + 1)
        return self.text[at + 1 : self.quotes[k]] if k < len(self.quotes) else None

    def value(self, at: int, kind: str | None):
        """A whole value of a kind at an offset, else null. Of a list that is no JSON its strings are the items."""
        first = self.text[at : at + 1]
        if kind == "boolean":
            return next((v for word, v in (("true", True), ("false", False)) if self.text.startswith(word, at)), None)
        if kind == "string" and first == '"':
            try:
                return json.JSONDecoder().raw_decode(self.text, at)[0]
            except ValueError:
                return None
        if first != {"array": "[", "object": "{"}.get(kind or "", " ") or (end := self.end(at)) is None:
            return None
        try:
            return json.loads(self.tidy(at, end))
        except (ValueError, RecursionError):
            return self._strings(at, end) or None if kind == "array" else None

    def _strings(self, start: int, end: int) -> list[str]:
        k, out = bisect_left(self.quotes, start), []
        while k + 1 < len(self.quotes) and self.quotes[k + 1] < end:
            inner = self.text[self.quotes[k] + 1 : self.quotes[k + 1]]
            try:
                out.append(json.loads(f'"{inner}"', strict=False))
            except ValueError:
                out.append(inner)
            k += 2
        return out


def bare(text: str) -> str:
    """A text without white space and a code fence around it."""
    text = text.strip()
    if len(text) >= 6 and text.startswith("```") and text.endswith("```"):
        text = text[3:-3]
        text = (text[4:] if text[:4].lower() == "json" else text).strip()
    return text


def read(text: str | None, schema: dict | None = None) -> tuple[dict | None, str, int | None, str | None]:
    """The object of a text; how it was found (whole, inner, tidied, salvaged; else refused or broken); where its JSON
    breaks and what stands around there.

    Read are the bare text, its first balanced object, and that one without idle commas: the first that is JSON counts.
    Where it is no object (a list, a number) it is refused. Otherwise the schema says what to save."""
    if text is None:
        return None, "broken", None, None
    plain = bare(text)
    marks, fault, inner = None, None, plain
    for how in ("whole", "inner", "tidied"):
        if how == "inner":
            marks = Marks(plain)
            start = plain.find("{")
            if start < 0:
                continue
            inner = plain[start : marks.end(start)]
        elif how == "tidied":
            start = max(0, plain.find("{"))
            inner = marks.tidy(start, start + len(inner))
        try:
            found = json.loads(inner)
        except (ValueError, RecursionError) as e:
            fault = (getattr(e, "pos", 0), inner)
            continue
        return (found, how, None, None) if isinstance(found, dict) else (None, "refused", None, None)
    at, around = (fault[0], fault[1][max(0, fault[0] - CONTEXT) : fault[0] + CONTEXT]) if fault else (None, None)
    saved = None
    if plain and schema and schema.get("type") == "object":
        saved = saved_review(marks, schema) or saved_fields(marks, schema.get("properties", {}))
    return (None if saved is None else saved | {"_salvaged_from_malformed_json": True}), "broken" if saved is None else "salvaged", at, around


def parsed(text: str | None, schema: dict | None = None) -> dict | None:
    return read(text, schema)[0]


def saved_review(marks: Marks, schema: dict) -> dict | None:
    """A review from the heads of a broken text: each allowed id takes the first decision and issue before the next id.

    Nothing is made up: ids without a decision are left out, reasons are dropped."""
    item = schema.get("properties", {}).get("decisions", {}).get("items", {}).get("properties", {})
    allowed, issues = set(item.get("candidate_id", {}).get("enum") or ()), item.get("issue_type", {}).get("enum", [])
    if not allowed or set(item.get("decision", {}).get("enum", [])) != {"keep", "reject"}:
        return None
    found: dict[str, dict] = {}
    current, missing = None, None
    for _, name, at in marks.heads:
        word = marks.raw(at)
        if name == "candidate_id" and word in allowed and word not in found:
            current = found[word] = {}
        elif name == "decision" and current is not None and word in ("keep", "reject"):
            current.setdefault("decision", word)
        elif name == "issue_type" and current is not None and word:
            current.setdefault("issue", word)
        elif name == "missing_label" and missing is None:
            lead = marks.text[at : at + 5].lower()
            missing = True if lead.startswith("true") else False if lead == "false" else None
    made = [{"candidate_id": c, "decision": f["decision"], "issue_type": f["issue"] if f.get("issue") in issues else DOUBTFUL, "justification": LOST_REASON} for c, f in found.items() if "decision" in f]
    if not made:
        return None
    return {"decisions": made, "expansion_requests": [], "missing_label": bool(missing), "comment": LOST_COMMENT, "_discarded_malformed_justifications": True}


def _empty(kind: str | None):
    return {"array": [], "object": {}, "boolean": False, "string": ""}.get(kind or "")


def saved_fields(marks: Marks, properties: dict) -> dict | None:
    """The fields of a schema that stand whole in a broken text, each at its first head; the others are empty; null
    where none is whole."""
    first: dict[str, int] = {}
    for _, name, at in marks.heads:
        first.setdefault(name, at)
    whole = {name: marks.value(first[name], f.get("type")) for name, f in properties.items() if name in first}
    if all(v is None for v in whole.values()):
        return None
    return {name: _empty(f.get("type")) if whole.get(name) is None else whole[name] for name, f in properties.items()}


def decisions(text: str | None, allowed: set[str]) -> dict[str, str]:
    """Decisions by candidate: of the parsed object, else those that stand whole in the broken text; none is made up."""
    value = parsed(text)
    if value is not None and isinstance(value.get("decisions"), list):
        pairs = [(str(d.get("candidate_id", "")).strip(), d.get("decision")) for d in value["decisions"] if isinstance(d, dict)]
    else:
        pairs, current, behind = [], None, 0
        marks = Marks(text or "")
        for start, name, at in marks.heads:
            word = marks.raw(at)
            if current and any(c in "{}" for c in marks.text[behind:start]):
                current = None
            if name == "candidate_id" and word:
                current, behind = current or word, at + len(word) + 2
            elif name == "decision" and current and word in ("keep", "reject"):
                pairs.append((current, word))
                current = None
    return {c: d for c, d in pairs if c in allowed and d in ("keep", "reject")}


def object_column(text: Column, schema: dict | None = None) -> Column:
    """The repaired object as JSON text, null where there is none. schema: a JSON schema by which to save broken ones."""
    return repair_column(text, schema)["object"]


def repair_column(text: Column, schema: dict | None = None) -> Column:
    """struct<object, how, error_at, error>: the repaired object as JSON text and what read() says of it."""
    kind = StructType.fromDDL("object string, how string, error_at int, error string")

    @F.arrow_udf(kind)
    def repair(texts: pa.Array) -> pa.Array:
        rows = [read(t, schema) for t in texts.to_pylist()]
        made = [None if r[0] is None else json.dumps(r[0], sort_keys=True) for r in rows]
        return pa.StructArray.from_arrays([pa.array(made, pa.string()), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.string()), (2, pa.int32()), (3, pa.string())))], ["object", "how", "error_at", "error"])

    return repair(text)
