"""A registry of candidates that grows with a stream of spans.

State is kept for each document and label: the last number, and for each known span who proposed it. A micro-batch's
spans are taken in their order; a new span gets the next number, a known one the proposal added to it. What a batch
changes leaves it as a row with a version, so that an append-only table with a checkpoint is exactly-once, and latest()
of it is the registry that candidates.registered() builds from all spans at once, as long as a document's spans arrive in
the order of `ord`. Records that come again in a later run change nothing but the proposals: skipping what exists needs
no look at earlier output.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import labels as L
from ..operators import candidates

_ROW = "start int, end int, text string, origin string, section string, normalised boolean, experts array<string>, confidences array<double>, thresholds array<double>, merged long, candidate_id string, number int, version long"
_COLUMNS = [c.split()[0] for c in _ROW.split(", ")]


def _grown(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    number, known = (state.get[0], json.loads(state.get[1])) if state.exists else (0, {})
    changed: dict[str, None] = {}
    for r in pd.concat(batches).sort_values("ord", kind="stable").to_dict("records"):
        place, expert = f"{r['start']}-{r['end']}", r["expert"]
        span = known.get(place)
        if span is None:
            number += 1
            span = known[place] = {"number": number, "text": r["text"], "origin": r["origin"], "section": r["section"], "normalised": bool(r["normalised"]), "said": {}, "merged": 0, "version": 0}
        elif expert is None:
            continue
        else:
            span["merged"] += 1
        if expert is not None:
            confidence, _, threshold = span["said"].get(expert, (float("-inf"), None, None))
            span["said"][expert] = (max(confidence, r["confidence"]), r["ord"], r["threshold"])
        changed[place] = None
    rows = []
    for place in changed:
        span = known[place]
        span["version"] += 1
        start, end = map(int, place.rsplit("-", 1))
        said = sorted(span["said"].items())
        name = f"{L.PREFIX[key[1]]}-C{span['number']:04d}"
        rows.append((*key, start, end, span["text"], span["origin"], span["section"], span["normalised"], [e for e, _ in said], [v[0] for _, v in said], [v[2] for _, v in said], span["merged"], name, span["number"], span["version"]))
    state.update((number, json.dumps(known)))
    yield pd.DataFrame(rows, columns=["_key", "label", *_COLUMNS])


def registry_stream(raw: DataFrame, sources: DataFrame, normalise: bool = False, key: str = "doc_id") -> DataFrame:
    """Versions of candidates from a stream of raw spans (the columns of candidates.registered()); sources is a table."""
    good = candidates.arrivals(raw, sources, normalise, key).filter("reason = 'accepted'")
    kept = good.select(key, "label", "ord", "start", "end", "text", "origin", "section", "normalised", "expert", "confidence", "threshold")
    kind = raw.schema[key].dataType.simpleString()
    grown = kept.groupBy(key, "label").applyInPandasWithState(_grown, f"_key {kind}, label string, {_ROW}", "number int, known string", "append", GroupStateTimeout.NoTimeout)
    pairs = lambda c: F.map_from_arrays("experts", c)
    return grown.select(
        F.col("_key").alias(key), "label", "start", "end", "text", "origin", "section", "normalised", F.col("experts").alias("proposed_by_experts"), pairs("confidences").alias("confidence_by_expert"), pairs("thresholds").alias("threshold_by_expert"),
        "merged", "candidate_id", "number", "version",
    )


def grow(raw: DataFrame, sources: DataFrame, out: str, checkpoint: str, normalise: bool = False, key: str = "doc_id", once: bool = True) -> StreamingQuery:
    """Appends versions of candidates to a Parquet table; with `once` what has arrived so far, else until stopped."""
    writer = registry_stream(raw, sources, normalise, key).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(versions: DataFrame, key: str = "doc_id") -> DataFrame:
    """The registry: each candidate's last version."""
    rest = [c for c in versions.columns if c not in (key, "label", "candidate_id", "version")]
    last = versions.groupBy(key, "label", "candidate_id").agg(F.max_by(F.struct(*rest), "version").alias("last"))
    return last.select(key, "label", "candidate_id", "last.*")
