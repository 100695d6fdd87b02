"""Selection policies. Order-dependent steps are folds over sorted arrays of one group; a group is a document's label.

features() gives each candidate what the policies ask for; mode() gives the ids that a policy selects, in order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import rules as R
from ..functions import text as T
from ..sources.store import apart
from . import votes as V
from .distinct import once
from .ranges import overlap_join

MODES = ("pubmedbert_only", "majority_vote", "pubmedbert_anchor", "pubmedbert_plus_verified", "expert_consensus_verified", "registry_filtered", "registry_all")


def features(candidates: DataFrame, matrix: DataFrame, key: str = "doc_id") -> DataFrame:
    """candidates (key, label, candidate_id, number, start, end, text, proposed_by_experts, confidence_by_expert) with votes."""
    keys = [key, "label", "candidate_id"]
    joined = candidates.join(apart(matrix), keys, "left")
    for r in V.ROLES:
        joined = joined.withColumn(r, F.coalesce(F.col(r), F.lit("missing")))
    return described(joined)


FEATURES = ("keeps", "fits", "weak", "anchor", "support", "quality", "rescued", "confidence", "plain", "boundary", "issue")


def described(joined: DataFrame, keep: list[str] | None = None, wanted: list[str] | None = None) -> DataFrame:
    """What candidates with their votes (votes.voted) are judged by.

    Rules on texts run once for each distinct text of a batch: they ask of experts only whether the anchor is one, and of
    votes only whether there is a keep. keep: columns of joined, wanted: FEATURES that are asked for (all where they are
    not given); others are neither carried through the rules nor made."""
    keep = joined.columns if keep is None else keep
    wanted = [f for f in FEATURES if wanted is None or f in wanted]
    experts, label, text, anchor = (F.col(c) for c in ("proposed_by_experts", "label", "text", "anchor"))
    keeps = sum((F.col(r) == "keep").cast("int") for r in V.ROLES)
    some = F.when(anchor, F.array(F.lit(R.L.ANCHOR))).when(~anchor, F.array().cast("array<string>"))
    rules = {
        "fits": R.passes_filter(label, text), "weak": R.weak_fragment(label, text, some), "quality": R.quality(label, text), "rescued": R.rescue(label, text, some, F.col("_kept").cast("int")),
        "plain": T.normalized(text), "boundary": R.boundary_score(label, text, F.lit(0), some), "issue": R.boundary_issue(label, text),
    }
    judged = {("_boundary" if f == "boundary" else f): c for f, c in rules.items() if f in wanted}
    by = ["label", "text"] + ["anchor"] * (not judged.keys().isdisjoint(("weak", "rescued", "_boundary"))) + ["_kept"] * ("rescued" in judged)
    made = {"keeps": keeps, "anchor": R.proposed_by_anchor(experts), "support": R.expert_support(experts), "confidence": F.coalesce(F.array_max(F.map_values("confidence_by_expert")), F.lit(0.0)), "_kept": keeps >= 1}
    carried = list(dict.fromkeys([*keep, *(by if judged else ()), *(["start"] if "_boundary" in judged else [])]))
    rows = joined.select(*(c for c in carried if c not in made), *(c.alias(f) for f, c in made.items() if f in wanted or judged and f in by))
    if judged:
        rows = once(rows, by, judged)
    place = lambda: F.struct(*(F.col(f"_boundary.{c}").alias(c) for c in ("score", "fit", "size")), (-F.col("start")).alias("place"))
    return rows.select(*keep, *(place().alias(f) if f == "boundary" else f for f in wanted))


def _near(a: Column, b: Column, strict: Column) -> Column:
    shared = T.overlap(a["start"], a["end"], b["start"], b["end"])
    shorter = F.greatest(F.lit(1), F.least(a["end"] - a["start"], b["end"] - b["start"]))
    inside = a["plain"].contains(b["plain"]) | b["plain"].contains(a["plain"])
    named = (a["plain"] != "") & (b["plain"] != "") & ((a["plain"] == b["plain"]) | (strict & inside))
    return (shared / shorter >= 0.85) | named


def _better(new: Column, old: Column) -> Column:
    higher, least = new["boundary"] > old["boundary"], new["boundary"] >= old["boundary"]
    return (old["weak"] & ~new["weak"]) | F.when(new["anchor"] & ~old["anchor"], least).otherwise(higher)


def without_redundant(items: Column, strict: Column) -> Column:
    """Fold: a candidate that nearly repeats a kept one replaces the first such one when its borders are better."""

    def step(kept: Column, new: Column) -> Column:
        def placed(at: Column) -> Column:
            swapped = F.transform(kept, lambda old, k: F.when((k + 1 == at) & _better(new, old), new).otherwise(old))
            return F.when(at == 0, F.concat(kept, F.array(new))).otherwise(swapped)

        return T.let(F.coalesce(F.array_position(F.transform(kept, lambda old: _near(new, old, strict)), True), F.lit(0)), placed)

    return F.aggregate(items, F.slice(items, 1, 0), step)


def _stays(label: str, outer: int, inner: int, issue: list, size: list, single: list) -> bool:
    """Whether of a span and one inside it the outer one stays."""
    if label in ("SampleSize", "DesignDescription", "StatisticalAnalysis"):
        return True
    if label == "ComparisonGroup":
        return single[inner]
    return issue[inner] if issue[outer] != issue[inner] else size[inner] >= size[outer]


def _uncontained(label: str, starts: list, ends: list, issue: list, size: list, single: list) -> list[int]:
    """Places of the spans that stay. Spans in their order meet those inside them, found among the sorted starts; each
    live pair takes out one span, so that no more pairs are judged than there are spans."""
    n = len(starts)
    if n <= 16:
        lost: set[int] = set()
        for a in range(n):
            for b in range(n) if a not in lost else ():
                if b in lost or not starts[a] <= starts[b] <= ends[a] or ends[b] > ends[a] or (starts[a] == starts[b] and ends[a] == ends[b]):
                    continue
                if _stays(label, a, b, issue, size, single):
                    lost.add(b)
                else:
                    lost.add(a)
                    break
        return [k for k in range(n) if k not in lost]
    by_start = np.argsort(np.array(starts, np.int64), kind="stable")
    sorted_starts, sorted_ends = np.array(starts, np.int64)[by_start], np.array(ends, np.int64)[by_start]
    low, high = np.searchsorted(sorted_starts, starts, "left").tolist(), np.searchsorted(sorted_starts, ends, "right").tolist()
    gone = np.zeros(n, bool)
    for a in range(n):
        if gone[a] or high[a] - low[a] < 2:
            continue
        near = by_start[low[a] : high[a]][sorted_ends[low[a] : high[a]] <= ends[a]]
        for b in np.sort(near[~gone[near]]).tolist():
            if starts[a] == starts[b] and ends[a] == ends[b]:
                continue
            if _stays(label, a, b, issue, size, single):
                gone[b] = True
            else:
                gone[a] = True
                break
    return np.flatnonzero(~gone).tolist()


@F.arrow_udf(ArrayType(StringType()))
def _uncontained_ids(label: pa.Array, ids: pa.Array, starts: pa.Array, ends: pa.Array, issue: pa.Array, size: pa.Array, single: pa.Array) -> pa.Array:
    rows = zip(*(c.to_pylist() for c in (label, ids, starts, ends, issue, size, single)), strict=True)
    return pa.array([None if r[1] is None else [r[1][k] for k in _uncontained(r[0], *r[2:])] for r in rows], pa.list_(pa.string()))


def without_contained(items: Column, label: Column) -> Column:
    """The ids that stay when of each strict containment of two kept spans the loser goes, pairs taken in order of the
    outer and then of the inner span; a lost outer span asks no more."""
    of = lambda f: F.transform(items, f)
    single = F.when(label == "ComparisonGroup", of(lambda x: F.size(F.split(T.clean(x["text"]), " ")) < 2)).otherwise(of(lambda x: F.lit(False)))
    return _uncontained_ids(label, of(lambda x: x["candidate_id"]), of(lambda x: x["start"]), of(lambda x: x["end"]), of(lambda x: x["issue"].isNotNull()), of(lambda x: F.length(x["text"])), single)


_ITEM = ("candidate_id", "start", "end", "text", "plain", "weak", "anchor", "boundary", "issue")
_FOLDED = ("candidate_id", "start", "end", "plain", "weak", "anchor", "boundary")  # what without_redundant() asks for


def grouped(chosen: DataFrame, order: list[str], key: str = "doc_id", fields: tuple[str, ...] = _ITEM) -> DataFrame:
    """key, label, items: each group's candidates (what of them is asked for) as an array in the given order."""
    item = F.struct(*order, F.struct(*fields).alias("c"))
    return chosen.groupBy(key, "label").agg(F.sort_array(F.collect_list(item)).getField("c").alias("items"))


def _ids(items: Column) -> Column:
    return F.transform(items, lambda x: x["candidate_id"])


def _picked(items: DataFrame, ids: Column, key: str) -> DataFrame:
    """A row for each of a group's ids, which are made first: a generator takes no Python function."""
    return items.select(key, "label", ids.alias("ids")).select(key, "label", F.posexplode("ids").alias("pos", "candidate_id"))


_OF_MODE = {
    "registry_all": (), "registry_filtered": ("fits",), "pubmedbert_only": ("fits", "anchor"), "majority_vote": ("fits", "keeps"), "pubmedbert_anchor": ("fits", "anchor", "keeps"),
    "pubmedbert_plus_verified": ("fits", "anchor", "weak", "keeps", "rescued", "plain", "boundary"),
    "expert_consensus_verified": ("fits", "anchor", "weak", "keeps", "support", "rescued", "plain", "boundary"),
}


def asked_by(name: str, prune_contained: bool = True, key: str = "doc_id") -> tuple[list[str], list[str]]:
    """The columns of candidates and the features that mode() asks for, as described() takes them."""
    prune = prune_contained and name in ("majority_vote", "pubmedbert_anchor")
    spans = prune or "boundary" in _OF_MODE[name]
    return [key, "label", "candidate_id", "number", *(("start", "end") if spans else ()), *(("text",) if prune else ())], [*_OF_MODE[name], *(["issue"] if prune else [])]


def mode(rows: DataFrame, name: str, key: str = "doc_id", prune_contained: bool = True) -> DataFrame:
    """key, label, pos, candidate_id that a policy selects from features(). prune_contained: for the two vote modes."""
    fits, votes = F.col("fits"), F.col("keeps")
    strict = F.col("label").isin(R.L.STRICT_LABELS)
    plain = {
        "registry_all": F.lit(True),
        "registry_filtered": fits,
        "pubmedbert_only": fits & F.col("anchor"),
        "majority_vote": fits & (votes >= 2),
        "pubmedbert_anchor": fits & ((F.col("anchor") & (votes >= 1)) | (votes >= 2)),
    }
    if name in plain:
        prune = prune_contained and name in ("majority_vote", "pubmedbert_anchor")
        items = grouped(rows.filter(plain[name]), ["number"], key, ("candidate_id", "start", "end", "text", "issue") if prune else ("candidate_id",))
        return _picked(items, without_contained(F.col("items"), F.col("label")) if prune else _ids(F.col("items")), key)
    if name not in _verified():
        raise ValueError(f"no such mode: {name}")
    chosen, rank = _verified()[name]
    items = grouped(rows.filter(chosen).withColumn("rank", rank), ["rank", "number"], key, _FOLDED)
    return _picked(items, _ids(without_redundant(F.col("items"), strict)), key)


def _verified() -> dict[str, tuple[Column, Column]]:
    """Of the modes that fold near repetitions: whom they choose, and what comes before the number in their order."""
    agreed, anchor, good = (F.col("keeps") >= 2) | F.col("rescued"), F.col("anchor"), ~F.col("weak")
    return {
        "pubmedbert_plus_verified": (F.col("fits") & F.when(anchor, good).otherwise(agreed), F.when(anchor, 0).otherwise(1)),
        "expert_consensus_verified": (F.col("fits") & good & ((F.col("support") >= 2) | agreed), F.lit(0)),
    }


def _by_rule() -> Column:
    """Whether a rule's fields beside a candidate choose it."""
    share = V.weighted_keep(F.col("vote_weights"))
    return (
        (~F.col("require_label_filter") | F.col("fits")) & (~F.col("reject_weak_fragments") | ~F.col("weak"))
        & ((share >= V.vote_threshold(F.col("min_vote_fraction"))) | ((F.col("support") >= F.col("min_expert_support")) & (F.col("confidence") >= F.col("min_confidence"))) | (F.col("use_high_quality_rescue") & F.col("rescued")))
    )


def calibrated(rows: DataFrame, configs: DataFrame, key: str = "doc_id") -> DataFrame:
    """config_id, key, label, pos, candidate_id: what each configuration selects.

    configs: config_id, label, require_label_filter, reject_weak_fragments, min_vote_fraction, min_expert_support,
    min_confidence, use_high_quality_rescue, vote_weights (in the order of the roles); some hundreds of rows a label at
    most, which bounds the broadcast. Configurations that keep the same candidates of a group share one fold."""
    met = rows.join(F.broadcast(configs), "label")
    signatures = met.filter(_by_rule()).groupBy(key, "label", "config_id").agg(F.array_sort(F.collect_list("number")).alias("numbers"))
    distinct = signatures.select(key, "label", "numbers").distinct()
    members = distinct.select(key, "label", "numbers", F.explode("numbers").alias("number")).join(apart(rows), [key, "label", "number"])
    item = F.struct("number", F.struct(*_ITEM).alias("c"))
    items = members.groupBy(key, "label", "numbers").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"]).alias("items"))
    kept = F.transform(without_redundant(F.col("items"), F.col("label").isin(R.L.STRICT_LABELS)), lambda x: x["candidate_id"])
    folded = items.select(key, "label", "numbers", kept.alias("ids"))
    return signatures.join(apart(folded), [key, "label", "numbers"]).select("config_id", key, "label", F.posexplode("ids").alias("pos", "candidate_id"))


def known(ids: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Given ids (key, label, pos, candidate_id) that the registry holds, in their order."""
    return ids.join(apart(rows.select(key, "label", "candidate_id").distinct()), [key, "label", "candidate_id"], "left_semi").select(key, "label", "pos", "candidate_id")


def strict(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, label, pos, candidate_id: what all roles keep with good borders, without contained spans."""
    items = grouped(rows.filter((F.col("keeps") == len(V.ROLES)) & F.col("issue").isNull()), ["number"], key)
    return _picked(items, without_contained(F.col("items"), F.col("label")), key)


def by_mode(rows: DataFrame, strict_ids: DataFrame | None = None, recommended: DataFrame | None = None, rules: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """mode, key, label, pos, candidate_id of all ten modes: strict, recommended and calibrated ones as far as they are given."""
    parts = {name: mode(rows, name, key) for name in MODES}
    if strict_ids is not None:
        parts["strict"] = strict_ids
    if recommended is not None:
        parts["recommended"] = recommended
    if rules is not None:
        parts["calibrated"] = calibrated(rows, rules.withColumn("config_id", F.lit(0)), key)
    out = None
    for name, ids in parts.items():
        one = ids.select(F.lit(name).alias("mode"), key, "label", "pos", "candidate_id")
        out = one if out is None else out.unionByName(one)
    return out


SOURCE_MODES = ("recommended", "registry_all", "registry_filtered", "expert_consensus_verified", "pubmedbert_plus_verified")
BY_SOURCE_MODE = (["doc_id", "label", "candidate_id", "number", "start", "end", *V.ROLES], ["fits", "anchor", "weak", "keeps", "support", "confidence", "rescued", "plain", "boundary"])


def by_source_mode(rows: DataFrame, rules: DataFrame, recommended: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key, label, pos, candidate_id: each label by the mode that its rule names, any other name by the rule itself.

    rules: one row a label, with source_mode and the fields of calibrated(); seven rows bound the broadcasts. A label has
    one rule, so that candidates meet it in one pass and are grouped once, whatever it says."""
    named = F.coalesce(F.col("source_mode"), F.lit(""))
    folds = ~named.isin("registry_all", "registry_filtered")
    by = {"registry_all": (F.lit(True), F.lit(0)), "registry_filtered": (F.col("fits"), F.lit(0)), **_verified()}
    chosen, rank = F, F
    for name, (test, first) in by.items():
        chosen, rank = chosen.when(named == name, test), rank.when(named == name, first)
    met = rows.join(F.broadcast(rules.filter(named != "recommended")), "label").filter(chosen.otherwise(_by_rule()))
    kept = met.withColumns({"rank": rank.otherwise(0), "_folds": folds, **{c: F.when(folds, F.col(c)) for c in _FOLDED[1:]}})
    item = F.struct("rank", "number", F.struct(*_FOLDED).alias("c"))
    items = kept.groupBy(key, "label", "_folds").agg(F.sort_array(F.collect_list(item)).getField("c").alias("items"))
    few = without_redundant(F.col("items"), F.col("label").isin(R.L.STRICT_LABELS))
    out = _picked(items, F.when(F.col("_folds"), _ids(few)).otherwise(_ids(F.col("items"))), key)
    if recommended is None:
        return out
    of = F.broadcast(rules.filter(named == "recommended").select("label"))
    return out.unionByName(known(recommended.join(of, "label", "left_semi"), rows, key))


def applied(rows: DataFrame, rules: DataFrame, recommended: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key, label, pos, candidate_id, start, end, text: final spans of a configuration. cross_label_conflicts() of these
    are the conflicts; a consensus is never claimed for them."""
    ids = by_source_mode(rows, rules, recommended, key)
    return ids.join(apart(rows.select(key, "label", "candidate_id", "start", "end", "text")), [key, "label", "candidate_id"])


def cross_label_conflicts(spans: DataFrame, key: str = "doc_id", least: float = 0.8) -> DataFrame:
    """Pairs of selected spans of different labels in one document that are equal or overlap heavily."""
    from .candidates import label_ord

    named = spans.select(key, "label", label_ord(F.col("label")).alias("ord"), "candidate_id", "start", "end", "text")
    pairs = overlap_join(named, named, key).filter("a.ord < b.ord")
    shared = T.overlap(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end"))
    shorter = F.greatest(F.lit(1), F.least(F.col("a.end") - F.col("a.start"), F.col("b.end") - F.col("b.start")))
    same = (F.col("a.start") == F.col("b.start")) & (F.col("a.end") == F.col("b.end")) & (F.col("a.text") == F.col("b.text"))
    kind = F.when(same, "exact_duplicate_cross_label").when(shared / shorter >= least, "heavy_overlap_cross_label")
    found = pairs.select(key, kind.alias("type"), F.col("a.label").alias("left_label"), F.col("b.label").alias("right_label"), F.col("a.candidate_id").alias("left_id"), F.col("b.candidate_id").alias("right_id"), shared.alias("overlap_chars"))
    return found.filter("type IS NOT NULL")
