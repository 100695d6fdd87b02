"""Calibration: a grid of selection rules per label, scored by token overlap with gold; the best one per label.

Configurations that select the same spans of a group share one score, so the cost follows the distinct selections."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import labels as L
from ..functions import text as T
from ..sources.store import apart
from . import select


def grid(spark: SparkSession, labels: list[str] | None = None, profiles: list[str] | None = None) -> DataFrame:
    """config_id (place in the grid), label and the fields of each rule: profiles x votes x supports x confidences x rescue."""
    rows, place = [], len(L.FIXED_MODES)
    for name in profiles or list(L.VOTE_PROFILES):
        for fraction in L.VOTE_FRACTIONS:
            for support in L.EXPERT_SUPPORTS:
                for confidence in L.CONFIDENCES:
                    for rescue in (False, True):
                        rows.append((place, name, list(L.VOTE_PROFILES[name]), fraction, support, confidence, rescue))
                        place += 1
    schema = "config_id int, vote_weight_profile string, vote_weights array<double>, min_vote_fraction double, min_expert_support int, min_confidence double, use_high_quality_rescue boolean"
    named = spark.createDataFrame([(x,) for x in labels or L.LABELS], "label string")
    out = named.crossJoin(F.broadcast(spark.createDataFrame(rows, schema)))  # literal tables: seven labels by the grid
    return out.withColumns({"source_mode": F.lit("calibrated_rule"), "require_label_filter": F.lit(True), "reject_weak_fragments": F.lit(True)})


def fixed_modes(spark: SparkSession, registry_all: bool = False) -> DataFrame:
    """config_id, label, source_mode of the fixed modes that stand before the grid."""
    modes = [*L.FIXED_MODES, *(["registry_all"] if registry_all else [])]
    return spark.createDataFrame([(k, x, m) for x in L.LABELS for k, m in enumerate(modes)], "config_id int, label string, source_mode string")


def default_config(spark: SparkSession) -> DataFrame:
    """Two thirds of the votes, or two experts, or rescue; for every label."""
    rows = grid(spark, profiles=["equal"])
    return rows.filter("abs(min_vote_fraction - 0.67) < 0.001 AND min_expert_support = 2 AND min_confidence = 0 AND use_high_quality_rescue")


def _sides(tokens: DataFrame, spans: DataFrame, by: list[str], name: str) -> DataFrame:
    a, b = tokens.alias("t"), spans.alias("s")
    met = a.join(apart(b), (F.col("t.doc_id") == F.col("s.doc_id")) & (F.col("t.start") < F.col("s.end")) & (F.col("s.start") < F.col("t.end")))
    return met.select(*(F.col(f"s.{c}").alias(c) for c in by), F.col("t.ord").alias("ord")).distinct().withColumn(name, F.lit(1))


def chosen_by_modes(features: DataFrame, recommended: DataFrame | None = None) -> DataFrame:
    """config_id, doc_id, label, pos, candidate_id that the fixed modes select.

    recommended: doc_id, label, pos, candidate_id of the meta agent's choice; where there is none, nothing is selected."""
    out = None
    for k, name in enumerate(L.FIXED_MODES):
        if name == "recommended":
            if recommended is None:
                continue
            picked = recommended.select("doc_id", "label", "pos", "candidate_id").join(apart(features.select("doc_id", "label", "candidate_id")), ["doc_id", "label", "candidate_id"], "left_semi")
        else:
            picked = select.mode(features, name)
        picked = picked.select(F.lit(k).alias("config_id"), "doc_id", "label", "pos", "candidate_id")
        out = picked if out is None else out.unionByName(picked)
    return out


def _sums(chosen: DataFrame, features: DataFrame, tokens: DataFrame, gold: DataFrame) -> DataFrame:
    """config_id, label, p, tp of chosen candidates (config_id, doc_id, label, candidate_id): their tokens, and those in gold.

    tokens: doc_id, ord, start, end. Configurations that choose the same candidates of a group share one count."""
    groups = chosen.groupBy("config_id", "doc_id", "label").agg(F.array_sort(F.collect_list("candidate_id")).alias("ids"))
    picks = groups.select("doc_id", "label", "ids").distinct()
    spans = picks.select("doc_id", "label", "ids", F.explode("ids").alias("candidate_id")).join(apart(features.select("doc_id", "label", "candidate_id", "start", "end")), ["doc_id", "label", "candidate_id"])
    predicted, wanted = _sides(tokens, spans, ["doc_id", "label", "ids"], "p"), _sides(tokens, gold, ["doc_id", "label"], "g")
    sums = predicted.join(apart(wanted), ["doc_id", "label", "ord"], "left").groupBy("doc_id", "label", "ids").agg(F.count("*").alias("p"), F.count("g").alias("tp"))
    return groups.join(apart(sums), ["doc_id", "label", "ids"]).groupBy("config_id", "label").agg(F.sum("p").alias("p"), F.sum("tp").alias("tp"))


def _with_scores(sums: DataFrame, configs: DataFrame, tokens: DataFrame, gold: DataFrame) -> DataFrame:
    totals = _sides(tokens, gold, ["doc_id", "label"], "g").groupBy("label").agg(F.count("*").alias("g"))
    return _rated(configs.select("config_id", "label").join(sums, ["config_id", "label"], "left").join(totals, "label", "left"))


def _rated(sums: DataFrame) -> DataFrame:
    every = sums.na.fill(0, ["p", "tp", "g"])
    tp, fp, fn = F.col("tp"), F.col("p") - F.col("tp"), F.col("g") - F.col("tp")
    return every.select("config_id", "label", "tp", fp.alias("fp"), fn.alias("fn"), *T.f_scores(tp, fp, fn))


def scored(features: DataFrame, tokens: DataFrame, gold: DataFrame, configs: DataFrame, modes: DataFrame | None = None, recommended: DataFrame | None = None) -> DataFrame:
    """config_id, label, tp, fp, fn, precision, recall, f1 of every configuration; modes: fixed_modes() to score with them."""
    chosen = select.calibrated(features, configs)
    if modes is not None:
        wanted_modes = F.broadcast(modes.select("config_id", "label"))  # a literal table: some modes a label
        chosen = chosen.unionByName(chosen_by_modes(features, recommended).join(wanted_modes, ["config_id", "label"], "left_semi"))
        configs = configs.select("config_id", "label").unionByName(modes.select("config_id", "label"))
    return _with_scores(_sums(chosen, features, tokens, gold), configs, tokens, gold)


_KEPT = ("label", "number", "start", "end", "plain", "weak", "anchor", "support", "confidence", "rescued")
#: Columns of candidates and features that grid_scored() asks for, as select.described() takes them.
ASKED = (["doc_id", "label", "candidate_id", "number", "start", "end", *select.V.ROLES], ["fits", "weak", "anchor", "support", "confidence", "rescued", "plain", "boundary"])
_BORDER = ("score", "fit", "size", "place")
_SUMS = "label string, config_id int, p long, tp long"
_GOLD = -1  # the config_id under which tokens of gold are summed


def _by_votes() -> list[list[bool]]:
    """Of each set of keeping roles (a bit a role): which profiles and fractions it satisfies, in the order of the grid."""
    out = []
    for code in range(1 << len(select.V.ROLES)):
        shares = [sum((w if code >> k & 1 else 0.0 for k, w in enumerate(p)), 0.0) / sum(p, 0.0) for p in L.VOTE_PROFILES.values()]
        out.append([share >= (2 / 3 if abs(f - 0.67) < 0.005 else f) for share in shares for f in L.VOTE_FRACTIONS])
    return out


def _by_experts() -> list[list[bool]]:
    """Of each number of supports and confidences that are reached (supports times steps): which pairs of them."""
    steps = range(len(L.CONFIDENCES) + 1)
    return [[s < support and x < step for s in range(len(L.EXPERT_SUPPORTS)) for x in range(len(L.CONFIDENCES))] for support in range(len(L.EXPERT_SUPPORTS) + 1) for step in steps]


class _Sets:
    """The distinct sets (bits) that a group's items, given by their codes, make under some tests, and which one each test
    makes. Groups of equal codes share the answer."""

    def __init__(self, passes: list[list[bool]]):
        self.passes, self.known = [[t for t, good in enumerate(row) if good] for row in passes], {}
        self.many = len(passes[0])

    def __call__(self, codes: tuple[int, ...]) -> tuple[list[int], np.ndarray]:
        if (out := self.known.get(codes)) is None:
            sets = [0] * self.many
            for k, code in enumerate(codes):
                for t in self.passes[code]:
                    sets[t] |= 1 << k
            place: dict[int, int] = {}
            at = np.array([place.setdefault(x, len(place)) for x in sets])
            out = list(place), at
            if len(codes) <= 16:
                if len(self.known) >= 20_000:
                    self.known.clear()
                self.known[codes] = out
        return out


def _bits(bits: int) -> list[int]:
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


def _folded(order: list[int], items: list[tuple], strict: bool, near: dict) -> list[int]:
    """select.without_redundant() over places of items: (start, end, plain, weak, anchor, borders)."""
    kept: list[int] = []
    for new in order:
        start, end, plain, weak, anchor, border = items[new]
        for k, old in enumerate(kept):
            o = items[old]
            pair = (old, new) if old < new else (new, old)
            if (close := near.get(pair)) is None:
                shared = max(0, min(end, o[1]) - max(start, o[0]))
                close = shared / max(1, min(end - start, o[1] - o[0])) >= 0.85
                if not close and plain and o[2]:
                    close = plain == o[2] or strict and (plain in o[2] or o[2] in plain)
                if len(near) < 100_000:
                    near[pair] = close
            if close:
                if o[3] and not weak or (border >= o[5] if anchor and not o[4] else border > o[5]):
                    kept[k] = new
                break
        else:
            kept.append(new)
    return kept


def _grid_fold(batches: Iterator[pa.RecordBatch], edges: np.ndarray | None, picks: bool) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (items, gold, text or tokens), a row a document: sums of _SUMS, a row a task for each label's
    configuration that chooses a token.

    A rule keeps what its votes keep, what its experts keep, and what is rescued: a group has as many selections as distinct
    sets by votes times distinct sets by experts, times two. Each is folded and counted once. Tokens are bits."""
    by_votes, by_experts = _Sets(_by_votes()), _Sets(_by_experts())
    n_fixed, shape = len(L.FIXED_MODES), (by_votes.many, by_experts.many, 2)
    grid_of: dict[str, np.ndarray] = {}
    fixed_of: dict[str, list[list[int]]] = {}
    gold_of: Counter = Counter()

    def group(label: str, items: list[tuple], tokens: list[int], gold: int, votes: tuple, experts: tuple, supports: tuple, rescued: tuple) -> None:
        strict, near = label in L.STRICT_LABELS, {}

        def counted(kept: list[int]) -> tuple[int, int]:
            bits = 0
            for k in kept:
                bits |= tokens[k]
            return bits.bit_count(), (bits & gold).bit_count()

        fixed = fixed_of.setdefault(label, [[0, 0] for _ in range(n_fixed)])
        n = len(items)
        agreed = [votes[k].bit_count() >= 2 or rescued[k] for k in range(n)]
        first = [k for k in range(n) if items[k][4] and not items[k][3]]
        modes = {
            "expert_consensus_verified": _folded([k for k in range(n) if not items[k][3] and (supports[k] or agreed[k])], items, strict, near),
            "pubmedbert_plus_verified": _folded(first + [k for k in range(n) if not items[k][4] and agreed[k]], items, strict, near), "registry_filtered": range(n),
        }
        for name, kept in modes.items():
            for x, many in enumerate(counted(kept)):
                fixed[L.FIXED_MODES.index(name)][x] += many
        good = [k for k in range(n) if not items[k][3]]
        if not good:
            return
        (vd, iv), (ed, ie) = by_votes(tuple(votes[k] for k in good)), by_experts(tuple(experts[k] for k in good))
        saved, known = sum(1 << j for j, k in enumerate(good) if rescued[k]), {0: (0, 0)}
        made = np.empty((len(vd), len(ed), 2, 2), np.int64)
        for a, v in enumerate(vd):
            for b, e in enumerate(ed):
                for r in (0, 1):
                    chosen = v | e | (saved if r else 0)
                    if (sums := known.get(chosen)) is None:
                        sums = known[chosen] = counted(_folded([good[j] for j in _bits(chosen)], items, strict, near))
                    made[a, b, r] = sums
        if label not in grid_of:
            grid_of[label] = np.zeros((*shape, 2), np.int64)
        grid_of[label] += made[iv[:, None], ie]

    def whole(part: pa.RecordBatch) -> None:
        n_items, n_gold = I.lengths(part["items"]), I.lengths(part["gold"])
        flat, spans = part["items"].flatten(), part["gold"].flatten()
        if edges is None:
            many = I.lengths(part["tokens"])
            pieces, base = part["tokens"].flatten(), np.cumsum(many) - many
            of, t_start, t_end = np.repeat(np.arange(part.num_rows), many), I.field(pieces, "start").astype(np.int64), I.field(pieces, "end").astype(np.int64)
        else:
            _, ends, t_start, t_end = T.token_places(part["text"], edges)
            of = np.searchsorted(ends, t_start, "right")
            many = np.bincount(of, minlength=part.num_rows)
            base, before = np.cumsum(many) - many, np.concatenate([[0], ends[:-1]])
            t_start, t_end = t_start - before[of], t_end - before[of]
        i_doc, g_doc = np.repeat(np.arange(part.num_rows), n_items), np.repeat(np.arange(part.num_rows), n_gold)
        (i_start, i_end), (g_start, g_end) = ((I.field(x, "start").astype(np.int64), I.field(x, "end").astype(np.int64)) for x in (flat, spans))
        move = I.shifts(part.num_rows, t_start, t_end, i_start, i_end, g_start, g_end)
        starts, stops = t_start + move[of], t_end + move[of]

        def bits(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[int]:
            low, high = np.searchsorted(stops, start + move[doc], "right") - base[doc], np.searchsorted(starts, end + move[doc], "left") - base[doc]
            return [(1 << h) - (1 << w) if h > w else 0 for w, h in zip(low.tolist(), high.tolist(), strict=True)]

        gold: dict[tuple[int, str], int] = {}
        for doc, label, b in zip(g_doc.tolist(), spans.field("label").to_pylist(), bits(g_doc, g_start, g_end), strict=True):
            gold[doc, label] = gold.get((doc, label), 0) | b
        for (_, label), b in gold.items():
            gold_of[label] += b.bit_count()
        if not len(flat):
            return
        tokens = bits(i_doc, i_start, i_end)
        labels = flat.field("label").dictionary_encode()
        codes, names = labels.indices.to_numpy(), labels.dictionary.to_pylist()
        order = np.lexsort((I.field(flat, "number"), codes, i_doc))
        flag = lambda name: pc.fill_null(flat.field(name), False).to_numpy(zero_copy_only=False)
        votes = sum(pc.fill_null(flat.field(r), False).to_numpy(zero_copy_only=False).astype(np.int64) << k for k, r in enumerate(select.V.ROLES))
        support = pc.fill_null(flat.field("support"), 0).to_numpy(zero_copy_only=False)
        experts = np.searchsorted(L.EXPERT_SUPPORTS, support, "right") * (len(L.CONFIDENCES) + 1) + np.searchsorted(L.CONFIDENCES, I.field(flat, "confidence"), "right")
        border = zip(*(flat.field("boundary").field(c).to_pylist() for c in _BORDER), strict=True)
        items = list(zip(i_start.tolist(), i_end.tolist(), flat.field("plain").to_pylist(), flag("weak").tolist(), flag("anchor").tolist(), border, strict=True))
        votes, experts, supports, rescued = votes.tolist(), experts.tolist(), (support >= 2).tolist(), flag("rescued").tolist()
        fits, picked = (flag("fits").tolist(), flag("picked").tolist()) if picks else ([], [])
        doc, code = i_doc[order], codes[order]
        heads = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])])).tolist()
        places, docs, of_label = order.tolist(), doc.tolist(), code.tolist()
        for k, to in zip(heads, [*heads[1:], len(places)], strict=True):
            mine, label = places[k:to], names[of_label[k]]
            wanted = gold.get((docs[k], label), 0)
            if picks:
                chosen = 0
                for j in mine:
                    chosen |= tokens[j] if picked[j] else 0
                fixed = fixed_of.setdefault(label, [[0, 0] for _ in range(n_fixed)])[L.FIXED_MODES.index("recommended")]
                fixed[0] += chosen.bit_count()
                fixed[1] += (chosen & wanted).bit_count()
                mine = [j for j in mine if fits[j]]
            of_group = lambda column: tuple(column[j] for j in mine)
            group(label, [items[j] for j in mine], [tokens[j] for j in mine], wanted, of_group(votes), of_group(experts), of_group(supports), of_group(rescued))

    for part in I.sliced(batches, lambda b: I.lengths(b["items"]) + I.lengths(b["gold"]) + 1, 100_000):
        whole(part)
    rows = [(label, _GOLD, many, 0) for label, many in gold_of.items()]
    rows += [(label, k, p, tp) for label, sums in fixed_of.items() for k, (p, tp) in enumerate(sums) if p]
    for label, sums in grid_of.items():
        rows += [(label, n_fixed + k, p, tp) for k, (p, tp) in enumerate(sums.reshape(-1, 2).tolist()) if p]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["label", "config_id", "p", "tp"])


def grid_scored(features: DataFrame, docs: DataFrame, gold: DataFrame | Column, recommended: DataFrame | None = None) -> DataFrame:
    """scored() of the fixed modes and the whole grid, in one row a document. docs: doc_id (each once) and the text, or arrays
    of tokens.

    gold: doc_id, label, start, end; or, where gold follows from candidates, a struct of start and end beside them, null for
    those that are none, so that features are read once."""
    spark, keys = features.sparkSession, ["doc_id", "label", "candidate_id"]
    if recommended is not None:
        features = features.join(apart(recommended.select(*keys).distinct().withColumn("picked", F.lit(True))), keys, "left")
    flags = ["fits", "picked"] if recommended is not None else []
    item = F.struct(*_KEPT, *flags, F.struct(*(F.col(f"boundary.{c}").alias(c) for c in _BORDER)).alias("boundary"), *((F.col(r) == "keep").alias(r) for r in select.V.ROLES))
    item = F.when(F.col("fits") | F.coalesce("picked", F.lit(False)) if flags else F.col("fits"), item).alias("item")
    span = lambda of: F.struct("label", of["start"].cast("int").alias("start"), of["end"].cast("int").alias("end"))
    if isinstance(gold, Column):
        sides = features.withColumn("_gold", gold).select("doc_id", item, F.when(F.col("_gold").isNotNull(), span(F.col("_gold"))).alias("gold"))
    else:
        given = gold.select("doc_id", span({"start": F.col("start"), "end": F.col("end")}).alias("gold"))
        sides = features.select("doc_id", item).unionByName(given, allowMissingColumns=True)
    rows = sides.filter("item IS NOT NULL OR gold IS NOT NULL").groupBy("doc_id").agg(F.collect_list("item").alias("items"), F.collect_list("gold").alias("gold"))
    texts = "text" in docs.columns
    rows = rows.join(apart(docs.select("doc_id", "text" if texts else "tokens")), "doc_id").drop("doc_id")
    edges, picks = T.word_edges(spark) if texts else None, recommended is not None
    sums = rows.mapInArrow(lambda batches: _grid_fold(batches, edges, picks), _SUMS).groupBy("config_id", "label").agg(F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    # One branch, so that documents are folded once: a row a label, with a list of its configurations.
    of_label = sums.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("config_id", F.struct("p", "tp")))).alias("sums"))
    configs = grid(spark).select("config_id", "label").unionByName(fixed_modes(spark).select("config_id", "label")).join(of_label, "label", "left")
    found = F.try_element_at("sums", F.col("config_id"))
    return _rated(configs.select("config_id", "label", found["p"].alias("p"), found["tp"].alias("tp"), F.try_element_at("sums", F.lit(_GOLD))["p"].alias("g")))


def best(scores: DataFrame, prefer: str = "f1") -> DataFrame:
    """The best row of each label; of equal ones the first of the grid."""
    order = {"f1": ("f1", "recall", "precision"), "recall": ("recall", "f1", "precision"), "precision": ("precision", "f1", "recall")}[prefer]
    first = Window.partitionBy("label").orderBy(*(F.desc(c) for c in order), "config_id")
    return scores.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def tuned(features: DataFrame, tokens: DataFrame, gold: DataFrame, configs: DataFrame, prefer: str = "f1", modes: DataFrame | None = None, recommended: DataFrame | None = None) -> DataFrame:
    return best(scored(features, tokens, gold, configs, modes, recommended), prefer)


def split(records: DataFrame, key: str, sizes: list[tuple[str, int]], seed: int = 13, rest: str = "test") -> DataFrame:
    """records with a column split: the first sizes in the order of a seeded hash, then the rest.

    Ranks are taken inside ranges of the hash, so no task sees all rows; the order is fixed by seed and key."""
    wanted = sum(n for _, n in sizes)
    keyed = records.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    head = keyed.select("_h", key).orderBy("_h", key).limit(wanted)  # as many rows as the sizes ask for
    place = head.withColumn("_n", F.row_number().over(Window.orderBy("_h", key)))
    upto, name = 0, F.lit(rest)
    cases = []
    for label, n in sizes:
        upto += n
        cases.append((upto, label))
    for bound, label in reversed(cases):
        name = F.when(F.col("_n") <= bound, label).otherwise(name)
    return keyed.join(place.select(key, "_n"), key, "left").withColumn("split", F.when(F.col("_n").isNull(), rest).otherwise(name)).drop("_h", "_n")
