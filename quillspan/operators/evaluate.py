"""Metrics of predicted against gold spans: spans, characters, tokens, presence, boundaries, confusions, recall.

Inputs are gold(doc_id, label, start, end) and predicted(doc_id, label, start, end), rows counted as they are. Every
metric has a row for each label, also for labels without spans; micro sums labels and macro averages them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import intervals as I
from ..functions import labels as L
from ..functions import text as T
from ..sources.store import apart
from .candidates import label_ord

NONE = "NONE"


def label_dim(spark) -> DataFrame:
    return spark.createDataFrame([(k, x) for k, x in enumerate(L.LABELS)], "ord int, label string")


def _all_labels(counts: DataFrame, columns: list[str]) -> DataFrame:
    """counts by label with zeros for absent labels."""
    dim = label_dim(counts.sparkSession).select("label")
    return dim.join(counts, "label", "left").select("label", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in columns))


def rolled_up(counts: DataFrame, accuracy: bool = False) -> DataFrame:
    """label, tp, fp, fn (, tn), precision, recall, f1 (, accuracy) with rows micro and macro (whose counts are null)."""
    names = ["tp", "fp", "fn", *(["tn"] if accuracy else [])]

    def scored(rows: DataFrame) -> DataFrame:
        tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
        more = [T.ratio(tp + F.col("tn"), tp + fp + fn + F.col("tn")).alias("accuracy")] if accuracy else []
        return rows.select("label", *names, *T.f_scores(tp, fp, fn), *more)

    each = scored(_all_labels(counts, names))
    micro = scored(each.agg(*(F.sum(c).alias(c) for c in names)).withColumn("label", F.lit("micro")))
    metrics = ["precision", "recall", "f1", *(["accuracy"] if accuracy else [])]
    macro = each.agg(*(F.avg(c).alias(c) for c in metrics)).select(F.lit("macro").alias("label"), *(F.lit(None).cast("long").alias(c) for c in names), *metrics)
    return each.unionByName(micro).unionByName(macro)


def sides(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """doc_id, label, start, end, side (g or p) of both inputs: what the metrics of one pass read."""
    keys = ["doc_id", "label", "start", "end"]
    return gold.select(*keys, F.lit("g").alias("side")).unionByName(predicted.select(*keys, F.lit("p").alias("side")))


def exact_of(both: DataFrame) -> DataFrame:
    """A gold key that is predicted counts once; repeated predictions are false. One pass over sides()."""
    g, p = F.col("side") == "g", F.col("side") == "p"
    keys = both.groupBy("doc_id", "label", "start", "end").agg(F.count_if(g).alias("g"), F.count_if(p).alias("p"))
    sums = keys.groupBy("label").agg(F.count_if((F.col("g") > 0) & (F.col("p") > 0)).alias("tp"), F.sum("g").alias("g"), F.sum("p").alias("p"))
    return rolled_up(sums.select("label", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn")))


def exact_metrics(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    return exact_of(sides(gold, predicted))


def _lists(both: DataFrame, by: list[str], order: bool) -> DataFrame:
    """Gold and predicted spans of each group as arrays; their places are their indices.

    The order is that of a column ord where the input has one, else that of label, start and end."""
    place = [F.col("ord").alias("place")] if order else []
    item = F.struct(*place, label_ord(F.col("label")).alias("o"), "start", "end", "label")
    lists = [F.array_sort(F.collect_list(F.when(F.col("side") == side, item))).alias(name) for side, name in (("g", "gs"), ("p", "ps"))]
    return both.groupBy(*by).agg(*lists)


def _matched(lists: DataFrame, threshold: float) -> DataFrame:
    """lists with a column m: the pairs (score, i, j) that are matched, best first. Rows are independent groups."""
    names = lists.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in I.sliced(batches, lambda b: I.lengths(b["gs"]) + I.lengths(b["ps"])):
            sides, bases = [], []
            for side in ("gs", "ps"):
                many, spans = I.lengths(part[side]), part[side].flatten()
                sides.append((np.repeat(np.arange(part.num_rows), many), I.field(spans, "start").astype(np.int64), I.field(spans, "end").astype(np.int64)))
                bases.append(np.cumsum(many) - many)
            i, j, score = (np.array(x) for x in I.greedy_matches(*sides, part.num_rows, threshold))
            i, j = i.astype(np.int64), j.astype(np.int64)
            row = sides[0][0][i]
            pairs = pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array((i - bases[0][row]).astype(np.int32)), pa.array((j - bases[1][row]).astype(np.int32))], ["score", "i", "j"])
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=part.num_rows)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(part[c] for c in names), pa.ListArray.from_arrays(pa.array(ends), pairs)], [*names, "m"])

    return lists.mapInArrow(run, StructType([*lists.schema.fields, *StructType.fromDDL("m array<struct<score:double,i:int,j:int>>").fields]))


def greedy_of(both: DataFrame, threshold: float, same_label: bool = True) -> DataFrame:
    """One-to-one matches by overlap over hull, best first; ties go to the later gold, then the later prediction.

    A document's candidate pairs are folded in that order; documents are independent. both: sides(), with a column ord
    where spans stand in an order of their own."""
    lists = _lists(both, ["doc_id", "label"] if same_label else ["doc_id"], "ord" in both.columns)
    folded = _matched(lists, threshold).select("doc_id", "gs", "ps", F.explode("m").alias("m"))
    a, b = F.get("gs", F.col("m.i")), F.get("ps", F.col("m.j"))
    return folded.select("doc_id", a["label"].alias("gold_label"), b["label"].alias("label"), a["start"].alias("g_start"), a["end"].alias("g_end"), b["start"].alias("start"), b["end"].alias("end"), F.col("m.score").alias("score"))


def greedy_matches(gold: DataFrame, predicted: DataFrame, threshold: float, same_label: bool = True) -> DataFrame:
    if "ord" in gold.columns and "ord" in predicted.columns:
        keys = ["doc_id", "label", "start", "end", "ord"]
        both = gold.select(*keys, F.lit("g").alias("side")).unionByName(predicted.select(*keys, F.lit("p").alias("side")))
        return greedy_of(both, threshold, same_label)
    return greedy_of(sides(gold, predicted), threshold, same_label)


def relaxed_of(both: DataFrame, threshold: float) -> DataFrame:
    """Counts by greedy matches. One pass over sides(): sizes and matches come from the same arrays."""
    lists = _matched(_lists(both, ["doc_id", "label"], "ord" in both.columns), threshold)
    sums = lists.groupBy("label").agg(F.sum(F.size("m")).alias("tp"), F.sum(F.size("gs")).alias("g"), F.sum(F.size("ps")).alias("p"))
    return rolled_up(sums.select("label", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn")))


def relaxed_metrics(gold: DataFrame, predicted: DataFrame, threshold: float) -> DataFrame:
    return relaxed_of(sides(gold, predicted), threshold)


def covered(spans: DataFrame) -> DataFrame:
    """Spans of each document and label merged where they overlap or touch."""
    from pyspark.sql import Window

    by = Window.partitionBy("doc_id", "label").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.filter("end > start").withColumn("fresh", F.when(reach >= F.col("start"), 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "label", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def character_metrics(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Counts of characters by interval arithmetic: no character becomes a row."""
    g, p = covered(gold), covered(predicted)
    total = lambda x, name: x.groupBy("label").agg(F.sum(F.col("end") - F.col("start")).alias(name))
    a, b = g.alias("a"), p.alias("b")
    met = a.join(apart(b), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")))
    shared = met.select(F.col("a.label").alias("label"), T.overlap(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end")).alias("n")).groupBy("label").agg(F.sum("n").alias("tp"))
    sums = total(g, "g").join(total(p, "p"), "label", "full").join(shared, "label", "left").na.fill(0)
    return rolled_up(sums.select("label", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn")))


def flagged_of(tokens: DataFrame, both: DataFrame) -> DataFrame:
    """doc_id, ord, g, p: tokens with the labels of gold and predicted spans that overlap them, as bit sets by label
    order. tokens: doc_id and an array of start and end.

    A document's spans meet its tokens before they become rows; borders of each side and label are sorted once and
    searched for each token, so that a document costs its tokens and spans times a logarithm."""
    item = F.struct("start", "end", label_ord(F.col("label")).alias("o"), (F.col("side") == "p").alias("p"))
    lists = both.filter("end > start").filter(F.col("label").isin(L.LABELS)).groupBy("doc_id").agg(F.collect_list(item).alias("spans"))
    met = tokens.select("doc_id", "tokens").join(apart(lists), "doc_id", "left").select("doc_id", "tokens", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in I.sliced(batches, lambda b: I.lengths(b["tokens"]) + I.lengths(b["spans"])):
            many, own = I.lengths(part["tokens"]), part["tokens"].flatten()
            spans, of = part["spans"].flatten(), np.repeat(np.arange(part.num_rows), I.lengths(part["spans"]))
            row = np.repeat(np.arange(part.num_rows), many)
            t_start, t_end, s_start, s_end = (I.field(x, c).astype(np.int64) for x in (own, spans) for c in ("start", "end"))
            move = I.shifts(part.num_rows, t_start, t_end, s_start, s_end)
            label, predicted = I.field(spans, "o"), I.field(spans, "p").astype(bool)
            flags = {False: np.zeros(len(row), np.int32), True: np.zeros(len(row), np.int32)}
            for side, bits in flags.items():
                for k in np.unique(label[predicted == side]).tolist():
                    some = (predicted == side) & (label == k)
                    hit = I.met((s_start + move[of])[some], (s_end + move[of])[some], t_start + move[row], t_end + move[row])
                    bits |= hit.astype(np.int32) << int(k)
            places = np.arange(len(row)) - (np.cumsum(many) - many)[row]
            yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(row)), pa.array(places.astype(np.int32)), pa.array(flags[False]), pa.array(flags[True])], ["doc_id", "ord", "g", "p"])

    return met.mapInArrow(run, StructType([tokens.schema["doc_id"], *StructType.fromDDL("ord int, g int, p int").fields]))


def _flagged(tokens: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    if "tokens" not in tokens.columns:
        lists = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "start", "end"))).alias("tokens"))
        tokens = lists.select("doc_id", F.transform("tokens", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("tokens"))
    return flagged_of(tokens, sides(gold, predicted))


def _bit(column: str, k: int) -> Column:
    return F.col(column).bitwiseAND(F.lit(1 << k)) != 0


def token_metrics(tokens: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One-vs-rest counts over tokens that overlap a span of the label. tokens: doc_id, ord, start, end, or arrays."""
    return token_counts_of(_flagged(tokens, gold, predicted))


def token_counts_of(flags: DataFrame) -> DataFrame:
    """The counts of token_metrics() from tokens with their bit sets."""
    counts = flags.agg(*(F.count_if(c).alias(f"{name}{k}") for k in range(len(L.LABELS)) for name, c in (("tp", _bit("g", k) & _bit("p", k)), ("fp", ~_bit("g", k) & _bit("p", k)), ("fn", _bit("g", k) & ~_bit("p", k)), ("tn", ~_bit("g", k) & ~_bit("p", k)))))
    rows = F.explode(F.array(*(F.struct(F.lit(x).alias("label"), *(F.col(f"{n}{k}").alias(n) for n in ("tp", "fp", "fn", "tn"))) for k, x in enumerate(L.LABELS)))).alias("r")
    return rolled_up(counts.select(rows).select("r.*"), accuracy=True)


def _top_label(column: str) -> Column:
    """The last label of a bit set, NONE for an empty one."""
    out = F.lit(NONE)
    for k, name in enumerate(L.LABELS):
        out = F.when(_bit(column, k), name).otherwise(out)
    return out


def token_assignment(flags: DataFrame) -> DataFrame:
    """One row: tokens whose single label (the last one in order on overlaps) is right, among all and among labelled.

    flags: flagged_of()."""
    both = flags.select(_top_label("g").alias("g"), _top_label("p").alias("p"))
    right, named = F.col("g") == F.col("p"), (F.col("g") != NONE) | (F.col("p") != NONE)
    sums = both.agg(F.count_if(right).alias("correct_tokens"), F.count("*").alias("total_tokens"), F.count_if(right & named).alias("labeled_correct_tokens"), F.count_if(named).alias("labeled_total_tokens"))
    return sums.withColumn("accuracy", T.ratio(F.col("correct_tokens"), F.col("total_tokens"))).withColumn("labeled_accuracy", T.ratio(F.col("labeled_correct_tokens"), F.col("labeled_total_tokens")))


def _confusion(pairs: DataFrame, gold_names: list[str]) -> DataFrame:
    """gold_label, predicted_label, n for every cell; pairs: gold_label, predicted_label, n."""
    spark = pairs.sparkSession
    cells = spark.createDataFrame([(a, b) for a in gold_names for b in [*L.LABELS, NONE]], "gold_label string, predicted_label string")
    sums = pairs.groupBy("gold_label", "predicted_label").agg(F.sum("n").alias("n"))
    return cells.join(sums, ["gold_label", "predicted_label"], "left").select("gold_label", "predicted_label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def token_confusion(flags: DataFrame) -> DataFrame:
    both = flags.select(_top_label("g").alias("gold_label"), _top_label("p").alias("predicted_label"), F.lit(1).alias("n"))
    return _confusion(both, [*L.LABELS, NONE])


def character_confusion(docs: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Cells by characters, the first label in order winning on overlaps. docs: doc_id, length.

    A document is cut at all span borders; a sweep gives each piece its gold and its predicted label, and a batch its
    cells."""
    item = F.struct("start", "end", label_ord(F.col("label")).alias("o"), (F.col("side") == "p").alias("p"))
    lists = sides(gold, predicted).filter("end > start").filter(F.col("label").isin(L.LABELS)).groupBy("doc_id").agg(F.collect_list(item).alias("spans"))
    met = docs.select("doc_id", F.col("length").cast("long").alias("length")).filter("length > 0").join(apart(lists), "doc_id", "left").select("length", "spans")
    names = [*L.LABELS, NONE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in I.sliced(batches, lambda b: I.lengths(b["spans"]) + 1):
            size = part["length"].to_numpy()
            spans, of = part["spans"].flatten(), np.repeat(np.arange(part.num_rows), I.lengths(part["spans"]))
            move = np.cumsum(size) - size
            start, end = (np.clip(I.field(spans, c).astype(np.int64), 0, size[of]) + move[of] for c in ("start", "end"))
            label, predicted = I.field(spans, "o"), I.field(spans, "p").astype(bool)
            cuts = np.unique(np.concatenate((move, move + size, start, end)))
            from_, to = cuts[:-1], cuts[1:]
            tops = []
            for side in (False, True):
                top = np.full(len(from_), len(L.LABELS))
                for k in range(len(L.LABELS) - 1, -1, -1):
                    some = (predicted == side) & (label == k) & (end > start)
                    top[I.met(start[some], end[some], from_, to)] = k
                tops.append(top)
            cells = np.zeros((len(names), len(names)), np.int64)
            np.add.at(cells, tuple(tops), to - from_)
            g, p = np.nonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in g], pa.string()), pa.array([names[k] for k in p], pa.string()), pa.array(cells[g, p])], ["gold_label", "predicted_label", "n"])

    return _confusion(met.mapInArrow(run, "gold_label string, predicted_label string, n long"), names)


def presence_metrics(docs: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Documents that have a label or not, for each label. docs: doc_id."""
    return presence_of(docs, sides(gold, predicted))


def presence_of(docs: DataFrame, both: DataFrame) -> DataFrame:
    """presence_metrics() in one pass over sides(): what a document's label has crosses as two flags."""
    n = docs.select("doc_id").distinct().agg(F.count("*").alias("docs"))
    g, p = (F.max((F.col("side") == x).cast("int")).alias(x) for x in ("g", "p"))
    has = both.filter("doc_id IS NOT NULL").groupBy("doc_id", "label").agg(g, p)
    counts = has.groupBy("label").agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"))
    each = _all_labels(counts, ["tp", "fp", "fn"]).crossJoin(F.broadcast(n))  # one row on the right side
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return each.select("label", "tp", "fp", "fn", (F.col("docs") - tp - fp - fn).alias("tn"), *T.f_scores(tp, fp, fn))


def boundary_errors(both: DataFrame) -> DataFrame:
    """Of matched spans (same label, any overlap): exact borders, mean errors, longer and shorter ones. both: sides()."""
    m = greedy_of(both, 0.01)
    ds, de = F.col("start") - F.col("g_start"), F.col("end") - F.col("g_end")
    sums = m.groupBy("label").agg(
        F.count("*").alias("matched_spans"), F.count_if((ds == 0) & (de == 0)).alias("exact"), F.sum(F.abs(ds)).alias("ds"), F.sum(F.abs(de)).alias("de"),
        F.count_if((ds < 0) | (de > 0)).alias("overextended"), F.count_if((ds > 0) | (de < 0)).alias("underextended"),
    )
    each = _all_labels(sums, ["matched_spans", "exact", "ds", "de", "overextended", "underextended"])
    n = F.col("matched_spans")
    return each.select("label", "matched_spans", T.ratio(F.col("exact"), n).alias("exact_boundary_accuracy"), T.ratio(F.col("ds"), n).alias("mean_absolute_start_error"), T.ratio(F.col("de"), n).alias("mean_absolute_end_error"), "overextended", "underextended")


def matched_confusion(both: DataFrame) -> DataFrame:
    """Labels of gold spans and of what they are matched to whatever its label, NONE for unmatched ones. both: sides()."""
    lists = _matched(_lists(both, ["doc_id"], "ord" in both.columns), 0.01)
    free = F.filter("gs", lambda a, i: ~F.exists("m", lambda x: x["i"] == i))
    rows = F.concat(
        F.transform("m", lambda x: F.struct(F.get("gs", x["i"])["label"].alias("gold_label"), F.get("ps", x["j"])["label"].alias("predicted_label"))),
        F.transform(free, lambda a: F.struct(a["label"].alias("gold_label"), F.lit(NONE).alias("predicted_label"))),
    )
    pairs = lists.select(F.explode(rows).alias("r")).select("r.*", F.lit(1).alias("n"))
    return _confusion(pairs, L.LABELS)


def oracle_recall(gold: DataFrame, registry: DataFrame, threshold: float | None = None) -> DataFrame:
    """How many gold spans the registry holds, exactly or by overlap."""
    if threshold is None:
        keys = ["doc_id", "label", "start", "end"]
        matched = gold.join(apart(registry.select(*keys).distinct()), keys, "left_semi").groupBy("label").agg(F.count("*").alias("matched"))
    else:
        matched = greedy_matches(gold, registry, threshold).groupBy("label").agg(F.count("*").alias("matched"))
    sums = gold.groupBy("label").agg(F.count("*").alias("gold_spans")).join(matched, "label", "left")
    each = _all_labels(sums, ["gold_spans", "matched"])
    rows = each.unionByName(each.agg(F.lit("micro").alias("label"), F.sum("gold_spans").alias("gold_spans"), F.sum("matched").alias("matched")))
    return rows.withColumn("recall", T.ratio(F.col("matched"), F.col("gold_spans")))


def registry_token_recall(flags: DataFrame) -> DataFrame:
    """Gold tokens that some candidate of the label overlaps; macro averages labels. flags: flagged_of() with the
    registry's spans on the predicted side."""
    m = token_counts_of(flags).filter("label <> 'macro'")
    rows = m.select("label", (F.col("tp") + F.col("fn")).alias("gold_tokens"), F.col("tp").alias("matched_gold_tokens"))
    rows = rows.withColumn("recall", T.ratio(F.col("matched_gold_tokens"), F.col("gold_tokens")))
    macro = rows.filter("label <> 'micro'").agg(F.lit("macro").alias("label"), F.lit(None).cast("long").alias("gold_tokens"), F.lit(None).cast("long").alias("matched_gold_tokens"), F.avg("recall").alias("recall"))
    return rows.unionByName(macro)


def per_document(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Counts and set-based exact scores of each document."""
    keys = ["doc_id", "label", "start", "end"]
    g, p = gold.select(*keys).distinct().withColumn("g", F.lit(1)), predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    both = g.join(apart(p), keys, "full").na.fill(0, ["g", "p"])
    sums = both.groupBy("doc_id").agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"))
    return sums.select("doc_id", "tp", "fp", "fn", *T.f_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def report(docs: DataFrame, tokens: DataFrame, both: DataFrame) -> DataFrame:
    """family, label, tp, fp, fn, precision, recall, f1 of the exact, relaxed, character, token and presence families.

    tokens: doc_id and arrays of tokens. both: sides(), best a stored table, since each family reads it once or twice."""
    gold, predicted = both.filter("side = 'g'"), both.filter("side = 'p'")
    families = {"exact": exact_of(both), "relaxed_50": relaxed_of(both, 0.5), "relaxed_75": relaxed_of(both, 0.75), "character": character_metrics(gold, predicted), "token": token_counts_of(flagged_of(tokens, both)), "presence": presence_metrics(docs, gold, predicted)}
    out = None
    for name, rows in families.items():
        rows = rows.select(F.lit(name).alias("family"), "label", "tp", "fp", "fn", "precision", "recall", "f1")
        out = rows if out is None else out.unionByName(rows)
    return out
