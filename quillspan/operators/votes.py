"""Votes and agreement: review partitions, vote matrices, kappas, consistency, consensus, weighted fractions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..sources.store import apart

ROLES = L.EXPERTS


def review_partition(reviews: DataFrame) -> DataFrame:
    """reviews (keep_ids, reject_ids, assigned_ids) with unknown, overlap and missing ids, emptiness and validity."""
    keep, reject = (F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")) for c in ("keep_ids", "reject_ids"))
    sent = F.array_union(keep, reject)
    out = reviews.withColumn("unknown_ids", F.array_sort(F.array_except(sent, "assigned_ids"))).withColumn("overlap_ids", F.array_sort(F.array_intersect(keep, reject)))
    out = out.withColumn("missing_ids", F.array_except("assigned_ids", sent)).withColumn("empty_review", (F.size("assigned_ids") > 0) & (F.size(sent) == 0))
    return out.withColumn("valid", (F.size("unknown_ids") == 0) & (F.size("overlap_ids") == 0) & (F.size("missing_ids") == 0) & ~F.col("empty_review"))


def normalized_review(reviews: DataFrame) -> DataFrame:
    """reviews (decisions, keep_ids, reject_ids, assigned_ids) with lists of kept and rejected ids, their validation, and
    the map `decided`, which is empty where ids are unknown or contradict each other, or nothing was sent.

    The lists of ids count only where the decisions hold no keep and no reject."""
    of = lambda what: F.coalesce(F.transform(F.filter("decisions", lambda d: d["decision"] == what), lambda d: F.trim(d["candidate_id"])), F.array().cast("array<string>"))
    both = F.size(of("keep")) + F.size(of("reject")) == 0
    lists = {c: F.when(both, F.coalesce(F.col(c), F.array().cast("array<string>"))).otherwise(of(what)) for c, what in (("keep_ids", "keep"), ("reject_ids", "reject"))}
    out = review_partition(reviews.withColumns(lists))
    usable = (F.size("unknown_ids") == 0) & (F.size("overlap_ids") == 0) & ~F.col("empty_review")
    known = lambda c, what: F.transform(F.filter(F.array_distinct(F.transform(c, lambda x: F.trim(x))), lambda x: F.array_contains("assigned_ids", x)), lambda x: F.struct(x.alias("key"), F.lit(what).alias("value")))
    pairs = F.when(usable, F.concat(known("keep_ids", "keep"), known("reject_ids", "reject"))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    return out.withColumn("decided", F.map_from_entries(pairs))


def expert_of_role(role: Column) -> Column:
    """The expert whose name a role is or begins with; otherwise what stands before the first underscore."""
    out = F.substring_index(role, "_", 1)
    for name in L.EXPERTS:
        out = F.when((role == name) | role.startswith(name + "_"), name).otherwise(out)
    return out


def label_consensus(reviews: DataFrame, selected: DataFrame, matrix: DataFrame, by: list[str], keys: list[str], unresolved: DataFrame | None = None) -> DataFrame:
    """consensus() of each group, and whether it also holds for the reviews: all roles complete, no unknown or
    contradicting ids, no unresolved expansion (unresolved: rows of open requests by group)."""
    sums = reviews.groupBy(*by).agg(F.count_distinct("role").alias("roles"), F.bool_and("valid").alias("valid"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("unknown_ids")))).alias("unknown_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("overlap_ids")))).alias("overlap_ids"))
    out = sums.join(apart(consensus(selected, matrix, by, keys)), by, "left").na.fill(0, ["selected", "unanimous", "majority", "unresolved"])
    if unresolved is not None:
        out = out.join(apart(unresolved.groupBy(*by).agg(F.count("*").alias("open_requests"))), by, "left")
    else:
        out = out.withColumn("open_requests", F.lit(0))
    complete = (F.col("roles") == len(ROLES)) & F.col("valid")
    agreed = complete & (F.col("selected") > 0) & (F.size("unknown_ids") == 0) & (F.size("overlap_ids") == 0) & (F.col("unresolved") == 0) & (F.coalesce("open_requests", F.lit(0)) == 0)
    return out.select(*by, complete.alias("review_complete"), "selected", "unanimous", "majority", "unresolved", "unknown_ids", "overlap_ids", agreed.alias("consensus_reached"))


def merged_decisions(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The decision of the latest attempt for each key."""
    return attempts.groupBy(*keys).agg(F.max_by("decision", "attempt").alias("decision"))


def vote_matrix(candidates: DataFrame, votes: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with one column a role: keep, reject or missing; see voted()."""
    return voted(candidates.select(*keys), votes, keys)


def voted(candidates: DataFrame, votes: DataFrame, keys: list[str]) -> DataFrame:
    """All columns of candidates, and one column a role: keep, reject or missing. A rejection wins over other votes of its role.

    Candidates and votes meet in one aggregate by their keys, which names each candidate; equal null keys count as equal.
    Where both lie by some of the keys (store.placed), rows stay where they are. Votes on nothing known are left out."""
    others = [c for c in candidates.columns if c not in keys]
    row = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(True)
    code = F.when(F.col("decision") == "reject", 2).when(F.col("decision") == "keep", 1)
    known = candidates.select(*keys, row.alias("_row"), *(F.lit(None).cast("int").alias(f"_{k}") for k in range(len(ROLES))))
    none = F.lit(None).cast(known.schema["_row"].dataType)
    cast = votes.select(*keys, none.alias("_row"), *(F.when(F.col("role") == r, code).alias(f"_{k}") for k, r in enumerate(ROLES)))
    met = known.unionByName(cast).groupBy(*keys).agg((F.first("_row", ignorenulls=True) if others else F.max("_row")).alias("_row"), *(F.max(f"_{k}").alias(f"_{k}") for k in range(len(ROLES))))
    decided = [F.when(F.col(f"_{k}") == 2, "reject").when(F.col(f"_{k}") == 1, "keep").otherwise("missing").alias(r) for k, r in enumerate(ROLES)]
    columns = [F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in candidates.columns]
    return met.filter("_row IS NOT NULL").select(*columns, *decided)


def _cohen(n: Column, agree: Column, keep_a: Column, keep_b: Column) -> Column:
    po = agree / n
    pe = (keep_a / n) * (keep_b / n) + ((n - keep_a) / n) * ((n - keep_b) / n)
    return F.when(n == 0, None).when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))


def pairwise_agreement(matrix: DataFrame, by: list[str]) -> DataFrame:
    """For each pair of roles: rated by both, raw agreement, kappa, Jaccard of what they keep (1 when both keep nothing)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("left_role"), F.lit(b).alias("right_role"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in combinations(ROLES, 2)))).alias("p")
    rated = matrix.select(*by, pairs).select(*by, "p.*")
    both = (F.col("a") != "missing") & (F.col("b") != "missing")
    count = lambda c: F.coalesce(F.sum(F.when(both, c.cast("int"))), F.lit(0)).cast("long")
    ka, kb = F.col("a") == "keep", F.col("b") == "keep"
    sums = rated.groupBy(*by, "left_role", "right_role").agg(count(F.lit(True)).alias("n"), count(F.col("a") == F.col("b")).alias("agree"), count(ka).alias("keep_a"), count(kb).alias("keep_b"), count(ka & kb).alias("keep_both"), count(ka | kb).alias("keep_any"))
    n = F.col("n")
    return sums.select(
        *by, "left_role", "right_role", "n",
        F.when(n > 0, F.col("agree") / n).alias("raw_agreement"),
        F.when(n > 0, _cohen(n, F.col("agree"), F.col("keep_a"), F.col("keep_b"))).alias("cohen_kappa"),
        F.when(F.col("keep_any") == 0, 1.0).otherwise(F.col("keep_both") / F.col("keep_any")).alias("keep_set_jaccard"),
    )


def fleiss(matrix: DataFrame, by: list[str]) -> DataFrame:
    """Fleiss' kappa over the rows that all roles rated; null where there is none."""
    k = len(ROLES)
    keeps = sum((F.col(r) == "keep").cast("int") for r in ROLES)
    rated = matrix.filter(" AND ".join(f"{r} <> 'missing'" for r in ROLES)).withColumn("keeps", keeps)
    x = F.col("keeps")
    sums = rated.groupBy(*by).agg(F.count("*").alias("n"), F.sum("keeps").alias("keep"), F.avg((x * x + (k - x) * (k - x) - k) / (k * (k - 1))).alias("p"))
    share = F.col("keep") / (F.col("n") * k)
    pe = share * share + (1 - share) * (1 - share)
    return sums.select(*by, "n", F.when(pe == 1, F.when(F.col("p") == 1, 1.0).otherwise(0.0)).otherwise((F.col("p") - pe) / (1 - pe)).alias("fleiss_kappa"))


def consistency(matrix: DataFrame, by: list[str]) -> DataFrame:
    """Counts of rows that all roles rated, agree on or split over, and the unanimity rate."""
    rated = F.lit(True)
    for r in ROLES:
        rated = rated & (F.col(r) != "missing")
    keep = sum((F.col(r) == "keep").cast("int") for r in ROLES)
    n = len(ROLES)
    sums = matrix.groupBy(*by).agg(
        F.count("*").alias("n_candidates"), F.count_if(rated).alias("reviewed_by_all"), F.count_if(rated & (keep == n)).alias("unanimous_keep"),
        F.count_if(rated & (keep == 0)).alias("unanimous_reject"), F.count_if(rated & keep.between(1, n - 1)).alias("conflicted"), F.count_if(~rated).alias("missing_decision"),
    )
    rate = F.when(F.col("reviewed_by_all") > 0, (F.col("unanimous_keep") + F.col("unanimous_reject")) / F.col("reviewed_by_all"))
    return sums.withColumn("unanimity_rate", rate)


def consensus(selected: DataFrame, matrix: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """For each group: whether something is selected and every role keeps all of it; majority and unresolved counts."""
    keep = sum((F.col(r) == "keep").cast("int") for r in ROLES)
    joined = selected.select(*keys).join(apart(matrix), keys, "left").withColumn("keeps", F.coalesce(keep, F.lit(0)))
    sums = joined.groupBy(*by).agg(
        F.count("*").alias("selected"), F.count_if(F.col("keeps") == len(ROLES)).alias("unanimous"), F.count_if(F.col("keeps") >= 2).alias("majority"), F.count_if(F.col("keeps") < len(ROLES)).alias("unresolved")
    )
    return sums.withColumn("consensus_reached", (F.col("selected") > 0) & (F.col("unresolved") == 0))


def weighted_keep(weights: Column, roles: list[str] | None = None) -> Column:
    """Share of the weights (an array in the order of the roles) whose role keeps; missing roles stay in the total."""
    roles = roles or ROLES
    safe = F.transform(weights, lambda w: F.greatest(F.lit(0.0), F.coalesce(w.cast("double"), F.lit(1.0))))
    total = F.aggregate(safe, F.lit(0.0), lambda a, x: a + x)
    kept = sum(F.when(F.col(r) == "keep", F.element_at(safe, k + 1)).otherwise(0.0) for k, r in enumerate(roles))
    return F.when(total <= 0, 0.0).otherwise(kept / total)


def vote_threshold(value: Column) -> Column:
    """A threshold as a number; near 0.67 it means two thirds, and so does what is no number."""
    x = value.try_cast("double")
    return F.when(x.isNull() | (F.abs(x - 0.67) < 0.005), 2 / 3).otherwise(x)
