"""More queries of the driver contract: prompts, reviews, proofs, records and repairs over whole tables, and the span
operators over prose that no template made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, json_repair, prompts
from ..functions import labels as L
from ..functions import rules as R
from ..functions import text as T
from ..sources.store import apart
from ..operators import calibrate, candidates, evaluate, generate, meta, realign, requests, select, votes
from ..sources import records, store
from ..sources.studies import CTE, studies
from . import catalogue as C
from . import oracle as O
from .catalogue import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]  # those of catalogue, with this module's


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


# --- text -----------------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, start::int AS start, "end"::int AS "end", text FROM ({O.offsets('documents', 'doc_id', "regexp_extract_all(text, '[^,;:]+|[,;:]', 0, 's')")}) WHERE NOT regexp_matches(text, '^([,;:]|\\s+)$')""")
def comma_clauses_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("text"))
    return C._documents(spark, sf_dir).select("doc_id", F.explode(T.clauses(span, ",;:", False)).alias("c")).select("doc_id", "c.*")


_SQUEEZED = "regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \\t\\r\\f\\x0B]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g')"


@query(f"""WITH f AS (SELECT conv_id, turn, regexp_replace({_SQUEEZED}, '^[ \\n\\t.;]+|[ \\n\\t.;]+$', '', 'g') AS comparable, regexp_replace(lower({O.clean('text')}), '^[ .,:;-]+|[ .,:;-]+$', '', 'g') AS b FROM conversations)
    SELECT conv_id, turn, comparable, regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '^study design[ :.-]+', ''), '^design[ :.-]+', ''), '^statistical analysis[ :.-]+', ''), '^analysis[ :.-]+', '') AS plain FROM f""")
def annotation_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _conversations(spark, sf_dir).select("conv_id", "turn", T.comparable(text).alias("comparable"), T.boundary_normalized(text).alias("plain"))


def _cue_test(text: str, cues: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {O.q(c.lower())})" for c in cues) + ")"


@query(f"WITH {CTE}, u AS ({C._units_sql('studies')}) " + " UNION ALL ".join(f"SELECT doc_id, sentence_id, '{x}' AS label FROM u WHERE {_cue_test('text', cues)}" for x, cues in L.CUES.items()))
def cued_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = generate.units(studies(spark, sf_dir))
    held = F.array_compact(F.array(*(F.when(T.any_cue(F.col("text"), cues), F.lit(x)) for x, cues in L.CUES.items())))
    return units.select("doc_id", "sentence_id", F.explode(held).alias("label"))


# --- prompts ----------------------------------------------------------------------------------------------------------


_CONTEXT = """substring(s.text, greatest(start - 180, 0) + 1, start - greatest(start - 180, 0)) || '<<' || substring(s.text, start + 1, "end" - start) || '>>' || substring(s.text, "end" + 1, 180)"""
_EXCERPT = "CASE WHEN length(c.text) <= 900 THEN c.text ELSE left(c.text, 446) || ' [...] ' || right(c.text, 446) END"


@query(f"""{O.candidates_cte()} SELECT doc_id, label, candidate_id, candidate_id || ' [' || label || '] offsets=' || start || ':' || "end" || ' experts=' || array_to_string(list_sort(experts), ',') || ' confidence={{' || array_to_string(list_transform(list_sort(experts), lambda e: e || ': ' || confidence::varchar), ', ') || '}}'
    || chr(10) || 'text_excerpt=' || {_EXCERPT} || chr(10) || 'boundary_context=' || {_CONTEXT} AS line, coalesce(list_sort(experts)[1], 'none') || '_' || label || '_DoctorAgent' AS doctor, label || '_MetaAgent' AS meta, coalesce(list_sort(experts)[1], 'none') AS expert
    FROM cands c JOIN studies s USING (doc_id)""")
def candidate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.pattern_candidates(spark, sf_dir).join(apart(studies(spark, sf_dir).select("doc_id", F.col("text").alias("source"))), "doc_id")
    item = F.struct("candidate_id", "label", "start", "end", "text", "proposed_by_experts", "confidence_by_expert")
    doctor = prompts.doctor_role(F.coalesce(F.get("proposed_by_experts", F.lit(0)), F.lit("none")), F.col("label"))
    return rows.select("doc_id", "label", "candidate_id", prompts.candidate_line(item, F.col("source")).alias("line"), doctor.alias("doctor"), prompts.meta_role(F.col("label")).alias("meta"), votes.expert_of_role(doctor).alias("expert"))


@query("SELECT conv_id, turn, greatest(16, least(1024, 8192 - (greatest(1, length(role) // 4) + greatest(1, length(text) // 4) + 32) - 64))::int AS tokens FROM conversations")
def completion_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    budget = prompts.completion_budget(F.col("role"), F.col("text"), 1024, prompts.WINDOWS[0], 64, 16)
    return _conversations(spark, sf_dir).select("conv_id", "turn", budget.cast("int").alias("tokens"))


@query("SELECT doc_id, '[local guideline: ' || source || '] ' || CASE WHEN length(text) <= 1400 THEN text ELSE rtrim(left(text, 1382)) || ' ...[truncated]' END AS snippet, ((doc_id // 7)::int) AS batch FROM documents")
def guideline_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C._documents(spark, sf_dir)
    return docs.select("doc_id", prompts.local_snippet(F.col("source"), F.col("text")).alias("snippet"), prompts.batch_of(F.col("doc_id"), 7).alias("batch"))


@query("""WITH RECURSIVE i AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, greatest(1, length(text) // 4) AS n FROM conversations),
    r AS (SELECT conv_id, turn, k, 0 AS batch, n AS total, 1 AS many FROM i WHERE k = 1
        UNION ALL SELECT i.conv_id, i.turn, i.k, r.batch + x.f, CASE WHEN x.f = 1 THEN 0 ELSE r.total END + i.n, CASE WHEN x.f = 1 THEN 0 ELSE r.many END + 1
        FROM r JOIN i ON i.conv_id = r.conv_id AND i.k = r.k + 1, LATERAL (SELECT (r.total + i.n > 150 OR r.many >= 3)::int AS f) x)
    SELECT conv_id, turn::bigint AS ord, batch::int AS batch FROM r""")
def adaptive_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _conversations(spark, sf_dir).select("conv_id", F.col("turn").alias("ord"), "text")
    return requests.batches(items, 150, 3, "conv_id")


_SHOWN = "count(*)::int AS most_decisions, min(candidate_id) AS first_id, max(candidate_id) AS last_id"


@query(f"""{O.candidates_cte()} SELECT doc_id, label, label AS asked_label, {_SHOWN}, {len(answers.ISSUES)} AS n_issues, (SELECT count(*) FROM ({C._units_sql('studies')}) u WHERE u.doc_id = cands.doc_id)::int AS n_sentences, 5 AS most_expansions, 3 AS most_searches FROM cands GROUP BY ALL""")
def answer_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What schemas of reviews and label decisions allow, read from the schemas' JSON: one of each for a document's label."""
    docs = studies(spark, sf_dir).select("doc_id", F.transform(T.source_units(F.col("text")), lambda u: u["sentence_id"]).alias("sentences"))
    shown = C.pattern_candidates(spark, sf_dir).groupBy("doc_id", "label").agg(F.array_sort(F.collect_list("candidate_id")).alias("ids")).join(apart(docs), "doc_id")
    made = shown.select("doc_id", "label", answers.review_column(F.col("ids"), F.col("label")).alias("r"), answers.label_decision_column(F.col("ids"), F.col("sentences"), F.col("label")).alias("m"))
    of = lambda c, *path: F.get_json_object(c, "$.properties." + ".".join(path))
    one, asked = "decisions.items.properties", "expansion_requests.items.properties"
    ids = F.from_json(of("r", one, "candidate_id.enum"), "array<string>")
    return made.select(
        "doc_id", "label", of("r", asked, "label.enum[0]").alias("asked_label"), of("r", "decisions.minItems").cast("int").alias("most_decisions"), F.get(ids, F.lit(0)).alias("first_id"),
        F.element_at(F.from_json(of("m", "selected_candidate_ids.items.enum"), "array<string>"), -1).alias("last_id"), F.json_array_length(of("r", one, "issue_type.enum")).alias("n_issues"),
        F.json_array_length(of("m", asked, "sentence_id.enum")).alias("n_sentences"), of("m", "expansion_requests.maxItems").cast("int").alias("most_expansions"), of("m", "source_search_requests.maxItems").cast("int").alias("most_searches"),
    )


# --- reviews, proofs, requests ----------------------------------------------------------------------------------------------


_ATTEMPTS = " UNION ALL ".join(f"SELECT doc_id, label, candidate_id, {k} AS attempt, CASE ({O.SEED} + {5 * k}) % 3 WHEN 0 THEN 'keep' ELSE 'reject' END AS decision FROM cands WHERE {O.SEED} % {k + 1} = 0" for k in range(3))


@query(f"{O.candidates_cte()}, a AS ({_ATTEMPTS}) SELECT doc_id, label, candidate_id, arg_max(decision, attempt) AS decision FROM a GROUP BY ALL")
def review_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = C._seed()
    tries = [F.when(seed % (k + 1) == 0, F.struct(F.lit(k).alias("attempt"), F.when((seed + 5 * k) % 3 == 0, "keep").otherwise("reject").alias("decision"))) for k in range(3)]
    rows = C.pattern_candidates(spark, sf_dir).select("doc_id", "label", "candidate_id", F.explode(F.array_compact(F.array(*tries))).alias("t"))
    return votes.merged_decisions(rows.select("doc_id", "label", "candidate_id", "t.*"), ["doc_id", "label", "candidate_id"])


_PROOFS = f"""{O.candidates_cte()}, u AS ({C._units_sql('studies')}), chosen AS (SELECT doc_id, label, candidate_id, text, {O.SEED} AS seed FROM feature WHERE fits),
    proofs AS (SELECT *, 0 AS ord, printf('S%04d', 1 + seed % 3) AS sid FROM chosen UNION ALL SELECT *, 1, printf('S%04d', 1 + seed % 9) FROM chosen),
    good AS (SELECT p.doc_id, p.label, p.candidate_id, p.ord, p.sid, row_number() OVER (PARTITION BY p.doc_id, p.label, p.candidate_id ORDER BY p.ord) AS n FROM proofs p JOIN u ON u.doc_id = p.doc_id AND u.sentence_id = p.sid AND contains(u.text, p.text))"""


def _proofs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Selected candidates, and their first valid proofs of two that each names."""
    rows = store.stored(C.pattern_candidates(spark, sf_dir).filter(R.passes_filter(F.col("label"), F.col("text"))).withColumn("seed", C._seed()), "chosen")
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("ord"), F.format_string("S%04d", 1 + F.col("seed") % n).alias("evidence_sentence_id")) for k, n in ((0, 3), (1, 9))))).alias("p")
    proofs = rows.select("doc_id", "label", "candidate_id", F.col("text").alias("evidence_quote"), named).select("*", "p.*", F.lit("fits").alias("label_fit_rationale"), F.lit(None).cast("string").alias("boundary_rationale"))
    return rows, meta.valid_proofs(proofs, rows, generate.units(studies(spark, sf_dir)), ["doc_id", "label"])


@query(f"{_PROOFS} SELECT doc_id, label, candidate_id, ord, sid AS evidence_sentence_id, 'fits' AS label_fit_rationale, '' AS boundary_rationale FROM good WHERE n = 1")
def valid_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, good = _proofs(spark, sf_dir)
    return good.select("doc_id", "label", "candidate_id", "ord", "evidence_sentence_id", "label_fit_rationale", "boundary_rationale")


@query(f"{_PROOFS} SELECT doc_id, label, candidate_id FROM chosen ANTI JOIN good USING (doc_id, label, candidate_id)")
def missing_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, good = _proofs(spark, sf_dir)
    return meta.missing_proofs(rows.select("doc_id", "label", "candidate_id"), good, ["doc_id", "label"])


_NOT_REJECTED = " AND ".join(f"{e} <> 'reject'" for e in L.EXPERTS)


@query(f"{O.candidates_cte()} SELECT doc_id, label, candidate_id, issue AS reason FROM feature WHERE fits AND {_NOT_REJECTED}")
def strict_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the filter leaves and nobody rejects: here a missing vote is a kept one."""
    cands = C._stored_candidates(spark, sf_dir)
    matrix = C._matrix(cands)
    kind = matrix.select("doc_id", "label", "candidate_id", *(F.when(F.col(e) == "missing", "keep").otherwise(F.col(e)).alias(e) for e in L.EXPERTS))
    chosen = cands.filter(R.passes_filter(F.col("label"), F.col("text"))).select("doc_id", "label", "candidate_id")
    return meta.strict_selected(chosen, cands, kind, ["doc_id", "label"])


_OPERATIONS = ("exact_quote_proposal", "split_by_clause", "split_by_sentence", "expand_to_sentence_start", "expand_to_sentence_end", "search_missing_label", "generate_number_centered_span", "trim_left")
_REQUESTS = f"""{O.candidates_cte()}, seeded AS (SELECT *, {O.SEED} AS seed FROM cands), asked AS (SELECT doc_id, (start * 100000 + "end" * 10 + {O.ORD})::int AS ord, label, ([{R.quoted(_OPERATIONS)}])[seed % 8 + 1] AS requested_operation,
    CASE WHEN seed % 8 IN (1, 2, 3, 4) THEN CASE WHEN seed % 5 = 0 THEN 'XXX-C9999' ELSE candidate_id END END AS parent_candidate_id, CASE WHEN seed % 8 = 3 AND seed % 3 = 0 THEN 'S9999' END AS sentence_id,
    CASE WHEN seed % 8 = 0 THEN CASE WHEN seed % 3 = 0 THEN 'no such words' ELSE string_split(text, ' ')[-1] END END AS proposed_text FROM seeded)"""


@query(f"""{_REQUESTS}, joint AS (SELECT *, 0 AS side FROM asked WHERE ord % 3 > 0 UNION ALL SELECT *, 1 FROM asked WHERE ord % 3 <> 1),
    once AS (SELECT doc_id, label, requested_operation, parent_candidate_id, sentence_id, proposed_text, min([side, ord]) AS first FROM joint GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY first, requested_operation, parent_candidate_id NULLS FIRST, sentence_id NULLS FIRST, proposed_text NULLS FIRST) AS n FROM once)
    SELECT doc_id, label, requested_operation, parent_candidate_id, sentence_id, proposed_text FROM n WHERE n <= 5""")
def merged_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewers' requests and the meta agent's, some of which both make: the first five of a label."""
    asked = store.stored(C._requests(spark, sf_dir, C._stored_candidates(spark, sf_dir)), "asked")
    return requests.merged(asked.filter("ord % 3 > 0"), asked.filter("ord % 3 <> 1"), 5)


# --- lookups, final spans, grid ---------------------------------------------------------------------------------------------


@query(f"""{O.candidates_cte()}, s AS (SELECT * FROM ({ORACLE_SQL['selection_by_source_mode']})) SELECT s.doc_id, s.label, pos, candidate_id, start::int AS start, "end"::int AS "end", text FROM s JOIN cands USING (doc_id, label, candidate_id)""")
def applied_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.applied(C._placed_features(spark, sf_dir), C._rules(spark))


@query(f"""{O.candidates_cte()} SELECT doc_id, label, (number - 1)::int AS pos, candidate_id, start::int AS start, "end"::int AS "end", text FROM cands WHERE {O.SEED} % 4 <> 0""")
def tolerant_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of which each fourth is unknown to the registry: known ones get their spans, the others are left out."""
    cands = C._stored_candidates(spark, sf_dir)
    ids = cands.select("doc_id", "label", (F.col("number") - 1).alias("pos"), F.when(C._seed() % 4 == 0, F.concat("candidate_id", F.lit("x"))).otherwise(F.col("candidate_id")).alias("candidate_id"))
    return candidates.spans_of(ids, cands, strict=False).select("doc_id", "label", "pos", "candidate_id", "start", "end", "text")


_RULE = f"{C._SHARE} >= CASE WHEN abs(min_vote_fraction - 0.67) < 0.005 THEN 2 / 3.0::double ELSE min_vote_fraction END OR (support >= min_expert_support AND top >= min_confidence) OR (use_high_quality_rescue AND rescued)"


@query(f"""{O.candidates_cte()}, {C._GRID}, ok AS (SELECT label, {', '.join(L.EXPERTS)}, support, CASE WHEN support > 0 THEN confidence ELSE 0 END AS top, rescued FROM feature WHERE fits AND NOT weak)
    SELECT config_id, label, (SELECT count(*) FROM ok WHERE ok.label = grid.label AND ({_RULE})) AS n_chosen FROM grid""")
def config_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates each rule of the grid takes. Candidates that no rule can tell apart are counted first: what is
    left is bounded by the votes, experts and steps of confidence."""
    rows = C._features(spark, sf_dir).filter("fits AND NOT weak")
    step = F.array_max(F.filter(F.array(*(F.lit(float(x)) for x in L.CONFIDENCES)), lambda x: F.col("confidence") >= x))
    kinds = rows.groupBy("label", *L.EXPERTS, "support", step.alias("confidence"), "rescued").agg(F.count("*").alias("n"))
    grid = calibrate.grid(spark)
    met = grid.join(kinds.hint("merge"), "label", "left")
    taken = (votes.weighted_keep(F.col("vote_weights")) >= votes.vote_threshold(F.col("min_vote_fraction"))) | ((F.col("support") >= F.col("min_expert_support")) & (F.col("confidence") >= F.col("min_confidence"))) | (F.col("use_high_quality_rescue") & F.col("rescued"))
    return met.groupBy("config_id", "label").agg(F.sum(F.when(taken, F.col("n")).otherwise(0)).cast("long").alias("n_chosen"))


# --- records and repairs ----------------------------------------------------------------------------------------------------


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3")
def limited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id")
    return records.limited(docs, 3, "source", "doc_id")


@query(f"""{O.candidates_cte()} SELECT doc_id, label, start::int AS start, "end"::int AS "end", text FROM cands WHERE {O.SEED} % 5 > 1""")
def gold_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations as JSON records and back: a cancelled annotation comes first, other items and labels stand between."""
    kind = F.when(C._seed() % 5 == 0, "choices").otherwise("labels")
    label = F.when(C._seed() % 5 == 1, "Foreign").otherwise(F.col("label"))
    item = F.struct(kind.alias("type"), F.struct("start", "end", "text", F.array(label, F.lit("Second")).alias("labels")).alias("value"))
    lists = C.pattern_candidates(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(item).alias("result"))
    cancelled, kept = (F.struct(F.lit(c).alias("was_cancelled"), F.col("result")) for c in (True, False))
    rows = lists.select(F.lit("all.json").alias("source_file"), F.col("doc_id").alias("record_index"), F.parse_json(F.to_json(F.struct(F.array(cancelled, kept).alias("annotations")))).alias("record"))
    return records.gold_items(rows).select(F.col("record_index").alias("doc_id"), "label", "start", "end", "text")


_SAVE = {"type": "object", "properties": {"lang": {"type": "string"}, "text": {"type": "string"}, "ids": {"type": "array"}}}
_HOW = "CASE doc_id % 5 WHEN 0 THEN 'whole' WHEN 1 THEN 'whole' WHEN 2 THEN 'inner' WHEN 3 THEN 'tidied' ELSE 'salvaged' END"


@query(f"SELECT doc_id, {_HOW} AS how, lang, sha256(CASE WHEN doc_id % 5 = 4 THEN '' ELSE text END) AS text_sha256, CASE WHEN doc_id % 5 = 4 THEN 0 ELSE 2 END AS n_ids FROM documents")
def repaired_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as answers of a model: plain, fenced, inside prose, with idle commas, and cut inside the text."""
    docs = C._documents(spark, sf_dir).filter("text IS NOT NULL")
    made, turn = F.to_json(F.struct("lang", F.array(F.col("doc_id"), F.lit(7)).alias("ids"), "text")), F.col("doc_id") % 5
    head = F.to_json(F.struct("lang"))
    spoiled = (
        F.when(turn == 0, made).when(turn == 1, F.concat(F.lit("```json\n"), made, F.lit("\n```"))).when(turn == 2, F.concat(F.lit("The answer is: "), made, F.lit(" Good luck!")))
        .when(turn == 3, F.concat(F.substring(made, 1, F.length(made) - 1), F.lit(" , }"))).otherwise(F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(", \"text\": \""), F.replace(F.translate("text", "\\\"", "  "), F.lit("\n"), F.lit("\\n"))))
    )
    got = docs.select("doc_id", json_repair.repair_column(spoiled, _SAVE).alias("r"))
    saved = F.from_json("r.object", "lang string, text string, ids array<long>")
    return got.select("doc_id", "r.how", saved.alias("o")).select("doc_id", "how", "o.lang", F.sha2("o.text", 256).alias("text_sha256"), F.size("o.ids").alias("n_ids"))


@query(f"""{O.candidates_cte()}, g AS (SELECT doc_id, label, start + ({O.SEED} % 3) * 2 + 1 AS gs, "end" + ({O.SEED} % 3) * 2 + 1 AS ge, text, replace(text, ' ', ' ' || chr(10)) AS wide FROM cands WHERE contains(text, ' ')),
    p AS (SELECT g.*, list_filter(range(0, length(s.text) - length(g.text) + 1), lambda i: substring(s.text, i + 1, length(g.text)) = g.text) AS hits FROM g JOIN studies s USING (doc_id)),
    n AS (SELECT *, list_sort(list_transform(hits, lambda i: [abs(i - gs), i]))[1][2] AS found FROM p)
    SELECT doc_id, label, gs::int AS start, ge::int AS "end", wide AS text, found::int AS new_start, (found + length(text))::int AS new_end, 'whitespace_repair' AS status, abs(gs - found)::int AS moved FROM n""")
def gold_realign_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = lambda c: (F.col(c) + (C._seed() % 3) * 2 + 1).cast("int").alias(c)
    gold = C.pattern_candidates(spark, sf_dir).filter(F.col("text").contains(" ")).select("doc_id", "label", moved("start"), moved("end"), F.replace("text", F.lit(" "), F.lit(" \n")).alias("text"))
    return realign.realigned(gold, studies(spark, sf_dir))


# --- span operators over prose ------------------------------------------------------------------------------------------------


@query(" UNION ALL ".join(f'SELECT doc_id, label, start::int AS start, "end"::int AS "end", text, method FROM ({O.matches_sql("documents", "doc_id", "text", x, n, p)})' for x, found in L.patterns().items() for n, p in found))
def pattern_spans_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.pattern_spans(C._documents(spark, sf_dir))


_PIECES = f"""pieces AS (SELECT doc_id, 'Outcome' AS label, start, "end", text FROM ({C._clause_sql('documents')}) UNION ALL SELECT doc_id, 'SampleSize', start, "end", text FROM ({O.offsets('documents', 'doc_id', C.TOKEN_PIECES)}) WHERE NOT regexp_matches(text, '^\\s+$'))"""


@query(f"""WITH {_PIECES}, v AS (SELECT d.lang, label, {O.validation('d.text', 'label', 'p.text', 'start', '"end"')} AS reason FROM pieces p JOIN documents d USING (doc_id)) SELECT lang, label, reason, count(*) AS n FROM v GROUP BY ALL""")
def validation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses and tokens of all texts as candidates, and what the rules say of them.

    Pieces meet their text inside its row and leave it behind; each distinct piece of some megabytes is judged once."""
    counts = generate.piece_counts(C._documents(spark, sf_dir), {"clause": "Outcome", "token": "SampleSize"}, "lang")
    label, text = F.col("label"), F.col("text")
    rows = counts.withColumns({"plain": R.stripped(text), "clean": T.clean(text)}).withColumn("low", F.lower("clean")).withColumn("words", R.words_of(F.col("low")))
    issue = R.boundary_issue(label, text, tuple(F.col(c) for c in ("clean", "low", "words")))
    reason = R.reason(label, text, F.col("outside"), F.col("other"), F.col("plain"), issue)
    return rows.select("lang", "label", reason.alias("reason"), "n").groupBy("lang", "label", "reason").agg(F.sum("n").alias("n"))


_PROSE = f"""WITH numbered AS (SELECT doc_id, start, "end", row_number() OVER (PARTITION BY doc_id ORDER BY start) AS n FROM ({C._units_sql('documents')})), dim AS (SELECT unnest([{R.quoted(L.LABELS)}]) AS label),
    gold AS (SELECT doc_id, ([{R.quoted(L.LABELS)}])[doc_id % {len(L.LABELS)} + 1] AS label, start, "end" FROM numbered), pred AS (SELECT doc_id, ([{R.quoted(L.LABELS)}])[doc_id % {len(L.LABELS)} + 1] AS label, start, "end" FROM ({C._clause_sql('documents')}))"""


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as gold spans and clauses as predicted ones, one label a document."""
    docs = C._documents(spark, sf_dir).filter("text IS NOT NULL")
    label = F.element_at(F.array(*(F.lit(x) for x in L.LABELS)), (F.col("doc_id") % len(L.LABELS) + 1).cast("int")).alias("label")
    whole = F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("text"))
    of = lambda spans, side: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(side).alias("side")))
    rows = docs.select("doc_id", label, F.explode(F.concat(of(T.source_units(F.col("text")), "g"), of(T.clauses(whole), "p"))).alias("s"))
    return rows.select("doc_id", "label", "s.start", "s.end", "s.side")


@query(C._relaxed_sql(0.5).replace(O.gold_cte(), _PROSE))
def relaxed_metrics_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C._rounded(evaluate.relaxed_of(_prose(spark, sf_dir), 0.5), "precision", "recall", "f1")
