"""SQL for DuckDB that states operators a second time, for comparing results. Builders of SQL text."""

from __future__ import annotations

from ..functions import labels as L
from ..functions import rules as R
from ..sources.studies import CTE as STUDIES

SPACES = r"[ \t\n\r\f\v]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def normalized(x: str) -> str:
    return f"trim(lower({clean(x)}), ' .,:;()[]{{}}')"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, {q(chr(91) + 'A-Za-z0-9]+(?:[-' + chr(39) + '][A-Za-z0-9]+)?')}))"


def has(x: str, pattern: str, options: str = "s") -> str:
    return f"regexp_matches({x}, {q(pattern)}, '{options}')"


def any_cue(x: str, cues: list[str]) -> str:
    return f"list_bool_or(list_transform([{R.quoted([c.lower() for c in cues])}], lambda c: contains(lower({x}), c)))"


def trim_sides(text: str, start: str) -> tuple[str, str]:
    """Start and text of a span after trimming white space, then closing signs left and opening signs right."""
    bare = f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"
    lead = f"(length({text}) - length(ltrim({text}, ' ' || chr(9) || chr(10) || chr(13))))"
    left = f"ltrim({bare}, {q(',;:)]}”’' + chr(34) + chr(39))})"
    out = f"rtrim({left}, {q(',;:([{“‘' + chr(34) + chr(39))})"
    return f"({start} + {lead} + length({bare}) - length({left}))", out


def comparison(low: str) -> str:
    return f"(trim({low}, ' .,:;()[]{{}}') NOT IN ({R.quoted(L.WEAK_COMPARISON)}) AND {any_cue(low, L.FILTER_CUES['ComparisonGroup'])})"


def fits(label: str, text: str) -> str:
    p, low = clean(text), f"lower({clean(text)})"
    shapes = " OR ".join([has(p, L.COUNT_SHAPES_CASED[0]), *(has(low, x) for x in L.COUNT_SHAPES)])
    rejects = " OR ".join(has(low, x) for x in L.OUTCOME_REJECTS)
    rest = " ".join(f"WHEN '{x}' THEN {any_cue(low, L.FILTER_CUES[x])}" for x in ("Participant", "DesignDescription", "StatisticalAnalysis"))
    return f"""({p} <> '' AND CASE {label}
        WHEN 'SampleSize' THEN {has(p, chr(92) + 'd')} AND NOT {has(low, L.NUMBER_REJECTS)} AND NOT {has(p, '^[0-9]+(?:[.][0-9]+)?%$')} AND ({shapes})
        WHEN 'Outcome' THEN NOT ({rejects}) AND {any_cue(low, L.FILTER_CUES['Outcome'])}
        WHEN 'ComparisonGroup' THEN {comparison(low)}
        WHEN 'Intervention' THEN NOT ({comparison(low)} AND NOT {has(low, L.INTERVENTION_WORDS)}) AND {any_cue(low, L.FILTER_CUES['Intervention'])}
        {rest} ELSE true END)"""


def weak(label: str, text: str, anchor: str) -> str:
    n, low = words(clean(text)), normalized(text)
    return f"""CASE {label} WHEN 'Outcome' THEN {n} <= 1 AND {low} IN ({R.quoted(L.WEAK_OUTCOME)})
        WHEN 'SampleSize' THEN NOT {has(text, chr(92) + 'd')} OR ({n} = 1 AND NOT {anchor})
        WHEN 'ComparisonGroup' THEN {n} <= 1 OR {low} IN ({R.quoted(L.WEAK_COMPARISON)}) ELSE false END"""


def quality(label: str, text: str) -> str:
    low = f"lower({clean(text)})"
    cases = []
    for name, parts in L.QUALITY.items():
        points = [f"{n} * {has(low, p)}::int" for p, n in parts]
        if name != "SampleSize":
            points.append(f"({words(low)} >= 2)::int")
        cases.append(f"WHEN '{name}' THEN {' + '.join(points)}")
    return f"CASE {label} {' '.join(cases)} ELSE 0 END"


def boundary_issue(label: str, text: str) -> str:
    p, low = clean(text), f"lower({clean(text)})"
    found = f"regexp_extract_all({low}, '[A-Za-z]+(?:-[A-Za-z]+)?')"
    opening = ")]}”’" + chr(34) + chr(39) + ",;:"
    return f"""CASE WHEN {p} = '' THEN 'whitespace_only'
        WHEN contains({q(opening)}, left({p}, 1)) THEN 'starts_with_closing_punctuation'
        WHEN {has(low, '^(?:ure|ation|tion|ment|ness|ing|ed|ly)-')} AND len(string_split({p}, ' ')) <= 4 THEN 'possible_midword_start'
        WHEN {found}[-1] IN ({R.quoted(L.TRAILING_WORDS)}) THEN 'incomplete_trailing_word'
        WHEN {label} = 'StatisticalAnalysis' AND {has(p, '^[A-Za-z]{2,5}$')} AND {low} NOT IN ({R.quoted(L.METHOD_CUES)}) THEN 'short_statistical_fragment'
        WHEN {label} = 'StatisticalAnalysis' AND len({found}) < 3 AND NOT {any_cue(low, L.METHOD_CUES)} THEN 'insufficient_statistical_evidence' END"""


DASH = r"[-\x{2010}-\x{2015}]"


def validation(source: str, label: str, text: str, start: str, end: str) -> str:
    p = f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"
    return f"""CASE WHEN {label} NOT IN ({R.quoted(L.LABELS)}) THEN 'unsupported_label'
        WHEN {start} < 0 OR {end} <= {start} OR {end} > length({source}) THEN 'invalid_offsets'
        WHEN substring({source}, {start} + 1, {end} - {start}) <> {text} THEN 'text_offset_mismatch'
        WHEN {p} = '' THEN 'whitespace_only'
        WHEN {has(p, '^[[:punct:]]+$')} THEN 'punctuation_only'
        WHEN lower({p}) IN ({R.quoted(L.STOPWORDS)}) THEN 'isolated_stopword'
        WHEN {has(p, '^' + chr(92) + 'p{L}$')} THEN 'one_character_alphabetic_fragment'
        WHEN {has(p, '^##')} OR {has(p, f'^{DASH}?[A-Za-z]{{1,2}}{DASH}?$')} OR (length({p}) <= 20 AND {has(p, '^[A-Za-z]{2,}' + DASH + '$')}) THEN 'broken_subword_fragment'
        WHEN (length({p}) <= 2 AND NOT {has(p, '^' + chr(92) + 'p{N}+$')}) OR (length({p}) <= 50 AND len(string_split({clean(text)}, ' ')) <= 6 AND {has(p, '[A-Za-z]-' + chr(92) + 's+[A-Za-z]')})
            OR (length({p}) - length(replace({p}, chr(10), '')) >= 3 AND list_max(list_transform(string_split({p}, chr(10)), lambda x: length(trim(x)))) <= 3) THEN 'malformed_pdf_fragment'
        WHEN {label} = 'SampleSize' AND {has(p, '^[(]' + chr(92) + 's*[Nn]' + chr(92) + 's*=')} AND NOT ends_with({p}, ')') THEN 'incomplete_sample_size_parenthesis'
        ELSE coalesce({boundary_issue(label, text)}, 'accepted') END"""


def offsets(rows: str, key: str, pieces: str, where: str = "true") -> str:
    """A query of key, ord, start, end, text over a relation whose expression `pieces` tiles a text."""
    return f"""SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY k) - 1 AS ord, (sum(length(text)) OVER (PARTITION BY {key} ORDER BY k))::bigint - length(text) AS start,
        (sum(length(text)) OVER (PARTITION BY {key} ORDER BY k))::bigint AS "end", text
        FROM (SELECT {key}, unnest({pieces}) AS text, generate_subscripts({pieces}, 1) AS k FROM {rows}) WHERE {where}"""


def matches_sql(rows: str, key: str, text: str, label: str, name: str, pattern: str) -> str:
    """key, label, start, end, text, method of a pattern's trimmed matches: gaps and matches by two lists."""
    found, gaps = f"regexp_extract_all({text}, {q(pattern)}, 0, 'is')", f"regexp_split_to_array({text}, {q(pattern)}, 'is')"
    start, left = trim_sides("m", "s")
    return f"""SELECT {key}, '{label}' AS label, start, start + length(t) AS "end", t AS text, '{name}' AS method FROM (
        SELECT {key}, {start} AS start, {left} AS t FROM (
            SELECT {key}, m, (sum(length(g) + length(m)) OVER (PARTITION BY {key} ORDER BY k))::bigint - length(m) AS s FROM (
                SELECT {key}, unnest(f) AS m, unnest(g[1:len(f)]) AS g, generate_subscripts(f, 1) AS k FROM (SELECT {key}, {found} AS f, {gaps} AS g FROM {rows})))) WHERE length(t) > 0"""


def patterns_cte() -> str:
    parts = [matches_sql("studies", "doc_id", "text", label, name, p) for label, found in L.patterns().items() for name, p in found]
    return "raw AS (" + " UNION ALL ".join(parts) + "), pats AS (SELECT doc_id, label, start, \"end\", min(text) AS text, min(method) AS method FROM raw GROUP BY ALL)".replace("GROUP BY ALL", 'GROUP BY doc_id, label, start, "end"')


# Experts, confidences and votes of pattern candidates by integer arithmetic, the same in both engines.
ORD = "CASE label " + " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(L.LABELS)) + " END"
SEED = f'(doc_id * 31 + start * 17 + "end" * 7 + ({ORD}) * 5)'


def candidates_cte() -> str:
    experts = ", ".join(f"CASE WHEN ({SEED} + {13 * k}) % 3 = 0 THEN '{e}' END" for k, e in enumerate(L.EXPERTS))
    prefix = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.PREFIX.items()) + " END"
    roles = ", ".join(f"CASE ({SEED} + {k * 11}) % 4 WHEN 0 THEN 'reject' WHEN 1 THEN 'missing' ELSE 'keep' END AS {e}" for k, e in enumerate(L.EXPERTS))
    return f"""WITH {STUDIES}, {patterns_cte()},
    cands AS (SELECT *, printf('%s-C%04d', {prefix}, number) AS candidate_id FROM (
        SELECT doc_id, label, start, "end", text, list_filter([{experts}], lambda x: x IS NOT NULL) AS experts, ({SEED} % 1000) / 1000.0::double AS confidence,
        row_number() OVER (PARTITION BY doc_id, label ORDER BY start, "end", text) AS number FROM pats)),
    votes AS (SELECT doc_id, label, candidate_id, {roles} FROM cands),
    feats AS (SELECT c.*, {", ".join(f"v.{e}" for e in L.EXPERTS)}, ({" + ".join(f"(v.{e} = 'keep')::int" for e in L.EXPERTS)}) AS keeps, list_contains(experts, 'PubMedBERT') AS anchor, len(experts) AS support,
        {fits("c.label", "c.text")} AS fits, {quality("c.label", "c.text")} AS quality FROM cands c JOIN votes v USING (doc_id, label, candidate_id)),
    feat AS (SELECT *, {weak("label", "text", "anchor")} AS weak, {boundary_issue("label", "text")} AS issue FROM feats),
    feature AS (SELECT *, label IN ({R.quoted(L.STRICT_LABELS)}) AND NOT weak AND (keeps >= 1 OR CASE label WHEN 'SampleSize' THEN quality >= 2 WHEN 'ComparisonGroup' THEN quality >= 2 AND {words("text")} <= 8 WHEN 'Outcome' THEN quality >= 2 AND {words("text")} <= 10 END) AS rescued FROM feat)"""


def gold_cte() -> str:
    """Gold spans: two thirds of the pattern candidates, some with moved borders; predictions: all that fit."""
    return f"""{candidates_cte()}, gold AS (SELECT doc_id, label, start + ({SEED} % 5 = 0)::int AS start, "end" - ({SEED} % 7 = 0)::int AS "end" FROM cands WHERE {SEED} % 3 <> 1 AND "end" - start > 3),
    pred AS (SELECT doc_id, label, start, "end" FROM feature WHERE fits), dim AS (SELECT unnest([{R.quoted(L.LABELS)}]) AS label)"""


def rolled_up(counts: str, accuracy: bool = False) -> str:
    tn = ", tn" if accuracy else ""
    acc = ", coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0)::double, 0) AS accuracy" if accuracy else ""
    zero = ", coalesce(tn, 0)::bigint AS tn" if accuracy else ""
    sums = ", sum(tn)::bigint AS tn" if accuracy else ""
    nulls = ", NULL::bigint AS tn" if accuracy else ""
    avg = ", avg(accuracy) AS accuracy" if accuracy else ""
    return f"""counts AS ({counts}), zeros AS (SELECT label, coalesce(tp, 0)::bigint AS tp, coalesce(fp, 0)::bigint AS fp, coalesce(fn, 0)::bigint AS fn{zero} FROM dim LEFT JOIN counts USING (label)),
    summed AS (SELECT * FROM zeros UNION ALL SELECT 'micro', sum(tp)::bigint AS tp, sum(fp)::bigint, sum(fn)::bigint{sums} FROM zeros),
    pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::double, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::double, 0) AS recall{acc} FROM summed),
    scored AS (SELECT label, tp, fp, fn{tn}, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1{", accuracy" if accuracy else ""} FROM pr),
    every AS (SELECT * FROM scored UNION ALL SELECT 'macro', NULL::bigint, NULL::bigint, NULL::bigint{nulls}, avg(precision), avg(recall), avg(f1){avg} FROM scored WHERE label <> 'micro')
    SELECT label, tp, fp, fn{tn}, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1{", round(accuracy, 6) AS accuracy" if accuracy else ""} FROM every"""


# --- folds: order-dependent selection, stated as list_reduce over ordered lists of one-element lists --------------------


def contains_pair(a: str, b: str) -> str:
    return f"""{a}.start <= {b}.start AND {b}."end" <= {a}."end" AND NOT ({a}.start = {b}.start AND {a}."end" = {b}."end")"""


def keeps_outer(a: str, b: str) -> str:
    return f"""CASE WHEN {a}.label IN ('SampleSize', 'DesignDescription', 'StatisticalAnalysis') THEN true
        WHEN {a}.label = 'ComparisonGroup' THEN len(string_split({clean(b + '.text')}, ' ')) < 2
        WHEN {a}.issue IS NOT NULL AND {b}.issue IS NULL THEN false WHEN {b}.issue IS NOT NULL AND {a}.issue IS NULL THEN true
        ELSE length({b}.text) >= length({a}.text) END"""


def without_contained(where: str) -> str:
    """Ids of a mode whose contained spans are pruned: pairs in order of the outer loop, then the inner one."""
    kind = "STRUCT(a VARCHAR, b VARCHAR, l VARCHAR)[]"
    return f"""base AS (SELECT * FROM feature WHERE {where}),
    pairs AS (SELECT a.doc_id, a.label, list([{{'a': a.candidate_id, 'b': b.candidate_id, 'l': CASE WHEN {keeps_outer("a", "b")} THEN b.candidate_id ELSE a.candidate_id END}}] ORDER BY a.number, b.number) AS l
        FROM base a JOIN base b ON a.doc_id = b.doc_id AND a.label = b.label AND {contains_pair("a", "b")} GROUP BY a.doc_id, a.label),
    gone AS (SELECT doc_id, label, list_transform(list_reduce(list_prepend([]::{kind}, l), lambda acc, x: CASE WHEN list_has_any(list_transform(acc, lambda y: y.l), [x[1].a, x[1].b]) THEN acc ELSE list_concat(acc, x) END), lambda y: y.l) AS gone FROM pairs)
    SELECT doc_id, label, (row_number() OVER (PARTITION BY doc_id, label ORDER BY number) - 1)::int AS pos, candidate_id FROM base LEFT JOIN gone USING (doc_id, label) WHERE NOT coalesce(list_contains(gone, candidate_id), false)"""


ITEM = "STRUCT(id VARCHAR, s BIGINT, e BIGINT, plain VARCHAR, weak BOOLEAN, anchor BOOLEAN, b BIGINT[], strict BOOLEAN)"


def item(row: str = "") -> str:
    """A candidate of `feature` as the fold over redundant candidates sees it."""
    p, n = clean("text"), words(clean("text"))
    usual = "CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.PREFERRED_WORDS.items()) + f" ELSE {L.OTHER_PREFERRED_WORDS} END"
    strict = f"label IN ({R.quoted(L.STRICT_LABELS)})"
    whole = f"{p} <> '' AND NOT contains({q(',;:.)]}')}, left({p}, 1)) AND NOT contains({q(',;:([{')}, right({p}, 1))"
    score = f"10 * fits::int + 2 * ({whole})::int - 8 * weak::int + quality - CASE WHEN {strict} AND {n} > 14 THEN {n} - 14 ELSE 0 END + CASE WHEN {strict} AND {n} BETWEEN 2 AND 8 THEN 2 ELSE 0 END"
    return f"""{{'id': candidate_id, 's': start::bigint, 'e': "end"::bigint, 'plain': {normalized('text')}, 'weak': weak, 'anchor': anchor, 'b': [({score})::bigint, -abs({n} - {usual})::bigint, -length({p})::bigint, -start::bigint], 'strict': {strict}}}"""


def _near(y: str, x: str) -> str:
    inside = f"contains({y}.plain, {x}.plain) OR contains({x}.plain, {y}.plain)"
    return f"""(greatest(0, least({y}.e, {x}.e) - greatest({y}.s, {x}.s)) / greatest(1, least({y}.e - {y}.s, {x}.e - {x}.s))::double >= 0.85
        OR ({y}.plain <> '' AND {x}.plain <> '' AND ({y}.plain = {x}.plain OR {x}.strict AND ({inside}))))"""


def _better(x: str, y: str) -> str:
    return f"({y}.weak AND NOT {x}.weak OR CASE WHEN {x}.anchor AND NOT {y}.anchor THEN {x}.b >= {y}.b ELSE {x}.b > {y}.b END)"


def redundant_fold(items: str) -> str:
    """Ids that stay of an ordered list of one-element lists of items."""
    at = f"coalesce(list_position(list_transform(acc, lambda y: {_near('y', 'x[1]')}), true), 0)"
    step = f"CASE WHEN {at} = 0 THEN list_concat(acc, x) ELSE list_transform(acc, lambda y, k: CASE WHEN k = {at} AND {_better('x[1]', 'y')} THEN x[1] ELSE y END) END"
    return f"list_transform(list_reduce(list_prepend([]::{ITEM}[], {items}), lambda acc, x: {step}), lambda y: y.id)"


def without_redundant(where: str, rank: str = "0") -> str:
    return f"""lists AS (SELECT doc_id, label, list([{item()}] ORDER BY {rank}, number) AS l FROM feature WHERE {where} GROUP BY doc_id, label),
    kept AS (SELECT doc_id, label, {redundant_fold("l")} AS ids FROM lists)
    SELECT doc_id, label, (generate_subscripts(ids, 1) - 1)::int AS pos, unnest(ids) AS candidate_id FROM kept"""


AGREED = "(keeps >= 2 OR rescued)"


# --- matches of gold and predictions -----------------------------------------------------------------------------------


def matched(threshold: float, same_label: bool = True) -> str:
    """matches(doc_id, g, p): rows of gi and pi that the greedy rule matches. Needs gold and pred."""
    by, order = ("doc_id, label", 'start, "end"') if same_label else ("doc_id", f'{ORD}, start, "end"')
    return f"""gi AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS i FROM gold), pi AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS j FROM pred),
    c AS (SELECT {", ".join("gi." + x for x in by.split(", "))}, i, j, (least(gi."end", pi."end") - greatest(gi.start, pi.start)) / (greatest(gi."end", pi."end") - least(gi.start, pi.start))::double AS score FROM gi JOIN pi USING ({by}) WHERE gi.start < pi."end" AND pi.start < gi."end"),
    l AS (SELECT {by}, list_prepend([]::STRUCT(i BIGINT, j BIGINT)[], list([{{'i': i, 'j': j}}] ORDER BY score DESC, i DESC, j DESC)) AS l FROM c WHERE score >= {threshold} GROUP BY {by}),
    m AS (SELECT {by}, unnest(list_reduce(l, lambda a, x: CASE WHEN list_contains(list_transform(a, lambda y: y.i), x[1].i) OR list_contains(list_transform(a, lambda y: y.j), x[1].j) THEN a ELSE list_concat(a, x) END)) AS m FROM l),
    matches AS (SELECT gi.doc_id, gi.label AS gold_label, pi.label AS label, gi.start AS gs, gi."end" AS ge, pi.start AS ps, pi."end" AS pe FROM (SELECT {by}, m.i AS i, m.j AS j FROM m) JOIN gi USING ({by}, i) JOIN pi USING ({by}, j))"""


def longest(rows: str, key: str, patterns: list[str]) -> str:
    """key, s, m: offset and text of the longest match of any pattern in a relation's text, the earliest of equals."""
    parts = []
    for p in patterns:
        found, gaps = f"regexp_extract_all(text, {q(p)}, 0, 'is')", f"regexp_split_to_array(text, {q(p)}, 'is')"
        parts.append(f"""SELECT {key}, m, (sum(length(g) + length(m)) OVER (PARTITION BY {key} ORDER BY k))::bigint - length(m) AS s FROM (
            SELECT {key}, unnest(f) AS m, unnest(g[1:len(f)]) AS g, generate_subscripts(f, 1) AS k FROM (SELECT {key}, {found} AS f, {gaps} AS g FROM {rows}))""")
    return f"SELECT {key}, arg_max(m, [length(m), -s]) AS m, arg_max(s, [length(m), -s]) AS s FROM ({' UNION ALL '.join(parts)}) GROUP BY {key}"
