"""Labels, experts and lexicons. All tables here are fixed values that results depend on."""

from __future__ import annotations

# Labels in their order (which decides output order and ties), with identifier prefixes.
LABELS = ["Participant", "Intervention", "Outcome", "SampleSize", "ComparisonGroup", "DesignDescription", "StatisticalAnalysis"]
PREFIX = {"Participant": "PAR", "Intervention": "INT", "Outcome": "OUT", "SampleSize": "SAM", "ComparisonGroup": "COM", "DesignDescription": "DES", "StatisticalAnalysis": "STA"}
STRICT_LABELS = ["Outcome", "SampleSize", "ComparisonGroup"]
EXPERTS = ["SciBERT", "PubMedBERT", "ClinicalBERT"]
ANCHOR = "pubmedbert"
PREFERRED_WORDS = {"SampleSize": 7, "Outcome": 4, "ComparisonGroup": 4}
OTHER_PREFERRED_WORDS = 6

# Words that make no span, that must not end one, and that mark a statistical method.
STOPWORDS = ["the", "a", "an", "of", "in", "and", "or", "to", "for"]
TRAILING_WORDS = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "past", "the", "to", "with"]
METHOD_CUES = ["ancova", "anova", "regression", "mixed-effects", "mixed effects", "t-test", "t-tests", "chi-square", "imputation", "f-test", "f-tests"]

# Cue words of each label.
CUES = {
    "Participant": ["participants", "students", "teachers", "children", "adolescents", "eligibility", "eligible", "aged", "recruited"],
    "Intervention": ["programme", "program", "intervention", "treatment", "therapy", "sessions", "training", "curriculum", "counseling", "mindfulness", "CBT", "SEL"],
    "Outcome": ["outcome", "endpoint", "measure", "measured", "assessed", "scale", "score", "symptoms", "self-esteem", "stress", "depression", "anxiety", "well-being"],
    "SampleSize": ["n=", "n =", "N=", "N =", "participants", "subjects", "students", "teachers", "enrolled", "completed", "allocated", "randomized", "sample"],
    "ComparisonGroup": ["control", "wait-list", "waitlist", "usual care", "placebo", "comparison", "business-as-usual", "BAU"],
    "DesignDescription": ["randomized", "randomised", "randomly assigned", "assigned to", "allocation", "quasi-experimental", "cohort", "trial", "cross-sectional"],
    "StatisticalAnalysis": ["regression", "ANCOVA", "ANOVA", "mixed-effects", "t-test", "subgroup analysis", "Stata"],
}
PRE_EXPANSION_LABELS = ["Participant", "Intervention", "Outcome", "SampleSize"]

# Patterns that generate spans. UNIT stands ungrouped in three of them, so that there its first word
# closes one branch and its last word opens another; strict patterns group it.
UNIT = "participants?|students?|teachers?|children|adolescents?|schools?|classrooms?|parents?|families|subjects?|pupils|youths?|dyads?|clusters?"


def patterns(strict_units: bool = False) -> dict[str, list[tuple[str, str]]]:
    unit = f"(?:{UNIT})" if strict_units else UNIT
    return {
        "SampleSize": [
            ("sample_n_equals", rf"\b[Nn]\s*=\s*\d[\d,]*(?:\.\d+)?(?:\s*{unit})?\b"),
            ("sample_number_unit", rf"\b\d[\d,]*(?:\.\d+)?\s+{unit}\b"),
            ("sample_group_n", r"\b(?:intervention|control|comparison|treatment|wait[-\s]?list|usual\s+care|experimental)(?:\s+group)?\s+n\s*=\s*\d[\d,]*(?:\.\d+)?\b"),
        ],
        "Participant": [
            ("participant_group_phrase", rf"\b(?:[A-Za-z0-9%/+-]+\s+){{0,8}}{unit}\b"),
            ("participant_aged_phrase", rf"\b{unit}\s+(?:aged|ages?)\s+\d{{1,2}}(?:\s*(?:-|to)\s*\d{{1,2}})?\b"),
            ("participant_grade_phrase", r"\b(?:\d+(?:st|nd|rd|th)?|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|middle|high|secondary|primary|elementary)\s+(?:grade\s+)?(?:students|children|pupils|adolescents)\b"),
        ],
        "Intervention": [
            ("intervention_named_program", r"\b(?:the\s+)?(?:[A-Z][A-Za-z0-9'&-]+|[a-z]+)(?:\s+(?:[A-Z][A-Za-z0-9'&-]+|[a-z]+)){0,8}\s+(?:program|programme|curriculum|intervention|therapy|training)\b"),
            ("intervention_session_phrase", r"\b\d+\s+(?:weekly\s+)?(?:sessions|lessons|meetings|classes|modules)\b(?:\s+(?:of|focused\s+on|covering)\s+[A-Za-z][^.;,]{0,80})?"),
            ("intervention_cue_phrase", r"\b(?:mindfulness|CBT|cognitive[-\s]behavioral|social[-\s]emotional|SEL|counseling|coping|skills?)\b[^.;]{0,120}\b(?:program|programme|curriculum|sessions?|lessons?|training|intervention|therapy)\b"),
        ],
        "Outcome": [
            ("outcome_symptom_phrase", r"\b(?:anxiety|depression|depressive|stress|trauma|internalizing|externalizing|conduct|behavioral|behavioural|emotional|prosocial|self[-\s]esteem|well[-\s]?being|resilience|coping)\s+(?:symptoms?|scores?|problems?|behavio[u]?rs?|skills?|well[-\s]?being|scale|subscale|measure|outcome)\b"),
            ("outcome_measure_phrase", r"\b(?:[A-Za-z][A-Za-z'&-]+\s+){0,8}(?:scale|subscale|inventory|questionnaire|assessment|index|measure|score)\b"),
            ("outcome_instrument_acronym", r"\b(?:CES-D|SDQ|RCADS|BDI|CBCL|YSR|PSS|RSES)(?:\s+(?:scale|score|subscale|inventory|questionnaire))?\b"),
        ],
    }


# Parts of patterns() and what they cost less as in Java. A word that white space must follow ends where its run of signs
# ends, so that giving signs back, or trying a run of letters both ways, finds nothing more.
_POSSESSIVE = {
    r"(?:[A-Z][A-Za-z0-9'&-]+|[a-z]+)": r"[A-Z][A-Za-z0-9'&-]*+",
    r"(?:\s+[A-Z]": r"(?:\s++[A-Z]",
    r"(?:[A-Za-z0-9%/+-]+\s+)": r"(?:[A-Za-z0-9%/+-]++\s++)",
    r"(?:[A-Za-z][A-Za-z'&-]+\s+)": r"(?:[A-Za-z][A-Za-z'&-]++\s++)",
}


def possessive(pattern: str) -> str:
    """A pattern of patterns(), without regard to case, with the same matches and fewer tries."""
    for part, quick in _POSSESSIVE.items():
        pattern = pattern.replace(part, quick)
    return pattern


# Boundary patterns (number phrases, comparators, designs, methods, introducing verbs).
BOUNDARY_UNIT = "(?:participants?|students?|teachers?|children|adolescents?|schools?|classrooms?|parents?|families|subjects?|pupils|youths?|dyads?|clusters?|cases?)"
NUMBER_BOUNDARIES = [
    rf"\b(?:intervention|control|comparison|treatment|wait[-\s]?list|usual\s+care)?\s*n\s*=\s*\d[\d,]*(?:\.\d+)?(?:\s*{BOUNDARY_UNIT})?",
    rf"\bN\s*=\s*\d[\d,]*(?:\.\d+)?(?:\s*{BOUNDARY_UNIT})?",
    rf"\b\d[\d,]*(?:\.\d+)?\s+{BOUNDARY_UNIT}\b",
]
CUE_BOUNDARIES = {
    "ComparisonGroup": r"\b(?:business[-\s]as[-\s]usual|BAU|wait[-\s]?list(?:\s+control)?|usual\s+care|control\s+group|placebo|no\s+intervention|active\s+comparator)\b[^.;,)]*",
    "DesignDescription": r"\b(?:cluster\s+)?(?:randomi[sz]ed\s+controlled\s+trial|randomi[sz]ed\s+trial|quasi[-\s]experimental|pretest[-\s]posttest|cross[-\s]sectional|cohort|factorial\s+design|mixed\s+factorial)\b[^.;]*",
    "StatisticalAnalysis": r"\b(?:multilevel\s+linear\s+model(?:ing)?|linear\s+mixed\s+model(?:s)?|mixed[-\s]effects?\s+model(?:s)?|ANCOVA|ANOVA|logistic\s+regression|linear\s+regression|t[-\s]?test|chi[-\s]?square|intention[-\s]to[-\s]treat|last\s+observation\s+carried\s+forward|Hedges'?\s+g|Cohen'?s\s+d|odds\s+ratio|confidence\s+intervals?)\b[^.;]*",
}
INTRO_VERBS = r"^(?:the\s+)?(?:study\s+)?(?:included|recruited|enrolled|assessed|measured|reported|received|were|was|are|is)\s+"

# What the label filters look for.
NUMBER_REJECTS = r"\bp\s*[<=>]|\bf\s*\(|\bχ2\b|\bchi[-\s]?square\b|\bβ\b|\bbeta\b|\bci\b|\bodds\s+ratio\b|\bor\s*[=:]|\bsd\b|\bm\s*=|\bmean\b|\bage\b|\byears?\s+old\b"
FILTER_UNIT = "participants?|students?|teachers?|children|adolescents?|schools?|classrooms?|parents?|families|subjects?|pupils|youths?|dyads?|clusters?|kindergartens?"
FILTER_GROUP = r"intervention|control|comparison|treatment|wait[-\s]?list|experimental"
COUNT_SHAPES_CASED = [rf"\b[Nn]\s*=\s*\d[\d,]*(?:\.\d+)?(?:\s*{FILTER_UNIT})?\b"]
COUNT_SHAPES = [
    rf"\b\d[\d,]*(?:\.\d+)?\s+{FILTER_UNIT}\b",
    rf"\b(?:{FILTER_GROUP})\s+n\s*=\s*\d[\d,]*(?:\.\d+)?\b",
    rf"\b\d[\d,]*(?:\.\d+)?\s+(?:from|in|assigned to|allocated to)\s+(?:the\s+)?(?:{FILTER_GROUP})\b",
    rf"\b\d[\d,]*(?:\.\d+)?.*\b(?:{FILTER_GROUP})\b.*\b\d[\d,]*(?:\.\d+)?\b",
]
OUTCOME_REJECTS = [
    r"\b(?:anova|ancova|regression|mixed\s+model|t[-\s]?test|chi[-\s]?square|p\s*[<=>]|cohen|hedges|odds\s+ratio)\b",
    r"\b(?:intervention|program|curriculum|lesson|training|therapy|treatment)\b.*\b(?:delivered|session|weekly)\b",
    r"\b(?:instruments?|measures?)\s+were\s+used\b",
    r"\b(?:sociodemographic|demographic)\s+questionnaire\b",
]
FILTER_CUES = {
    "Participant": ["student", "teacher", "child", "children", "adolescent", "participant", "parent", "classroom", "school", "kindergarten"],
    "Intervention": ["intervention", "program", "programme", "curriculum", "therapy", "training", "lesson", "counseling", "mindfulness", "cbt", "sel", "sessions"],
    "Outcome": ["outcome", "measure", "scale", "score", "symptom", "depression", "depressive", "anxiety", "stress", "well-being", "wellbeing", "self-esteem", "behavior", "behaviour", "prosocial", "conduct", "emotional", "mental health", "coping", "resilience", "competence", "adjustment", "inventory", "questionnaire", "instrument", "assessment", "index", "mood", "feelings", "beck depression", "bdi", "ces-d", "sdq"],
    "ComparisonGroup": ["control", "wait-list", "waitlist", "usual care", "business-as-usual", "bau", "placebo", "comparison group", "no intervention", "active comparator", "normal activities"],
    "DesignDescription": ["randomized", "randomised", "controlled trial", "rct", "quasi-experimental", "experiment", "pretest", "posttest", "follow-up", "crossover", "cross-sectional", "cohort", "factorial", "randomization", "randomisation", "assigned", "design"],
    "StatisticalAnalysis": ["anova", "ancova", "regression", "mixed model", "mixed-model", "multilevel", "t-test", "t test", "chi-square", "χ2", "imputation", "intention-to-treat", "cohen", "hedges", "odds ratio", "confidence interval", "covariate", "bonferroni", "spss", "stata", "effect size"],
}
INTERVENTION_WORDS = r"\b(?:intervention|program|curriculum|therapy|training|lesson|counseling|mindfulness|cbt|sel)\b"
WEAK_COMPARISON = ["control", "wait", "drop", "comparison"]
WEAK_OUTCOME = ["depression", "mood", "feelings", "satisfaction", "anxiety", "stress", "score", "outcome"]
QUALITY = {
    "SampleSize": [
        (r"\d", 1),
        (r"\b(?:participants?|students?|children|adolescents?|schools?|classrooms?|parents?|families|subjects?|pupils)\b", 1),
        (rf"\b(?:{FILTER_GROUP})\b", 1),
        (r"\b\d[\d,]*(?:\.\d+)?.*\b\d[\d,]*(?:\.\d+)?\b", 1),
    ],
    "Outcome": [
        (r"\b(?:scale|score|inventory|questionnaire|instrument|assessment|index)\b", 2),
        (r"\b(?:depression|depressive|anxiety|mood|feelings|symptoms?|well-?being|self-esteem|behavior|behaviour)\b", 1),
    ],
    "ComparisonGroup": [
        (r"\b(?:wait[-\s]?list|usual care|business-as-usual|bau|placebo|no intervention|active comparator)\b", 2),
        (r"\b(?:control|comparison)\b", 1),
        (r"\b(?:group|school|classroom|condition)\b", 1),
    ],
}
VOTE_PROFILES = {
    "equal": (1.0, 1.0, 1.0),
    "scibert_weighted": (1.25, 1.0, 1.0),
    "pubmedbert_weighted": (1.0, 1.25, 1.0),
    "clinicalbert_weighted": (1.0, 1.0, 1.25),
}
VOTE_FRACTIONS = [0.34, 0.50, 0.67, 1.0]
EXPERT_SUPPORTS = [1, 2, 3]
CONFIDENCES = [0.0, 0.25, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90]
FIXED_MODES = ["recommended", "expert_consensus_verified", "pubmedbert_plus_verified", "registry_filtered"]
