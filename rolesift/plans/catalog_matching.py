"""Catalogue: rules, scores, decisions, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.operators import digest, matching, rules
from rolesift.operators.normalize import normalize_jobs
from rolesift.plans.catalog_base import SQL_HASH, SQL_POSTINGS, document_postings, table, texts

# a small rule set whose terms occur in the given prose
PROSE = rules.profile_of(
    positive={
        "common": {"weight": 0.55, "terms": ["zuver", "the en", "those"]},
        "mixed_case": {"weight": 0.35, "terms": [" Thion ", "eau", "eau"]},
        "est_les": 0.2,
        "gone": {"weight": 0.0, "terms": ["the"]},
        "blank": {"weight": 1.0, "terms": [" "]},
    },
    negative={"junk": {"weight": 0.15, "terms": ["###", "$$$"]}, "ble": {"weight": 0.05, "terms": ["nble"]}},
    places=["london", "berlin"],
    remote=["remote"],
    regions=["eu", "tion"],
)


def prose_matches(spark, sf) -> DataFrame:
    return matching.match_postings(normalize_jobs(document_postings(spark, sf)), PROSE, 0.3, True)


def _report(matches: DataFrame) -> DataFrame:
    return matches.select(
        "source_id", F.col("job_index").alias("doc_id"), F.round("score", 9).alias("score"),
        F.array_join("matched_terms", ",").alias("matched_terms"), "geo_pass", "decision",
    )


def keyword_score(spark, sf) -> DataFrame:
    return _report(prose_matches(spark, sf))


# what stands before a title, and the place, by turns: every default rule and the geography gate
_TURNS = [
    ("Lead Machine Learning Engineer", "Utrecht"), ("ML Engineer", "Oslo"), ("Data Scientist", "Hamburg"),
    ("Applied Science", "The Hague"), ("MLOps", "Remote, EMEA"), ("ML Ops Engineer, Research Engineer", "Remote"),
    ("AI Engineer", "Manchester, England"), ("AI Scientist", "Eindhoven"), ("Machine Learning Scientist", "Deutschland"),
    ("Deep Learning Engineer", "distributed, eu"), ("Computer Vision Engineer", "Rotterdam"), ("NLP Engineer", "Berlin"),
    ("Large Language Model Engineer", "Munich"), ("Data Scientist Intern", "London"), ("Student Data Scientist, Sales", "Frankfurt"),
    ("Account Executive", "Amsterdam"), ("Gardener", "London"),
]


def default_rules_score(spark, sf) -> DataFrame:
    """The default profile, remote gate on, over titles and places that hold its terms by turns."""
    turn = F.col("job_index") % len(_TURNS)
    by_turn = lambda k: F.element_at(F.array(*[F.lit(t[k]) for t in _TURNS]), (turn + 1).cast("int"))
    posts = document_postings(spark, sf)
    posts = posts.withColumns({"title": F.concat(by_turn(0), F.lit(" "), "title"), "location": by_turn(1)})
    normal = normalize_jobs(posts)
    return _report(matching.match_postings(normal, rules.profile_of(), enable_remote=True))


def decision_filter(spark, sf) -> DataFrame:
    return matching.to_send(prose_matches(spark, sf)).groupBy("source_id").agg(F.count("*").alias("sent"))


def score_parts(spark, sf) -> DataFrame:
    """Positive score and penalty of the text alone, before they are weighed."""
    text = F.lower("text")
    return texts(spark, sf, "documents", "doc_id", "text").select(
        "doc_id",
        F.round(matching.positive_score(text, PROSE.positive), 9).alias("positive"),
        F.round(matching.penalty(text, PROSE.negative), 9).alias("penalty"),
    )


def posting_slice(spark, sf) -> DataFrame:
    """Normalise, score and rank: the twenty best sendable postings."""
    best = digest.top_items(matching.to_send(prose_matches(spark, sf)), 20)
    return best.select(
        "source_id", F.col("job_index").alias("doc_id"), "title", "location", "url", "canonical_hash",
        F.round("score", 9).alias("score"), F.array_join("matched_terms", ",").alias("matched_terms"),
    )


_OVERRIDES = {
    0: '{"positive_terms": {"Common": {"weight": 0.9}, "newer": {"weight": 0.4, "terms": ["Ing", "ing", ""]}, "late": 0.3}, "geo_terms": ["Paris", "tion"]}',
    1: '{"positive_terms": {"common": {"weight": 0}, "mixed_case": {"terms": ["is"]}, "weightless": {"terms": ["x"]}}, "negative_terms": {"ble": 0.25}}',
    2: '{"positive_terms": {"common": 0.15, "odd": "text"}, "geo_terms": "no list", "remote_terms": ["an"]}',
    3: None,
}


def _profile_of(number) -> F.Column:
    out = F.lit(None).cast("string")
    for i, text in _OVERRIDES.items():
        out = F.when(number == i, F.lit(text)).otherwise(out)
    return out


def rule_overrides(spark, sf) -> DataFrame:
    """Merged positive rules of every supplier, overrides by nation."""
    configs = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("source_id"), _profile_of(F.col("s_nationkey") % 4).alias("matching_profile")
    )
    merged = rules.source_profiles(configs, PROSE)
    return merged.select(
        "source_id", F.posexplode("positive").alias("place", "rule"), F.array_join("places", ",").alias("places")
    ).select(
        "source_id", F.col("place").cast("long").alias("place"), "rule.family", F.col("rule.weight").alias("weight"),
        F.array_join("rule.terms", ",").alias("terms"), "places",
    )


def source_profile_score(spark, sf) -> DataFrame:
    """Every document under the rules of its own source."""
    sources = table(spark, sf, "documents").select("source").distinct()
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int") % 4
    configs = sources.select(F.col("source").alias("source_id"), _profile_of(number).alias("matching_profile"))
    profiles = rules.source_profiles(configs, PROSE)
    normal = normalize_jobs(document_postings(spark, sf))
    return _report(matching.match_with_source_profiles(normal, profiles, 0.3, True))


# --------------------------------------------------------------------------
# the same in SQL, written out from rule tables


def _q(term: str) -> str:
    return "'" + term.replace("'", "''") + "'"


def _any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(t)})" for t in terms) + ")" if terms else "false"


def _first(text: str, terms) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, {_q(t)}) THEN {_q(t)}" for t in terms) + " END"


def _sum(text: str, rows) -> str:
    return " + ".join(["0.0::DOUBLE", *[f"CASE WHEN {_any(text, terms)} THEN {w}::DOUBLE ELSE 0 END" for _, w, terms in rows]])


def sql_scored(positive, negative, places, remote, regions, min_score, where="true", postings=SQL_POSTINGS) -> str:
    hits = ", ".join(_first(t, terms) for t in ("lt", "ld") for _, _, terms in positive)
    minus = f"({_sum('lt', negative)}) + ({_sum('ld', negative)})"
    score = f"greatest(0.0, least(1.0, 0.65 * least(1.0, {_sum('lt', positive)}) + 0.35 * least(1.0, {_sum('ld', positive)}) - ({minus})))"
    geo = f"({_any('h', places)} OR ({_any('h', remote)} AND {_any('h', regions)}))"
    return f"""SELECT *, CASE WHEN NOT geo_pass THEN 'reject_geo' WHEN raw_score < {min_score} THEN 'reject_score' ELSE 'send' END AS decision
      FROM (SELECT *, {score} AS raw_score, {geo} AS geo_pass,
              array_to_string(list_sort(list_distinct([{hits}])), ',') AS matched_terms
            FROM (SELECT *, lower(title) AS lt, lower(description) AS ld, lower(location) || ' ' || lower(description) AS h
                  FROM ({postings}) WHERE {where}))"""


_POS = [
    ("common", 0.55, ["zuver", "the en", "those"]),
    ("mixed_case", 0.35, ["thion", "eau"]),
    ("est_les", 0.2, ["est les"]),
]
_NEG = [("junk", 0.15, ["###", "$$$"]), ("ble", 0.05, ["nble"])]
_PLACES, _REMOTE, _REGIONS = ["london", "berlin"], ["remote"], ["eu", "tion"]
_PROSE_SQL = sql_scored(_POS, _NEG, _PLACES, _REMOTE, _REGIONS, 0.3)
_COLUMNS = "source_id, job_index AS doc_id, round(raw_score, 9) AS score, matched_terms, geo_pass, decision"


# the default rules once more, written out by hand for the check: fixed values
_DEFAULT_SQL = sql_scored(
    [
        ("machine_learning_engineer", 1.0, ["machine learning engineer", "ml engineer"]), ("data_scientist", 1.0, ["data scientist"]),
        ("applied_scientist", 1.0, ["applied scientist", "applied science"]),
        ("mlops_engineer", 1.0, ["mlops engineer", "ml ops engineer", "mlops", "ml ops"]), ("research_engineer", 0.9, ["research engineer"]),
        ("ai_engineer", 0.9, ["ai engineer"]), ("ai_scientist", 0.95, ["ai scientist"]),
        ("machine_learning_scientist", 1.0, ["machine learning scientist"]), ("deep_learning_engineer", 0.95, ["deep learning engineer"]),
        ("computer_vision_engineer", 0.9, ["computer vision engineer"]), ("nlp_engineer", 0.9, ["nlp engineer", "natural language processing engineer"]),
        ("llm_engineer", 0.9, ["llm engineer", "large language model engineer"]),
    ],
    [("intern", 0.35, ["intern", "internship"]), ("student", 0.35, ["student"]), ("sales", 0.25, ["sales"]), ("account_executive", 0.35, ["account executive"])],
    ["london", "united kingdom", "uk", "england", "germany", "deutschland", "berlin", "munich", "muenchen", "hamburg", "frankfurt",
     "netherlands", "nederland", "amsterdam", "rotterdam", "the hague", "utrecht", "eindhoven"],
    ["remote", "work from home", "distributed"],
    ["europe", "eu", "emea"],
    0.6,
    postings=f"""SELECT * REPLACE (CASE job_index % {len(_TURNS)} {" ".join(f"WHEN {i} THEN {_q(t[0])}" for i, t in enumerate(_TURNS))} END || ' ' || title AS title,
        CASE job_index % {len(_TURNS)} {" ".join(f"WHEN {i} THEN {_q(t[1])}" for i, t in enumerate(_TURNS))} END AS location) FROM ({SQL_POSTINGS})""",
)

# merged rules per override, by hand
_MERGED = {
    0: ([("common", 0.9, ["zuver", "the en", "those"]), *_POS[1:], ("newer", 0.4, ["ing"]), ("late", 0.3, ["late"])], _NEG, [*_PLACES, "paris", "tion"], _REMOTE),
    1: ([("mixed_case", 0.35, ["is"]), _POS[2]], [_NEG[0], ("ble", 0.25, ["ble"])], _PLACES, _REMOTE),
    2: ([("common", 0.15, ["common"]), *_POS[1:]], _NEG, _PLACES, [*_REMOTE, "an"]),
    3: (_POS, _NEG, _PLACES, _REMOTE),
}
_RULE_ROWS = ", ".join(
    f"({n}, {i}, {_q(f)}, {w}::DOUBLE, {_q(','.join(t))}, {_q(','.join(m[2]))})"
    for n, m in _MERGED.items()
    for i, (f, w, t) in enumerate(m[0])
)
_BY_SOURCE = " UNION ALL ".join(
    f"SELECT {_COLUMNS} FROM ({sql_scored(p, n, g, r, _REGIONS, 0.3, f'CAST(substr(source_id, 4) AS INT) % 4 = {i}')})"
    for i, (p, n, g, r) in _MERGED.items()
)

QUERIES = {
    "posting_slice": (
        posting_slice,
        f"""SELECT source_id, job_index AS doc_id, title, location, url, {SQL_HASH} AS canonical_hash,
              round(raw_score, 9) AS score, matched_terms FROM ({_PROSE_SQL}) WHERE decision = 'send'
            ORDER BY raw_score DESC, source_id, job_index LIMIT 20""",
    ),
    "keyword_score": (keyword_score, f"SELECT {_COLUMNS} FROM ({_PROSE_SQL})"),
    "default_rules_score": (default_rules_score, f"SELECT {_COLUMNS} FROM ({_DEFAULT_SQL})"),
    "decision_filter": (
        decision_filter,
        f"SELECT source_id, count(*) AS sent FROM ({_PROSE_SQL}) WHERE decision = 'send' GROUP BY 1",
    ),
    "score_parts": (
        score_parts,
        f"""SELECT doc_id, round(least(1.0, {_sum('t', _POS)}), 9) AS positive, round({_sum('t', _NEG)}, 9) AS penalty
            FROM (SELECT doc_id, lower(text) AS t FROM documents)""",
    ),
    "rule_overrides": (
        rule_overrides,
        f"""SELECT s_suppkey AS source_id, place::BIGINT AS place, family, weight, terms, places
            FROM supplier JOIN (VALUES {_RULE_ROWS}) r(n, place, family, weight, terms, places) ON n = s_nationkey % 4""",
    ),
    "source_profile_score": (source_profile_score, _BY_SOURCE),
}
