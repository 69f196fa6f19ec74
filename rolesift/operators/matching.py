"""Keyword score, geography gate and decision.

Two forms of one computation. With one profile for the run the rules are part
of the plan: ``contains`` chains inside whole-stage codegen, no join. With
per-source profiles the rules are columns next to the posting. Both add weights
in rule order, so the last bits of a score do not depend on partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.operators.rules import MatchProfile, Rule
from rolesift.session import broadcast_if_small

# fixed values: share of each field in the score
TITLE_WEIGHT = 0.65
DESCRIPTION_WEIGHT = 0.35

_TEXTS = {"_title": "title", "_description": "description", "_location": "location"}


def _lowered(postings: DataFrame) -> DataFrame:
    return postings.withColumns({name: F.lower(F.col(c)) for name, c in _TEXTS.items()}).withColumn(
        "_place", F.concat_ws(" ", "_location", "_description")
    )


def _any_term(text: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms], F.lit(False))


def _hit(text: Column, rule: Rule) -> Column:
    """The rule's first term, in its own order, found in the text; else null."""
    out = F
    for term in rule.terms:
        out = out.when(F.contains(text, F.lit(term)), F.lit(term))
    return out


def _sum_in_order(weights: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, weights, F.lit(0.0))


def positive_score(text: Column, rules: tuple[Rule, ...]) -> Column:
    total = _sum_in_order([F.when(_any_term(text, r.terms), F.lit(r.weight)).otherwise(0.0) for r in rules])
    return F.least(F.lit(1.0), total)


def penalty(text: Column, rules: tuple[Rule, ...]) -> Column:
    return _sum_in_order([F.when(_any_term(text, r.terms), F.lit(r.weight)).otherwise(0.0) for r in rules])


def final_score(title: Column, description: Column, minus: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), TITLE_WEIGHT * title + DESCRIPTION_WEIGHT * description - minus))


def decide(geo_pass: Column, score: Column, min_score: float) -> Column:
    return F.when(~geo_pass, "reject_geo").when(score < min_score, "reject_score").otherwise("send")


def _finish(scored: DataFrame, columns: list[str], min_score: float) -> DataFrame:
    """The four result columns, through a generator of one row.

    A later filter on the decision would otherwise be copied below the whole
    computation and every text be cleaned and searched again for it.
    """
    score = final_score(F.col("_ts"), F.col("_ds"), F.col("_minus"))
    decided = scored.withColumn("score", score).select(
        *columns,
        F.array(
            F.struct("score", "matched_terms", "geo_pass", decide(F.col("geo_pass"), F.col("score"), min_score).alias("decision"))
        ).alias("_match"),
    )
    return decided.select(*columns, F.inline_outer("_match"))


def match_postings(
    postings: DataFrame, profile: MatchProfile, min_score: float = 0.60, enable_remote: bool = False
) -> DataFrame:
    """Adds score, matched_terms, geo_pass and decision under one profile."""
    title, description, place = F.col("_title"), F.col("_description"), F.col("_place")
    hits = [_hit(text, r) for text in (title, description) for r in profile.positive]
    geo = _any_term(place, profile.places)
    if enable_remote:
        geo = geo | (_any_term(place, profile.remote) & _any_term(place, profile.regions))
    scored = _lowered(postings).select(
        *postings.columns,
        positive_score(title, profile.positive).alias("_ts"),
        positive_score(description, profile.positive).alias("_ds"),
        (penalty(title, profile.negative) + penalty(description, profile.negative)).alias("_minus"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))).alias("matched_terms"),
        geo.alias("geo_pass"),
    )
    return _finish(scored, postings.columns, min_score)


def match_with_source_profiles(
    postings: DataFrame, profiles: DataFrame, min_score: float = 0.60, enable_remote: bool = False
) -> DataFrame:
    """As :func:`match_postings` with the rule row of each posting's source."""

    def found(text: Column, terms: Column) -> Column:
        return F.exists(terms, lambda t: F.contains(text, t))

    def first_terms(text: Column) -> Column:
        firsts = F.transform("positive", lambda r: F.get(F.filter(r["terms"], lambda t: F.contains(text, t)), F.lit(0)))
        return F.array_compact(firsts)

    def total(text: Column, rules: str) -> Column:
        return F.aggregate(
            rules, F.lit(0.0), lambda acc, r: acc + F.when(found(text, r["terms"]), r["weight"]).otherwise(0.0)
        )

    title, description, place = F.col("_title"), F.col("_description"), F.col("_place")
    geo = found(place, F.col("places"))
    if enable_remote:
        geo = geo | (found(place, F.col("remote")) & found(place, F.col("regions")))
    scored = (
        _lowered(postings)
        .join(broadcast_if_small(profiles), "source_id")
        .select(
            *[F.col(c) for c in postings.columns],
            F.least(F.lit(1.0), total(title, "positive")).alias("_ts"),
            F.least(F.lit(1.0), total(description, "positive")).alias("_ds"),
            (total(title, "negative") + total(description, "negative")).alias("_minus"),
            F.array_sort(F.array_distinct(F.concat(first_terms(title), first_terms(description)))).alias("matched_terms"),
            geo.alias("geo_pass"),
        )
    )
    return _finish(scored, postings.columns, min_score)


def to_send(matches: DataFrame) -> DataFrame:
    return matches.filter(F.col("decision") == "send")
