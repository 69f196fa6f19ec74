"""Ranked digest, its text, and the run report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolesift.functions.text import blank_to_null, known_zone, local_time_label, truncate_text

# fixed value: longest message
MAX_CHARS = 3900


def top_items(matches: DataFrame, max_items: int = 20, ordinals: list[str] | None = None) -> DataFrame:
    """Best scores first, ties in run order: a distributed top-k, no full sort."""
    ordinals = ordinals or ["source_id", "page_index", "job_index"]
    return matches.orderBy(F.col("score").desc(), *ordinals).limit(max_items)


def digest_lines(items: DataFrame, header_chars: Column, ordinals: list[str] | None = None) -> DataFrame:
    """Numbered lines of the top items with ``fits``: whether the text still has room.

    Works on at most ``max_items`` rows. A line fits while every line up to it
    stays within the limit, line ends included.
    """
    ordinals = ordinals or ["source_id", "page_index", "job_index"]
    order = W.orderBy(F.col("score").desc(), *ordinals)
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    numbered = items.withColumn("rank", F.row_number().over(order)).withColumn(
        "line",
        F.concat(
            F.col("rank").cast("string"), F.lit(". "), F.col("company"), F.lit(" | "), F.col("title"), F.lit(" | "),
            F.coalesce(blank_to_null(F.col("location")), F.lit("Unknown location")), F.lit(" | "), F.col("url"),
        ),
    )
    total = header_chars + F.sum(F.length("line") + 1).over(so_far)
    return numbered.withColumn("fits", total <= MAX_CHARS)


def digest_text(
    items: DataFrame, run_at: Column, sources_total: Column, matched_total: Column, zone: str = "UTC",
    ordinals: list[str] | None = None,
) -> DataFrame:
    """One row: the digest text, items sent, lines shown and omitted."""
    zone = known_zone(zone)
    sized = items.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy()))
    header = F.concat(
        F.lit("ML Vacancy Digest | "), local_time_label(run_at, zone), F.lit("\nNew matched vacancies: "),
        F.col("_n").cast("string"), F.lit("\n"),
    )
    lines = digest_lines(sized.withColumn("_header", header), F.length("_header"), ordinals)
    shown = F.filter(
        F.array_sort(F.collect_list(F.struct("rank", "line", "fits"))), lambda x: x["fits"]
    )
    one = lines.agg(
        F.first("_header").alias("header"), F.count(F.lit(1)).alias("items"), F.transform(shown, lambda x: x["line"]).alias("lines")
    ).filter(F.col("items") > 0)
    omitted = F.col("items") - F.size("lines")
    note = F.when(
        omitted > 0,
        F.concat(F.lit("...and "), omitted.cast("string"), F.lit(" more matches were omitted due to Telegram length limits.")),
    )
    footer = F.concat(
        F.lit("Sources scanned: "), sources_total.cast("string"), F.lit(" | Matched before dedupe: "),
        matched_total.cast("string"), F.lit(" | Timezone: " + zone),
    )
    return one.select(
        F.array_join(F.array_compact(F.concat(F.array("header"), "lines", F.array(note, F.lit(""), footer))), "\n").alias(
            "digest_text"
        ),
        F.col("items").alias("jobs_sent"),
        F.size("lines").cast("long").alias("lines_shown"),
        omitted.cast("long").alias("lines_omitted"),
    )


def run_report(summaries: DataFrame, run_at: Column, zone: str = "UTC") -> DataFrame:
    """One row: the report text over per-source counts and errors.

    The text is cut at ``MAX_CHARS`` and every line takes two characters at least with
    its line end, so that many halves of it decide: both lists are top-k reads however
    many sources there are. A missing name shows as nothing. Totals count all sources.
    """
    zone = known_zone(zone)
    enough = MAX_CHARS // 2 + 1
    good, bad = summaries.filter(F.col("error").isNull()), summaries.filter(F.col("error").isNotNull())
    totals = summaries.agg(
        F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("jobs_fetched"))), F.lit(0)).alias("jobs"),
        F.count_if(F.col("error").isNull()).alias("good"),
        F.count(F.lit(1)).alias("all"),
    )
    by_count = [F.col("jobs_fetched").desc(), F.lower("company_name"), F.col("source_id")]
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    good_line = F.concat(F.lit("- "), shown("company_name"), F.lit(": "), shown("jobs_fetched"))
    bad_line = F.concat(F.lit("- "), shown("company_name"), F.lit(" ("), shown("careers_url"), F.lit("): "), "error")

    def listed(rows: DataFrame, kind: str, order: list, line: Column) -> DataFrame:
        top = rows.orderBy(*order).limit(enough).withColumn("i", F.row_number().over(W.orderBy(*order)))
        return top.select(F.lit(kind).alias("kind"), "i", line.alias("line"))

    def gathered(kind: str) -> Column:
        mine = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("i", "line"))))
        return F.transform(mine, lambda x: x["line"]).alias(f"{kind}_lines")

    # the totals and the lines of each list that can show, brought to one row
    joined = (
        totals.unionByName(listed(good, "good", by_count, good_line), allowMissingColumns=True)
        .unionByName(listed(bad, "bad", [F.col("source_id")], bad_line), allowMissingColumns=True)
        .agg(*[F.max(c).alias(c) for c in ("jobs", "good", "all")], gathered("good"), gathered("bad"))
    )
    failed = F.col("all") - F.col("good")
    none = F.array().cast("array<string>")
    head = F.array(
        F.concat(F.lit("Scrape Summary | "), local_time_label(run_at, zone), F.lit(" " + zone)),
        F.concat(
            F.lit("Vacancies scraped: "), F.col("jobs").cast("string"), F.lit(" across "),
            F.col("good").cast("string"), F.lit("/"), F.col("all").cast("string"), F.lit(" sources"),
        ),
    )
    good_part = F.when(F.col("good") > 0, F.concat(F.array(F.lit(""), F.lit("Per company:")), "good_lines")).otherwise(none)
    bad_title = F.concat(F.lit("Errored sources ("), failed.cast("string"), F.lit("):"))
    bad_part = F.when(failed > 0, F.concat(F.array(F.lit(""), bad_title), "bad_lines")).otherwise(none)
    return joined.select(truncate_text(F.array_join(F.concat(head, good_part, bad_part), "\n"), MAX_CHARS).alias("report_text"))
