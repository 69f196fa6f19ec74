"""Per-source summaries and the one-row account of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_summaries(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Jobs after dedupe per source, 0 where it failed or had none."""
    counts = jobs.groupBy("source_id").agg(F.count("*").alias("_jobs"))
    return outcomes.join(counts, "source_id", "left").select(
        "source_id",
        "company_name",
        "careers_url",
        F.when(F.col("error").isNull(), F.coalesce("_jobs", F.lit(0))).otherwise(0).cast("long").alias("jobs_fetched"),
        "error",
    )


def run_status(errors: Column, jobs_fetched: Column) -> Column:
    return F.when(errors == 0, "success").when(jobs_fetched > 0, "partial_failure").otherwise("failure")


# failed sources that the summary names; all of them stand in the run's table of errors
SUMMARY_ERRORS = 5000


def run_errors(summaries: DataFrame) -> DataFrame:
    """The failed sources of a run: a table like any other, however many they are."""
    return summaries.filter(F.col("error").isNotNull()).select("source_id", "error")


def run_counters(summaries: DataFrame, named: int = SUMMARY_ERRORS) -> DataFrame:
    """sources_total, jobs_fetched, errors and the error map as JSON with sorted keys.

    The map names the first ``named`` failed sources in order and counts the others
    under a last key ``...``.
    """
    totals = summaries.agg(
        F.count("*").alias("sources_total"),
        F.coalesce(F.sum("jobs_fetched"), F.lit(0)).alias("jobs_fetched"),
        F.count("error").alias("errors_total"),
    )
    first = run_errors(summaries).orderBy("source_id").limit(named)  # a top-k: no sort of all
    listed = first.agg(F.array_sort(F.collect_list(F.struct("source_id", "error"))).alias("_errors"))
    one = totals.unionByName(listed, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("sources_total", "jobs_fetched", "errors_total")],
        F.first("_errors", ignorenulls=True).alias("_errors"),
    )
    more = F.col("errors_total") - F.size("_errors")
    rest = F.when(more > 0, F.array(F.struct(F.lit("...").alias("source_id"), F.concat(more.cast("string"), F.lit(" more")).alias("error"))))
    entries = F.concat("_errors", F.coalesce(rest, F.array().cast("array<struct<source_id:string,error:string>>")))
    return one.select(
        "sources_total",
        "jobs_fetched",
        "errors_total",
        run_status(F.col("errors_total"), F.col("jobs_fetched")).alias("status"),
        F.when(F.size("_errors") > 0, F.to_json(F.map_from_entries(entries))).alias("error_summary"),
    )
