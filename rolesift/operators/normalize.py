"""Raw postings to comparable ones, and the source-level first-wins dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.functions.keys import canonical_hash, location_or_hint
from rolesift.functions.text import clean
from rolesift.functions.urls import canonical_url

ORDINALS = ["page_index", "job_index"]


def first_wins(rows: DataFrame, keys: list[str], ordinals: list[str]) -> DataFrame:
    """The earliest row of each key.

    An aggregate, not a window: copies of a hot key collapse inside each map
    task, so at most one row per key and task is shuffled.
    """
    order = F.struct(*ordinals)
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, "_row.*").select(*rows.columns)


def dedupe_source_jobs(raw_jobs: DataFrame) -> DataFrame:
    """One row per (source, raw URL, title), over all pages of the source."""
    return first_wins(raw_jobs, ["source_id", "url", "title"], ORDINALS)


def normalize_jobs(raw_jobs: DataFrame) -> DataFrame:
    """Clean text, canonical URL, location with country hint, natural key.

    Needs ``company_name`` and ``country_hint`` next to the raw posting.
    """
    kept = [c for c in raw_jobs.columns if c not in ("title", "location", "url", "description", "company_name", "country_hint")]
    tidy = raw_jobs.select(
        *kept,
        clean(F.col("company_name")).alias("company"),
        clean(F.col("title")).alias("title"),
        location_or_hint(F.col("location"), F.col("country_hint")).alias("location"),
        canonical_url(F.col("url")).alias("url"),
        clean(F.col("description")).alias("description"),
    )
    return tidy.withColumn(
        "canonical_hash",
        canonical_hash(F.col("source_id"), F.col("external_id"), F.col("url"), F.col("title"), F.col("location")),
    )
