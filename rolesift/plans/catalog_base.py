"""Shared pieces of the query catalogue.

The job-posting columns are stood in for by the given tables: a document is a
posting (first line its title, text its description), a page a landed page, and
so on. Each entry is a Spark query and, where SQL can say it, the SQL to check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.session import spread_if_few

SPACES = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of long texts, spread over the cores."""
    return spread_if_few(table(spark, sf_dir, name).select(*columns))


def sql_clean(expr: str) -> str:
    return f"trim(regexp_replace(coalesce({expr}, ''), '{SPACES}', ' ', 'g'))"


def sql_unescape(expr: str) -> str:
    """The entities that occur in ``pages``."""
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&"), ("&amp", "&")):
        expr = f"replace({expr}, '{entity}', '{char}')"
    return expr


def sql_canonical_url(expr: str) -> str:
    """For URLs whose query is one of the shapes of ``pages``."""
    bare = f"regexp_replace({expr}, '#.*$', '')"
    kept = f"regexp_replace({bare}, '\\?utm_[^&]*$', '')"
    return f"regexp_replace({kept}, '/+($|\\?)', '\\1')"


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def document_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw postings."""
    return texts(spark, sf_dir, "documents", "source", "doc_id", "text", "lang").select(
        F.col("source").alias("source_id"),
        F.lit(0).alias("page_index"),
        F.col("doc_id").alias("job_index"),
        F.col("doc_id").cast("string").alias("external_id"),
        F.concat(F.lit("https://"), "source", F.lit(".Example.com/Jobs/"), F.col("doc_id").cast("string"), F.lit("/?utm_source=x&b=2")).alias("url"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(F.col("lang") == "de", "Berlin").when(F.col("lang") == "en", "  London \n UK ").alias("location"),
        F.col("text").alias("description"),
        F.lit(None).cast("timestamp").alias("posted_at"),
        F.initcap("source").alias("company_name"),
        F.when(F.col("lang") == "fr", "Remote").alias("country_hint"),
    )


SQL_POSTINGS = f"""
  SELECT source AS source_id, doc_id AS job_index, CAST(doc_id AS VARCHAR) AS external_id,
         'https://' || source || '.example.com/Jobs/' || doc_id || '?b=2' AS url,
         {sql_clean("split_part(text, chr(10), 1)")} AS title,
         CASE lang WHEN 'de' THEN 'Berlin' WHEN 'en' THEN 'London UK' WHEN 'fr' THEN 'Remote' ELSE '' END AS location,
         {sql_clean("text")} AS description,
         upper(left(source, 1)) || substr(source, 2) AS company
  FROM documents"""
SQL_HASH = (
    "sha256(source_id || '|' || external_id || '|' || url || '|' || lower(title) || '|' || lower(location))"
)
