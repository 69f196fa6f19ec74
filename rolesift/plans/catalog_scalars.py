"""Catalogue: scalar functions, normalisation and dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.functions import text as tx
from rolesift.functions import urls
from rolesift.functions.keys import canonical_hash, location_or_hint
from rolesift.operators.normalize import dedupe_source_jobs, first_wins, normalize_jobs
from rolesift.plans.catalog_base import (
    SQL_HASH,
    SQL_POSTINGS,
    document_postings,
    sql_canonical_url,
    sql_clean,
    sql_unescape,
    stamp,
    table,
    texts,
)


def clean_text(spark, sf) -> DataFrame:
    cleaned = tx.clean(F.col("text"))
    return texts(spark, sf, "documents", "doc_id", "text").select("doc_id", F.md5(cleaned).alias("digest"), F.length(cleaned).cast("long").alias("chars"))


def compact_text(spark, sf) -> DataFrame:
    return texts(spark, sf, "pages", "page_id", "html").select("page_id", F.md5(tx.compact(F.col("html"))).alias("digest"))


def parse_datetime(spark, sf) -> DataFrame:
    d = F.col("o_orderdate").cast("timestamp")
    written = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(d, "yyyy/MM/dd"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(d, "yyyyMMdd'T'HHmm'+0200'"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.date_format(d, "'Mon, 'd MMM yyyy HH:mm:ss '-0330'"))
        .otherwise(F.concat(F.lit("Posted "), F.date_format(d, "yyyy-MM-dd")))
    )
    return table(spark, sf, "orders").select("o_orderkey", stamp(tx.parse_datetime(written)).alias("posted_at"))


_HREFS = {"root": "/x/y", "up": "../up", "query": "?page=3", "sibling": "next", "host": "//cdn.example.org/a", "full": "https://o.example.org/p", "blank": "", "fragment": "#f"}


def join_url(spark, sf) -> DataFrame:
    forms = F.array(*[F.struct(F.lit(k).alias("form"), F.lit(v).alias("href")) for k, v in _HREFS.items()])
    return table(spark, sf, "pages").select("page_id", "url", F.explode(forms).alias("h")).select(
        "page_id", F.col("h.form").alias("form"), urls.join_url(F.col("url"), F.col("h.href")).alias("joined")
    )


def canonical_url(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("url"))


def natural_key(spark, sf) -> DataFrame:
    key = canonical_hash(
        F.lit("web"), F.col("page_id").cast("string"), urls.canonical_url(F.col("url")), F.col("html"), F.lit("Berlin  DE")
    )
    return table(spark, sf, "pages").select("page_id", key.alias("canonical_hash"))


def slugify(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.slugify(F.col("text")).alias("slug"))


def location_hint(spark, sf) -> DataFrame:
    told = F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("\t town ")))
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf, "customer").join(nations, "c_nationkey", "left").select(
        "c_custkey", location_or_hint(told, F.col("n_name")).alias("location")
    )


def url_template(spark, sf) -> DataFrame:
    template = F.when(F.col("p_size") > 40, F.lit("https://x/{city}/{id}")).otherwise(F.lit("https://x/jobs/{id}-{slug}?t={title}"))
    values = {"id": F.col("p_partkey").cast("string"), "slug": tx.slugify(F.col("p_name")), "title": F.col("p_name")}
    return table(spark, sf, "part").select("p_partkey", tx.fill_template(template, values).alias("url"))


def url_ids(spark, sf) -> DataFrame:
    url = F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), F.lit("/"), (F.col("page_id") * 37).cast("string"), F.lit("/"))
    return table(spark, sf, "pages").select(
        "page_id",
        urls.url_tail(url).alias("tail"),
        urls.long_number(url).alias("long_number"),
        urls.number_after_second_segment(url).alias("closing_number"),
    )


def local_time_label(spark, sf) -> DataFrame:
    zone = tx.known_zone("Europe/Berlin")
    utc = tx.known_zone("Nowhere/Land")
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        "event_id", tx.local_time_label(ts, zone).alias("local"), tx.local_time_label(ts, utc).alias("fallback")
    )


def truncate_text(spark, sf) -> DataFrame:
    cut = tx.truncate_text(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(cut).cast("long").alias("chars"), F.md5(cut).alias("digest"))


def lenient_int(spark, sf) -> DataFrame:
    said = (
        F.when(F.col("p_size") < 10, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")))
        .when(F.col("p_size") < 20, F.concat(F.col("p_size").cast("string"), F.lit(".5")))
        .when(F.col("p_size") < 30, (-F.col("p_size")).cast("string"))
        .when(F.col("p_size") < 40, F.col("p_brand"))
    )
    return table(spark, sf, "part").select("p_partkey", tx.lenient_int(said, 15, 1).cast("long").alias("n"))


def normalized_postings(spark, sf) -> DataFrame:
    return normalize_jobs(document_postings(spark, sf)).select(
        "source_id", "job_index", "company", "title", "location", "url", F.md5("description").alias("description"), "canonical_hash"
    )


def first_copy_wins(spark, sf) -> DataFrame:
    """One document per (source, text), the lowest id."""
    return first_wins(table(spark, sf, "documents").select("source", "text", "doc_id", "lang"), ["source", "text"], ["doc_id"]).select(
        "source", "doc_id", "lang"
    )


def source_dedupe(spark, sf) -> DataFrame:
    """Events as raw jobs, URL by user and title by type: the first of each stays."""
    jobs = table(spark, sf, "events").select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("source_id"),
        F.concat(F.lit("/u/"), F.col("props")).alias("url"),
        F.col("event_type").alias("title"),
        F.col("event_id").alias("page_index"),
        F.lit(0).alias("job_index"),
    )
    return dedupe_source_jobs(jobs).select("source_id", "url", "title", F.col("page_index").alias("event_id"))


_HOST = "regexp_extract(url, '^(https?://[^/]*)', 1)"
_PATH = "regexp_extract(url, '^https?://[^/]*([^?#]*)', 1)"
_DIR = f"regexp_extract({_PATH}, '^(.*/)', 1)"
_UPDIR = f"regexp_replace({_DIR}, '[^/]*/$', '')"

QUERIES = {
    "clean_text": (clean_text, f"SELECT doc_id, md5({sql_clean('text')}) AS digest, length({sql_clean('text')}) AS chars FROM documents"),
    "compact_text": (compact_text, f"SELECT page_id, md5({sql_clean(sql_unescape('html'))}) AS digest FROM pages"),
    "parse_datetime": (
        parse_datetime,
        """SELECT o_orderkey, strftime(CASE o_orderpriority
             WHEN '1-URGENT' THEN o_orderdate
             WHEN '2-HIGH' THEN date_trunc('day', o_orderdate)
             WHEN '3-MEDIUM' THEN date_trunc('minute', o_orderdate) - INTERVAL 2 HOUR
             WHEN '4-NOT SPECIFIED' THEN o_orderdate + INTERVAL 210 MINUTE
           END, '%Y-%m-%d %H:%M:%S') AS posted_at FROM orders""",
    ),
    "join_url": (
        join_url,
        f"""SELECT page_id, form, CASE form
              WHEN 'root' THEN {_HOST} || '/x/y'
              WHEN 'up' THEN {_HOST} || {_UPDIR} || 'up'
              WHEN 'query' THEN {_HOST} || {_PATH} || '?page=3'
              WHEN 'sibling' THEN {_HOST} || {_DIR} || 'next'
              WHEN 'host' THEN regexp_extract(url, '^(https?:)', 1) || '//cdn.example.org/a'
              WHEN 'full' THEN 'https://o.example.org/p'
              WHEN 'blank' THEN ''
              WHEN 'fragment' THEN regexp_replace(url, '#.*$', '') || '#f' END AS joined
            FROM pages, (SELECT unnest(['root', 'up', 'query', 'sibling', 'host', 'full', 'blank', 'fragment']) AS form)""",
    ),
    "canonical_url": (canonical_url, f"SELECT page_id, {sql_canonical_url('url')} AS url FROM pages"),
    "natural_key": (
        natural_key,
        f"""SELECT page_id, sha256('web|' || page_id || '|' || {sql_canonical_url('url')} || '|' ||
              lower({sql_clean("html")}) || '|berlin de') AS canonical_hash
            FROM pages""",
    ),
    "slugify": (
        slugify,
        r"""SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(text),
              '[^\p{L}\p{N}]+', '-', 'g'), '-'), ''), 'job') AS slug FROM documents""",
    ),
    "location_hint": (
        location_hint,
        """SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN lower(c_mktsegment) || ' town'
             ELSE coalesce(n_name, '') END AS location
           FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    ),
    "url_template": (
        url_template,
        """SELECT p_partkey, CASE WHEN p_size > 40 THEN '' ELSE 'https://x/jobs/' || p_partkey || '-' ||
             replace(lower(p_name), ' ', '-') || '?t=' || p_name END AS url FROM part""",
    ),
    "url_ids": (
        url_ids,
        """SELECT page_id, CAST(page_id * 37 AS VARCHAR) AS tail,
             nullif(regexp_extract(regexp_extract(url, '^([^?#]*)', 1) || '/' || (page_id * 37) || '/', '[0-9]{4,}'), '') AS long_number,
             CASE WHEN NOT regexp_matches(url, '^[^?#]*/([?#]|$)') THEN CAST(page_id * 37 AS VARCHAR) END AS closing_number FROM pages""",
    ),
    "local_time_label": (
        local_time_label,
        """SELECT event_id, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS local,
             strftime(ts, '%Y-%m-%d %H:%M') AS fallback FROM events""",
    ),
    "truncate_text": (
        truncate_text,
        """SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, CASE WHEN length(text) > 3900
             THEN left(text, 3885) || chr(10) || '...(truncated)' ELSE text END AS t FROM documents)""",
    ),
    "lenient_int": (
        lenient_int,
        """SELECT p_partkey, CAST(CASE WHEN p_size < 10 THEN greatest(p_size, 1) WHEN p_size < 20 THEN 15
             WHEN p_size < 30 THEN 1 ELSE 15 END AS BIGINT) AS n FROM part""",
    ),
    "normalized_postings": (
        normalized_postings,
        f"""SELECT source_id, job_index, company, title, location, url, md5(description) AS description,
              {SQL_HASH} AS canonical_hash FROM ({SQL_POSTINGS})""",
    ),
    "first_copy_wins": (
        first_copy_wins,
        "SELECT source, doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source, text ORDER BY doc_id) = 1",
    ),
    "source_dedupe": (
        source_dedupe,
        """SELECT 's' || user_id AS source_id, '/u/' || props AS url, event_type AS title, min(event_id) AS event_id
           FROM events GROUP BY 1, 2, 3""",
    ),
}
