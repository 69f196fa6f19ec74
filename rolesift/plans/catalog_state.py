"""Catalogue: keyed state, suppression, summaries, digest and report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.operators import accounting, digest, state
from rolesift.plans.catalog_base import stamp, table
from rolesift.session import materialize
from rolesift.sources.store import RunStore

_NOW = "2024-01-15 12:00:00"


def _now() -> F.Column:
    return F.lit(_NOW).cast("timestamp")


# --------------------------------------------------------------------------
# sources


def _stored_and_configured(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Suppliers as stored sources; those of the first nations, and nations, as configs."""
    suppliers = table(spark, sf, "supplier")
    past = F.lit("2020-01-01").cast("timestamp")
    empty = F.create_map().cast("map<string,string>")

    def rows(df: DataFrame, sid, company, enabled) -> DataFrame:
        return df.select(
            sid.alias("source_id"), company.alias("company_name"), F.concat(F.lit("https://"), sid).alias("careers_url"),
            F.lit("lever").alias("parser_type"), F.lit(None).cast("string").alias("country_hint"), empty.alias("selectors"),
            enabled.alias("enabled"),
        )

    sid = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    stored = rows(suppliers, sid, F.col("s_name"), F.col("s_acctbal") > 1000).withColumns({"created_at": past, "updated_at": past})
    known = rows(suppliers.filter("s_nationkey < 15"), sid, F.upper("s_name"), F.col("s_acctbal") > 5000)
    fresh = rows(table(spark, sf, "nation"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.col("n_name"), F.lit(True))
    return stored, known.unionByName(fresh)


def upsert_sources(spark, sf) -> DataFrame:
    stored, configs = _stored_and_configured(spark, sf)
    return state.upsert_sources(stored, configs, _now()).select(
        "source_id", "company_name", "enabled", stamp(F.col("created_at")).alias("created_at"), stamp(F.col("updated_at")).alias("updated_at")
    )


def active_sources(spark, sf) -> DataFrame:
    """Enabled and configured; page options come from the config."""
    stored, configs = _stored_and_configured(spark, sf)
    optioned = configs.withColumn("jobs_path", F.concat(F.lit("p."), "source_id"))
    return state.active_sources(state.upsert_sources(stored, configs, _now()), optioned).select("source_id", "company_name", "jobs_path")


# --------------------------------------------------------------------------
# vacancies


def _order_postings(spark, sf, where: str) -> DataFrame:
    return table(spark, sf, "orders").filter(where).select(
        F.lit("shop").alias("source_id"), F.col("o_custkey").cast("string").alias("canonical_hash"),
        F.col("o_orderkey").cast("string").alias("external_id"), F.col("o_orderpriority").alias("url"),
        F.col("o_orderstatus").alias("title"), F.lit("x").alias("location"), F.lit("").alias("description"),
        F.col("o_orderdate").cast("timestamp").alias("posted_at"), "o_orderkey",
    )


def last_sighting_wins(spark, sf) -> DataFrame:
    """Several hits of one key in a run: the last in order stays."""
    kept = state.last_sightings(_order_postings(spark, sf, "true"), ["posted_at", "o_orderkey"])
    return kept.select("canonical_hash", "external_id", "url", "title", stamp(F.col("posted_at")).alias("posted_at"))


def upsert_vacancies(spark, sf) -> DataFrame:
    """Orders before mid 1996 as the snapshot, later ones as a run with an earlier clock."""
    split, seen, run_at = "1996-06-01", F.lit("1996-06-01").cast("timestamp"), F.lit("1996-03-01").cast("timestamp")
    early = state.last_sightings(_order_postings(spark, sf, f"o_orderdate < timestamp_ntz'{split}'"), ["posted_at", "o_orderkey"])
    late = state.last_sightings(_order_postings(spark, sf, f"o_orderdate >= timestamp_ntz'{split}'"), ["posted_at", "o_orderkey"])
    snapshot = early.withColumns({"first_seen_at": seen, "last_seen_at": seen})
    return state.upsert_vacancies(snapshot, late, run_at).select(
        "canonical_hash", "external_id", "url", stamp(F.col("first_seen_at")).alias("first_seen_at"), stamp(F.col("last_seen_at")).alias("last_seen_at")
    )


def fold_sightings(spark, sf) -> DataFrame:
    """Thirty daily runs of sightings folded to one row per user."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    daily = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("canonical_hash"), day.alias("first_seen_at")).agg(
        F.max_by("event_type", "event_id").alias("title"), F.max("event_id").cast("string").alias("external_id")
    )
    rows = daily.select(
        F.lit("web").alias("source_id"), "canonical_hash", "external_id", F.lit("u").alias("url"), "title", F.lit("").alias("location"),
        F.lit("").alias("description"), F.lit(None).cast("timestamp").alias("posted_at"), "first_seen_at",
        F.col("first_seen_at").alias("last_seen_at"), F.dayofmonth("first_seen_at").cast("long").alias("run_id"),
    )
    return state.fold_sightings(rows).select(
        "canonical_hash", "external_id", "title", stamp(F.col("first_seen_at")).alias("first_seen_at"),
        stamp(F.col("last_seen_at")).alias("last_seen_at"), "run_id",
    )


# --------------------------------------------------------------------------
# notices


def suppressed_postings(spark, sf) -> DataFrame:
    """Events after the run time against notices from purchases before it."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    keyed = events.select(
        F.col("event_type").alias("source_id"), F.col("user_id").cast("string").alias("canonical_hash"), "ts", "value", "event_id"
    )
    notices = state.new_notifications(keyed.filter(F.col("ts") < _now()).withColumn("source_id", F.lit("view")), F.col("ts"), 2)
    other = state.new_notifications(keyed.filter("value > 60"), F.col("ts"), 20, channel="mail")
    fresh = state.drop_suppressed(keyed.filter(F.col("ts") >= _now()), notices.unionByName(other), _now())
    return fresh.select("source_id", "canonical_hash", "event_id")


def suppression_history(spark, sf) -> DataFrame:
    """What would be sent over all events, 7 days apart, per user and type."""
    return state.sent_in_history(table(spark, sf, "events"), ["user_id", "event_type"], "ts", 7).select(
        "user_id", "event_type", stamp(F.col("ts")).alias("sent_at")
    )


def suppression_history_hot_keys(spark, sf) -> DataFrame:
    """The same per type alone, with keys too long for one array."""
    return state.sent_in_history(table(spark, sf, "events"), ["event_type"], "ts", 3, limit=500).select(
        "event_type", stamp(F.col("ts")).alias("sent_at")
    )


def published_runs(spark, sf) -> DataFrame:
    """Notices appended run by run; only those of published runs are read."""
    from rolesift.session import shared_folder
    import uuid

    store = RunStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for run_id, kind in enumerate(["view", "click", "error", "purchase", "signup"], start=1):
        rows = events.filter(F.col("event_type") == kind).select(F.col("event_type").alias("source_id"), F.col("user_id").cast("string").alias("canonical_hash"), "ts")
        store.write("notifications", run_id, state.new_notifications(rows, F.col("ts")))
        if kind != "error":
            account = rows.agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.count("*").alias("jobs_sent"))
            store.write("runs", run_id, account.withColumns({
                "status": F.lit("success"), "sources_total": F.lit(1).cast("long"), "jobs_fetched": F.col("jobs_sent"),
                "jobs_matched": F.col("jobs_sent"), "error_summary": F.lit(None).cast("string"), "trigger": F.lit(None).cast("string")}))
    return store.read("notifications").groupBy("source_id", "run_id").agg(
        F.count("*").alias("n"), stamp(F.max("dedupe_until")).alias("last_until")
    )


# --------------------------------------------------------------------------
# summaries


def _summaries(spark, sf) -> DataFrame:
    """Documents as jobs per source; every fifth source failed, suppliers gave nothing."""
    jobs = table(spark, sf, "documents").select(F.col("source").alias("source_id"))
    number = F.regexp_extract("source_id", r"(\d+)", 1).cast("int")
    good = jobs.distinct().withColumn("error", F.when(number % 5 == 0, F.concat(F.lit("timeout after "), number.cast("string"), F.lit("s"))))
    idle = table(spark, sf, "supplier").select(F.concat(F.lit("sup"), F.col("s_suppkey").cast("string")).alias("source_id"), F.lit(None).cast("string").alias("error"))
    outcomes = good.unionByName(idle).withColumns({"company_name": F.initcap("source_id"), "careers_url": F.concat(F.lit("https://"), "source_id")})
    return accounting.source_summaries(jobs, outcomes)


def source_summary(spark, sf) -> DataFrame:
    return _summaries(spark, sf)


def run_counters(spark, sf) -> DataFrame:
    return accounting.run_counters(_summaries(spark, sf))


def run_report(spark, sf) -> DataFrame:
    return digest.run_report(_summaries(spark, sf), _now())


def _items(spark, sf, n: int) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.initcap("source").alias("company"), F.col("source").alias("source_id"), F.col("doc_id").alias("job_index"),
        F.lit(0).alias("page_index"), F.md5("text").alias("title"), F.when(F.col("lang") == "en", "London").alias("location"),
        F.concat(F.lit("https://x/"), F.col("doc_id").cast("string")).alias("url"), F.round(F.col("n_chars") / 1000).alias("score"),
    )
    return digest.top_items(docs, n)


def top_items(spark, sf) -> DataFrame:
    """Fifty best of the documents, many scores tied."""
    return _items(spark, sf, 50).select("source_id", F.col("job_index").alias("doc_id"), "score")


def digest_lines(spark, sf) -> DataFrame:
    lines = digest.digest_lines(_items(spark, sf, 90), F.lit(70))
    return lines.select(F.col("rank").cast("long").alias("rank"), "line", "fits")


def digest_text(spark, sf) -> DataFrame:
    """Ninety items, more than a message holds."""
    items = materialize(_items(spark, sf, 90))
    return digest.digest_text(items, _now(), F.lit(19), F.lit(1234), "Europe/Berlin")


_S = "'s' || s_suppkey"
_SOURCES = f"""(SELECT coalesce(o.sid, c.sid) AS source_id, CASE WHEN c.sid IS NOT NULL THEN c.name ELSE o.name END AS company_name,
    CASE WHEN c.sid IS NOT NULL THEN c.on_ ELSE false END AS enabled, CASE WHEN o.sid IS NULL THEN '{_NOW}' ELSE '2020-01-01 00:00:00' END AS created_at,
    CASE WHEN c.sid IS NOT NULL THEN '{_NOW}' ELSE '2020-01-01 00:00:00' END AS updated_at
  FROM (SELECT {_S} AS sid, s_name AS name FROM supplier) o FULL JOIN
    (SELECT {_S} AS sid, upper(s_name) AS name, s_acctbal > 5000 AS on_ FROM supplier WHERE s_nationkey < 15
     UNION ALL SELECT 'n' || n_nationkey, n_name, true FROM nation) c ON o.sid = c.sid)"""
_SUMMARY = """(SELECT s.source_id, upper(left(s.source_id, 1)) || substr(s.source_id, 2) AS company_name, 'https://' || s.source_id AS careers_url,
    CASE WHEN error IS NULL THEN coalesce(n, 0) ELSE 0 END AS jobs_fetched, error FROM
    (SELECT DISTINCT source AS source_id, CASE WHEN CAST(substr(source, 4) AS INT) % 5 = 0 THEN 'timeout after ' || CAST(substr(source, 4) AS INT) || 's' END AS error
     FROM documents UNION ALL SELECT 'sup' || s_suppkey, NULL FROM supplier) s LEFT JOIN
    (SELECT source, count(*) AS n FROM documents GROUP BY 1) d ON d.source = s.source_id)"""
_ITEMS = """(SELECT *, row_number() OVER (ORDER BY score DESC, source_id, doc_id) AS rank FROM (SELECT upper(left(source, 1)) || substr(source, 2) AS company, source AS source_id, doc_id,
    md5(text) AS title, CASE WHEN lang = 'en' THEN 'London' ELSE 'Unknown location' END AS location,
    'https://x/' || doc_id AS url, round(n_chars / 1000) AS score FROM documents) ORDER BY rank LIMIT {n})"""
_LINE = "rank || '. ' || company || ' | ' || title || ' | ' || location || ' | ' || url"
_HEADER = "'ML Vacancy Digest | 2024-01-15 13:00' || chr(10) || 'New matched vacancies: ' || n || chr(10)"


def _history(key: str, days: int) -> str:
    same = " AND ".join(f"e.{k.strip()} = s.{k.strip()}" for k in key.split(","))
    return f"""WITH RECURSIVE s AS (SELECT {key}, min(ts) AS ts FROM events GROUP BY ALL UNION ALL
      SELECT {', '.join('e.' + k.strip() for k in key.split(','))}, min(e.ts) FROM s JOIN events e ON {same} AND e.ts >= s.ts + INTERVAL {days} DAY GROUP BY ALL)
      SELECT {key}, strftime(ts, '%Y-%m-%d %H:%M:%S') AS sent_at FROM s"""


QUERIES = {
    "upsert_sources": (upsert_sources, f"SELECT * FROM {_SOURCES}"),
    "active_sources": (
        active_sources,
        f"SELECT source_id, company_name, 'p.' || source_id AS jobs_path FROM {_SOURCES} WHERE enabled",
    ),
    "last_sighting_wins": (
        last_sighting_wins,
        """SELECT CAST(o_custkey AS VARCHAR) AS canonical_hash, CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority AS url,
             o_orderstatus AS title, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS posted_at FROM orders
           QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    ),
    "upsert_vacancies": (
        upsert_vacancies,
        """WITH l AS (SELECT *, o_orderdate >= TIMESTAMP '1996-06-01' AS late FROM orders
                      QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate >= TIMESTAMP '1996-06-01' ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
           SELECT CAST(coalesce(n.o_custkey, o.o_custkey) AS VARCHAR) AS canonical_hash, CAST(coalesce(n.o_orderkey, o.o_orderkey) AS VARCHAR) AS external_id,
             coalesce(n.o_orderpriority, o.o_orderpriority) AS url, CASE WHEN o.o_custkey IS NULL THEN '1996-03-01 00:00:00' ELSE '1996-06-01 00:00:00' END AS first_seen_at,
             CASE WHEN n.o_custkey IS NULL THEN '1996-06-01 00:00:00' ELSE '1996-03-01 00:00:00' END AS last_seen_at
           FROM (SELECT * FROM l WHERE late) n FULL JOIN (SELECT * FROM l WHERE NOT late) o ON n.o_custkey = o.o_custkey""",
    ),
    "fold_sightings": (
        fold_sightings,
        """SELECT CAST(user_id AS VARCHAR) AS canonical_hash, CAST(max(event_id) FILTER (d = ld) AS VARCHAR) AS external_id,
             arg_max(event_type, event_id) FILTER (d = ld) AS title, strftime(min(d), '%Y-%m-%d 00:00:00') AS first_seen_at,
             strftime(max(d), '%Y-%m-%d 00:00:00') AS last_seen_at, CAST(day(max(d)) AS BIGINT) AS run_id
           FROM (SELECT *, CAST(ts AS DATE) AS d, max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS ld FROM events) GROUP BY user_id""",
    ),
    "suppressed_postings": (
        suppressed_postings,
        f"""SELECT event_type AS source_id, CAST(user_id AS VARCHAR) AS canonical_hash, event_id FROM events e WHERE ts >= TIMESTAMP '{_NOW}'
              AND NOT (event_type = 'view' AND EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.ts < TIMESTAMP '{_NOW}'
                AND p.ts + INTERVAL 2 DAY > TIMESTAMP '{_NOW}'))""",
    ),
    "suppression_history": (suppression_history, _history("user_id, event_type", 7)),
    "suppression_history_hot_keys": (suppression_history_hot_keys, _history("event_type", 3)),
    "published_runs": (
        published_runs,
        """SELECT event_type AS source_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 4 ELSE 5 END::BIGINT AS run_id, count(*) AS n,
             strftime(max(ts) + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS last_until FROM events WHERE event_type <> 'error' GROUP BY 1, 2""",
    ),
    "source_summary": (source_summary, f"SELECT source_id, company_name, careers_url, jobs_fetched, error FROM {_SUMMARY}"),
    "run_counters": (
        run_counters,
        f"""SELECT count(*) AS sources_total, CAST(sum(jobs_fetched) AS BIGINT) AS jobs_fetched, count(error) AS errors_total, 'partial_failure' AS status,
              '{{' || string_agg('"' || source_id || '":"' || error || '"', ',' ORDER BY source_id) FILTER (error IS NOT NULL) || '}}' AS error_summary FROM {_SUMMARY}""",
    ),
    "run_report": (
        run_report,
        f"""WITH s AS (SELECT * FROM {_SUMMARY}), t AS (SELECT 'Scrape Summary | 2024-01-15 12:00 UTC' || chr(10) || 'Vacancies scraped: ' || CAST(sum(jobs_fetched) AS BIGINT)
                || ' across ' || count(*) FILTER (error IS NULL) || '/' || count(*) || ' sources' || chr(10) || chr(10) || 'Per company:' || chr(10)
                || string_agg('- ' || company_name || ': ' || jobs_fetched, chr(10) ORDER BY jobs_fetched DESC, lower(company_name), source_id) FILTER (error IS NULL)
                || chr(10) || chr(10) || 'Errored sources (' || count(error) || '):' || chr(10)
                || string_agg('- ' || company_name || ' (' || careers_url || '): ' || error, chr(10) ORDER BY source_id) FILTER (error IS NOT NULL) AS r FROM s)
            SELECT CASE WHEN length(r) > 3900 THEN left(r, 3885) || chr(10) || '...(truncated)' ELSE r END AS report_text FROM t""",
    ),
    "top_items": (top_items, f"SELECT source_id, doc_id, score FROM {_ITEMS.format(n=50)}"),
    "digest_lines": (
        digest_lines,
        f"SELECT rank, line, 70 + sum(length(line) + 1) OVER (ORDER BY rank) <= 3900 AS fits FROM (SELECT rank, {_LINE} AS line FROM {_ITEMS.format(n=90)})",
    ),
    "digest_text": (
        digest_text,
        f"""WITH l AS (SELECT rank, {_LINE} AS line, count(*) OVER () AS n FROM {_ITEMS.format(n=90)}),
              f AS (SELECT *, length({_HEADER}) + sum(length(line) + 1) OVER (ORDER BY rank) <= 3900 AS fits FROM l),
              a AS (SELECT any_value(n) AS n, count(*) FILTER (fits) AS k, string_agg(line, chr(10) ORDER BY rank) FILTER (fits) AS body FROM f)
            SELECT {_HEADER} || coalesce(chr(10) || body, '') || CASE WHEN n > k THEN chr(10) || '...and ' || (n - k) || ' more matches were omitted due to Telegram length limits.' ELSE '' END
              || chr(10) || chr(10) || 'Sources scanned: 19 | Matched before dedupe: 1234 | Timezone: Europe/Berlin' AS digest_text,
              n AS jobs_sent, k AS lines_shown, n - k AS lines_omitted FROM a""",
    ),
}
