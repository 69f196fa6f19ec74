"""Catalogue: source configs, page frontier, and whole jobs."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions import urls
from rolesift.operators import pages as pg
from rolesift.operators import rules
from rolesift.plans.catalog_base import table, texts
from rolesift.plans.catalog_pages import _sql_links, event_copies
from rolesift.plans.jobs import RunParams, load_sources, run_once
from rolesift.session import shared_folder
from rolesift.sources.configs import config_violations, shape_configs
from rolesift.sources.frontier import page_frontier
from rolesift.sources.store import RunStore
from rolesift.streaming.recurring import recurring_run

# one config text per remainder of the supplier key
_CONFIGS = {
    0: '{"id": " c%d ", "company_name": "Co %d", "careers_url": "https://x.org/%d", "parser_type": "lever", "country_hint": " UK ", "note": {"a": 1}}',
    1: '{"id": "c%d", "company_name": "Co", "careers_url": "ftp://x", "parser_type": "generic_html", "enabled": false, "selectors": {"job_card": ".j", "mystery": "x", "odd": "y"}, "parser_options": {"jobs_path": "d"}, "pagination": {"strategy": "Query_Param ", "max_pages": "3"}}',
    2: '{"id": "c%d", "company_name": "Co", "careers_url": "http://x", "parser_type": "generic_json", "parser_options": {"jobs_path": "", "fields": {"title": "t"}, "deep": 1}, "pagination": {"strategy": "scroll", "max_pages": 0}}',
    3: '{"id": "c%d", "company_name": "Co", "careers_url": "http://x", "parser_type": "generic_json", "parser_options": {"jobs_path": "a.b", "fields": {"url": "u", "n": 5}}, "json_job_url_template": " https://x/{id} "}',
    4: '{"id": "c%d", "company_name": "Co", "careers_url": "http://x", "parser_type": "mystery", "enabled": null, "selectors": ["a"], "pagination": {"strategy": "x"}}',
    5: '{"id": "shared", "careers_url": "http://x"}',
    6: '{"id": "c%d", broken',
    7: '{"id": "c%d", "company_name": "Co", "careers_url": "http://x", "parser_type": "workday", "pagination": {"strategy": "offset_limit", "max_pages": 2, "limit": 0, "start_offset": "-1"}, "matching_profile": 7}',
}


def _config_files(spark, sf) -> DataFrame:
    key = F.col("s_suppkey")
    text = F.lit(None).cast("string")
    for n, template in _CONFIGS.items():
        text = F.when(key % 8 == n, F.replace(F.lit(template), F.lit("%d"), key.cast("string"))).otherwise(text)
    return table(spark, sf, "supplier").select(key.cast("string").alias("file"), text.alias("config_text"))


def config_shape(spark, sf) -> DataFrame:
    shaped = shape_configs(_config_files(spark, sf))
    return shaped.select(
        "file", "source_id", "company_name", "parser_type", "country_hint", "enabled", "jobs_path", "job_url_template",
        F.array_join(F.array_sort(F.map_keys("selectors")), ",").alias("selector_keys"),
        F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("field_names"),
        F.array_join(F.array_sort(F.map_keys("extra")), ",").alias("extra_keys"),
    )


def config_problems(spark, sf) -> DataFrame:
    return config_violations(_config_files(spark, sf)).filter("rule <> 'duplicate_id'").select("file", "severity", "rule", "message")


def duplicate_config_ids(spark, sf) -> DataFrame:
    return config_violations(_config_files(spark, sf)).filter("rule = 'duplicate_id'").select("source_id", "severity", "message")


def _paged(spark, sf, careers: Column, paging: Column) -> DataFrame:
    configs = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("source_id"),
        careers.alias("careers_url"),
        F.try_parse_json(paging).alias("pagination"),
        F.create_map().cast("map<string,variant>").alias("extra"),
    )
    return page_frontier(configs).select("source_id", F.col("page_index").cast("long").alias("page_index"), "url")


def page_frontier_query_param(spark, sf) -> DataFrame:
    """Follow-up pages by number; the careers URL names one of them already."""
    key = F.col("s_suppkey").cast("string")
    careers = F.concat(F.lit("https://x.org/"), key, F.lit("?a=1&page=2&a=b+c"))
    plain = F.concat(F.lit('{"strategy": "attrax_page_query", "max_pages": "'), (F.col("s_nationkey") % 6).cast("string"), F.lit('"}'))
    made = F.concat(F.lit('{"strategy": "query_param", "start_page": 0, "max_pages": 4, "url_template": "https://y.org/{page}'), F.when(F.col("s_nationkey") == 7, "{size}").otherwise(""), F.lit('"}'))
    return _paged(spark, sf, careers, F.when(F.col("s_acctbal") > 5000, made).otherwise(plain))


def page_frontier_offset_limit(spark, sf) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    careers = F.concat(F.lit("https://x.org/"), key)
    plain = F.concat(F.lit('{"strategy": "offset_limit", "max_pages": 3, "limit": "'), (F.col("s_nationkey") - 5).cast("string"), F.lit('"}'))
    made = F.lit('{"strategy": "offset_limit", "max_pages": 3, "limit": 25, "start_offset": 10, "url_template": "https://y.org/?n={limit}&o={offset}&p={page}"}')
    return _paged(spark, sf, careers, F.when(F.col("s_acctbal") > 5000, made).otherwise(plain))


def set_query_param(spark, sf) -> DataFrame:
    """A repeated key keeps its first place and its last value."""
    url = F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), F.lit("?cat=A+B&page=1&cat=C%26D&q="))
    made = urls.set_query_params(url, [(F.lit("page"), F.col("page_id").cast("string")), (F.lit("new"), F.lit("x y"))])
    return table(spark, sf, "pages").select("page_id", made.alias("url"))


# --------------------------------------------------------------------------
# jobs

_START = datetime(2024, 1, 2, 6, tzinfo=timezone.utc)
_RULES = rules.profile_of(
    positive={"th": {"weight": 0.7, "terms": ["th"]}, "en": {"weight": 0.6, "terms": ["en", "er"]}},
    negative={"on": {"weight": 0.2, "terms": ["on"]}},
    places=["london"],
)


_CAREERS = "https://menu.example.com/x/"


def _site_url(page: Column) -> Column:
    """Where a site's pages lie, as its frontier names them."""
    return F.when(page == 0, _CAREERS).otherwise(F.concat(F.lit(_CAREERS + "?page="), (page + 1).cast("string")))


def _site_fetches(spark, sf) -> DataFrame:
    """Pages as landed copies of ten sites, some failed, some blocked."""
    site, page = F.col("page_id") % 10, F.floor(F.col("page_id") / 10).cast("int")
    blocked = (page % 9 == 8) & (site % 3 == 1) | (F.col("page_id") == 4)
    return table(spark, sf, "pages").select(
        F.concat(F.lit("site"), site.cast("string")).alias("source_id"), page.alias("page_index"), _site_url(page).alias("url"), F.lit(0).alias("attempt"),
        F.lit("http").alias("channel"), F.when((F.col("page_id") % 17 == 5), 500).otherwise(200).alias("status_code"),
        F.when(blocked, F.concat("html", F.lit("unusual traffic"))).otherwise(F.col("html")).alias("content"),
        F.lit(None).cast("string").alias("error"), F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc)).alias("fetched_at"),
    )


def _site_configs(spark, sf, max_pages: int | None = None) -> DataFrame:
    """The ten sites with as many pages as landed, or as told."""
    numbers = table(spark, sf, "pages").select((F.col("page_id") % 10).cast("string").alias("n"), F.floor(F.col("page_id") / 10).alias("page"))
    sites = numbers.groupBy("n").agg((F.max("page") + 1 if max_pages is None else F.lit(max_pages)).cast("string").alias("pages"))
    text = F.concat(
        F.lit('{"id": "site'), "n", F.lit('", "company_name": "Site '), "n", F.lit('", "careers_url": "%s", "parser_type": "generic_html", "pagination": {"strategy": "query_param", "max_pages": ' % _CAREERS), "pages", F.lit('}, "country_hint": "'),
        F.when(F.col("n").isin("1", "2", "3"), "Paris").otherwise("London"), F.lit('", "enabled": '), F.when(F.col("n") == "9", "false").otherwise("true"),
        F.lit(', "selectors": {"job_card": "nav li", "title": "a", "link": "a"}}'),
    )
    return shape_configs(sites.select("n", text.alias("config_text")).withColumnRenamed("n", "file"))


def site_run(spark, sf) -> DataFrame:
    """A full run over the pages of ten sites."""
    store = RunStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    row = run_once(store, _site_fetches(spark, sf), _site_configs(spark, sf), _START, RunParams(min_score=0.4, profile=_RULES))
    return row.select("status", "sources_total", "jobs_fetched", "jobs_matched", "jobs_sent", "error_summary")


_FEWER = 3


def frontier_pages(spark, sf) -> DataFrame:
    """Landed pages that still count once the sites have three pages each; every fourth landed under an older URL,
    every fifth without one."""
    fetches, number = _site_fetches(spark, sf), F.col("page_index")
    older = F.concat(F.lit(_CAREERS + "?p="), number.cast("string"))
    url = F.when(number % 5 == 4, F.lit(None)).when(number % 4 == 1, older).otherwise(F.concat(F.col("url"), F.lit("#top")))
    kept = pg.of_frontier(fetches.withColumn("url", url), page_frontier(_site_configs(spark, sf, _FEWER + 3)))
    return kept.select("source_id", F.col("page_index").cast("long").alias("page_index"), F.length("content").cast("long").alias("size"))


def site_run_of_fewer_pages(spark, sf) -> DataFrame:
    """The second of two runs, between which ``max_pages`` fell to three."""
    store = RunStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    params = RunParams(min_score=0.4, profile=_RULES)
    for hour, pages in enumerate((None, _FEWER)):
        row = run_once(store, _site_fetches(spark, sf), _site_configs(spark, sf, pages), _START + timedelta(hours=hour), params, notify=False)
    return row.select(F.col("run_id").cast("long").alias("run_id"), "status", "sources_total", "jobs_fetched", "jobs_matched")


def site_matches(spark, sf) -> DataFrame:
    """The matches that a run appends, read back: how many of each site, score and decision."""
    store = RunStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    run_once(store, _site_fetches(spark, sf), _site_configs(spark, sf), _START, RunParams(min_score=0.4, profile=_RULES), notify=False)
    found = store.read("matches").groupBy("source_id", F.round("score", 6).alias("score"), "geo_pass", "decision", F.size("matched_terms").alias("terms"))
    return found.agg(F.count("*").alias("n"), F.count_distinct("canonical_hash").alias("keys"))


_LANDED_FIRST = 4


def recurring_site_runs(spark, sf) -> DataFrame:
    """Runs of a recurring job: the sites' first pages land, then the others, then nothing; a replay finds its run."""
    folder = f"{shared_folder(spark)}/recurring-{uuid.uuid4().hex}"
    store, params = RunStore(spark, f"{folder}/store"), RunParams(min_score=0.4, profile=_RULES)
    fetches = _site_fetches(spark, sf)
    for part in (F.col("page_index") < _LANDED_FIRST, F.col("page_index") >= _LANDED_FIRST, None):
        if part is not None:
            fetches.filter(part).write.mode("append").parquet(f"{folder}/landed")
        job = recurring_run(
            spark, f"{folder}/landed", store, lambda: _site_configs(spark, sf), f"{folder}/checkpoint", params, False,
            {"availableNow": True}, lambda: _START,
        )
        job.awaitTermination()
    last = store.runs().orderBy(F.desc("run_id")).first()
    run_once(store, fetches, _site_configs(spark, sf), _START, params, trigger=last["trigger"])
    return store.runs().select("run_id", "status", "sources_total", "jobs_fetched", "jobs_matched")


def config_folder(spark, sf) -> DataFrame:
    """Sources of a folder of JSON files, one a supplier, written and read back, with their number of pages."""
    key = F.col("s_suppkey").cast("string")
    folder = f"{shared_folder(spark)}/configs-{uuid.uuid4().hex}"
    families = F.array(*map(F.lit, ["lever", "greenhouse", "workday"]))
    # a file a supplier: spread over the cores, as a small table would be written by one task
    texts(spark, sf, "supplier", "s_suppkey", "s_name", "s_nationkey").select(
        F.concat(F.lit(" c"), key).alias("id"), F.col("s_name").alias("company_name"), F.concat(F.lit("https://x.org/"), key).alias("careers_url"),
        F.element_at(families, (F.col("s_suppkey") % 3 + 1).cast("int")).alias("parser_type"), F.when(F.col("s_nationkey") > 9, "DE").alias("country_hint"),
        (F.col("s_suppkey") % 7 != 0).alias("enabled"),
        F.struct(F.lit("query_param").alias("strategy"), (F.col("s_nationkey") % 4 + 1).alias("max_pages")).alias("pagination"),
    ).write.option("maxRecordsPerFile", 1).json(folder)
    sources = load_sources(spark, folder)
    pages = page_frontier(sources).groupBy("source_id").agg(F.count("*").alias("pages"))
    return sources.join(pages, "source_id").select("source_id", "company_name", "parser_type", "country_hint", "enabled", "pages")


def hourly_reads(spark, sf) -> DataFrame:
    """What each of 24 backfill runs, an hour apart, would read."""
    copies = event_copies(spark, sf).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    reads = pg.copies_of_runs(copies, F.lit(_START), 24, ["event_id"])
    return reads.groupBy(F.col("run").cast("long").alias("hour")).agg(F.count("*").alias("copies"), F.sum("event_id").alias("id_sum"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


_ERR, _WARN = "error", "warning"
_PROBLEMS = [
    (1, _ERR, "careers_url", "careers_url must be absolute URL"),
    (1, _WARN, "selectors", "unknown selector keys: mystery, odd"),
    (1, _WARN, "parser_options", "unsupported parser_options: jobs_path"),
    (2, _ERR, "jobs_path", "generic_json requires parser_options.jobs_path"),
    (2, _ERR, "fields_url", "generic_json requires parser_options.fields.url or job_url_template"),
    (2, _ERR, "pagination_strategy", "pagination.strategy must be one of query_param, attrax_page_query, offset_limit"),
    (2, _ERR, "pagination_max_pages", "pagination.max_pages must be an integer >= 1"),
    (2, _WARN, "parser_options", "unsupported parser_options: deep"),
    (3, _ERR, "fields_title", "generic_json requires parser_options.fields.title"),
    (4, _ERR, "container_selectors", "selectors must be an object"),
    (4, _ERR, "parser_type", "unknown parser type 'mystery'"),
    (5, _ERR, "required_keys", "Missing required keys: company_name, parser_type"),
    (6, _ERR, "json", "not a JSON object"),
    (7, _ERR, "container_matching_profile", "matching_profile must be an object"),
    (7, _ERR, "pagination_limit", "pagination.limit must be an integer >= 1"),
    (7, _ERR, "pagination_start_offset", "pagination.start_offset must be an integer >= 0"),
]
_SHAPES = [
    (0, True, "Co %d", "lever", "UK", True, None, None, "", None, "note"),
    (1, True, "Co", "generic_html", None, False, "d", None, "job_card,mystery,odd", None, ""),
    (2, True, "Co", "generic_json", None, True, "", None, "", "title", ""),
    (3, True, "Co", "generic_json", None, True, "a.b", "https://x/{id}", "", "n,url", ""),
    (4, True, "Co", "mystery", None, False, None, None, "", None, ""),
    (5, False, None, None, None, True, None, None, "", None, ""),
    (6, None, None, None, None, True, None, None, "", None, None),
    (7, True, "Co", "workday", None, True, None, None, "", None, ""),
]
_MENU = f"""(SELECT page_id % 10 AS site, page_id // 10 AS page, url, title FROM ({_sql_links('menu.example.com')}))"""
_SITES = """(SELECT page_id % 10 AS site, page_id // 10 AS page, page_id % 17 = 5 AS failed,
    ((page_id // 10) % 9 = 8 AND page_id % 10 % 3 = 1) OR page_id = 4 AS blocked FROM pages WHERE page_id % 10 < 9)"""

def _site_sql(pages: str = "") -> str:
    """A run over the sites' pages, or those that a condition names."""
    return f"""WITH p AS (SELECT * FROM {_SITES} {pages}),
              e AS (SELECT site, CASE WHEN failed THEN 'fetch failed for site' || site || ': HTTP status 500' ELSE 'blocked by anti-bot policy: unusual traffic' END AS error
                    FROM p WHERE page = 0 AND (failed OR blocked)),
              stop AS (SELECT site, min(page) AS last_page FROM p WHERE page > 0 AND blocked AND NOT failed GROUP BY 1),
              ok AS (SELECT site, page FROM p LEFT JOIN stop USING (site) WHERE NOT failed AND NOT blocked AND (last_page IS NULL OR page < last_page)
                     AND site NOT IN (SELECT site FROM e)),
              jobs AS (SELECT DISTINCT site, url, title FROM {_MENU} JOIN ok USING (site, page)),
              m AS (SELECT *, 0.65 * least(1.0, (CASE WHEN contains(lower(title), 'th') THEN 0.7 ELSE 0 END + CASE WHEN contains(lower(title), 'en') OR contains(lower(title), 'er') THEN 0.6 ELSE 0 END))
                      - CASE WHEN contains(lower(title), 'on') THEN 0.2 ELSE 0 END AS score FROM jobs),
              c AS (SELECT count(*) AS matched FROM m WHERE score >= 0.4 AND site NOT IN (1, 2, 3))
            SELECT CASE WHEN (SELECT count(*) FROM e) = 0 THEN 'success' ELSE 'partial_failure' END AS status, 9 AS sources_total,
              (SELECT count(*) FROM jobs) AS jobs_fetched, matched AS jobs_matched, least(matched, 20) AS jobs_sent,
              (SELECT '{{' || string_agg('"site' || site || '":"' || error || '"', ',' ORDER BY site) || '}}' FROM e) AS error_summary FROM c"""


QUERIES = {
    "config_shape": (
        config_shape,
        f"""SELECT CAST(s_suppkey AS VARCHAR) AS file, CASE own WHEN true THEN 'c' || s_suppkey WHEN false THEN 'shared' END AS source_id,
              replace(company, '%d', CAST(s_suppkey AS VARCHAR)) AS company_name, parser AS parser_type, hint AS country_hint, enabled, jobs_path,
              template AS job_url_template, selector_keys, field_names, extra_keys
            FROM supplier JOIN (VALUES {_values(_SHAPES)}) v(n, own, company, parser, hint, enabled, jobs_path, template, selector_keys, field_names, extra_keys)
              ON n = s_suppkey % 8""",
    ),
    "config_problems": (
        config_problems,
        f"""SELECT CAST(s_suppkey AS VARCHAR) AS file, severity, rule, message FROM supplier
            JOIN (VALUES {_values(_PROBLEMS)}) v(n, severity, rule, message) ON n = s_suppkey % 8""",
    ),
    "duplicate_config_ids": (
        duplicate_config_ids,
        """SELECT 'shared' AS source_id, 'error' AS severity, 'Duplicate source id ''shared''' AS message FROM supplier
           WHERE s_suppkey % 8 = 5 HAVING count(*) > 1""",
    ),
    "page_frontier_query_param": (
        page_frontier_query_param,
        """WITH s AS (SELECT *, 'https://x.org/' || s_suppkey || '?a=1&page=2&a=b+c' AS careers FROM supplier),
             u AS (SELECT s_suppkey, i, CASE WHEN s_acctbal > 5000 THEN 'https://y.org/' || i ELSE 'https://x.org/' || s_suppkey || '?a=b+c&page=' || (i + 1) END AS url
                   FROM s, range(1, 6) r(i) WHERE i < CASE WHEN s_acctbal > 5000 THEN 4 ELSE s_nationkey % 6 END AND NOT (s_acctbal > 5000 AND s_nationkey = 7))
           SELECT CAST(s_suppkey AS VARCHAR) AS source_id, 0 AS page_index, careers AS url FROM s UNION ALL
           SELECT CAST(s_suppkey AS VARCHAR), row_number() OVER (PARTITION BY s_suppkey ORDER BY i), url FROM u""",
    ),
    "page_frontier_offset_limit": (
        page_frontier_offset_limit,
        """WITH s AS (SELECT *, greatest(s_nationkey - 5, 1) AS size FROM supplier)
           SELECT CAST(s_suppkey AS VARCHAR) AS source_id, i AS page_index, CASE WHEN i = 0 THEN 'https://x.org/' || s_suppkey
             WHEN s_acctbal > 5000 THEN 'https://y.org/?n=25&o=' || (10 + 25 * i) || '&p=' || (i + 1)
             ELSE 'https://x.org/' || s_suppkey || '?offset=' || (size * i) || '&limit=' || size END AS url FROM s, range(0, 3) r(i)""",
    ),
    "set_query_param": (
        set_query_param,
        "SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || '?cat=C%26D&page=' || page_id || '&q=&new=x+y' AS url FROM pages",
    ),
    "site_run": (site_run, _site_sql()),
    "site_run_of_fewer_pages": (
        site_run_of_fewer_pages,
        f"SELECT 2 AS run_id, status, sources_total, jobs_fetched, jobs_matched FROM ({_site_sql(f'WHERE page < {_FEWER}')})",
    ),
    "site_matches": (
        site_matches,
        _site_sql().split("c AS (SELECT count(*)")[0] + """x AS (SELECT *, round(greatest(score, 0), 6)::DOUBLE AS s, site NOT IN (1, 2, 3) AS geo_pass,
              contains(lower(title), 'th')::INT + (contains(lower(title), 'en') OR contains(lower(title), 'er'))::INT AS terms FROM m)
            SELECT 'site' || site AS source_id, s AS score, geo_pass, CASE WHEN NOT geo_pass THEN 'reject_geo' WHEN score < 0.4 THEN 'reject_score' ELSE 'send' END AS decision,
              terms, count(*) AS n, count(*) AS keys FROM x GROUP BY ALL""",
    ),
    "recurring_site_runs": (
        recurring_site_runs,
        f"""SELECT 1 AS run_id, status, sources_total, jobs_fetched, jobs_matched FROM ({_site_sql(f'WHERE page < {_LANDED_FIRST}')})
            UNION ALL SELECT 2, status, sources_total, jobs_fetched, jobs_matched FROM ({_site_sql()})""",
    ),
    "config_folder": (
        config_folder,
        """SELECT 'c' || s_suppkey AS source_id, s_name AS company_name, ['lever', 'greenhouse', 'workday'][s_suppkey % 3 + 1] AS parser_type,
             CASE WHEN s_nationkey > 9 THEN 'DE' END AS country_hint, s_suppkey % 7 <> 0 AS enabled, s_nationkey % 4 + 1 AS pages FROM supplier""",
    ),
    "frontier_pages": (
        frontier_pages,
        f"""SELECT 'site' || (page_id % 10) AS source_id, page_id // 10 AS page_index,
              length(html) + CASE WHEN (page_id // 10) % 9 = 8 AND (page_id % 10) % 3 = 1 OR page_id = 4 THEN 15 ELSE 0 END AS size
            FROM pages WHERE page_id // 10 < {_FEWER + 3} AND (page_id // 10) % 4 <> 1""",
    ),
    "hourly_reads": (
        hourly_reads,
        """SELECT hour, count(*) AS copies, CAST(sum(event_id) AS BIGINT) AS id_sum FROM (
             SELECT hour, event_id, ts, coalesce(max(CASE WHEN event_id % 3 = 0 AND event_id % 4 <> 0 THEN ts END) OVER p,
                 max(CASE WHEN event_id % 3 = 0 THEN ts END) OVER p, min(ts) OVER p) AS begun
             FROM events, range(0, 24) r(hour) WHERE ts <= TIMESTAMP '2024-01-02 06:00:00' + hour * INTERVAL 1 HOUR
             WINDOW p AS (PARTITION BY hour, user_id, CAST(floor(value) AS INT) % 2)) WHERE ts >= begun GROUP BY 1""",
    ),
}
