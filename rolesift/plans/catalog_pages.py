"""Catalogue: page outcomes, JSON paths, HTML elements and page families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions import variants as vx
from rolesift.functions.text import clean, parse_datetime
from rolesift.operators import pages as pg
from rolesift.operators.extraction import explode_postings, extract_postings
from rolesift.operators.html_nodes import html_nodes
from rolesift.plans.catalog_base import stamp, table, texts

# --------------------------------------------------------------------------
# page outcomes


def blocked_pages(spark, sf) -> DataFrame:
    """Each page, some with a challenge title, a challenge body or a status."""
    kind = F.col("page_id") % 6
    content = (
        F.when(kind == 1, F.concat(F.lit("<TITLE lang=x>\n Just a Moment... Access denied</TITLE>"), "html"))
        .when(kind == 2, F.concat("html", F.lit("<div>Cloud Ray ID: 77</div>")))
        .when(kind == 3, F.concat("html", F.lit("<p>UNUSUAL TRAFFIC, automated queries</p>")))
        .otherwise(F.col("html"))
    )
    status = F.when(F.col("page_id") % 5 == 0, 403).when(F.col("page_id") % 7 == 0, 404).otherwise(200)
    return texts(spark, sf, "pages", "page_id", "html").select("page_id", pg.blocked_reason(content, status).alias("reason"))


def attempt_resolution(spark, sf) -> DataFrame:
    """Events as landed copies: a user is a page, the newest copy of a channel counts."""
    kind = F.col("event_type")
    rows = F.when(kind == "click", F.array()).otherwise(F.array(F.col("event_id").cast("string")))
    copies = table(spark, sf, "events").select(
        (F.col("user_id") % 20).cast("string").alias("source_id"),
        F.col("user_id").cast("int").alias("page_index"),
        (F.floor(F.col("value")) % 4).cast("int").alias("attempt"),
        F.when(F.col("event_id") % 2 == 0, "http").otherwise("rendered").alias("channel"),
        F.when(kind == "error", "failed").when(kind == "purchase", "blocked").otherwise("read").alias("state"),
        F.when(kind.isin("error", "purchase"), F.col("props")).alias("reason"),
        F.when(~kind.isin("error", "purchase"), rows).alias("postings"),
        F.col("ts").alias("fetched_at"),
    )
    return pg.resolve_attempts(copies, 3).select(
        F.col("page_index").alias("user_id"), "outcome", "reason", F.get("postings", F.lit(0)).alias("posting"),
        F.coalesce(F.size("postings"), F.lit(-1)).cast("long").alias("n"),
    )


def _daily_pages(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Users as sources, days as pages, the last event of a day its outcome."""
    page = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).cast("int")
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    outcomes = (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").cast("string").alias("source_id"), page.alias("page_index"))
        .agg(last.alias("kind"), F.max("event_id").alias("event_id"))
        .select(
            "source_id", "page_index", "event_id",
            F.when(F.col("kind") == "error", "blocked").when(F.col("kind") == "purchase", "failed").otherwise("done").alias("outcome"),
            F.when(F.col("kind").isin("error", "purchase"), F.upper("kind")).alias("reason"),
        )
    )
    users = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("source_id")).distinct()
    kind = F.when(F.col("source_id").cast("int") % 9 == 0, "mystery").otherwise("generic_html")
    return outcomes, users.withColumn("parser_type", kind)


def source_outcomes(spark, sf) -> DataFrame:
    pages, sources = _daily_pages(spark, sf)
    return pg.source_outcomes(pages, sources).select("source_id", "error", F.col("blocked_page").cast("long").alias("blocked_page"))


def page_policy(spark, sf) -> DataFrame:
    """Pages that count: read, of good sources, before the first later block."""
    pages, sources = _daily_pages(spark, sf)
    kept = pg.usable_pages(pages, pg.source_outcomes(pages, sources))
    return kept.select("source_id", F.col("page_index").cast("long").alias("page_index"), "event_id")


def as_of_pages(spark, sf) -> DataFrame:
    """The copies of each page's latest crawl at noon of January 10; crawls, retries and renderings mixed."""
    return pg.current_copies(event_copies(spark, sf), F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")).select(
        "source_id", "page_index", "event_id"
    )


def event_copies(spark, sf) -> DataFrame:
    """Every event as a landed copy: two pages a user, three attempts, every fourth rendered."""
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("source_id"), (F.floor("value").cast("int") % 2).alias("page_index"),
        (F.col("event_id") % 3).cast("int").alias("attempt"),
        F.when(F.col("event_id") % 4 == 0, "rendered").otherwise("http").alias("channel"),
        F.col("ts").alias("fetched_at"), "event_id",
    )


# --------------------------------------------------------------------------
# JSON


def json_sniff(spark, sf) -> DataFrame:
    form = F.col("event_id") % 5
    content = (
        F.when(form == 0, F.col("props"))
        .when(form == 1, F.concat(F.lit(" \n ["), "props", F.lit("]")))
        .when(form == 2, F.concat(F.lit("x"), "props"))
        .when(form == 3, F.concat("props", F.lit("}")))
        .otherwise(F.lit('"text"'))
    )
    doc = vx.parse_document(content)
    return table(spark, sf, "events").select("event_id", vx.kind(doc).alias("kind"))


_DOC = '{"job": {"id": %d, "places": ["A", " ", "B", null, 3], "7": {"n": null}, "who": {"@id": "w%d"}}, "loc": {"value": " v  x ", "y": 1}, "on": true, "at": "2024-02-03T04:05:06Z", "so \\"x\\"": {"why?": {"": "q%d"}}}'
_PATHS = ["job.id", "job.places", "job.places.2", "job.places.9", "job.7", "job.7.n", "job.who", "loc", "on", "no.where", "at", 'so "x".why?.', 'so "x".why', ".", "job..id"]


def json_paths(spark, sf) -> DataFrame:
    """One document per order read at fifteen paths, some with odd or empty keys: as text, identifier and time."""
    key = F.col("o_orderkey").cast("string")
    doc = F.try_parse_json(F.replace(F.lit(_DOC), F.lit("%d"), key))
    docs = texts(spark, sf, "orders", "o_orderkey").select("o_orderkey", doc.alias("doc"))
    read = docs.select("o_orderkey", "doc", F.explode(F.array(*map(F.lit, _PATHS))).alias("path"))
    value = F.col("value")
    found = read.withColumn("value", vx.at_path(F.col("doc"), F.col("path"))).select(
        "o_orderkey",
        "path",
        vx.text_of(value).alias("text"),
        F.when(F.col("path").isin("job.id", "job.who", "loc"), clean(vx.identifier_of(value))).alias("identifier"),
    )
    # a column of its own, so that the documents need not wait while texts are unescaped
    return found.select("o_orderkey", "path", clean(F.col("text")).alias("text"), "identifier", stamp(parse_datetime(F.col("text"))).alias("time"))


# --------------------------------------------------------------------------
# HTML elements


def html_elements(spark, sf) -> DataFrame:
    """Elements per page and tag."""
    nodes = html_nodes(texts(spark, sf, "pages", "page_id", "html"), ["page_id"], "html")
    return nodes.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


_SELECTORS = {
    "menu": "nav li > a",
    "second": "li:nth-of-type(2) a[href^='/']",
    "advert": "body div.ad",
    "listed": "h1, footer, title",
    "none": "nav > a, article h2",
}


def css_select(spark, sf) -> DataFrame:
    """Elements answering each selector, per page."""
    roles = F.create_map(*[F.lit(x) for kv in _SELECTORS.items() for x in kv])
    nodes = html_nodes(texts(spark, sf, "pages", "page_id", "html"), ["page_id"], "html", roles)
    hit = nodes.select("page_id", F.explode("roles").alias("role"))
    return hit.groupBy("page_id", "role").agg(F.count("*").alias("n"))


def element_text(spark, sf) -> DataFrame:
    """Text of titles and headings."""
    nodes = html_nodes(texts(spark, sf, "pages", "page_id", "html"), ["page_id"], "html").filter(F.col("tag").isin("title", "h1"))
    return nodes.select("page_id", "tag", "text")


# --------------------------------------------------------------------------
# page families

_OPTIONS = {
    "careers_url": "string", "parser_type": "string", "selectors": "map<string,string>", "jobs_path": "string",
    "url_base": "string", "fields": "map<string,string>", "job_url_template": "string",
}


def _mapped(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _postings(pages: DataFrame, family: str, key: str = "page", **options: Column) -> DataFrame:
    given = {"parser_type": F.lit(family), **options}
    ready = pages.withColumns({n: given.get(n, F.lit(None)).cast(t) for n, t in _OPTIONS.items()})
    rows = explode_postings(extract_postings(ready.select(key, "content", *_OPTIONS), [family]), [key])
    return rows.select(
        key, F.col("job_index").cast("long").alias("job_index"), "external_id", "url", "title", "location", "description",
        stamp(F.col("posted_at")).alias("posted_at"),
    )


def _part_pages(spark, sf, item: Column, wrap) -> DataFrame:
    """Parts as postings, 25 to a page; ``wrap`` turns the page's items into content.

    Every posting of size over 40 repeats the address of the one before it.
    """
    parts = table(spark, sf, "part").withColumns(
        {
            "page": F.floor(F.col("p_partkey") / 25),
            "u": F.when(F.col("p_size") > 40, F.col("p_partkey") - 1).otherwise(F.col("p_partkey")).cast("string"),
            "title": F.concat("p_name", F.lit(" &amp; "), "p_brand"),
            "day": F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd"),
        }
    )
    listed = parts.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item")))).alias("items"))
    return listed.select("page", wrap(F.transform("items", lambda x: x["item"])).alias("content"))


def _json_list(name: str):
    return lambda items: F.concat(F.lit(' {"' + name + '": ['), F.array_join(items, ", "), F.lit("]}"))


def _html_list(items: Column) -> Column:
    return F.concat(F.lit("<html><body><ul class='jobs'>"), F.array_join(items, "\n"), F.lit("</ul></body></html>"))


def _text(template: str) -> Column:
    """``{column}`` marks filled from columns."""
    out = F.lit(template)
    for name in ("p_partkey", "u", "title", "p_type", "p_brand", "day"):
        out = F.replace(out, F.lit("<" + name + ">"), F.col(name).cast("string"))
    return out




def _base() -> Column:
    return F.lit("https://jobs.example.com/board/list")


def generic_json_postings(spark, sf) -> DataFrame:
    item = _text('{"jobId": <p_partkey>, "head": {"name": " <title>"}, "link": "../r/<u>", "tags": ["<p_type>", "x"], "about": "<p_brand>", "on": "<day>T01:02:03Z"}')
    fields = {"title": "head.name", "url": "link", "external_id": "jobId", "location": "tags", "description": "about", "posted_at": "on"}
    pages = _part_pages(spark, sf, item, lambda items: F.concat(F.lit('{"r": {"jobs": [7, '), F.array_join(items, ","), F.lit("]}}")))
    return _postings(
        pages, "generic_json", careers_url=_base(), jobs_path=F.lit("r.jobs"), url_base=F.lit("https://www.example.org/a/b/c"), fields=_mapped(fields)
    )


def generic_json_places(spark, sf) -> DataFrame:
    """No location field: offices, then locations, then the parts of location; URL by template."""
    item = F.when(F.col("p_size") <= 15, _text('{"id": "<p_partkey>", "title": "<title>", "offices": ["<p_type>", " "]}')).when(
        F.col("p_size") <= 30, _text('{"id": "<p_partkey>", "title": "<title>", "locations": [{"city": "<p_type>"}, "Rome", {"name": "Rome"}]}')
    ).otherwise(_text('{"id": "<p_partkey>", "title": "<title>", "location": {"city": "<p_type>", "country": "DE"}}'))
    fields = {"title": "title", "external_id": "id"}
    template = F.lit("https://www.example.org/{id}/{slug}")
    return _postings(
        _part_pages(spark, sf, item, _json_list("data")), "generic_json", careers_url=_base(), jobs_path=F.lit("data"),
        fields=_mapped(fields), job_url_template=template,
    )


def linked_data_postings(spark, sf) -> DataFrame:
    """Linked-data scripts with lists and graphs; repeated addresses stay."""
    item = _text(
        '{"@type": ["Thing", "JobPosting"], "title": "<title>", "url": "/jobs/<u>", "identifier": {"name": "", "value": <p_partkey>}, '
        '"jobLocation": [{"address": {"addressLocality": "<p_type>", "addressCountry": "NL"}}, "<p_brand>", {"address": "<p_brand>"}], '
        '"description": "D <p_brand>", "datePosted": "<day>"}'
    )
    wrap = lambda items: F.concat(
        F.lit('<html><script type="application/ld+json">[{"@type": "Organization"}, {"@graph": ['), F.array_join(items, ","),
        F.lit(']}]</script><script type="application/ld+json">{broken</script></html>'),
    )
    return _postings(_part_pages(spark, sf, item, wrap), "lever", careers_url=_base())


def greenhouse_postings(spark, sf) -> DataFrame:
    item = _text("<div class=opening><a href='/x/jobs/100<u>0000'><title></a> |\n <span><p_type></span> -</div><a href='/about'>About</a>")
    return _postings(_part_pages(spark, sf, item, _html_list), "greenhouse", careers_url=_base())


def lever_postings(spark, sf) -> DataFrame:
    item = _text("<div><a href='https://jobs.lever.co/x/id<u>/'><title></a><span><p_type></span></div>")
    return _postings(_part_pages(spark, sf, item, _html_list), "lever", careers_url=_base())


def _either(spark, sf, json_item: str, json_list: str, html_item: str) -> DataFrame:
    """Even pages as JSON, odd pages as HTML."""
    even = _part_pages(spark, sf, _text(json_item), _json_list(json_list)).filter(F.col("page") % 2 == 0)
    odd = _part_pages(spark, sf, _text(html_item), _html_list).filter(F.col("page") % 2 == 1)
    return even.unionByName(odd)


def smartrecruiters_postings(spark, sf) -> DataFrame:
    pages = _either(
        spark, sf,
        '{"id": "", "name": "<title>", "ref": "https://jobs.smartrecruiters.com/Co/eng/9<u>", "releasedDate": "<day>", "location": {"city": "<p_type>", "region": "", "country": "DE"}, "department": {"label": "<p_brand>"}}',
        "content",
        "<li data-department='<p_brand>'><a href='/en/job/9<u>'><title></a></li>",
    )
    return _postings(pages, "smartrecruiters", careers_url=_base())


def teamtailor_postings(spark, sf) -> DataFrame:
    pages = _either(
        spark, sf,
        '{"id": "<p_partkey>", "links": {"careersite-job-url": "/jobs/<u>"}, "attributes": {"title": "<title>", "location": "<p_type>", "remote_status": "<p_brand>", "body": "B <p_brand>", "created_at": "<day>"}}',
        "data",
        "<li><a data-job-url='/jobs/<u>' data-job-title='<title>' data-posted-at='<day>'>x</a><b class='job-location'><p_type></b><i data-job-location><p_brand></i></li>",
    )
    return _postings(pages, "teamtailor", careers_url=_base())


def workable_postings(spark, sf) -> DataFrame:
    pages = _either(
        spark, sf,
        '{"shortcode": "S<u>", "name": "<title>", "location": {"city": "<p_type>", "country": "<p_brand>"}, "description": "D", "created_at": "<day>"}',
        "jobs",
        "<li data-job-id='J<p_partkey>' data-posted-at='<day>'><p><a href='/w/<u>'><title></a></p><span class='location'><p_type></span></li>",
    )
    return _postings(pages, "workable", careers_url=_base())


def workday_postings(spark, sf) -> DataFrame:
    """Script data first, then links with addresses not seen there."""
    item = _text('{"title": "<title>", "externalPath": "/job/<u>", "locationsText": "<p_type>", "postedOn": "<day>", "bulletFields": ["R<p_partkey>"]}')
    wrap = lambda items: F.concat(
        F.lit('<html><script>window.data = {"jobPostings": ['), F.array_join(items, ","),
        F.lit("]};</script><a href='/job/extra'>Extra</a><a href='/other'>Other</a></html>"),
    )
    return _postings(_part_pages(spark, sf, item, wrap), "workday", careers_url=_base())


def generic_html_cards(spark, sf) -> DataFrame:
    """Menu entries of the given pages as cards."""
    pages = texts(spark, sf, "pages", "page_id", "html").withColumnRenamed("html", "content")
    selectors = {"job_card": "nav li", "title": "a", "link": "li a[href]", "location": ".nowhere"}
    return _postings(pages, "generic_html", "page_id", careers_url=F.lit("https://menu.example.com/x/"), selectors=_mapped(selectors)).select(
        "page_id", "url", "title", "location"
    )


def generic_card_fields(spark, sf) -> DataFrame:
    """Cards that are links, with fields by selector and by attribute."""
    item = _text("<a class='card big' href='/jobs/<u>' data-id='D<p_partkey>'><h2><title></h2><p class=loc><p_type></p><time><day></time></a>")
    selectors = {"job_card": "a.card", "title": "h2", "location": "p.loc", "posted_at": "time", "external_id": ".none", "description": "a > p"}
    fallback = _part_pages(spark, sf, item, _html_list)
    return _postings(fallback, "generic_html", careers_url=_base(), selectors=_mapped({k: v for k, v in selectors.items() if k != "external_id"}))


def keyword_links(spark, sf) -> DataFrame:
    """No cards configured: links with a posting word in text or address."""
    pages = texts(spark, sf, "pages", "page_id", "html").withColumnRenamed("html", "content")
    return _postings(pages, "generic_html", "page_id", careers_url=F.lit("https://example.com/careers")).select("page_id", "url", "title").union(
        _postings(pages, "generic_html", "page_id", careers_url=F.lit("https://careers.example.com/")).select("page_id", "url", "title")
    )


def mixed_families(spark, sf) -> DataFrame:
    """One dispatch over pages of several families and an unknown one."""
    html = _part_pages(spark, sf, _text("<li class=job><a href='/x/jobs/100<u>0000'><title></a></li>"), _html_list)
    family = F.get(F.array(*map(F.lit, ["greenhouse", "workable", "generic_html", "mystery"])), (F.col("page") % 4).cast("int"))
    ready = html.withColumns({n: F.lit(None).cast(t) for n, t in _OPTIONS.items()}).withColumns({"parser_type": family, "careers_url": _base()})
    rows = explode_postings(extract_postings(ready, ["greenhouse", "workable", "generic_html"]), ["page"])
    return rows.join(ready.select("page", "parser_type"), "page").groupBy("parser_type").agg(
        F.count("*").alias("n"), F.countDistinct("external_id").alias("ids")
    )


_PART = """(SELECT p_partkey // 25 AS page, p_partkey, p_type, p_brand, p_size,
      CAST(CASE WHEN p_size > 40 THEN p_partkey - 1 ELSE p_partkey END AS VARCHAR) AS u,
      p_name || ' & ' || p_brand AS title, DATE '2024-01-01' + p_size AS d,
      strftime(DATE '2024-01-01' + p_size, '%Y-%m-%d 00:00:00') AS posted_at FROM part)"""


def _sql(select: str, where: str = "true", once: bool = True) -> str:
    qualify = "QUALIFY row_number() OVER (PARTITION BY page, u ORDER BY p_partkey) = 1" if once else ""
    return f"""SELECT *, row_number() OVER (PARTITION BY page ORDER BY k) - 1 AS job_index
      FROM (SELECT page, p_partkey AS k, {select} FROM {_PART} WHERE {where} {qualify})"""


def _final(sql: str) -> str:
    return f"SELECT page, job_index, external_id, url, title, location, description, posted_at FROM ({sql})"


_SLUG = r"trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', '-', 'g'), '-')"
_JOBS = "https://jobs.example.com"
_EVEN_ODD = "SELECT * FROM ({even}) UNION ALL SELECT * FROM ({odd})"
_LINKS = (
    "SELECT page_id, i, 'https://{host}' || " + "h AS url, t AS title FROM (SELECT page_id, generate_subscripts(hs, 1) AS i, unnest(hs) AS h0, unnest(ts) AS t0 "
    "FROM (SELECT page_id, regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 1) AS hs, "
    "regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 2) AS ts FROM pages)), "
    "LATERAL (SELECT trim(replace(replace(h0, '&amp;', '&'), '&quot;', '\"')) AS h, trim(replace(replace(t0, '&amp;', '&'), '&quot;', '\"')) AS t)"
)


def _sql_links(host: str) -> str:
    return f"""SELECT page_id, url, title FROM ({_LINKS.format(host=host)}) WHERE title <> ''
      QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY i) = 1"""


_OUTCOMES = """(SELECT CAST(user_id AS VARCHAR) AS source_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS page_index,
      arg_max(event_type, (ts, event_id)) AS kind, max(event_id) AS event_id FROM events GROUP BY 1, 2)"""
_PER_SOURCE = f"""(SELECT source_id, max(kind) FILTER (page_index = 0) AS first_kind,
      min(page_index) FILTER (page_index > 0 AND kind = 'error') AS blocked_page FROM {_OUTCOMES} GROUP BY 1)"""
_ERRORS = f"""(SELECT source_id, blocked_page, CASE WHEN CAST(source_id AS INT) % 9 = 0 THEN 'Unknown parser type: mystery'
      WHEN first_kind = 'error' THEN 'blocked by anti-bot policy: ERROR'
      WHEN first_kind = 'purchase' THEN 'fetch failed for ' || source_id || ': PURCHASE'
      WHEN first_kind IS NULL THEN 'fetch failed for ' || source_id || ': no landed page' END AS error FROM {_PER_SOURCE})"""

QUERIES = {
    "blocked_pages": (
        blocked_pages,
        """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'http_403' WHEN page_id % 6 = 1 THEN 'title:just a moment'
             WHEN page_id % 6 = 2 THEN 'ray id' WHEN page_id % 6 = 3 THEN 'automated queries' END AS reason FROM pages""",
    ),
    "attempt_resolution": (
        attempt_resolution,
        """WITH c AS (SELECT user_id, CAST(floor(value) AS INT) % 4 AS attempt, event_id % 2 AS ch, arg_max(event_type, ts) AS kind,
                    arg_max(event_id, ts) AS id, arg_max(props, ts) AS props FROM events GROUP BY 1, 2, 3),
             a AS (SELECT coalesce(h.user_id, r.user_id) AS user_id, coalesce(h.attempt, r.attempt) AS attempt,
                     CASE WHEN h.kind IS NULL OR (h.kind = 'click' AND r.kind IS NOT NULL) THEN r ELSE h END AS x
                   FROM (SELECT * FROM c WHERE ch = 0 AND attempt < 3) h FULL JOIN (SELECT * FROM c WHERE ch = 1 AND attempt < 3) r
                     ON h.user_id = r.user_id AND h.attempt = r.attempt),
             e AS (SELECT user_id, arg_min(x, attempt) FILTER (x.kind <> 'error') AS ended, arg_max(x, attempt) AS last FROM a GROUP BY 1)
           SELECT user_id, CASE WHEN ended IS NULL THEN 'failed' WHEN ended.kind = 'purchase' THEN 'blocked' ELSE 'done' END AS outcome,
             CASE WHEN ended IS NULL THEN last.props WHEN ended.kind = 'purchase' THEN ended.props END AS reason,
             CASE WHEN ended.kind NOT IN ('purchase', 'click') THEN CAST(ended.id AS VARCHAR) END AS posting,
             CASE WHEN ended IS NULL OR ended.kind = 'purchase' THEN -1 WHEN ended.kind = 'click' THEN 0 ELSE 1 END AS n FROM e""",
    ),
    "source_outcomes": (source_outcomes, f"SELECT source_id, error, blocked_page FROM {_ERRORS}"),
    "page_policy": (
        page_policy,
        f"""SELECT source_id, page_index, event_id FROM {_OUTCOMES} JOIN {_ERRORS} USING (source_id)
            WHERE error IS NULL AND kind NOT IN ('error', 'purchase') AND (blocked_page IS NULL OR page_index < blocked_page)""",
    ),
    "as_of_pages": (
        as_of_pages,
        """SELECT source_id, page_index, event_id FROM (
             SELECT CAST(user_id AS VARCHAR) AS source_id, CAST(floor(value) AS INT) % 2 AS page_index, event_id, ts,
               coalesce(max(CASE WHEN event_id % 3 = 0 AND event_id % 4 <> 0 THEN ts END) OVER p,
                 max(CASE WHEN event_id % 3 = 0 THEN ts END) OVER p, min(ts) OVER p) AS begun
             FROM events WHERE ts <= TIMESTAMP '2024-01-10 12:00:00'
             WINDOW p AS (PARTITION BY user_id, CAST(floor(value) AS INT) % 2)) WHERE ts >= begun""",
    ),
    "json_sniff": (json_sniff, "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'OBJECT' WHEN 1 THEN 'ARRAY' END AS kind FROM events"),
    "json_paths": (
        json_paths,
        """SELECT o_orderkey, path, CASE path WHEN 'job.id' THEN CAST(o_orderkey AS VARCHAR) WHEN 'job.places' THEN 'A, B, 3'
             WHEN 'job.places.2' THEN 'B' WHEN 'loc' THEN 'v x' WHEN 'on' THEN 'True' WHEN 'at' THEN '2024-02-03T04:05:06Z'
             WHEN 'so "x".why?.' THEN 'q' || o_orderkey ELSE '' END AS text,
             CASE path WHEN 'job.id' THEN CAST(o_orderkey AS VARCHAR) WHEN 'job.who' THEN 'w' || o_orderkey WHEN 'loc' THEN 'v x' END AS identifier,
             CASE path WHEN 'at' THEN '2024-02-03 04:05:06' END AS time
           FROM orders, (SELECT unnest(['job.id', 'job.places', 'job.places.2', 'job.places.9', 'job.7', 'job.7.n', 'job.who', 'loc', 'on',
             'no.where', 'at', 'so "x".why?.', 'so "x".why', '.', 'job..id']) AS path)""",
    ),
    "html_elements": (
        html_elements,
        """SELECT page_id, lower(tag) AS tag, count(*) AS n FROM (SELECT page_id,
             unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)[^<>]*>', 1)) AS tag FROM pages) GROUP BY 1, 2""",
    ),
    "css_select": (
        css_select,
        """SELECT page_id, role, n FROM (SELECT page_id, unnest(['menu', 'second', 'advert', 'listed']) AS role,
             unnest([len(regexp_extract_all(html, '<li><a ')), CAST(len(regexp_extract_all(html, '<li><a ')) >= 2 AS BIGINT),
                     len(regexp_extract_all(html, '<div class="ad">')), len(regexp_extract_all(html, '<(h1|footer|title)>'))]) AS n FROM pages) WHERE n > 0""",
    ),
    "element_text": (
        element_text,
        """SELECT page_id, tag, trim(regexp_replace(replace(replace(replace(t, '&amp;', '&'), '&amp', '&'), '&quot;', '"'), '\\s+', ' ', 'g')) AS text FROM
             (SELECT page_id, unnest(['title', 'h1']) AS tag, unnest([regexp_extract(html, '(?s)<title>(.*?)</title>', 1),
               regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)]) AS t FROM pages)""",
    ),
    "generic_json_postings": (
        generic_json_postings,
        _final(_sql("""CAST(p_partkey AS VARCHAR) AS external_id, 'https://www.example.org/a/r/' || u AS url, title, p_type || ', x' AS location,
          p_brand AS description, strftime(d + INTERVAL '1:02:03' HOUR TO SECOND, '%Y-%m-%d %H:%M:%S') AS posted_at""".replace(
            "INTERVAL '1:02:03' HOUR TO SECOND", "INTERVAL 3723 SECOND"))),
    ),
    "generic_json_places": (
        generic_json_places,
        _final(_sql(f"""CAST(p_partkey AS VARCHAR) AS external_id, 'https://www.example.org/' || p_partkey || '/' || {_SLUG} AS url, title,
          CASE WHEN p_size <= 15 THEN p_type WHEN p_size <= 30 THEN p_type || ', Rome' ELSE p_type || ', DE' END AS location,
          '' AS description, NULL AS posted_at""", once=False)),
    ),
    "linked_data_postings": (
        linked_data_postings,
        _final(_sql(f"""CAST(nullif(p_partkey, 0) AS VARCHAR) AS external_id, '{_JOBS}/jobs/' || u AS url, title, p_type || ', NL, ' || p_brand AS location,
          'D ' || p_brand AS description, posted_at""", once=False)),
    ),
    "greenhouse_postings": (
        greenhouse_postings,
        _final(_sql(f"""'100' || u || '0000' AS external_id, '{_JOBS}/x/jobs/100' || u || '0000' AS url, title, p_type AS location,
          '' AS description, NULL AS posted_at""")),
    ),
    "lever_postings": (
        lever_postings,
        _final(_sql("""'id' || u AS external_id, 'https://jobs.lever.co/x/id' || u || '/' AS url, title, p_type AS location,
          '' AS description, NULL AS posted_at""")),
    ),
    "smartrecruiters_postings": (
        smartrecruiters_postings,
        _final(_EVEN_ODD.format(
            even=_sql("""'9' || u AS external_id, 'https://jobs.smartrecruiters.com/Co/eng/9' || u AS url, title,
              p_type || ', DE, ' || p_brand AS location, '' AS description, posted_at""", "page % 2 = 0"),
            odd=_sql(f"""'9' || u AS external_id, '{_JOBS}/en/job/9' || u AS url, title, p_brand AS location, '' AS description,
              NULL AS posted_at""", "page % 2 = 1"))),
    ),
    "teamtailor_postings": (
        teamtailor_postings,
        _final(_EVEN_ODD.format(
            even=_sql(f"""CAST(p_partkey AS VARCHAR) AS external_id, '{_JOBS}/jobs/' || u AS url, title, p_type || ', ' || p_brand AS location,
              'B ' || p_brand AS description, posted_at""", "page % 2 = 0"),
            odd=_sql(f"""u AS external_id, '{_JOBS}/jobs/' || u AS url, title, p_type || ' ' || p_brand AS location, '' AS description,
              posted_at""", "page % 2 = 1"))),
    ),
    "workable_postings": (
        workable_postings,
        _final(_EVEN_ODD.format(
            even=_sql(f"""'S' || u AS external_id, '{_JOBS}/board/S' || u AS url, title, p_type || ', ' || p_brand AS location,
              'D' AS description, posted_at""", "page % 2 = 0"),
            odd=_sql(f"""'J' || p_partkey AS external_id, '{_JOBS}/w/' || u AS url, title, p_type AS location, '' AS description,
              posted_at""", "page % 2 = 1"))),
    ),
    "workday_postings": (
        workday_postings,
        f"""WITH w AS ({_sql(f"'R' || p_partkey AS external_id, '{_JOBS}/job/' || u AS url, title, p_type AS location, '' AS description, posted_at")})
          SELECT page, job_index, external_id, url, title, location, description, posted_at FROM w UNION ALL
          SELECT page, count(*), NULL, '{_JOBS}/job/extra', 'Extra', '', '', NULL FROM w GROUP BY page""",
    ),
    "generic_html_cards": (
        generic_html_cards,
        f"SELECT page_id, url, title, '' AS location FROM ({_sql_links('menu.example.com')})",
    ),
    "generic_card_fields": (
        generic_card_fields,
        _final(_sql(f"""'D' || p_partkey AS external_id, '{_JOBS}/jobs/' || u AS url, title, p_type AS location, p_type AS description,
          posted_at""")),
    ),
    "keyword_links": (
        keyword_links,
        f"""SELECT * FROM ({_sql_links('example.com')}) WHERE regexp_matches(lower(title || ' ' || url), 'job|career|position|opening|role')
            UNION ALL SELECT * FROM ({_sql_links('careers.example.com')})""",
    ),
    "mixed_families": (
        mixed_families,
        f"""SELECT parser_type, count(*) AS n, count(DISTINCT id) AS ids FROM (
              SELECT ['greenhouse', 'workable', 'generic_html'][page % 4 + 1] AS parser_type,
                CASE page % 4 WHEN 2 THEN NULL ELSE page || '/' || u END AS id FROM {_PART} WHERE page % 4 < 3
              QUALIFY row_number() OVER (PARTITION BY page, u ORDER BY p_partkey) = 1) GROUP BY 1""",
    ),
}
