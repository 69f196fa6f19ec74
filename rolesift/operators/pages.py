"""Landed page copies to page, attempt and source outcomes.

``page_fetches``: source_id, page_index, url, attempt, channel ('http' or
'rendered'), status_code, content, error, fetched_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesift.functions.text import blank_to_null
from rolesift.functions.urls import canonical_url
from rolesift.operators.extraction import PARSER_TYPES
from rolesift.session import broadcast_if_small

PAGE_FETCHES = (
    "source_id string, page_index int, url string, attempt int, channel string, "
    "status_code int, content string, error string, fetched_at timestamp"
)

# pages whose times are broadcast: a row is an id, a number and a time
BROADCAST_PAGES = 200_000

# fixed values: signs of an anti-bot answer, in the order they are tried
BLOCKED_STATUS = [401, 403, 429, 503]
BLOCKED_TITLES = [
    "attention required",
    "just a moment",
    "verify you are human",
    "access denied",
    "security check",
    "temporarily blocked",
]
BLOCKED_BODIES = [
    "cf-chl",
    "cf_chl",
    "cf-challenge",
    "ray id",
    "please enable javascript and cookies to continue",
    "request unsuccessful. incident id",
    "automated queries",
    "unusual traffic",
    "/cdn-cgi/challenge-platform/",
]


def blocked_by_content(content: Column) -> Column:
    """``title:phrase`` or a body phrase, whichever comes first; else null."""
    title = F.lower(F.regexp_extract(content, r"(?is)<title[^>]*>(.*?)</title>", 1))
    body = F.lower(content)
    reasons = [F.when(F.contains(title, F.lit(p)), F.lit(f"title:{p}")) for p in BLOCKED_TITLES]
    reasons += [F.when(F.contains(body, F.lit(p)), F.lit(p)) for p in BLOCKED_BODIES]
    return F.coalesce(*reasons)


def blocked_reason(content: Column, status: Column) -> Column:
    by_status = F.when(status.isin(BLOCKED_STATUS), F.concat(F.lit("http_"), status.cast("string")))
    return F.coalesce(by_status, blocked_by_content(content))


def of_frontier(fetches: DataFrame, frontier: DataFrame) -> DataFrame:
    """Landed pages that their source's frontier still names, numbered as it numbers them.

    A page is known by its canonical URL, one landed without a URL by its number. What
    an earlier frontier named, before ``max_pages`` or the numbering changed, counts no
    longer. The frontier is a few rows a source; contents stay where they are unless it
    outgrows the checked broadcast.
    """
    by_number = lambda n: F.concat(F.lit("page:"), n.cast("string"))
    by_url = F.concat(F.lit("url:"), canonical_url(F.col("url")))
    named = frontier.select(
        "source_id", F.col("page_index").alias("_place"), F.explode(F.array(by_url, by_number(F.col("page_index")))).alias("_at")
    )
    places = named.groupBy("source_id", "_at").agg(F.min("_place").cast("int").alias("_place"))
    blank = F.trim(F.coalesce("url", F.lit(""))) == ""
    landed = fetches.withColumn("_at", F.when(blank, by_number(F.col("page_index"))).otherwise(by_url))
    found = landed.join(broadcast_if_small(places, BROADCAST_PAGES), ["source_id", "_at"])
    return found.select(*[F.col("_place").alias(c) if c == "page_index" else c for c in fetches.columns])


def current_copies(fetches: DataFrame, run_at: Column) -> DataFrame:
    """Copies of each page's latest crawl at ``run_at``, contents in place.

    A crawl begins with a plain first attempt (a rendered one where there is no plain
    one; without a first attempt all copies count). Its time comes from the narrow key
    columns, combined on the map side, and older copies are dropped before anything
    is parsed. Contents move only when the pages outgrow a broadcast.
    """
    page = ["source_id", "page_index"]
    seen = fetches.filter(F.col("fetched_at") <= run_at)
    first = F.col("attempt") == 0
    begun = seen.groupBy(*page).agg(
        F.max(F.when(first & (F.col("channel") == "http"), F.col("fetched_at"))).alias("_plain"),
        F.max(F.when(first, F.col("fetched_at"))).alias("_first"),
        F.min("fetched_at").alias("_any"),
    )
    begun = begun.select(*page, F.coalesce("_plain", "_first", "_any").alias("_from"))
    crawl = seen.join(broadcast_if_small(begun, BROADCAST_PAGES), page)
    return crawl.filter(F.col("fetched_at") >= F.col("_from")).drop("_from")


def copies_of_runs(fetches: DataFrame, first_run: Column, hours: int, kept: list[str]) -> DataFrame:
    """The copies that each of ``hours`` runs an hour apart reads: ``run``, counted from 0, the page and ``kept`` columns.

    What :func:`current_copies` reads at any time, for all runs in one pass. A copy counts
    from its landing until a new crawl of its page begins: a plain first attempt, or before
    the first of those any first attempt. That end is a running minimum over the page's
    own few copies, and the copy is dealt to the runs inside with one range of numbers.
    """
    page = ["source_id", "page_index"]
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    hour = 3_600_000_000
    narrow = fetches.select(*dict.fromkeys([*page, *kept]), "attempt", "channel", micros(F.col("fetched_at")).alias("_us"))
    first = F.col("attempt") == 0
    plain = F.min(F.when(first & (F.col("channel") == "http"), F.col("_us"))).over(Window.partitionBy(*page))
    starts = first & ((F.col("channel") == "http") | plain.isNull() | (F.col("_us") < plain))
    falling = Window.partitionBy(*page).orderBy(F.desc("_us"))
    marked = narrow.withColumn("_start", F.when(starts, F.col("_us")))
    ended = marked.withColumn("_end", F.min("_start").over(falling.rangeBetween(Window.unboundedPreceding, -1)))
    since = lambda c: F.greatest(F.ceil((c - micros(first_run)) / hour).cast("int"), F.lit(0))
    # greatest() passes over nulls, but a crawl that nothing ends is read by all later runs
    endless = F.col("_us").isNotNull() & F.col("_end").isNull()
    runs = ended.withColumns({"_from": since(F.col("_us")), "_to": F.when(endless, F.lit(hours)).otherwise(F.least(since(F.col("_end")), F.lit(hours)))})
    inside = runs.filter(F.col("_from") < F.col("_to"))
    return inside.select(F.explode(F.sequence("_from", F.col("_to") - 1)).alias("run"), *dict.fromkeys([*page, *kept]))


def classify_copies(copies: DataFrame, status_errors: bool = True) -> DataFrame:
    """Adds ``state`` (failed, blocked or read) and ``reason`` to each copy.

    A status of 400 or more is a failed fetch before its text is looked at;
    with ``status_errors=False`` the blocked statuses count as blocked instead.
    """
    status = F.coalesce(F.col("status_code"), F.lit(200))
    failed = F.coalesce(
        blank_to_null(F.col("error")),
        F.when(F.lit(status_errors) & (status >= 400), F.concat(F.lit("HTTP status "), status.cast("string"))),
    )
    blocked = blocked_by_content(F.col("content")) if status_errors else blocked_reason(F.col("content"), status)
    return copies.withColumns({"_failed": failed, "_blocked": blocked}).select(
        *copies.columns,
        F.when(F.col("_failed").isNotNull(), "failed")
        .when(F.col("_blocked").isNotNull(), "blocked")
        .otherwise("read")
        .alias("state"),
        F.coalesce("_failed", "_blocked").alias("reason"),
    )


def resolve_attempts(copies: DataFrame, max_attempts: int = 3) -> DataFrame:
    """One row per page: outcome (done, blocked, failed), reason and postings.

    Within an attempt the rendered copy counts only when the plain one was read
    and gave nothing. Blocked or read ends the page; a failure moves on to the
    next attempt, and the last failure stays. A plain copy without a rendered
    one is final, an empty page being no failure.

    Both aggregates hash by page: the first exchange serves the second.
    """
    page = ["source_id", "page_index"]
    answer = F.struct("state", "reason", "postings")
    by_channel = lambda name: F.max_by(answer, F.when(F.col("channel") == name, F.col("fetched_at")))
    attempts = (
        copies.filter(F.col("attempt") < max_attempts)
        .repartition(*page)
        .groupBy(*page, "attempt")
        .agg(by_channel("http").alias("http"), by_channel("rendered").alias("rendered"))
    )
    empty = (F.col("http.state") == "read") & (F.size("http.postings") == 0) & F.col("rendered").isNotNull()
    answers = attempts.select(
        *page, "attempt", F.when(F.col("http").isNull() | empty, F.col("rendered")).otherwise(F.col("http")).alias("a")
    )
    final = F.col("a.state") != "failed"
    resolved = answers.groupBy(*page).agg(
        F.min_by("a", F.when(final, F.col("attempt"))).alias("ended"), F.max_by("a", "attempt").alias("last")
    )
    return resolved.select(
        *page,
        F.when(F.col("ended").isNull(), "failed")
        .when(F.col("ended.state") == "blocked", "blocked")
        .otherwise("done")
        .alias("outcome"),
        F.coalesce("ended.reason", F.when(F.col("ended").isNull(), F.col("last.reason"))).alias("reason"),
        F.when(F.col("ended.state") == "read", F.col("ended.postings")).alias("postings"),
    )


def source_outcomes(page_outcomes: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per source: its error, if any, and the page it was blocked at.

    The first page failing or blocked fails the source.
    """
    first = F.col("page_index") == 0
    per_source = page_outcomes.groupBy("source_id").agg(
        F.max(F.when(first, F.col("outcome"))).alias("first_outcome"),
        F.max(F.when(first, F.col("reason"))).alias("first_reason"),
        F.min(F.when((F.col("outcome") == "blocked") & ~first, F.col("page_index"))).alias("blocked_page"),
    )
    known = F.col("parser_type").isin(PARSER_TYPES)
    return sources.join(per_source, "source_id", "left").select(
        *sources.columns,
        F.when(~known, F.concat(F.lit("Unknown parser type: "), F.col("parser_type")))
        .when(
            F.col("first_outcome") == "blocked",
            F.concat(F.lit("blocked by anti-bot policy: "), F.coalesce("first_reason", F.lit(""))),
        )
        .when(
            F.col("first_outcome") == "failed",
            F.concat(F.lit("fetch failed for "), F.col("source_id"), F.lit(": "), F.coalesce("first_reason", F.lit(""))),
        )
        .when(
            F.col("first_outcome").isNull(),
            F.concat(F.lit("fetch failed for "), F.col("source_id"), F.lit(": no landed page")),
        )
        .alias("error"),
        "blocked_page",
    )


def usable_pages(page_outcomes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Read pages of good sources, up to the first later page that was blocked."""
    good = outcomes.filter(F.col("error").isNull()).select("source_id", "blocked_page")
    return (
        page_outcomes.filter(F.col("outcome") == "done")
        .join(broadcast_if_small(good), "source_id")
        .filter(F.col("blocked_page").isNull() | (F.col("page_index") < F.col("blocked_page")))
        .drop("blocked_page")
    )
