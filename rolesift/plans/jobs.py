"""The jobs a user starts: run once, backfill, validate sources."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.operators import accounting, digest, matching, normalize, pages, rules, state
from rolesift.operators.extraction import PARSER_TYPES, explode_postings, extract_postings
from rolesift.session import broadcast_if_small, materialize, release, spread_if_few
from rolesift.sources.configs import config_violations, read_configs, shape_configs
from rolesift.sources.frontier import page_frontier
from rolesift.sources.store import COMPACT_EVERY, RunStore

RUN_ROW = (
    "run_id long, started_at timestamp, finished_at timestamp, status string, sources_total long, jobs_fetched long, "
    "jobs_matched long, jobs_sent long, error_summary string, trigger string, report_text string, digest_text string"
)
ORDINALS = ["source_id", "page_index", "job_index"]


@dataclass(frozen=True)
class RunParams:
    """Job parameters; the defaults are the documented ones."""

    min_score: float = 0.60
    max_items: int = 20
    dedupe_days: int = 7
    enable_remote: bool = False
    zone: str = "UTC"
    max_attempts: int = 3
    profile: rules.MatchProfile = field(default_factory=rules.profile_of)


def read_pages(
    fetches: DataFrame, sources: DataFrame, frontier: DataFrame, run_at: datetime, max_attempts: int = 3
) -> DataFrame:
    """Landed copies of the frontier's pages to page outcomes with their postings, as of ``run_at``."""
    known = sources.filter(F.col("parser_type").isin(PARSER_TYPES))
    families = [r["parser_type"] for r in known.select("parser_type").distinct().collect()]  # eight at most
    options = ["careers_url", "parser_type", "selectors", "jobs_path", "url_base", "fields", "job_url_template"]
    landed = pages.of_frontier(spread_if_few(fetches), frontier)
    copies = pages.current_copies(landed, F.lit(run_at)).join(
        broadcast_if_small(sources.select("source_id", *options)), "source_id"
    )
    judged = pages.classify_copies(copies)
    # text of blocked and failed copies goes no further
    readable = judged.withColumn("content", F.when(F.col("state") == "read", F.col("content")))
    read = extract_postings(readable.drop("url", "status_code", "error"), families)
    outcomes = pages.resolve_attempts(read, max_attempts)
    return outcomes.join(broadcast_if_small(sources.select("source_id", "parser_type")), "source_id")


def score_jobs(jobs: DataFrame, sources: DataFrame, params: RunParams) -> DataFrame:
    """Raw jobs to normalised, scored postings with a decision."""
    identity = sources.select("source_id", "company_name", "country_hint")
    normal = normalize.normalize_jobs(jobs.join(broadcast_if_small(identity), "source_id"))
    tuned = sources.filter(F.col("matching_profile").isNotNull())
    if tuned.limit(1).count() == 0:
        return matching.match_postings(normal, params.profile, params.min_score, params.enable_remote)
    profiles = rules.source_profiles(sources, params.profile)
    return matching.match_with_source_profiles(normal, profiles, params.min_score, params.enable_remote)


def run_once(
    store: RunStore,
    fetches: DataFrame,
    configs: DataFrame,
    run_at: datetime,
    params: RunParams | None = None,
    notify: bool = True,
    run_id: int | None = None,
    trigger: str | None = None,
) -> DataFrame:
    """One full run at ``run_at``; returns its one row with the two texts.

    ``configs`` are shaped and valid. A run id already published is not run
    again: its stored row comes back; so for a ``trigger``, the name of what started
    the run, which gets a run id of its own. Ids are claimed, so runs started at the same
    time have two; a trigger that was lost on the way comes back to the id it claimed. Without ``notify`` there is no digest and
    nothing is recorded as sent.
    """
    params = params or RunParams()
    if trigger is not None:
        done = store.of_trigger(trigger)
        if done.limit(1).count():
            return done
    run_id = store.claim_run(trigger) if run_id is None else run_id
    if store.is_published(run_id):
        return store.runs().filter(F.col("run_id") == run_id)
    staged: list[DataFrame] = []

    def stage(rows: DataFrame) -> DataFrame:
        staged.append(materialize(rows))
        return staged[-1]

    try:
        return _run(store, fetches, configs, run_at, params, notify, run_id, trigger, stage)
    finally:
        release(*staged)


def _run(store, fetches, configs, run_at, params, notify, run_id, trigger, stage) -> DataFrame:
    """The steps of a run; its row is written last."""
    spark = store.spark
    clock = F.lit(datetime.now(timezone.utc))
    now = F.lit(run_at)

    store.write("sources", run_id, state.upsert_sources(store.sources(), configs, clock))
    stored = store.of_run("sources", run_id)
    sources = stage(state.active_sources(stored, configs.drop("file", "pagination", "parser_options", "extra")))

    frontier = page_frontier(configs)
    page_rows = stage(read_pages(fetches, sources, frontier, run_at, params.max_attempts))
    outcomes = pages.source_outcomes(page_rows, sources)
    raw = explode_postings(pages.usable_pages(page_rows, outcomes), ["source_id", "page_index"])
    # five consumers below
    scored = stage(score_jobs(normalize.dedupe_source_jobs(raw), sources, params))

    sightings = state.last_sightings(scored, ORDINALS).withColumns({"first_seen_at": now, "last_seen_at": now})
    store.write("sightings", run_id, sightings)
    store.write("matches", run_id, scored.withColumn("created_at", now))
    summaries = stage(accounting.source_summaries(scored, outcomes))
    store.write("errors", run_id, accounting.run_errors(summaries))
    account = accounting.run_counters(summaries).first()
    matched = matching.to_send(scored)
    matched_total = matched.count()

    report = sent = None
    if notify:
        fresh = state.drop_suppressed(matched, store.live_notices(run_at), now)
        items = stage(digest.top_items(fresh, params.max_items))
        store.write("notifications", run_id, state.new_notifications(items, now, params.dedupe_days))
        sent = digest.digest_text(items, now, F.lit(account["sources_total"]), F.lit(matched_total), params.zone).first()
        report = digest.run_report(summaries, now, params.zone).first()

    row = {
        "run_id": run_id,
        "started_at": run_at,
        "finished_at": datetime.now(timezone.utc),
        "status": account["status"],
        "sources_total": account["sources_total"],
        "jobs_fetched": account["jobs_fetched"],
        "jobs_matched": matched_total,
        "jobs_sent": sent["jobs_sent"] if sent else 0,
        "error_summary": account["error_summary"],
        "trigger": trigger,
        "report_text": report["report_text"] if report and account["sources_total"] else None,
        "digest_text": sent["digest_text"] if sent else None,
    }
    result = spark.createDataFrame([row], RUN_ROW)
    store.write("runs", run_id, result)
    store.compact_vacancies(COMPACT_EVERY)
    return result


def backfill(
    store: RunStore, fetches: DataFrame, configs: DataFrame, hours: int, base: datetime,
    params: RunParams | None = None, notify: bool = False,
) -> Iterator[DataFrame]:
    """``hours`` hourly runs, oldest first, each on the pages landed by its time.

    Runs depend on each other's notices, so they follow one another; each is
    parallel inside.
    """
    if hours <= 0:
        raise ValueError("hours must be > 0")
    for offset in range(hours - 1, -1, -1):
        yield run_once(store, fetches, configs, base - timedelta(hours=offset), params, notify)


def validate_sources(spark: SparkSession, folder: str) -> DataFrame:
    """All violations of all config files; errors first."""
    return config_violations(read_configs(spark, folder)).orderBy("severity", "file", "rule")


def load_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Shaped configs, refusing a folder with errors."""
    files = read_configs(spark, folder)
    broken = config_violations(files).filter(F.col("severity") == "error").limit(5).collect()
    if broken:
        raise ValueError("; ".join(f"{r['file']}: {r['message']}" for r in broken))
    return shape_configs(files)
