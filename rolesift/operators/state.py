"""Keyed state as set operations: upserts, suppression, notifications.

A table's new version is a new snapshot; nothing is updated in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesift.session import broadcast_if_small, materialize, release

VACANCY_KEY = ["source_id", "canonical_hash"]
VACANCY_FIELDS = ["external_id", "url", "title", "location", "description", "posted_at"]
SOURCE_FIELDS = ["company_name", "careers_url", "parser_type", "country_hint", "selectors", "enabled"]
CHANNEL = "telegram"  # fixed value: the one notification channel


def upsert_sources(stored: DataFrame, configs: DataFrame, clock: Column) -> DataFrame:
    """Configured sources inserted or overwritten; enabled ones no longer configured disabled.

    ``created_at`` stays; only configured rows get a new ``updated_at``.
    """
    old, new = stored.alias("old"), configs.select("source_id", *SOURCE_FIELDS).alias("new")
    configured = F.col("new.source_id").isNotNull()

    def field(name: str) -> Column:
        kept = F.lit(False) if name == "enabled" else F.col(f"old.{name}")
        return F.when(configured, F.col(f"new.{name}")).otherwise(kept).alias(name)

    return old.join(new, F.col("old.source_id") == F.col("new.source_id"), "full_outer").select(
        F.coalesce("old.source_id", "new.source_id").alias("source_id"),
        *[field(n) for n in SOURCE_FIELDS],
        F.coalesce("old.created_at", clock).alias("created_at"),
        F.when(configured, clock).otherwise(F.col("old.updated_at")).alias("updated_at"),
    )


def active_sources(stored: DataFrame, configs: DataFrame) -> DataFrame:
    """Enabled sources that are configured: identity from the table, options from the file."""
    options = configs.drop(*SOURCE_FIELDS)
    return stored.filter("enabled").drop("created_at", "updated_at").join(options, "source_id")


def last_sightings(postings: DataFrame, ordinals: list[str]) -> DataFrame:
    """The last posting of each natural key in a run; collapses on the map side."""
    latest = F.max_by(F.struct(*VACANCY_FIELDS), F.struct(*ordinals))
    return postings.groupBy(*VACANCY_KEY).agg(latest.alias("_row")).select(*VACANCY_KEY, "_row.*")


def upsert_vacancies(snapshot: DataFrame, batch: DataFrame, run_at: Column) -> DataFrame:
    """Both sides hold a key once, so no key is hot whatever the data.

    New keys are first and last seen at the run time. Known ones take the new
    fields and the run time, even an earlier one, and keep ``first_seen_at``.
    """
    old, new = snapshot.alias("old"), batch.alias("new")
    on = reduce(lambda a, b: a & b, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in VACANCY_KEY])
    seen = F.col("new.canonical_hash").isNotNull()
    return old.join(new, on, "full_outer").select(
        *[F.coalesce(f"old.{k}", f"new.{k}").alias(k) for k in VACANCY_KEY],
        *[F.when(seen, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in VACANCY_FIELDS],
        F.coalesce("old.first_seen_at", run_at).alias("first_seen_at"),
        F.when(seen, run_at).otherwise(F.col("old.last_seen_at")).alias("last_seen_at"),
    )


def fold_sightings(sightings: DataFrame, first_run: str = "run_id", last_run: str = "run_id") -> DataFrame:
    """Many runs of sightings to one vacancy row per key.

    ``run_id`` orders the runs; ``first_seen_at`` comes from a key's first run
    and everything else from its last. Rows folded before name both runs.
    """
    last = F.max_by(F.struct(*VACANCY_FIELDS, "last_seen_at"), last_run)
    first = [F.min(first_run).alias(first_run)] if first_run != last_run else []
    return (
        sightings.groupBy(*VACANCY_KEY)
        .agg(last.alias("_row"), F.min_by("first_seen_at", first_run).alias("first_seen_at"), F.max(last_run).alias("run_id"), *first)
        .select(*VACANCY_KEY, *[f"_row.{c}" for c in VACANCY_FIELDS], "first_seen_at", "_row.last_seen_at", "run_id", *[first_run for _ in first])
    )


def muted_keys(notifications: DataFrame, now: Column, channel: str = CHANNEL, key: list[str] | None = None) -> DataFrame:
    """Keys with a notice still in force, each once."""
    live = notifications.filter((F.col("channel") == channel) & (F.col("dedupe_until") > now))
    return live.select(*(key or VACANCY_KEY)).distinct()


def drop_suppressed(
    postings: DataFrame, notifications: DataFrame, now: Column, channel: str = CHANNEL, key: list[str] | None = None
) -> DataFrame:
    """Postings whose key has no notice in force. Many postings of one key are one
    skewed partition of the left side, which adaptive execution splits."""
    key = key or VACANCY_KEY
    return postings.join(muted_keys(notifications, now, channel, key), key, "left_anti")


def new_notifications(items: DataFrame, now: Column, days: int = 7, channel: str = CHANNEL) -> DataFrame:
    """One notice per kept digest row, also those cut from the text."""
    return items.select(
        *VACANCY_KEY,
        F.lit(channel).alias("channel"),
        now.alias("sent_at"),
        (now + F.make_dt_interval(F.lit(days))).alias("dedupe_until"),
    )


# --------------------------------------------------------------------------
# suppression over a whole history

# a key with more events than this is too long for one task's array
HISTORY_ARRAY_LIMIT = 100_000


def sent_in_history(events: DataFrame, key: list[str], at: str, days: int, limit: int = HISTORY_ARRAY_LIMIT) -> DataFrame:
    """The events that would be notified, key by key and in time order.

    A key's first event is sent, then the first one at least ``days`` later, and
    so on. Keys of up to ``limit`` distinct times fold their sorted times in one
    pass. Longer ones never meet in one task: see :func:`_sent_of_long_keys`.
    """
    times = events.select(*key, at).distinct()
    counts = times.groupBy(*key).agg(F.count("*").alias("n"))
    # at most one key per ``limit`` events is long
    longer = counts.filter(F.col("n") > limit).select(*key)
    hot = longer.limit(1).count() > 0
    if hot:
        longer = broadcast_if_small(materialize(longer))
    short = times.join(longer, key, "left_anti") if hot else times
    gap = F.make_dt_interval(F.lit(days))
    nothing = F.array().cast(T_ARRAY[dict(events.dtypes)[at]])

    def step(sent: Column, t: Column) -> Column:
        return F.when(F.size(sent) == 0, F.array(t)).when(
            t >= F.element_at(sent, -1) + gap, F.concat(sent, F.array(t))
        ).otherwise(sent)

    folded = (
        short.groupBy(*key)
        .agg(F.array_sort(F.collect_list(at)).alias("_times"))
        .select(*key, F.explode_outer(F.aggregate("_times", nothing, step)).alias(at))
    )
    if not hot:
        return folded
    return folded.unionByName(_sent_of_long_keys(times.join(longer, key, "left_semi"), key, at, days))


T_ARRAY = {"timestamp": "array<timestamp>", "timestamp_ntz": "array<timestamp_ntz>"}


# stretches of a history in which successors are looked for by themselves, to a window of suppression
SLOTS = 168


def _sent_of_long_keys(times: DataFrame, key: list[str], at: str, days: int) -> DataFrame:
    """Sends of keys too long for an array: a successor table and pointer doubling.

    An event's successor is the key's first event at least ``days`` later; the sends are
    the orbit of the first event. Each round the events known to be sent follow pointers of
    twice the length, so a history of n sends takes log n rounds of equal joins, and no
    task, nor the driver, ever holds a key's events.
    """
    span = days * 86_400 * 1_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    events = materialize(times.select(*key, F.col(at), micros.alias("us")))
    jumps = materialize(_successors(events.select(*key, "us"), key, span))
    sent = materialize(events.groupBy(*key).agg(F.min("us").alias("us")))
    while True:
        fresh = sent.join(jumps, [*key, "us"]).select(*key, F.col("next").alias("us"))
        grown = materialize(sent.union(fresh).distinct())
        more = grown.count() > sent.count()
        release(sent)
        sent = grown
        if not more:
            break
        on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
        twice = jumps.alias("a").join(jumps.alias("b"), reduce(lambda x, y: x & y, on, F.col("a.next") == F.col("b.us")))
        longer = materialize(twice.select(*[F.col(f"a.{k}") for k in key], F.col("a.us"), F.col("b.next").alias("next")))
        release(jumps)
        jumps = longer
    release(jumps)
    return events.join(sent, [*key, "us"], "left_semi").select(*key, at)


def _successors(events: DataFrame, key: list[str], span: int) -> DataFrame:
    """``us`` and ``next``, the key's first event at least ``span`` later, of events that have one.

    An event asks at ``us + span``. The asked moment's own slot is searched first: events
    and questions of a slot in falling order, each question taking the event last seen.
    Where the slot has none, the first event of the key's next slot with any is it; slots
    are as many as the history is long, however many events it has.
    """
    slot = lambda c: F.floor(c / (span // SLOTS or 1))
    asked = events.select(*key, (F.col("us") + span).alias("moment"), F.col("us").alias("asker"))
    both = events.select(*key, F.col("us").alias("moment"), F.lit(None).cast("long").alias("asker")).union(asked)
    both = both.withColumn("slot", slot(F.col("moment")))
    falling = Window.partitionBy(*key, "slot").orderBy(F.desc("moment"), F.col("asker").asc_nulls_first())
    event = F.when(F.col("asker").isNull(), F.col("moment"))
    seen = both.withColumn("next", F.last(event, ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, 0)))
    answered = materialize(seen.filter("asker IS NOT NULL").select(*key, "slot", F.col("asker").alias("us"), "next"))
    # of each slot that is asked about in vain, the first event of a later slot
    firsts = events.groupBy(*key, slot(F.col("us")).alias("slot")).agg(F.min("us").alias("first"))
    unmet = answered.filter("next IS NULL").select(*key, "slot").distinct().withColumn("first", F.lit(None).cast("long"))
    later = Window.partitionBy(*key).orderBy(F.desc("slot"), F.col("first").asc_nulls_first())
    found = firsts.union(unmet).withColumn(
        "after", F.last("first", ignorenulls=True).over(later.rowsBetween(Window.unboundedPreceding, 0))
    )
    found = found.filter("first IS NULL AND after IS NOT NULL").select(*key, "slot", F.col("after").alias("next"))
    rest = answered.filter("next IS NULL").drop("next").join(found, [*key, "slot"]).select(*key, "us", "next")
    return answered.filter("next IS NOT NULL").select(*key, "us", "next").union(rest)
