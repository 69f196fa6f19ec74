import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rolesift.operators import accounting, digest, state
from rolesift.operators.normalize import dedupe_source_jobs

NOW = datetime(2026, 4, 17, 12)


def test_suppressed_now_free_after_the_window(spark):
    posting = spark.createDataFrame([("s1", "h1", 0.9)], "source_id string, canonical_hash string, score double")
    notices = state.new_notifications(posting, F.lit(NOW), 7)
    left = lambda now, channel="telegram": state.drop_suppressed(posting, notices, F.lit(now), channel).count()
    assert left(NOW) == 0 and left(NOW + timedelta(days=6)) == 0
    assert left(NOW + timedelta(days=7)) == 1 and left(NOW + timedelta(days=8)) == 1 and left(NOW, "mail") == 1


def brute_force(events, days):
    sent, last = [], {}
    for key, at in sorted(events, key=lambda e: e[1]):
        if key not in last or at >= last[key] + timedelta(days=days):
            last[key] = at
            sent.append((key, at))
    return sorted(sent)


@pytest.mark.parametrize("limit", [1000, 40])
def test_history_of_short_and_long_keys(spark, limit):
    rng = random.Random(7)
    # one key holds most rows, one has a long pause
    events = [("hot", NOW + timedelta(minutes=rng.randrange(40 * 1440))) for _ in range(400)]
    events += [(f"k{rng.randrange(9)}", NOW + timedelta(minutes=rng.randrange(40 * 1440))) for _ in range(120)]
    events += [("gap", NOW), ("gap", NOW + timedelta(days=7)), ("gap", NOW + timedelta(days=33, microseconds=1))]
    rows = spark.createDataFrame(events, "k string, ts timestamp")
    got = state.sent_in_history(rows, ["k"], "ts", 7, limit=limit)
    assert sorted((r["k"], r["ts"]) for r in got.collect()) == brute_force(events, 7)


def vacancy(key, title, n=0):
    return ("s", key, None, "u", title, "", "", None, n)


FIELDS = "source_id string, canonical_hash string, external_id string, url string, title string, location string, description string, posted_at timestamp"


def test_vacancy_upsert_keeps_first_seen_and_may_move_back(spark):
    batch = state.last_sightings(spark.createDataFrame([vacancy("a", "one", 0), vacancy("a", "two", 1), vacancy("b", "b", 2)], FIELDS + ", n int"), ["n"])
    first = state.upsert_vacancies(spark.createDataFrame([], FIELDS + ", first_seen_at timestamp, last_seen_at timestamp"), batch, F.lit(NOW))
    earlier = NOW - timedelta(hours=3)
    again = state.last_sightings(spark.createDataFrame([vacancy("a", "three", 0)], FIELDS + ", n int"), ["n"])
    got = {r["canonical_hash"]: (r["title"], r["first_seen_at"], r["last_seen_at"]) for r in state.upsert_vacancies(first, again, F.lit(earlier)).collect()}
    assert got == {"a": ("three", NOW, earlier), "b": ("b", NOW, NOW)}


def test_source_dedupe_over_pages(spark):
    rows = [("s", 1, 0, "u", "t", "later"), ("s", 0, 5, "u", "t", "first"), ("s", 0, 6, "u", "other", "x"), ("z", 3, 0, "u", "t", "own")]
    jobs = spark.createDataFrame(rows, "source_id string, page_index int, job_index int, url string, title string, location string")
    assert sorted(r["location"] for r in dedupe_source_jobs(jobs).collect()) == ["first", "own", "x"]


def test_dedupe_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [("s", rng.randrange(50), i, f"u{rng.randrange(20)}", "t", str(i)) for i in range(2000)]
    schema = "source_id string, page_index int, job_index int, url string, title string, location string"
    seen = []
    for parts in ("1", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        seen.append(sorted(r["location"] for r in dedupe_source_jobs(spark.createDataFrame(rows, schema).repartition(7)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1]


SUMMARY = "source_id string, company_name string, careers_url string, jobs_fetched long, error string"


def test_report_and_counters(spark):
    rows = [("trivago", "trivago", "https://t/", 7, None), ("sap", "SAP", "https://s/", 400, None), ("zal", "Zalando", "https://z/", 0, "timeout after 20s")]
    summaries = spark.createDataFrame(rows, SUMMARY)
    text = digest.run_report(summaries, F.lit(NOW)).first()[0]
    assert text.split("\n") == [
        "Scrape Summary | 2026-04-17 12:00 UTC", "Vacancies scraped: 407 across 2/3 sources", "", "Per company:", "- SAP: 400", "- trivago: 7",
        "", "Errored sources (1):", "- Zalando (https://z/): timeout after 20s",
    ]
    counted = accounting.run_counters(summaries).first()
    assert (counted["status"], counted["jobs_fetched"], counted["error_summary"]) == ("partial_failure", 407, '{"zal":"timeout after 20s"}')
    clean = accounting.run_counters(summaries.filter("error IS NULL")).first()
    assert (clean["status"], clean["error_summary"]) == ("success", None)
    assert accounting.run_counters(summaries.filter("error IS NOT NULL")).first()["status"] == "failure"
    broken = spark.createDataFrame([(f"s{i:05d}", "C", "https://x", 0, f"e{i}") for i in range(300)], SUMMARY)
    some = accounting.run_counters(broken, named=2).first()
    assert (some["errors_total"], some["error_summary"]) == (300, '{"s00000":"e0","s00001":"e1","...":"298 more"}')
    assert accounting.run_errors(broken).count() == 300
    many = spark.createDataFrame([(f"s{i:05d}", f"Company {i:05d}", "https://x", i, None) for i in range(2000)], SUMMARY)
    long = digest.run_report(many, F.lit(NOW), "Europe/Berlin").first()[0]
    assert len(long) == 3900 and long.endswith("\n...(truncated)") and "2000/2000" in long and "14:00 Europe/Berlin" in long


def test_digest_fits_and_counts_what_is_left_out(spark):
    items = [("s", 0, i, "Co", "T" * 200, "" if i == 0 else "Rome", f"https://x/{i}", 1.0 if i < 3 else 0.5) for i in range(30)]
    rows = spark.createDataFrame(items, "source_id string, page_index int, job_index int, company string, title string, location string, url string, score double")
    top = digest.top_items(rows, 20)
    got = digest.digest_text(top, F.lit(NOW), F.lit(3), F.lit(30)).first()
    lines = got["digest_text"].split("\n")
    assert lines[:3] == ["ML Vacancy Digest | 2026-04-17 12:00", "New matched vacancies: 20", ""]
    assert lines[3] == "1. Co | " + "T" * 200 + " | Unknown location | https://x/0"
    shown = [x for x in lines if " | TTT" in x]
    assert len(shown) == got["lines_shown"] and got["lines_omitted"] == 20 - len(shown) > 0
    assert len("\n".join(lines[: 3 + len(shown)])) <= 3900 < len("\n".join(lines[: 3 + len(shown)])) + 1 + len(shown[-1])
    assert lines[-1] == "Sources scanned: 3 | Matched before dedupe: 30 | Timezone: UTC"
    assert digest.digest_text(top.limit(0), F.lit(NOW), F.lit(3), F.lit(0)).count() == 0


def noon(day):
    return datetime(2026, 4, 1, 12, tzinfo=timezone.utc) + timedelta(days=day)


def test_only_live_notices_are_opened(spark, tmp_path):
    from rolesift.sources.store import RunStore

    store = RunStore(spark, str(tmp_path / "state"))
    assert store.live_notices(noon(0)).count() == 0
    runs = spark.createDataFrame([(noon(0), None, "success", 1, 1, 1, 1, None, None)], "started_at timestamp, finished_at timestamp, status string, "
                                 "sources_total long, jobs_fetched long, jobs_matched long, jobs_sent long, error_summary string, trigger string")  # fmt: skip
    for run_id, day in ((1, 0), (2, 5), (3, 9)):
        items = spark.createDataFrame([("s", f"h{run_id}")], "source_id string, canonical_hash string")
        store.write("notifications", run_id, state.new_notifications(items, F.lit(noon(day + 1))))  # a lost attempt, a day later
        store.write("notifications", run_id, state.new_notifications(items, F.lit(noon(day))))
        store.write("runs", run_id, runs)
    assert [r["n"] for r in store.read("notifications").groupBy("run_id").count().toDF("run_id", "n").collect()] == [1, 1, 1]
    live = store.live_notices(noon(8))
    assert sorted(r["run_id"] for r in live.collect()) == [2, 3]
    assert not [f for f in live.inputFiles() if "notifications" in f and "run_id=1" in f]
    store.retire_notices(noon(13))
    assert sorted(r["run_id"] for r in store.read("notifications").collect()) == [3]
