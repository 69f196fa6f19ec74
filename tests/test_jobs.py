import json
from datetime import datetime, timedelta, timezone

import pytest

from rolesift.operators.pages import PAGE_FETCHES
from rolesift.plans.jobs import RunParams, backfill, load_sources, run_once, validate_sources
from rolesift.sources.configs import read_configs, shape_configs
from rolesift.sources.frontier import page_frontier
from rolesift.sources.store import RunStore
from rolesift.streaming.recurring import recurring_run

T0 = datetime(2026, 4, 1, tzinfo=timezone.utc)
# two shops of our own and one that does not answer
MILL = json.dumps({"content": [{"id": "m-77", "name": "Data Scientist, Flour Quality", "ref": "https://mill.test/77", "location": {"city": "Utrecht", "country": "Netherlands"}},
                               {"id": "m-78", "name": "Miller", "ref": "https://mill.test/78", "location": {"city": "Utrecht"}}]})
YARN = json.dumps({"open": {"rows": [{"nr": 5, "what": "AI Engineer for Looms", "at": "/o/5", "spot": {"town": "Remote, EMEA"}}]}})
CONFIGS = {
    "mill": {"id": "mill", "company_name": "Old Mill", "careers_url": "https://mill.test/jobs", "parser_type": "smartrecruiters"},
    "yarn": {"id": "yarn", "company_name": "Yarn & Co", "careers_url": "https://yarn.test/open", "parser_type": "generic_json",
             "parser_options": {"jobs_path": "open.rows", "fields": {"title": "what", "url": "at", "external_id": "nr", "location": "spot.town"}}},
    "shut": {"id": "shut", "company_name": "Shut Ltd", "careers_url": "https://shut.test", "parser_type": "lever"},
}
PARAMS = RunParams(min_score=0.5, enable_remote=True)


def configs(spark, *names):
    return shape_configs(spark.createDataFrame([(n, json.dumps(CONFIGS[n])) for n in names], "file string, config_text string"))


def fetch(source, content, status=200, at=T0, page=0, url=None):
    return (source, page, url or CONFIGS[source]["careers_url"], 0, "http", status, content, None, at)


def fetches(spark, *rows):
    return spark.createDataFrame(rows, PAGE_FETCHES)


def test_runs_over_time(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "state"))
    pages = fetches(spark, fetch("mill", MILL), fetch("yarn", YARN), fetch("shut", "x", 502))
    every = configs(spark, "mill", "yarn", "shut")

    first = run_once(store, pages, every, T0, PARAMS).first()
    assert (first["status"], first["sources_total"], first["jobs_fetched"], first["jobs_matched"], first["jobs_sent"]) == ("partial_failure", 3, 3, 2, 2)
    assert json.loads(first["error_summary"]) == {"shut": "fetch failed for shut: HTTP status 502"}
    assert "1. Old Mill | Data Scientist, Flour Quality | Utrecht, Netherlands | https://mill.test/77" in first["digest_text"]
    assert "Vacancies scraped: 3 across 2/3 sources" in first["report_text"]

    # the same run again changes nothing
    counts = lambda: {t: store.read(t).count() for t in ("sightings", "matches", "notifications", "runs")}
    before = counts()
    run_once(store, pages, every, T0, PARAMS, run_id=1)
    assert counts() == before

    # a day later all is suppressed, and the source gone from the configs is disabled
    second = run_once(store, pages, configs(spark, "mill", "yarn"), T0 + timedelta(days=1), PARAMS).first()
    assert (second["status"], second["sources_total"], second["jobs_matched"], second["jobs_sent"]) == ("success", 2, 2, 0)
    assert second["digest_text"] is None
    assert {r["source_id"]: r["enabled"] for r in store.sources().collect()} == {"mill": True, "yarn": True, "shut": False}

    # an unpublished run is invisible
    store.write("notifications", 9, store.read("notifications").drop("run_id"))
    assert counts() == {"sightings": 6, "matches": 6, "notifications": 2, "runs": 2}

    seen = {r["source_id"]: (r["first_seen_at"], r["last_seen_at"]) for r in store.vacancies().collect()}
    assert set(seen.values()) == {(T0.replace(tzinfo=None), (T0 + timedelta(days=1)).replace(tzinfo=None))}
    store.compact_vacancies()
    store.compact_vacancies()  # nothing new: no new version
    assert store._base() == (1, 2, [])
    store.write("vacancy_base", 2, store.of_run("vacancy_base", 1).limit(0))  # a version that was never published
    assert {r["source_id"]: (r["first_seen_at"], r["last_seen_at"]) for r in store.vacancies().collect()} == seen
    # every notice and match belongs to a known vacancy
    assert store.read("matches").join(store.vacancies(), ["source_id", "canonical_hash"], "left_anti").count() == 0


def test_backfill_reads_pages_as_of_each_hour(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "state"))
    pages = fetches(spark, fetch("mill", MILL), fetch("mill", json.dumps({"content": []}), at=T0 + timedelta(minutes=90)))
    with pytest.raises(ValueError):
        next(backfill(store, pages, configs(spark, "mill"), 0, T0))
    rows = [r.first() for r in backfill(store, pages, configs(spark, "mill"), 2, T0 + timedelta(hours=2), PARAMS)]
    assert [(r["started_at"], r["jobs_fetched"], r["jobs_sent"]) for r in rows] == [
        ((T0 + timedelta(hours=1)).replace(tzinfo=None), 2, 0), ((T0 + timedelta(hours=2)).replace(tzinfo=None), 0, 0),
    ]
    assert store.read("notifications").count() == 0


def test_recurring_runs_lose_no_page(spark, tmp_path):
    store, landed = RunStore(spark, str(tmp_path / "state")), str(tmp_path / "landed")
    run_once(store, fetches(spark, fetch("yarn", YARN, at=T0 - timedelta(days=31))), configs(spark, "yarn"), T0 - timedelta(days=30), PARAMS)  # takes run id 1
    fetches(spark, fetch("mill", MILL)).write.parquet(landed)
    now = [T0]

    def go():
        recurring_run(spark, landed, store, lambda: configs(spark, "mill", "yarn"), str(tmp_path / "cp"), PARAMS,
                      trigger={"availableNow": True}, clock=lambda: now[0]).awaitTermination()

    go()
    go()  # nothing new: nothing runs
    ran = [(r["run_id"], r["jobs_fetched"]) for r in store.runs().orderBy("run_id").collect()]
    assert ran == [(1, 1), (2, 2)]
    # pages of other batches count as well, as of the run's time
    now[0] = T0 + timedelta(hours=1)
    fetches(spark, fetch("yarn", YARN, at=T0 + timedelta(minutes=30))).write.mode("append").parquet(landed)
    go()
    last = store.runs().filter("run_id = 3").first()
    assert (last["status"], last["jobs_fetched"]) == ("success", 3)
    # the same trigger again finds its run
    again = run_once(store, fetches(spark), configs(spark, "mill"), now[0], PARAMS, trigger=last["trigger"]).first()
    assert again["run_id"] == 3 and store.last_run() == 3


def test_concurrent_runs_have_rows_of_their_own(spark, tmp_path):
    """Ids are claimed: neither run writes over the other, and what a base missed is read beside it."""
    from concurrent.futures import ThreadPoolExecutor

    store = RunStore(spark, str(tmp_path / "state"))
    pages, every = fetches(spark, fetch("mill", MILL)), configs(spark, "mill")
    with ThreadPoolExecutor(2) as pool:
        rows = list(pool.map(lambda h: run_once(store, pages, every, T0 + timedelta(hours=h), PARAMS).first(), (0, 1)))
    assert sorted(r["run_id"] for r in rows) == [1, 2] and store.runs().count() == 2
    assert store.read("sightings").count() == 4
    # ids 3 and 4 are claimed; 4 ends first and a base is made, 3 comes later
    claimed = [store.claim_run(), store.claim_run("stream/7"), store.claim_run("stream/7")]
    assert claimed == [3, 4, 4]
    grown = fetches(spark, fetch("mill", MILL.replace("Miller", "Baker"), at=T0 + timedelta(hours=3)))
    run_once(store, grown, every, T0 + timedelta(hours=4), PARAMS, run_id=4)
    store.compact_vacancies()
    assert store._base()[1:] == (4, [3])
    first_seen = lambda: {r["title"]: r["first_seen_at"].hour for r in store.vacancies().collect()}
    before = first_seen()
    run_once(store, pages, every, T0 + timedelta(hours=3), PARAMS, run_id=3)
    assert first_seen() == before and set(before) == {"Data Scientist, Flour Quality", "Miller", "Baker"}
    store.compact_vacancies(0)
    assert first_seen() == before and store._base()[1:] == (4, [])


def test_pages_that_left_the_frontier_do_not_count(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "state"))
    config = lambda n: {**CONFIGS["mill"], "pagination": {"strategy": "query_param", "max_pages": n}}
    posting = lambda i: json.dumps({"content": [{"id": f"p{i}", "name": f"Miller {i}", "ref": f"https://mill.test/{i}"}]})
    at = CONFIGS["mill"]["careers_url"]
    landed = fetches(spark, fetch("mill", posting(0)), *[fetch("mill", posting(i), page=i, url=f"{at}?page={i + 1}") for i in range(1, 4)],
                     fetch("mill", posting(9), page=1, url=f"{at}?start=15"))
    shaped = lambda n: shape_configs(spark.createDataFrame([("f", json.dumps(config(n)))], "file string, config_text string"))
    counts = [run_once(store, landed, shaped(n), T0 + timedelta(hours=n), PARAMS, notify=False).first()["jobs_fetched"] for n in (4, 2)]
    assert counts == [4, 2]


def test_staged_tables_go_even_after_a_failure(spark, tmp_path):
    import os

    from rolesift.session import shared_folder

    folder = f"{shared_folder(spark).removeprefix('file:')}/staged"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    store = RunStore(spark, str(tmp_path / "state"))
    run_once(store, fetches(spark, fetch("mill", MILL)), configs(spark, "mill"), T0, PARAMS)
    with pytest.raises(Exception):
        run_once(store, spark.createDataFrame([("mill",)], "source_id string"), configs(spark, "mill"), T0, PARAMS)
    assert set(os.listdir(folder)) <= before


def test_a_cluster_without_a_shared_folder_is_refused():
    from rolesift.session import is_local

    assert is_local("local") and is_local("local[4]") and not is_local("local-cluster[2,1,1024]") and not is_local("yarn")


def test_config_folder(spark, tmp_path):
    folder = tmp_path / "sources"
    assert read_configs(spark, str(folder)).count() == 0
    folder.mkdir()
    config = {"id": " weaver ", "company_name": "Weaver", "careers_url": "https://weaver.test/c", "parser_type": "generic_html", "selectors": {"job_card": ".j"},
              "pagination": {"strategy": "query_param", "max_pages": 4, "page_param": "p"}, "json_job_url_template": "https://weaver.test/{id}", "owner": "x"}
    (folder / "a.json").write_text(json.dumps(config, indent=1))
    (folder / "notes.txt").write_text("not a config")
    assert validate_sources(spark, str(folder)).count() == 0
    shaped = load_sources(spark, str(folder))
    row = shaped.first()
    assert (row["source_id"], row["job_url_template"], row["enabled"], list(row["extra"])) == ("weaver", "https://weaver.test/{id}", True, ["owner"])
    urls = [r["url"] for r in page_frontier(shaped).orderBy("page_index").collect()]
    assert urls == ["https://weaver.test/c", "https://weaver.test/c?p=2", "https://weaver.test/c?p=3", "https://weaver.test/c?p=4"]
    (folder / "b.json").write_text(json.dumps({**config, "parser_type": "generic_json", "parser_options": {"jobs_path": "j", "fields": {"title": "t"}}, "json_job_url_template": ""}))
    rules = [(r["severity"], r["rule"]) for r in validate_sources(spark, str(folder)).collect()]
    assert rules == [("error", "duplicate_id"), ("error", "fields_url")]
    (folder / "c.json").write_text(json.dumps({**config, "id": "c", "selectors": {"job_card": "li:not(.x) > a", "title": "a:hover", "location": ""}}))
    found = validate_sources(spark, str(folder)).filter("file LIKE '%c.json'").collect()
    assert [(r["rule"], r["message"]) for r in found] == [("selector_forms", "selectors that cannot be matched: a:hover")]
    with pytest.raises(ValueError):
        load_sources(spark, str(folder))


def test_config_files_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from rolesift.plans import catalog_sources

    monkeypatch.setattr(catalog_sources, "shared_folder", lambda _: str(tmp_path))
    rows = [(i, f"S {i}", i % 25) for i in range(40)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    got = catalog_sources.config_folder(spark, str(tmp_path)).collect()
    assert {r["source_id"]: r["pages"] for r in got} == {f"c{i}": i % 25 % 4 + 1 for i, _, _ in rows}
    files = [f.name for f in tmp_path.glob("configs-*/*.json")]
    assert len(files) == 40 and len({f.split("-")[1] for f in files}) > 1
