from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rolesift.operators import pages as pg

NOON = datetime(2026, 4, 1, 12)


def test_block_detection(spark):
    rows = spark.createDataFrame(
        [
            (0, "<head><title>Careers</title></head><script src='https://www.google.com/recaptcha/api.js'></script>", 200),
            (1, "<title>Just a moment...</title>", 200),
            (2, "<title>Careers</title>", 403),
            (3, "<TITLE a=b>x\n</TITLE> automated queries, Ray ID: 1", 200),
            (4, "no title", 404),
        ],
        "i int, c string, s int",
    )
    got = [r["r"] for r in rows.select("i", pg.blocked_reason(F.col("c"), F.col("s")).alias("r")).orderBy("i").collect()]
    assert got == [None, "title:just a moment", "http_403", "ray id", None]


def copy(page, attempt, channel, state, posts=None, reason=None, late=0):
    return ("s", page, attempt, channel, state, reason, posts, NOON + timedelta(minutes=late))


def test_attempts(spark):
    copies = [
        copy(0, 0, "http", "failed", reason="x"), copy(0, 1, "http", "read", ["a"]), copy(0, 2, "http", "blocked", reason="late"),
        copy(1, 0, "http", "read", []), copy(1, 0, "rendered", "read", ["r"]),
        copy(2, 0, "http", "read", []), copy(2, 0, "rendered", "blocked", reason="b"),
        copy(3, 0, "http", "failed", reason="1"), copy(3, 1, "http", "failed", reason="2"), copy(3, 1, "rendered", "read", ["unused"]),
        copy(4, 0, "http", "read", []),
        copy(5, 0, "http", "read", ["old"]), copy(5, 0, "http", "read", ["new"], late=5),
        copy(6, 3, "http", "read", ["too late"]), copy(6, 0, "http", "failed", reason="f"),
    ]
    schema = "source_id string, page_index int, attempt int, channel string, state string, reason string, postings array<string>, fetched_at timestamp"
    got = {r["page_index"]: (r["outcome"], r["reason"], r["postings"]) for r in pg.resolve_attempts(spark.createDataFrame(copies, schema)).collect()}
    assert got == {
        0: ("done", None, ["a"]), 1: ("done", None, ["r"]), 2: ("blocked", "b", None), 3: ("failed", "2", None),
        4: ("done", None, []), 5: ("done", None, ["new"]), 6: ("failed", "f", None),
    }


def test_page_policy(spark):
    outcomes = [("a", 0, "done"), ("a", 1, "failed"), ("a", 2, "done"), ("a", 3, "blocked"), ("a", 4, "done"), ("b", 0, "blocked"), ("b", 1, "done"), ("c", 0, "failed"), ("e", 0, "done")]
    rows = spark.createDataFrame([(*o, "why", [f"{o[0]}{o[1]}"]) for o in outcomes], "source_id string, page_index int, outcome string, reason string, postings array<string>")
    sources = spark.createDataFrame([(s, "lever") for s in "abcd"] + [("e", "odd")], "source_id string, parser_type string")
    ends = pg.source_outcomes(rows, sources)
    assert {r["source_id"]: r["error"] for r in ends.collect()} == {
        "a": None, "b": "blocked by anti-bot policy: why", "c": "fetch failed for c: why", "d": "fetch failed for d: no landed page", "e": "Unknown parser type: odd",
    }
    kept = pg.usable_pages(rows, ends)
    assert sorted((r["source_id"], r["page_index"]) for r in kept.collect()) == [("a", 0), ("a", 2)]


def test_status_rule(spark):
    rows = spark.createDataFrame([(403, "x", None), (200, "x", "timeout"), (200, "unusual traffic", None), (None, "x", None)], "status_code int, content string, error string")
    states = lambda **kw: [(r["state"], r["reason"]) for r in pg.classify_copies(rows, **kw).collect()]
    assert states() == [("failed", "HTTP status 403"), ("failed", "timeout"), ("blocked", "unusual traffic"), ("read", None)]
    assert states(status_errors=False)[0] == ("blocked", "http_403")


def test_copies_of_runs_are_those_each_run_would_read(spark):
    import random

    draw = random.Random(3)
    rows = [
        ("s", draw.randrange(6), "u", draw.randrange(3), draw.choice(("http", "rendered")), 200, f"c{i}", None, NOON + timedelta(minutes=30 * draw.randrange(20)))
        for i in range(150)
    ]
    fetches = spark.createDataFrame(rows, pg.PAGE_FETCHES).cache()
    got = sorted((r["run"], r["page_index"], r["content"]) for r in pg.copies_of_runs(fetches, F.lit(NOON), 8, ["content"]).collect())
    want = []
    for run in range(8):
        seen = pg.current_copies(fetches, F.lit(NOON + timedelta(hours=run))).collect()
        want += [(run, r["page_index"], r["content"]) for r in seen]
    assert got == sorted(want) and len(want) > 150
