"""URL cascades, WARC bundles, template leaks and licence joins."""

import hashlib
import io
import os

import pytest

from oracle import compare, duck
from rolesift.llm import license_join, template_leaks, url_cascade, warc_bundles
from rolesift.llm.catalog import CATALOG

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOG.items() if sql])
def test_sql_agrees(spark, name):
    ok, note = compare(spark, duck(SF), SF, name, *CATALOG[name])
    assert ok, note


PAGES = [
    (1, "http://a.Example.NET/en/1?x=/de/"), (2, "https://example.net/de/2"), (3, "http://www.example.com/de/3#a"),
    (4, "http://x.org/fr/"), (5, "http://x.org/fr"), (6, None), (7, "no scheme/de/"), (8, "http://best-bets.example.com/a"),
    (9, "http://net"), (10, "http://notexample.net/en/"), (11, "http://://x/en/"), (12, ""), (1, "http://example.net/en/1"),
]


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for rule, verdict in url_cascade.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    bad = bool(set(host.replace("-", ".").split(".")) & set(url_cascade.BAD_WORDS))
    return host, path, best and best[0], best[1] if best else "block" if bad else "allow"


@pytest.mark.parametrize("bits", [1 << 27, 64])
def test_urls(spark, monkeypatch, bits):
    monkeypatch.setattr(url_cascade, "MAX_BITS", bits)  # one shard, then several
    pages = spark.createDataFrame([(i, u, "x") for i, u in PAGES], "page_id long, url string, host string")
    rules = url_cascade.RULES
    got = url_cascade.judge(pages, rules, url_cascade.hosts_with_words(pages)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *by_hand(u)) for i, u in PAGES), key=repr)
    none = pages.limit(0)
    assert url_cascade.judge(none, rules, url_cascade.hosts_with_words(none)).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) AS key", "id")
    listed = universe.filter("id % 13 = 0")
    cascades = url_cascade.build(listed, universe)
    assert len(cascades[0].levels) > 2
    rows = universe.selectExpr("id", "array(xxhash64(key)) AS h1", "array(xxhash64(key, 7)) AS h2")
    assert url_cascade.probe(rows, cascades, "on").filter("on[0] != (id % 13 = 0)").count() == 0


def test_warc(spark, tmp_path):
    big, other = "<p>é</p>" * 200, "<b>x</b>" * 300
    pages = [(1, "http://a/", big), (2, "http://b/\r\n", big), (3, None, big), (4, "u", other), (5, "u", "small"), (6, "u", "small"),
             (7, "u", None), (8, "u", ""), (3, None, big), (None, "u", "\r\n\r\nx"), (9, "u", big + "z" * 900_000)]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, size int")
    folder = f"file://{tmp_path}"
    index = warc_bundles.write_bundles(frame, folder)
    got = warc_bundles.read_records(index, folder).drop("url").collect()
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        keep = 3 if html == big else i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if keep == i else "revisit", None if keep == i else keep))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    name = index.first()["bundle"]
    data = (tmp_path / name).read_bytes()
    import zstandard

    frames = warc_bundles.frame_places(io.BytesIO(data), len(data))
    for at, n in frames:
        assert zstandard.ZstdDecompressor().decompress(data[at : at + n]).startswith(b"WARC/1.1\r\n")
    # any reader takes the bundle as one stream
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == index.filter(index["bundle"] == name).count()
    nothing = warc_bundles.write_bundles(frame.limit(0), folder)
    assert warc_bundles.read_records(nothing, folder).count() == 0


ITEM = "A train leaves Berlin at 9 and covers 120 km in 2 hours while a second train from Paris covers 300 km in 5 hours, how fast is each"


def test_leaks(spark):
    own = ITEM.replace("120", "450").replace("Berlin", "Madrid").replace(" 2 ", " 3 ")
    torn = ITEM.replace("120 km", "450 km").replace("300 km", "450 km")  # one value for two slots
    rows = [(1, f"Some words before. {ITEM}. And after."), (2, own), (3, torn), (4, "nothing of the kind " * 30), (5, None), (6, ""),
            (7, " ".join(ITEM.split()[:17]) + " other words that go on"), (8, " ".join(ITEM.split()[:9]) + " no more"),
            (1, f"Some words before. {ITEM}. And after."), (9, "short one"), (None, ITEM)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "short one"), (5, ITEM)], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["exact"]) for r in template_leaks.find_leaks(docs, items).collect()), key=repr)
    want = [(i, k, i != 2) for i in (1, 1, 2, 7, None) for k in (1, 5)] + [(9, 4, True)]
    assert got == sorted(want, key=repr)
    kept = template_leaks.drop_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 8]
    assert template_leaks.find_leaks(docs, items.limit(0)).count() == 0
    assert template_leaks.find_leaks(docs.limit(0), items).count() == 0


def test_licences(spark):
    rows = [(1, "x\nReleased under the MIT license.\ny under THE mit, license"), (2, None), (3, ""),
            (4, "This work is licensed under the GNU General Public Licence, version 3"), (5, "cc by nc cc-by-nc"),
            (6, "released under a mit of license"), (1, "plain"), (None, "Apache License, Version 2")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, labels string")
    got = {(r["doc_id"], r["n_words"]): r for r in license_join.scan(docs).collect()}
    assert len(got) == len(rows)
    r = got[1, 11]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == (2, 2, 7, "mit", "mit")
    r = got[5, 6]
    assert (r["n_base"], r["first_word"], r["last_word"], r["labels"], r["score"]) == (2, 0, 3, "cc-by-nc", 1.0)
    assert got[4, 12]["labels"] == "gpl-3" and got[4, 12]["base_labels"] == "" and 0.9 < got[4, 12]["score"] < 1
    assert got[None, 4]["base_labels"] == "apache-2" and got[2, 0]["labels"] == "" and got[6, 6]["labels"] == ""
    assert license_join.scan(docs.limit(0)).count() == 0


def test_wrapped_notices(spark):
    mit = license_join.TEMPLATES[1][1]
    half, words = len(mit) // 2, mit.split()
    cut = mit.index(" ", half)
    long = "x" * 700
    rows = [(1, "a\n" + mit[:cut] + "\n" + mit[cut + 1 :] + "\nb"), (2, mit[:cut] + "\n" + long + "\n" + mit[cut + 1 :]),
            (3, "\n".join(words)), (4, "\n".join(words[i] + " " + words[i + 1] for i in range(0, len(words) - 1, 2))),
            (5, " ".join(words[::-1]) + long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_join.scan(docs).collect()}
    # blocks end after eight lines or 640 characters
    assert got == {1: "mit", 2: "", 3: "", 4: "", 5: "mit"}


def test_native_plans(spark):
    if os.path.isdir(SF):
        for name in ("op6_template_leaks", "op10_license_join"):
            plan = CATALOG[name][0](spark, SF)._jdf.queryExecution().toString()
            assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


PASSAGE = (
    "the river was measured in 2010 by a group of surveyors who walked along its northern bank from the old mill to the "
    "harbour and wrote down every depth they found, and once more in 2010 when the water had fallen below the lowest mark"
)


def test_copies_with_an_edited_mention(spark):
    at = PASSAGE.rindex("2010")
    one = PASSAGE[:at] + "2019" + PASSAGE[at + 4 :]
    docs = spark.createDataFrame([(1, one), (2, one.replace("surveyors", "Romans")), (3, PASSAGE)], "doc_id long, text string")
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    got = sorted((r["doc_id"], r["exact"]) for r in template_leaks.find_leaks(docs, items).collect())
    assert got == [(1, False), (2, False), (3, True)]
    assert template_leaks.drop_leaks(docs, items).count() == 0
    # half an item with one slot changed in both ways, and a gap word in the way of two windows
    torn = "Ann paid 3 coins to Bob while the miller counted 3 sacks"
    assert template_leaks.find_leaks(
        spark.createDataFrame([(1, torn.replace("3 sacks", "5 sacks"))], "doc_id long, text string"),
        spark.createDataFrame([(1, torn)], "item_id long, text string"),
    ).count() == 1


def test_changed_names_numbers_and_units(spark):
    items = [(1, "Tom has 5 apples in his basket. Tom buys 3 more at the market before he walks 12 miles home with them all."),
             (2, "A shop sells pens at 3 dollars for each box of ten and the school pays 450 dollars in all this year.")]
    other = items[0][1].replace("Tom", "Ann").replace("5", "7").replace("3", "1,200").replace("12 miles", "40 kilometers")
    docs = [
        (1, other),
        (2, items[1][1].replace("3 d", "2.5 d").replace("450", "1,375")),
        (3, other.replace("Ann buys", "Bob buys")),
    ]
    got = template_leaks.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).select("doc_id", "item_id", "exact").collect()
    # the third has two names for one
    assert sorted(map(tuple, got)) == [(1, 1, False), (2, 2, False)]
