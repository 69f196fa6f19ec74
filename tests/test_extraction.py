import json

import pytest

from rolesift.operators.extraction import explode_postings, extract_postings

SCHEMA = ("source_id string, careers_url string, parser_type string, selectors map<string,string>, jobs_path string, url_base string, "
          "fields map<string,string>, job_url_template string, content string")  # fmt: skip
LD = '<script type="application/ld+json">%s</script>'


def page(sid, family, content, url="https://example.com/careers", selectors=None, path=None, base=None, fields=None, template=None):
    return (sid, url, family, selectors, path, base, fields, template, content if content is None or isinstance(content, str) else json.dumps(content))


def graph(depth):
    inner = {"@type": ["Thing", "JobPosting"], "title": f"Depth {depth}", "url": f"/d/{depth}"}
    for _ in range(depth):
        inner = {"@graph": [inner, {"@type": "WebSite"}]}
    return inner


PAGES = [
    page("tins", "greenhouse", "<ul><li><a href='/tins/jobs/5550001'>Tinsmith <b>II</b></a><i>Oslo</i><li><a href=/tins/jobs/5550001?b=1#x>Twin</a>"
         "<li><a href='/tins/jobs/5550002'></a><li><a href='/tins/about'>About</a><li><a href='/tins/jobs/5550003'>Solderer</a></ul>", "https://boards.greenhouse.io/tins"),
    page("kiln", "lever", "<p><a href='https://jobs.lever.co/kiln/9f-1'>Potter</a> <span>Bergen</span><p><a href='https://jobs.lever.co/kiln/9f-2'>Glazer</a>"),
    page("dock", "workday", '<script>var x = {"jobPostings": [{"title": "Crane driver", "externalPath": "/job/c", "locationsText": "Rotterdam"}, {"title": "No path"}, '
         '{"title": "Rigger", "externalPath": "/job/r", "bulletFields": ["R-9"]}]};</script>'),
    page("moss", "generic_html", {"data": [{"id": 41, "title": "Forester (North & East)", "offices": ["Umea", "Lulea"]}, {"id": "42", "title": "Ranger"}]}, template="https://moss.test/{id}-{slug}"),
    page("reed", "generic_json", {"found": {"0": [{"nr": 7, "what": "Thatcher &amp; Roofer", "locations": [{"location": "Ghent"}, {"location": "Bruges"}], "u": "/o/7"}, {"what": "no address"}, 5]}},
         path="found.0", base="https://reed.test", fields={"title": "what", "url": "u", "external_id": "nr"}),
    page("salt", "smartrecruiters", '{"content": [{"id": "s-1", "id": "s-2", "name": "Saltworker", "ref": "https://salt.test/2", "pay": NaN, "releasedDate": "2025-11-02T08:00:00Z", '
         '"location": {"city": "Faro", "country": "Portugal"}, "department": {"label": "Pans"}}]}'),
    page("odd", "smartrecruiters", {"content": [{"id": "o", "name": "Odd one", "ref": "https://odd.test/1", "location": "Pisa", "department": "Floor"}]}),
    page("loom", "teamtailor", {"data": [{"id": "w1", "attributes": {"title": "Weaver", "location": "Turku", "human_status_url": "https://loom.test/w"}}, {"id": "w2", "attributes": {"title": "Dyer"}}]}),
    page("cork", "workable", {"results": [{"shortcode": "CK", "title": "Cutter", "url": "https://cork.test/c", "location": {"city": "Evora", "country": "Portugal"}}, {"id": "x"}]}),
    page("ld", "greenhouse", LD % json.dumps({"@graph": [graph(1), {"@type": "JobPosting", "title": "R &amp;amp; D", "url": "/jobs/71", "jobLocationType": "TELECOMMUTE"},
                                                         {"@type": "jobposting", "title": "Again", "url": "/jobs/71", "identifier": {"name": "k9"}}]})
         + "<p>Nice | <a href='/jobs/71'>Third</a></p><p>Nice | <a href='/jobs/72'>Fresh</a></p><p><a href='/jobs/72'>Twice</a></p>"),
    page("deep", "generic_html", "".join(LD % json.dumps(graph(d)) for d in range(1, 9))),
    page("card", "generic_html", "<section><a class='box' href='/jobs/c1'><h3>Cooper</h3><em>Jerez</em></a><a class='box' href='/jobs/c1'><h3>Twin</h3></a>"
         "<a class='box no' href='/jobs/c2'><h3>Not this</h3></a><a class='box' href='/jobs/c3'><h3>Stave maker</h3></a></section>",
         selectors={"job_card": "section > a.box:not(.no)", "title": "h3:first-child", "location": "h3 + em"}),
    page("kw", "generic_html", "<a href='/about'>About</a><a href='/jobs/1' title='Smith'></a><a href='/jobs/1'>dup</a><a href='/p'>One open position</a>", "https://kw.test/", selectors={"job_card": ".none"}),
    page("none", "mystery", "<a href='/jobs/1'>x</a>"),
    page("empty", "generic_html", ""),
    page("gone", "generic_html", None),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = explode_postings(extract_postings(spark.createDataFrame(PAGES, SCHEMA)), ["source_id"]).orderBy("source_id", "job_index").collect()
    out = {}
    for r in rows:
        out.setdefault(r["source_id"], []).append(r)
    return out


def short(rows):
    return [(r["external_id"], r["url"], r["title"], r["location"]) for r in rows]


def test_links_of_families(found):
    assert [r["title"] for r in found["tins"]][0] == "Tinsmith II" and [r["external_id"] for r in found["tins"]][-1] == "5550003"
    assert len({r["url"] for r in found["tins"]}) == len(found["tins"])
    assert [(r["external_id"], r["title"]) for r in found["kiln"]] == [("9f-1", "Potter"), ("9f-2", "Glazer")]
    assert short(found["dock"]) == [(None, "https://example.com/job/c", "Crane driver", "Rotterdam"), ("R-9", "https://example.com/job/r", "Rigger", "")]


def test_json_of_families(found):
    assert short(found["moss"]) == [("41", "https://moss.test/41-forester-north-east", "Forester (North & East)", "Umea, Lulea"), ("42", "https://moss.test/42-ranger", "Ranger", "")]
    assert short(found["reed"]) == [("7", "https://reed.test/o/7", "Thatcher & Roofer", "Ghent, Bruges")]
    # of a repeated key the last counts, NaN is nothing
    assert short(found["salt"]) == [("s-2", "https://salt.test/2", "Saltworker", "Faro, Portugal, Pans")]
    assert str(found["salt"][0]["posted_at"]) == "2025-11-02 08:00:00"
    assert short(found["loom"]) == [("w1", "https://loom.test/w", "Weaver", "Turku")]
    assert short(found["cork"]) == [("CK", "https://cork.test/c", "Cutter", "Evora, Portugal")]


def test_an_odd_shape_gives_blanks_for_its_row(found):
    assert short(found["odd"]) == [("o", "https://odd.test/1", "Odd one", "Floor")]


def test_linked_data_rows_stay_and_block_later_ones(found):
    assert short(found["ld"]) == [
        (None, "https://example.com/d/1", "Depth 1", ""),
        (None, "https://example.com/jobs/71", "R &amp; D", "TELECOMMUTE"),
        ("k9", "https://example.com/jobs/71", "Again", ""),
        (None, "https://example.com/jobs/72", "Fresh", "Nice"),
    ]


def test_graphs_of_any_depth(found):
    assert [r["title"] for r in found["deep"]] == [f"Depth {d}" for d in range(1, 9)]


def test_cards_before_keyword_links(found):
    assert short(found["card"]) == [(None, "https://example.com/jobs/c1", "Cooper", "Jerez"), (None, "https://example.com/jobs/c3", "Stave maker", "")]
    assert short(found["kw"]) == [(None, "https://kw.test/jobs/1", "Smith", ""), (None, "https://kw.test/p", "One open position", "")]


def test_nothing_from_unknown_or_empty_pages(found):
    assert not {"none", "empty", "gone"} & found.keys()


def test_only_named_families_are_read(spark):
    some = extract_postings(spark.createDataFrame(PAGES, SCHEMA), ["lever"])
    assert {r["source_id"] for r in explode_postings(some, ["source_id"]).collect()} == {"kiln"}


def test_a_page_of_many_cards_and_links(spark):
    """Fields stay with their card, nested cards see what is inside them, and a large page takes no square of time."""
    n = 5000
    cards = "".join(f"<div class=card><a class=t href='/j/{i}'>Job {i}</a><div class=card><i class=loc>Town {i}</i><a href='/k/{i}'>x</a></div></div>" for i in range(n))
    listed = "".join(f"<li><a href='/jobs/{i}' data-job-title='J{i}'>x</a><b class=location>P{i}</b><b class=location>Q</b></li>" for i in range(n))
    own = "".join(f"<div class=job>J{i} <a>no</a><a href='/w/{i}'>J{i}</a><i class=location>L{i}</i></div>" for i in range(n))
    pages = [
        page("cards", "generic_html", cards, selectors={"job_card": ".card", "title": ".t", "location": ".loc"}),
        page("team", "teamtailor", f"<ul>{listed}</ul>"), page("work", "workable", own),
    ]
    rows = explode_postings(extract_postings(spark.createDataFrame(pages, SCHEMA)), ["source_id"]).collect()
    got = {}
    for r in rows:
        got.setdefault(r["source_id"], []).append((r["job_index"], r["title"], r["url"].rsplit("/", 2)[1:], r["location"]))
    every = {k: sorted(v) for k, v in got.items()}
    inner = [(f"Job {i}", ["j", str(i)], f"Town {i}") for i in range(n)]
    assert [x[1:] for x in every["cards"]][::2] == inner and [x[1:] for x in every["cards"]][1] == ("Town 0 x", ["k", "0"], "Town 0")
    assert [x[1:] for x in every["team"]] == [(f"J{i}", ["jobs", str(i)], f"P{i} Q") for i in range(n)]
    assert [x[1:] for x in every["work"]] == [(f"J{i}", ["w", str(i)], f"L{i}") for i in range(n)]
