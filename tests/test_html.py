import pyarrow as pa

from rolesift.operators.html_nodes import _parse_pages, compile_selector, read_elements


def tags(html):
    return [(e["tag"], e["parent"], e["text"]) for e in read_elements(html, {}, True)]


def test_unclosed_paragraphs_and_void_tags():
    assert tags("<div><p>one<br>two<p>three<img></div>four") == [
        ("div", -1, "one two three"), ("p", 0, "one two"), ("br", 1, ""), ("p", 0, "three"), ("img", 3, ""),
    ]
    assert [t for t, _, _ in tags("<ul><li>a<ul><li>b</ul><li>c</ul>")] == ["ul", "li", "ul", "li", "li"]
    assert [p for _, p, _ in tags("<ul><li>a<ul><li>b</ul><li>c</ul>")] == [-1, 0, 1, 2, 0]


def test_script_text_is_no_text():
    rows = read_elements("<body>a<script>var x = '</p>';</script>b</body>", {}, True)
    assert rows[0]["text"] == "a b" and rows[1]["raw"] == "var x = '</p>';" and rows[1]["text"] is None


def test_entities_are_resolved_twice():
    row = read_elements("<a href='/x?a=1&amp;b=2'>R&amp;amp;D&nbsp; x</a>", {}, False)[0]
    assert row["text"] == "R&D x" and dict(row["attrs"])["href"] == "/x?a=1&b=2"


def hits(html, selector):
    return [e["id"] for e in read_elements(html, {"r": selector}, True) if "r" in e["roles"]]


def test_selectors():
    page = "<main><div class='a b' id=x><p>1</p><p data-k='v-1'>2</p></div><a href='/en/jobs/1'><b>t</b></a></main>"
    # ids: main 0, div 1, p 2, p 3, a 4, b 5
    assert hits(page, ".a.b > p") == [2, 3]
    assert hits(page, "main p:nth-of-type(2)") == [3]
    assert hits(page, "#x, a[href^=\"/en/jobs/\"] b") == [1, 5]
    assert hits(page, "[data-k]") == [3] and hits(page, "p[data-k*='-']") == [3] and hits(page, "[data-k=v-1]") == [3]
    assert hits(page, "main > p") == [] and hits(page, "div > div:nth-of-type(3) p") == []
    assert hits(page, "*[href$='1']") == [4] and hits(page, "[class~=b]") == [1]
    assert compile_selector("a:hover") is None and compile_selector("") is None and hits(page, "a:hover") == []


def test_positions_siblings_and_negation():
    page = "<ul><li class=k>0<li>1<li class=k>2<li>3</ul><p></p><p lang='en-GB'>x</p><b>y</b>"
    # ids: ul 0, li 1-4, p 5 6, b 7
    assert hits(page, "li:nth-child(odd)") == [1, 3] and hits(page, "li:nth-child(2n)") == [2, 4] and hits(page, "li:nth-child(-n+2)") == [1, 2]
    assert hits(page, "li:first-child, li:last-child") == [1, 4] and hits(page, "li:nth-last-child(2)") == [3]
    assert hits(page, "li:not(.k)") == [2, 4] and hits(page, ":not(li):not(ul)") == [5, 6, 7] and hits(page, "li:not(:first-child, .k)") == [2, 4]
    assert hits(page, "li.k + li") == [2, 4] and hits(page, "li.k ~ li") == [2, 3, 4] and hits(page, "ul ~ p") == [5, 6] and hits(page, "p+b") == [7]
    assert hits(page, "p:empty") == [5] and hits(page, "[lang|=en]") == [6] and hits(page, ":is(p, b):last-of-type") == [6, 7] and hits(page, "b:only-of-type") == [7]
    assert compile_selector("a::before") is None and compile_selector("li:not(") is None and compile_selector("a:has(b)") is None


def test_a_batch_of_pages_is_walked_in_slices():
    pages = ["<p>%d %s</p>" % (i, "x" * 3000) for i in range(2000)] + [None]
    got = list(_parse_pages(iter([(pa.array(pages), pa.nulls(2001, pa.map_(pa.string(), pa.string())))]), True))
    assert len(got) > 4 and max(a.nbytes for a in got) < 5 << 20
    whole = [page for a in got for page in a.to_pylist()]
    assert [p and int(p[0]["text"].split()[0]) for p in whole] == [*range(2000), None]
