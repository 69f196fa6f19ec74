"""Pages to element rows, with the CSS selectors each element answers to.

The only per-page Python of the library: an Arrow UDF walks each page once with
the standard HTML tokenizer. A page is one value and is never split; a batch is taken
in slices, so memory is bounded by one Arrow batch of pages
(``spark.sql.execution.arrow.maxBytesPerBatch``) and the elements of one slice or page.
All choices made on top of the elements are Column expressions.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rolesift.functions.slices import in_slices

ELEMENT = T.StructType(
    [
        T.StructField("id", T.IntegerType()),  # document order
        T.StructField("parent", T.IntegerType()),  # -1 at the top
        T.StructField("last", T.IntegerType()),  # id of the last element inside this one
        T.StructField("depth", T.IntegerType()),
        T.StructField("nth_of_type", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("roles", T.ArrayType(T.StringType())),
        T.StructField("own_text", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("raw", T.StringType()),
        # of elements with a role and the parents of postings: where the parent stands in the array, and
        # which of the elements of each role (and of LINKS) lie inside, as a stretch of those in order
        T.StructField("up", T.IntegerType()),
        T.StructField(
            "inside",
            T.MapType(
                T.StringType(),
                T.StructType([T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())]),
            ),
        ),
    ]
)
ELEMENTS = T.ArrayType(ELEMENT)
# the name under which ``inside`` counts links
LINKS = "a[href]"

# fixed values of the HTML standard
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN_TEXT = frozenset("script style template".split())
_BLOCK = frozenset(
    "address article aside blockquote details dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
# an opening tag ends these open siblings, looking no further out than the barrier
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr"}, {"table"}),
}
_P_BARRIER = _BLOCK - {"p"} | {"td", "th", "li", "dd", "dt", "body", "html"}


class _Element:
    __slots__ = ("id", "parent", "last", "depth", "nth", "child", "tag", "attrs", "own", "texts")

    def __init__(self, id, parent, depth, nth, tag, attrs):
        self.id, self.parent, self.last, self.depth, self.nth = id, parent, id, depth, nth
        self.tag, self.attrs, self.own, self.texts = tag, attrs, [], (0, 0)


class _Walker(HTMLParser):
    """Flat list of elements in document order plus the page's text pieces."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[_Element] = []
        self.pieces: list[str] = []
        self.open: list[_Element] = []
        self.seen: dict[tuple[int, str], int] = {}
        self.children: dict[int, list[int]] = {}

    def _leave(self, depth: int) -> None:
        for element in self.open[depth:]:
            element.last = len(self.elements) - 1
            element.texts = (element.texts[0], len(self.pieces))
        del self.open[depth:]

    def _end_open(self, tags, barrier) -> None:
        outermost = None
        for i in range(len(self.open) - 1, -1, -1):
            tag = self.open[i].tag
            if tag in tags:
                outermost = i
            elif tag in barrier:
                break
        if outermost is not None:
            self._leave(outermost)

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS:
            self._end_open(*_ENDS[tag])
        elif tag in _BLOCK:
            self._end_open({"p"}, _P_BARRIER)
        parent = self.open[-1] if self.open else None
        where = (parent.id if parent else -1, tag)
        nth = self.seen[where] = self.seen.get(where, 0) + 1
        known: dict[str, str] = {}
        for name, value in attrs:
            known.setdefault(name, value or "")
        element = _Element(len(self.elements), where[0], len(self.open), nth, tag, known)
        element.texts = (len(self.pieces), len(self.pieces))
        siblings = self.children.setdefault(where[0], [])
        siblings.append(element.id)
        element.child = len(siblings)
        self.elements.append(element)
        if tag not in _VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # '/>' only closes void elements in HTML

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                self._leave(i)
                return

    def handle_data(self, data):
        if self.open:
            self.open[-1].own.append(data)
        piece = data.strip()
        if piece and not any(e.tag in _HIDDEN_TEXT for e in self.open):
            self.pieces.append(piece)

    def walk(self, content: str) -> None:
        self.feed(content)
        self.close()
        self._leave(0)


# --------------------------------------------------------------------------
# selectors: tag, *, .class, #id, [attr], [attr=v] and ^= *= $= ~= |=, positions among
# siblings, :empty, :not(), :is(); descendant, child and sibling steps, comma lists

_ATOM = re.compile(
    r"""\s*(?P<comb>[>,+~])\s*|(?P<space>\s+)|(?P<tag>\*|[a-zA-Z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)
    |\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[\^*$~|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]
    |:(?P<side>nth|nth-last)-(?P<among>child|of-type)\(\s*(?P<nth>odd|even|[+-]?\d+|[+-]?\d*n(?:\s*[+-]\s*\d+)?)\s*\)
    |:(?P<end>first|last|only)-(?P<kind>child|of-type)|:(?P<empty>empty)
    |:(?P<group>not|is|where)\(\s*(?P<inner>(?:[^()]|\([^()]*\))*)\)""",
    re.VERBOSE,
)
_COMPARE = {
    "=": lambda have, want: have == want,
    "^=": lambda have, want: bool(want) and have.startswith(want),
    "*=": lambda have, want: bool(want) and want in have,
    "$=": lambda have, want: bool(want) and have.endswith(want),
    "~=": lambda have, want: want in have.split(),
    "|=": lambda have, want: have == want or have.startswith(want + "-"),
}


def _formula(text: str) -> tuple[int, int]:
    """``an+b`` as (a, b)."""
    text = {"odd": "2n+1", "even": "2n"}.get(text, re.sub(r"\s", "", text))
    if "n" not in text:
        return 0, int(text)
    a, b = text.split("n")
    return int({"": "1", "+": "1", "-": "-1"}.get(a, a)), int(b or 0)


def compile_selector(selector: str):
    """Alternatives, each a list of (combinator, tests) from left to right.

    None when the selector uses anything outside the supported forms.
    """
    alternatives, steps, tests, link = [], [], [], " "
    pos, text = 0, selector.strip()
    while pos < len(text):
        m = _ATOM.match(text, pos)
        if m is None:
            return None
        pos = m.end()
        if m["comb"] or m["space"]:
            if tests:
                steps.append((link, tests))
            elif m["comb"]:
                return None
            tests, link = [], m["comb"] or " "
            if link == ",":
                alternatives.append(steps)
                steps, link = [], " "
        elif m["tag"]:
            tests.append(("tag", m["tag"].lower(), None, None))
        elif m["cls"]:
            tests.append(("attr", "class", "~=", m["cls"]))
        elif m["id"]:
            tests.append(("attr", "id", "=", m["id"]))
        elif m["attr"]:
            want = next((m[g] for g in ("dq", "sq", "bare") if m[g] is not None), None)
            tests.append(("attr", m["attr"].lower(), m["op"], want))
        elif m["nth"]:
            tests.append(("nth", m["among"], m["side"] == "nth-last", _formula(m["nth"])))
        elif m["end"]:
            ends = {"first": (False,), "last": (True,), "only": (False, True)}[m["end"]]
            tests += [("nth", m["kind"], from_end, (0, 1)) for from_end in ends]
        elif m["empty"]:
            tests.append(("empty", None, None, None))
        else:
            inner = compile_selector(m["inner"])
            if inner is None:
                return None
            tests.append(("group", m["group"] == "not", None, inner))
    if not tests:
        return None
    return [*alternatives, [*steps, (link, tests)]]


def _position(walker: _Walker, element: _Element, among: str, from_end: bool) -> int:
    if not from_end:
        return element.child if among == "child" else element.nth
    later = walker.children[element.parent][element.child :]
    return 1 + sum(among == "child" or walker.elements[i].tag == element.tag for i in later)


def _answers(walker: _Walker, element: _Element, tests) -> bool:
    for what, name, op, want in tests:
        if what == "tag":
            if name != "*" and element.tag != name:
                return False
        elif what == "nth":
            a, b = want
            off = _position(walker, element, name, op) - b
            if off != 0 if a == 0 else off % a or off // a < 0:
                return False
        elif what == "empty":
            if walker.children.get(element.id) or "".join(element.own):
                return False
        elif what == "group":
            if any(_selected(walker, element, s, len(s) - 1) for s in want) == name:
                return False
        else:
            have = element.attrs.get(name)
            if have is None or (op and not _COMPARE[op](have, want)):
                return False
    return True


def _selected(walker: _Walker, element: _Element, steps, at: int) -> bool:
    link, tests = steps[at]
    if not _answers(walker, element, tests):
        return False
    if at == 0:
        return True
    if link in "+~":
        first = max(0, element.child - 2) if link == "+" else 0
        before = walker.children[element.parent][first : element.child - 1]
        return any(_selected(walker, walker.elements[i], steps, at - 1) for i in before)
    parent = element.parent
    while parent >= 0:
        if _selected(walker, walker.elements[parent], steps, at - 1):
            return True
        if link == ">":
            return False
        parent = walker.elements[parent].parent
    return False


def _squeeze(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def plain_json(text: str) -> str | None:
    """A JSON text as Spark reads it: of repeated keys the last, no NaN; null when it is not JSON."""
    try:
        return json.dumps(json.loads(text, parse_constant=lambda _: None), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


def _graph_members(value) -> list:
    """The objects of linked data in order, ``@graph`` lists expanded in place to any depth."""
    out, todo = [], list(reversed(value if isinstance(value, list) else [value]))
    while todo:
        one = todo.pop()
        if isinstance(one, dict):
            kinds = one.get("@type")
            kinds = kinds if isinstance(kinds, list) else [kinds]
            if isinstance(one.get("@graph"), list) and not any(str(k).lower() == "jobposting" for k in kinds):
                todo.extend(reversed(one["@graph"]))
                continue
        out.append(one)
    return out


def _unescaped_json(raw: str) -> str:
    """Script data with the entities of its strings resolved and ``@graph`` lists expanded; other text as it is."""
    start, end = min((i for i in (raw.find("{"), raw.find("[")) if i >= 0), default=-1), max(raw.rfind("}"), raw.rfind("]"))
    if start < 0:
        return raw

    def resolve(value):
        if isinstance(value, str):
            return _squeeze(value)
        if isinstance(value, list):
            return [resolve(v) for v in value]
        if isinstance(value, dict):
            return {k: resolve(v) for k, v in value.items()}
        return value

    try:
        value = json.loads(raw[start : end + 1], parse_constant=lambda _: None)
        return json.dumps(resolve(_graph_members(value) if '"@graph"' in raw else value), ensure_ascii=False)
    except (ValueError, RecursionError):
        return raw


def read_elements(content: str, selectors: dict[str, str], keep_all: bool, compiled: dict | None = None) -> list[dict]:
    """Elements of one page: all, or those a later step can ask for.

    Without ``keep_all`` these are links, data scripts, elements answering a
    selector, and the parents of elements in role ``posting``. Text and
    attributes come with entities resolved once more than the page wrote them,
    as postings are compared after a second unescape.
    """
    walker = _Walker()
    walker.walk(content)
    elements = walker.elements
    compiled = {} if compiled is None else compiled
    wanted = []
    for role, selector in selectors.items():
        if selector not in compiled:
            compiled[selector] = compile_selector(selector or "")
        wanted.append((role, compiled[selector]))
    roles: dict[int, list[str]] = {}
    parents: set[int] = set()
    for element in elements:
        for role, alternatives in wanted:
            if alternatives and any(_selected(walker, element, s, len(s) - 1) for s in alternatives):
                roles.setdefault(element.id, []).append(role)
                if role == "posting" and element.parent >= 0:
                    parents.add(element.parent)
    out = []
    for e in elements:
        script = e.tag == "script"
        raw = "".join(e.own) if script else None
        data_script = script and (e.attrs.get("type") == "application/ld+json" or "jobPostings" in raw)
        link = e.tag == "a" and "href" in e.attrs
        if not (keep_all or link or data_script or e.id in roles or e.id in parents):
            continue
        pieces = [raw.strip()] if script else walker.pieces[e.texts[0] : e.texts[1]]
        out.append(
            {
                "id": e.id,
                "parent": e.parent,
                "last": e.last,
                "depth": e.depth,
                "nth_of_type": e.nth,
                "tag": e.tag,
                "attrs": [(k, _squeeze(v)) for k, v in e.attrs.items()],
                "roles": roles.get(e.id, []),
                "own_text": None if script else _squeeze(" ".join(" ".join(e.own).split())),
                "text": None if script else " ".join(_squeeze(" ".join(pieces)).split()),
                "raw": _unescaped_json(raw) if data_script else raw if keep_all else None,
            }
        )
    if not keep_all:
        _add_stretches(out, parents)
    return out


def _add_stretches(out: list[dict], parents: set[int]) -> None:
    """``up`` and ``inside``; elements inside another are a stretch of document order, so two searches find them."""
    ids = [e["id"] for e in out]
    of_role: dict[str, list[int]] = {}
    for e in out:
        for role in [*e["roles"], *([LINKS] if e["tag"] == "a" and any(k == "href" for k, _ in e["attrs"]) else [])]:
            of_role.setdefault(role, []).append(e["id"])
    for e in out:
        if e["roles"] or e["id"] in parents:
            at = bisect_left(ids, e["parent"])
            e["up"] = at if at < len(ids) and ids[at] == e["parent"] else None
            e["inside"] = []
            for role, members in of_role.items():
                start, end = bisect_right(members, e["id"]), bisect_right(members, e["last"])
                if end > start:
                    e["inside"].append((role, {"start": start, "n": end - start}))


def _parse_pages(batches: Iterator[tuple[pa.Array, pa.Array]], keep_all: bool) -> Iterator[pa.Array]:
    compiled: dict = {}  # the selectors of this task, each compiled once

    def parse(contents: list, selectors: list) -> list:
        return [None if c is None else read_elements(c, dict(s or ()), keep_all, compiled) for c, s in zip(contents, selectors)]

    return in_slices(batches, parse, to_arrow_type(ELEMENTS))


@F.arrow_udf(ELEMENTS)
def _reachable(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    return _parse_pages(batches, keep_all=False)


@F.arrow_udf(ELEMENTS)
def _everything(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    return _parse_pages(batches, keep_all=True)


@F.arrow_udf(T.StringType())
def readable_json(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """:func:`plain_json` of texts that Spark's own parser refuses."""
    return in_slices(batches, lambda texts: [None if t is None else plain_json(t) for t in texts], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def unsupported_selectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Of each list those selectors that use other than the supported forms."""
    odd = lambda some: [s for s in some if s and s.strip() and compile_selector(s) is None]
    return in_slices(batches, lambda lists: [None if some is None else odd(some) for some in lists], pa.list_(pa.string()))


def reachable_elements(content: Column, selectors: Column) -> Column:
    """Elements of a page that extraction can ask for, in document order."""
    return _reachable(content, selectors)


def html_nodes(pages: DataFrame, key: list[str], content: str = "content", selectors: Column | None = None) -> DataFrame:
    """One row per element, under the page's key columns."""
    roles = F.create_map().cast("map<string,string>") if selectors is None else selectors
    return (
        pages.select(*key, _everything(F.col(content), roles).alias("elements"))
        # outer, so that no filter on ``elements`` is inferred and the walk runs once
        .select(*key, F.explode_outer("elements").alias("e"))
        .filter(F.col("e").isNotNull())
        .select(*key, "e.*")
        .drop("up", "inside")
        .withColumnRenamed("id", "node_id")
        .withColumnRenamed("parent", "parent_id")
        .withColumnRenamed("last", "last_id")
    )
