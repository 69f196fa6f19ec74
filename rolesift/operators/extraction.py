"""Pages to postings.

A page stays one row until its postings are final: they are built as an array
by Column expressions and exploded once, so extraction never shuffles and a
source holding most pages is spread over tasks like any other. Documents (JSON,
linked data, embedded script data) meet in one raw shape, links and cards in
another; entities in JSON are resolved by an Arrow call fed only by pages whose
text holds '&'.

Input columns: the page key, ``content``, ``source_id``, ``careers_url``,
``parser_type``, ``selectors`` MAP, ``jobs_path``, ``url_base``, ``fields`` MAP
and ``job_url_template``.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rolesift.functions import urls
from rolesift.functions.slices import in_slices
from rolesift.functions.text import (
    blank_to_null,
    clean,
    fill_template,
    let,
    slugify,
    timestamp_of_text,
)
from rolesift.functions.variants import (
    at_path,
    elements,
    follow,
    identifier_of,
    is_array,
    is_object,
    joined,
    member,
    parse_document,
    path_steps,
    scalar_text,
    strict_json,
    text_of,
    truthy_text,
)
from rolesift.operators.html_nodes import LINKS, reachable_elements, readable_json
from rolesift.session import built_once

# fixed values: the page families
PARSER_TYPES = [
    "greenhouse", "lever", "workday", "generic_html", "generic_json",
    "smartrecruiters", "teamtailor", "workable",
]

# fixed values: which elements are postings and which tell their place
FAMILY_SELECTORS = {
    "greenhouse": {"posting": "a[href*='/jobs/'], a[href*='greenhouse.io']"},
    "lever": {"posting": "a[href*='jobs.lever.co'], a[href*='lever.co']"},
    "workday": {"posting": "a[href*='workdayjobs.com'], a[href*='/job/']"},
    "smartrecruiters": {"posting": "a[href*='smartrecruiters.com'], a[href*='/job/']"},
    "teamtailor": {
        "posting": "a[href*='/jobs/'], a[data-job-url]",
        "location": "[data-job-location], .job-location, .location",
    },
    "workable": {
        "posting": "[data-ui='job'], .jobs li, .job",
        "location": ".location, [data-ui='job-location']",
    },
}
# fixed values: words that mark a link as a posting
POSTING_WORDS = "job|career|position|opening|role"
# fixed values: JSON fields a generic HTML source reads when it names none
DEFAULT_JSON_FIELDS = {
    "title": "title",
    "url": "url",
    "external_id": "id",
    "location": "location",
    "description": "description",
    "posted_at": "posted_at",
}

# One shape for a row found anywhere on a page, before clean-up. ``source`` tells
# where it was found: json, linked, script, card, link or keyword.
_FIELDS = ["source", "external_id", "url", "title", "location", "description", "posted_at", "slug"]
ROWS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in _FIELDS]))


@F.arrow_udf(ROWS)
def _unescape_rows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    def unescaped(pages: list) -> list:
        return [None if page is None else [{k: v and html.unescape(v) for k, v in row.items()} for row in page] for page in pages]

    return in_slices(batches, unescaped, to_arrow_type(ROWS))


def _row(source: str, **fields: Column) -> Column:
    named = {"source": F.lit(source), **fields}
    return F.struct(*[named.get(n, F.lit(None)).cast("string").alias(n) for n in _FIELDS])


def _none() -> Column:
    return F.array().cast(ROWS)


def _objects(items: Column) -> Column:
    return F.filter(F.coalesce(items, F.array().cast("array<variant>")), is_object)


# --------------------------------------------------------------------------
# first wins inside a page


def first_per_url(rows: Column, taken: Column | None = None) -> Column:
    """Rows with a title and a URL, the first of each URL, none in ``taken``; one sort, no scan for each row."""
    whole = F.filter(rows, lambda r: (r["title"] != "") & (r["url"] != ""))

    def entry(url: Column, place: Column) -> Column:
        return F.struct(url.alias("url"), place.cast("int").alias("place"))

    def keep(kept: Column) -> Column:
        # sorted by URL and place, a row is its URL's first when the one before has another;
        # URLs taken already stand at place -1, before all others
        entries = F.transform(kept, lambda r, i: entry(r["url"], i))
        if taken is not None:
            entries = F.concat(F.transform(F.coalesce(taken, F.array().cast("array<string>")), lambda u: entry(u, F.lit(-1))), entries)

        def firsts(ordered: Column) -> Column:
            return F.filter(
                ordered, lambda x, k: (x["place"] >= 0) & ((k == 0) | (F.get(ordered, k - 1)["url"] != x["url"]))
            )

        places = F.array_sort(F.transform(let(F.array_sort(entries), firsts), lambda x: x["place"]))
        return F.transform(places, lambda i: F.get(kept, i))

    return let(whole, keep)


# --------------------------------------------------------------------------
# JSON documents


def _place_fallback(item: Column) -> Column:
    """offices[], then locations[], then the parts of location."""

    def place(v: Column) -> Column:
        named = F.coalesce(*[blank_to_null(text_of(member(v, k))) for k in ("location", "name", "city")])
        return F.when(is_object(v), named).otherwise(F.trim(scalar_text(v)))

    offices = joined(F.transform(elements(member(item, "offices")), lambda v: F.trim(scalar_text(v))))
    places = joined(F.array_distinct(F.transform(elements(member(item, "locations")), place)))
    where = member(item, "location")
    parts = joined(F.array(*[F.trim(scalar_text(member(where, k))) for k in ("city", "region", "country")]))
    return F.coalesce(
        blank_to_null(offices), blank_to_null(places), blank_to_null(F.when(is_object(where), parts)), F.lit("")
    )


_TEXT_FIELDS = ["url", "title", "location", "description", "posted_at", "slug"]


def generic_json_rows(doc: Column, jobs_path: Column, paths: Column) -> Column:
    """Rows named by configured paths; ``paths`` holds :func:`path_steps` per field."""

    def rows(pairs: Column) -> Column:
        def row(item: Column) -> Column:
            # one expression reads all text fields
            def build(texts: Column) -> Column:
                named = {name: F.get(texts, F.lit(i)) for i, name in enumerate(_TEXT_FIELDS)}
                named["location"] = F.coalesce(blank_to_null(named["location"]), _place_fallback(item))
                found = follow(item, F.try_element_at(paths, F.lit("external_id")))
                return _row("json", external_id=identifier_of(found), **named)

            return let(F.transform(pairs, lambda pair: text_of(follow(item, pair))), build)

        return F.transform(_objects(elements(at_path(doc, F.trim(jobs_path)))), row)

    named = F.array(*map(F.lit, _TEXT_FIELDS))
    return let(F.transform(named, lambda name: F.try_element_at(paths, name)), rows)


def smartrecruiters_rows(doc: Column) -> Column:
    def row(item: Column) -> Column:
        get = lambda k: truthy_text(member(item, k))
        where, unit = member(item, "location"), member(item, "department")
        parts = [truthy_text(member(where, k)) for k in ("city", "region", "country")]
        parts.append(F.when(is_object(unit), truthy_text(member(unit, "label"))).otherwise(truthy_text(unit)))
        return _row(
            "json",
            external_id=get("id"),
            url=F.coalesce(get("ref"), get("jobAdUrl")),
            title=F.coalesce(get("name"), get("title")),
            location=joined(F.array(*parts)),
            description=scalar_text(member(member(item, "jobAd"), "sections")),
            posted_at=F.coalesce(get("releasedDate"), get("createdOn")),
        )

    return F.transform(_objects(F.coalesce(elements(member(doc, "content")), elements(member(doc, "jobs")))), row)


def teamtailor_rows(doc: Column) -> Column:
    def row(item: Column) -> Column:
        attr = lambda k: truthy_text(member(member(item, "attributes"), k))
        return _row(
            "json",
            external_id=truthy_text(member(item, "id")),
            url=F.coalesce(
                attr("human_status_url"), attr("url"), truthy_text(member(member(item, "links"), "careersite-job-url"))
            ),
            title=F.coalesce(attr("title"), truthy_text(member(item, "title"))),
            location=joined(F.array(attr("location"), attr("location_name"), attr("remote_status"))),
            description=F.coalesce(attr("body"), attr("description")),
            posted_at=F.coalesce(attr("created_at"), attr("published_at")),
        )

    return F.transform(_objects(elements(member(doc, "data"))), row)


def workable_rows(doc: Column) -> Column:
    def row(item: Column) -> Column:
        get = lambda k: truthy_text(member(item, k))
        where = member(item, "location")
        parts = joined(F.array(truthy_text(member(where, "city")), truthy_text(member(where, "country"))))
        return _row(
            "json",
            external_id=F.coalesce(get("id"), get("shortcode")),
            url=F.coalesce(get("url"), get("shortcode")),
            title=F.coalesce(get("title"), get("name")),
            location=F.when(is_object(where), parts).otherwise(truthy_text(where)),
            description=get("description"),
            posted_at=F.coalesce(get("published"), get("created_at")),
        )

    results = elements(member(doc, "results"))
    listed = F.when(F.size(results) > 0, results).when(
        truthy_text(member(doc, "results")).isNull(), elements(member(doc, "jobs"))
    )
    return F.transform(_objects(listed), row)


# --------------------------------------------------------------------------
# linked data and embedded script data


def linked_data_objects(scripts: Column) -> Column:
    """Every posting of the scripts in order; the walk of the page has expanded ``@graph`` lists."""
    parsed = F.filter(F.transform(scripts, strict_json), lambda v: v.isNotNull())
    objects = F.flatten(F.transform(parsed, lambda v: F.when(is_array(v), elements(v)).otherwise(F.array(v))))
    return F.filter(objects, lambda o: is_object(o) & is_job_posting(o))


def is_job_posting(o: Column) -> Column:
    """``@type`` is JobPosting, or a list holding it, in any case."""
    types = let(
        member(o, "@type"),
        lambda t: F.transform(F.coalesce(elements(t), F.array(t)), lambda x: F.lower(scalar_text(x))),
    )
    return F.coalesce(F.array_contains(types, "jobposting"), F.lit(False))


def _linked_place(v: Column) -> Column:
    """A string, or an address given as text or in four parts."""

    def from_address(a: Column) -> Column:
        keys = ("streetAddress", "addressLocality", "addressRegion", "addressCountry")
        parts = joined(F.array(*[truthy_text(member(a, k)) for k in keys]))
        return F.when(is_object(a), parts).when(F.schema_of_variant(a) == "STRING", scalar_text(a))

    address = F.coalesce(member(v, "address"), v)
    return clean(F.when(is_object(v), from_address(address)).when(F.schema_of_variant(v) == "STRING", scalar_text(v)))


def linked_data_rows(objects: Column) -> Column:
    def row(o: Column) -> Column:
        place = member(o, "jobLocation")
        places = F.transform(F.coalesce(elements(place), F.array(place)), _linked_place)
        named = joined(F.array_distinct(places))
        return _row(
            "linked",
            external_id=identifier_of(member(o, "identifier")),
            url=F.coalesce(truthy_text(member(o, "url")), F.col("careers_url")),
            title=scalar_text(member(o, "title")),
            location=F.coalesce(blank_to_null(named), scalar_text(member(o, "jobLocationType"))),
            description=scalar_text(member(o, "description")),
            posted_at=scalar_text(member(o, "datePosted")),
        )

    return F.transform(objects, row)


def workday_script_rows(scripts: Column) -> Column:
    """Rows of ``jobPostings`` inside scripts, read from first '{' to last '}'."""

    def items(script: Column) -> Column:
        doc = strict_json(F.regexp_extract(script, r"(?s)\{.*\}", 0))
        return F.coalesce(elements(member(doc, "jobPostings")), F.array().cast("array<variant>"))

    def row(item: Column) -> Column:
        text = lambda k: scalar_text(member(item, k))
        return _row(
            "script",
            external_id=truthy_text(F.try_variant_get(item, '$["bulletFields"][0]', "variant")),
            url=truthy_text(member(item, "externalPath")),
            title=text("title"),
            location=text("locationsText"),
            description=text("description"),
            posted_at=text("postedOn"),
        )

    holding = F.filter(scripts, lambda s: F.contains(s, F.lit("jobPostings")))
    return F.transform(_objects(F.flatten(F.transform(holding, items))), row)


# --------------------------------------------------------------------------
# links and cards


def _attr(node: Column, name: str) -> Column:
    return clean(F.try_element_at(node["attrs"], F.lit(name)))


def _has_role(node: Column, role: str) -> Column:
    return F.array_contains(node["roles"], role)


def _first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def _is_link(node: Column) -> Column:
    return (node["tag"] == "a") & F.map_contains_key(node["attrs"], "href")


def _by_role(nodes: Column, roles: list[str]) -> Column:
    """The elements of each role, and the links, in document order: what ``inside`` counts in."""

    def of(role: str) -> Column:
        return F.filter(nodes, lambda n: _has_role(n, role)).alias(role)

    return F.struct(*map(of, roles), F.filter(nodes, _is_link).alias(LINKS))


def _first_inside(lists: Column, outer: Column, role: str) -> Column:
    return F.get(lists[role], F.try_element_at(outer["inside"], F.lit(role))["start"])


def _all_inside(lists: Column, outer: Column, role: str) -> Column:
    def stretch(at: Column) -> Column:
        return F.slice(lists[role], F.coalesce(at["start"], F.lit(0)) + 1, F.coalesce(at["n"], F.lit(0)))

    return let(F.try_element_at(outer["inside"], F.lit(role)), stretch)


def family_link_rows(nodes: Column) -> Column:
    """Posting links of the six families, by the family's own rules."""
    family = F.col("parser_type")
    workable, teamtailor = family == "workable", family == "teamtailor"
    bare = family == "workday"

    def rows(lists: Column) -> Column:
        def gather(n: Column) -> Column:
            parent = F.get(nodes, n["up"])
            outer = F.when(workable, n).otherwise(parent)
            places = F.when(workable | teamtailor, F.transform(_all_inside(lists, outer, "location"), lambda m: m["text"]))
            return F.struct(
                n.alias("spot"), F.when(workable, _first_inside(lists, n, LINKS)).otherwise(n).alias("link"),
                parent.alias("parent"), clean(F.array_join(places, " ")).alias("places"),
            )

        return F.transform(F.transform(lists["posting"], gather), read)

    def read(g: Column) -> Column:
        spot, link, parent = g["spot"], g["link"], g["parent"]
        text = clean(link["text"])
        title = F.when(teamtailor, F.coalesce(blank_to_null(_attr(spot, "data-job-title")), text)).otherwise(text)
        href = F.coalesce(
            blank_to_null(_attr(link, "href")), F.when(teamtailor, blank_to_null(_attr(link, "data-job-url"))), F.lit("")
        )
        around = clean(parent["text"])
        beside = F.btrim(F.replace(around, title, F.lit("")), F.lit(" |,-"))
        place = (
            F.when(bare, F.lit(""))
            .when(workable, g["places"])
            .when(teamtailor, F.coalesce(blank_to_null(_attr(parent, "data-location")), g["places"]))
            .when(
                family == "smartrecruiters",
                F.coalesce(blank_to_null(_attr(parent, "data-location")), _attr(parent, "data-department")),
            )
            .otherwise(F.when((around != "") & (around != title), beside).otherwise(""))
        )
        return _row(
            "link",
            external_id=F.when(workable | teamtailor, _attr(spot, "data-job-id")),
            url=href,
            title=title,
            location=place,
            posted_at=F.when(workable | teamtailor, _attr(spot, "data-posted-at")),
        )

    return let(_by_role(nodes, ["posting", "location"]), rows)


def card_rows(nodes: Column) -> Column:
    """Postings of configured cards: each field by selector, else by attribute."""
    roles = ["title", "link", "location", "description", "posted_at", "external_id"]

    def rows(lists: Column) -> Column:
        def gather(card: Column) -> Column:
            found = [_first_inside(lists, card, r).alias(r) for r in roles]
            return F.struct(card.alias("card"), *found, _first_inside(lists, card, LINKS).alias("anchor"))

        return F.transform(F.transform(lists["job_card"], gather), read)

    def read(g: Column) -> Column:
        card = g["card"]
        text = lambda r: blank_to_null(clean(g[r]["text"]))
        title = F.coalesce(text("title"), blank_to_null(_attr(card, "title")), clean(card["text"]))
        href = F.coalesce(
            *[
                blank_to_null(_attr(node, name))
                for node, name in [
                    (g["link"], "href"), (card, "href"), (g["link"], "data-href"),
                    (g["link"], "data-url"), (g["anchor"], "href"),
                ]
            ],
            F.lit(""),
        )
        picked = F.coalesce(
            blank_to_null(_attr(g["external_id"], "data-id")), blank_to_null(_attr(g["external_id"], "id")), text("external_id")
        )
        carried = F.coalesce(*[blank_to_null(_attr(card, a)) for a in ("data-job-id", "data-id", "data-posting-id")])
        return _row(
            "card",
            external_id=F.when(g["external_id"].isNotNull(), picked).otherwise(carried),
            url=href,
            title=title,
            location=text("location"),
            description=text("description"),
            posted_at=text("posted_at"),
        )

    return let(_by_role(nodes, ["job_card", *roles]), rows)


def keyword_link_rows(nodes: Column) -> Column:
    """Every link; those without a posting word are dropped once joined."""
    return F.transform(
        F.filter(nodes, _is_link),
        lambda n: _row(
            "keyword",
            url=_attr(n, "href"),
            title=F.coalesce(blank_to_null(clean(n["text"])), _attr(n, "title")),
        ),
    )


# --------------------------------------------------------------------------
# the whole step


@built_once
def page_selectors() -> Column:
    """Role to selector: the family's own, or the source's for generic HTML."""
    out = F.when(F.col("parser_type") == "generic_html", F.col("selectors"))
    for family, roles in FAMILY_SELECTORS.items():
        pairs = [x for role, selector in roles.items() for x in (F.lit(role), F.lit(selector))]
        out = out.when(F.col("parser_type") == family, F.create_map(*pairs))
    return out


def _json_rows(doc: Column, families: tuple[str, ...]) -> Column:
    family = F.col("parser_type")
    readers = {
        "smartrecruiters": smartrecruiters_rows,
        "teamtailor": teamtailor_rows,
        "workable": workable_rows,
    }
    out = F.when(doc.isNull(), _none())
    if {"generic_json", "generic_html"} & set(families):
        generic = family.isin("generic_json", "generic_html")
        out = out.when(generic, generic_json_rows(doc, F.col("_jobs_path"), F.col("_paths")))
    for name in families:
        if name in readers:
            out = out.when(family == name, readers[name](doc))
    return out.otherwise(_none())


@built_once
def _document_and_paths() -> Column:
    """The parsed document and the paths to read from it."""
    family = F.col("parser_type")
    generic_html = family == "generic_html"
    own = F.coalesce(F.col("fields"), F.create_map().cast("map<string,string>"))
    defaults = F.create_map(*[F.lit(x) for kv in DEFAULT_JSON_FIELDS.items() for x in kv])
    merged = F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(own, k)), own)
    named = F.map_filter(F.when(generic_html, merged).otherwise(own), lambda _, v: F.coalesce(F.trim(v), F.lit("")) != "")
    tuned = F.col("job_url_template").isNotNull() | (F.size(own) > 0)
    listed = F.coalesce(F.col("jobs_path"), F.when(generic_html, "data").otherwise(""))
    readable = family.isin("generic_json", "generic_html", "smartrecruiters", "teamtailor", "workable")
    named_here = {
        "_doc": F.when(readable, parse_document(F.col("content"))),
        "_readable": readable,
        "_jobs_path": F.when(generic_html & ~tuned, "data").otherwise(listed),
        "_paths": F.transform_values(named, lambda _, v: path_steps(F.trim(v))),
    }
    return F.array(F.struct(*[c.alias(n) for n, c in named_here.items()]))


@built_once
def _json_of_page(families: tuple[str, ...]) -> Column:
    """The raw rows of the page's document, the one that Spark read or else the one written anew."""
    document = F.coalesce("_doc", strict_json(F.col("_anew")))
    return F.transform(F.array(document), lambda doc: F.struct(_json_rows(doc, families).alias("_json")))


def _computed_once(rows: DataFrame, kept: list[str], one_struct: Column) -> DataFrame:
    """Columns that leave through a one-row generator, so that later steps never copy their expressions."""
    return rows.select(*kept, F.inline(one_struct))


def _joined_rows() -> Column:
    """Title cleaned and URL made absolute, once for all rows of the page."""
    family = F.col("parser_type")
    base = F.when(
        family == "generic_json", F.coalesce(blank_to_null(F.trim("url_base")), F.col("careers_url"))
    ).otherwise(F.col("careers_url"))
    templated = family.isin("generic_json", "generic_html") & F.col("job_url_template").isNotNull()

    def build(r: Column) -> Column:
        def made(c: Column) -> Column:
            slug = F.coalesce(blank_to_null(clean(r["slug"])), slugify(c["title"]))
            return fill_template(F.col("job_url_template"), {"id": c["ext"], "slug": slug, "title": c["title"]})

        def whole(c: Column) -> Column:
            url = F.when(c["href"] != "", urls.join_url(base, c["href"])).when(templated & (r["source"] == "json"), made(c))
            return F.struct(
                r["source"].alias("source"), r["external_id"].alias("external_id"),
                F.coalesce(url, F.lit("")).alias("url"), c["title"].alias("title"),
                *[r[n].alias(n) for n in ("location", "description", "posted_at")],
            )

        cleaned = [clean(r["title"]).alias("title"), blank_to_null(clean(r["external_id"])).alias("ext"), clean(r["url"]).alias("href")]
        return let(F.struct(*cleaned), whole)

    return F.transform("_rows", build)


def _chosen_rows(rows: Column) -> Column:
    """JSON if it gave any; else linked data, then cards, links or keyword links.

    Linked-data rows stay as they are and only block later rows of their URLs.
    """
    generic_html = F.col("parser_type") == "generic_html"

    def of(*sources: str) -> Column:
        return F.filter(rows, lambda r: r["source"].isin(*sources))

    def speaks(r: Column) -> Column:
        return F.lower(F.concat_ws(" ", r["title"], r["url"])).rlike(POSTING_WORDS)

    def choose(linked: Column) -> Column:
        known = F.transform(linked, lambda r: r["url"])
        nothing = F.array().cast("array<string>")
        asked = [
            (of("json"), nothing),
            (of("script", "link"), known),
            (of("card"), known),
            (F.filter(of("keyword"), speaks), known),
        ]
        sets = F.transform(
            F.array(*[F.struct(some.alias("rows"), taken.alias("taken")) for some, taken in asked]),
            lambda s: first_per_url(s["rows"], s["taken"]),
        )
        return let(
            sets,
            lambda s: F.when(F.size(s[0]) > 0, s[0])
            .when(~generic_html, F.concat(linked, s[1]))
            .when(F.size(s[2]) > 0, F.concat(linked, s[2]))
            .otherwise(F.concat(linked, s[3])),
        )

    return let(F.filter(of("linked"), lambda r: r["title"] != ""), choose)


def extract_postings(pages: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Adds ``postings``, the array of a page's postings in page order; drops ``content``.

    ``families`` names the parser types that occur, which keeps the plan to
    those; pages of any other type give no postings. Location, description,
    time and id are still as found; :func:`explode_postings` cleans them.
    """
    families = tuple(f for f in PARSER_TYPES if families is None or f in families)
    family = F.col("parser_type")
    kept = [c for c in pages.columns if c != "content"]

    known = _computed_once(pages, pages.columns, _document_and_paths())
    # documents with repeated keys or NaN, which Spark refuses, are written anew first
    refused = F.col("_readable") & F.col("_doc").isNull() & F.col("content").rlike(r"^\s*[\[{]")
    known = known.withColumn("_anew", readable_json(F.when(refused, F.col("content"))))
    read = _computed_once(known, [*kept, "content"], _json_of_page(families))
    escaped = F.exists("_json", lambda r: F.contains(F.concat_ws(" ", *[r[n] for n in _FIELDS]), F.lit("&")))
    # a page whose JSON surely gives a posting needs no HTML walk
    settled = F.exists(
        "_json",
        lambda r: (F.trim(r["title"]) != "") & ~F.contains(r["title"], F.lit("&")) & (F.trim(r["url"]) != ""),
    )
    walk = family.isin([f for f in families if f != "generic_json"]) & ~F.coalesce(settled, F.lit(False))
    gated = read.withColumns({"_escaped": F.when(escaped, F.col("_json")), "_walk": walk})
    # the two Arrow calls stand side by side: neither is fed by the other
    plain = F.when(F.col("_escaped").isNull(), F.col("_json")).otherwise(_unescape_rows("_escaped"))
    if set(families) <= {"generic_json"}:
        found = gated.select(*kept, plain.alias("_rows"))
    else:
        nodes = reachable_elements(
            F.when(F.col("_walk"), F.col("content")), F.when(F.col("_walk"), page_selectors())
        )
        walked = gated.select(*kept, plain.alias("_json"), nodes.alias("_nodes"))
        found = walked.select(*kept, _walked_rows(families).alias("_rows"))
    return found.select(*kept, _postings().alias("postings"))


@built_once
def _postings() -> Column:
    return let(_joined_rows(), _chosen_rows)


@built_once
def _walked_rows(families: tuple[str, ...]) -> Column:
    """All raw rows of a page: those of its document and those of its elements."""
    family, nodes = F.col("parser_type"), F.col("_nodes")
    generic_html = family == "generic_html"
    scripts = F.filter(nodes, lambda n: n["tag"] == "script")
    linked = F.filter(scripts, lambda n: F.try_element_at(n["attrs"], F.lit("type")) == "application/ld+json")
    objects = linked_data_objects(F.transform(linked, lambda n: n["raw"]))
    parts = [F.when(F.size(linked) > 0, linked_data_rows(objects))]
    if "workday" in families:
        parts.append(F.when(family == "workday", workday_script_rows(F.transform(scripts, lambda n: n["raw"]))))
    if set(families) & set(FAMILY_SELECTORS):
        parts.append(F.when(~generic_html, family_link_rows(nodes)))
    if "generic_html" in families:
        parts.append(F.when(generic_html, card_rows(nodes)))
        parts.append(F.when(generic_html, keyword_link_rows(nodes)))
    return F.concat(F.col("_json"), *[F.coalesce(part, _none()) for part in parts])


@built_once
def _posting_columns() -> list[Column]:
    family, p, url = F.col("parser_type"), F.col("p"), F.col("p.url")
    source = F.col("p.source")
    given = blank_to_null(clean(F.col("p.external_id")))
    tailed = family.isin("teamtailor", "workable") | ((family == "lever") & (source == "link"))
    made = (
        F.when(source == "linked", F.lit(None).cast("string"))
        .when(tailed, urls.url_tail(url))
        .when((family == "greenhouse") & (source == "link"), urls.long_number(url))
        .when(family == "smartrecruiters", urls.number_after_second_segment(url))
    )
    return [
        F.coalesce(given, made).alias("external_id"),
        url.alias("url"),
        F.col("p.title").alias("title"),
        clean(p["location"]).alias("location"),
        clean(p["description"]).alias("description"),
        timestamp_of_text(clean(p["posted_at"])).alias("posted_at"),
    ]


def explode_postings(pages: DataFrame, key: list[str]) -> DataFrame:
    """One clean row per posting with its ordinal ``job_index`` in the page."""
    # the outer form keeps Spark from inferring a filter on ``postings`` and
    # pushing copies of its whole expression, Arrow calls included, below
    rows = pages.select(*dict.fromkeys([*key, "parser_type"]), F.posexplode_outer("postings").alias("job_index", "p"))
    return rows.filter(F.col("job_index").isNotNull()).select(*key, "job_index", *_posting_columns())
