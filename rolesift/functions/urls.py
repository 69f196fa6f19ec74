"""URL expressions: canonical form, joining, query edits, path tails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesift.functions.text import blank_to_null, let

# scheme, authority, path, query, fragment (RFC 3986, appendix B)
_PARTS = r"^(?:([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(?:#(.*))?$"

# fixed values: query parameters that only track the visitor
TRACKING_PREFIX = "utm_"
TRACKING_PARAMS = ["gh_src", "lever-source", "source", "tracking"]


def _tidy(url: Column) -> Column:
    """Ends trimmed; tab and line ends are never part of a URL."""
    return F.regexp_replace(F.trim(url), r"[\t\r\n]", "")


def split_url(url: Column) -> Column:
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    return F.struct(
        F.lower(part(1)).alias("scheme"),
        part(3).alias("authority"),
        part(4).alias("path"),
        part(6).alias("query"),
        part(7).alias("fragment"),
    )


def _decode(c: Column) -> Column:
    # a lone percent sign stays a percent sign
    return F.try_url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(c: Column) -> Column:
    return F.replace(
        F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def query_pairs(query: Column) -> Column:
    """Decoded ``ARRAY<STRUCT<k, v>>``; blank values kept, blank pairs dropped."""
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            F.when(
                F.contains(p, F.lit("=")), _decode(F.regexp_replace(p, r"^[^=]*=", ""))
            ).otherwise("").alias("v"),
        ),
    )


def encode_pairs(pairs: Column) -> Column:
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&"
    )


def join_parts(scheme: Column, authority: Column, path: Column, query: Column, fragment: Column | None = None) -> Column:
    out = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(""),
        F.when((authority != "") & (path != "") & ~F.startswith(path, F.lit("/")), F.lit("/")).otherwise(""),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    if fragment is None:
        return out
    return F.concat(out, F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no trailing '/', tracking parameters or fragment."""

    def wanted(p: Column) -> Column:
        key = F.lower(p["k"])
        return ~F.startswith(key, F.lit(TRACKING_PREFIX)) & ~key.isin(TRACKING_PARAMS)

    tidy = _tidy(url)
    part = lambda i: F.regexp_extract(tidy, _PARTS, i)
    query = part(6)
    kept = F.when(query == "", F.lit("")).otherwise(encode_pairs(F.filter(query_pairs(query), wanted)))
    return join_parts(F.lower(part(1)), F.lower(part(3)), F.regexp_replace(part(4), r"/+$", ""), kept)


def _fold_dots(path: Column) -> Column:
    """Dot segments removed; a path ending in one keeps its last '/'."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    stack = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    closed = F.when(last.isin(".", ".."), F.concat(stack, F.array(F.lit("")))).otherwise(stack)
    return F.array_join(closed, "/")


def join_url(base: Column, href: Column) -> Column:
    """``href`` resolved against ``base``; a blank href stays ''."""

    def resolve(both: Column) -> Column:
        b, r = both["b"], both["r"]
        folder = F.regexp_extract(b["path"], r"^(.*/)?[^/]*$", 1)
        merged = F.when(F.startswith(r["path"], F.lit("/")), r["path"]).otherwise(
            # empty segments inside a merged path are closed up
            F.regexp_replace(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), r["path"]), r"(?<=.)//+", "/")
        )
        path = F.when(merged.rlike(r"(^|/)\.\.?(/|$)"), _fold_dots(merged)).otherwise(merged)
        same = (r["scheme"] == "") | (r["scheme"] == b["scheme"])
        return (
            F.when(~same, both["href"])
            .when(r["authority"] != "", join_parts(b["scheme"], r["authority"], r["path"], r["query"], r["fragment"]))
            .when(
                r["path"] == "",
                join_parts(
                    b["scheme"], b["authority"], b["path"],
                    F.when(r["query"] != "", r["query"]).otherwise(b["query"]), r["fragment"],
                ),
            )
            .otherwise(join_parts(b["scheme"], b["authority"], path, r["query"], r["fragment"]))
        )

    tidy = _tidy(href)
    parsed = F.struct(split_url(_tidy(base)).alias("b"), split_url(tidy).alias("r"), tidy.alias("href"))
    return F.when(F.coalesce(tidy, F.lit("")) == "", F.lit("")).otherwise(let(parsed, resolve))


def set_query_params(url: Column, params: list[tuple[Column, Column]]) -> Column:
    """Set parameters; a repeated key keeps its first place and its last value."""

    def last_value(pairs: Column, key: Column) -> Column:
        return F.element_at(F.filter(pairs, lambda p: p["k"] == key), -1)["v"]

    added = F.array(*[F.struct(k.alias("k"), v.alias("v")) for k, v in params])

    def build(u: Column) -> Column:
        def collapsed(pairs: Column) -> Column:
            keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
            return F.transform(keys, lambda k: F.struct(k.alias("k"), last_value(pairs, k).alias("v")))

        query = let(F.concat(query_pairs(u["query"]), added), lambda pairs: encode_pairs(collapsed(pairs)))
        return join_parts(u["scheme"], u["authority"], u["path"], query, u["fragment"])

    return let(split_url(_tidy(url)), build)


def url_tail(url: Column) -> Column:
    """Last non-empty '/' segment, null when there is none."""
    return blank_to_null(F.regexp_extract(url, r"([^/]+)/*$", 1))


def long_number(url: Column) -> Column:
    """First run of four or more digits, else null."""
    return blank_to_null(F.regexp_extract(url, r"(\d{4,})", 1))


def number_after_second_segment(url: Column) -> Column:
    """Digits closing the URL after two path segments, else null."""
    return blank_to_null(F.regexp_extract(url, r"/[^/]+/[^/]+/(\d+)/*$", 1))
