"""Text cleaning, HTML entities, timestamps and small string helpers."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift.functions.slices import in_slices

# Unicode white space plus the four ASCII separator controls that Java's
# White_Space property leaves out.
_SPACES = r"(?U)[\s\x1c-\x1f]+"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean(c: Column) -> Column:
    """Null becomes '', runs of white space become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _SPACES, " "))


@F.arrow_udf(T.StringType())
def _unescape(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return in_slices(batches, lambda texts: [None if t is None else html.unescape(t) for t in texts], pa.string())


def unescape(c: Column) -> Column:
    """HTML entities to characters. Only values holding '&' travel to Python."""
    return F.coalesce(_unescape(F.when(F.contains(c, F.lit("&")), c)), c)


def compact(c: Column) -> Column:
    """Unescape, then clean."""
    return clean(unescape(c))


def truncate_text(c: Column, max_chars: int = 3900) -> Column:
    # fixed value: the suffix of a shortened message
    suffix = "\n...(truncated)"
    return F.when(
        F.length(c) > max_chars,
        F.concat(F.substring(c, 1, max_chars - len(suffix)), F.lit(suffix)),
    ).otherwise(c)


def local_time_label(ts: Column, zone: str, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """A UTC instant as wall-clock text in ``zone``."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts), pattern)


def known_zone(zone: str) -> str:
    """``zone`` when it names a time zone, else UTC."""
    from zoneinfo import available_timezones

    return zone if zone in available_timezones() else "UTC"


def slugify(c: Column) -> Column:
    """Letters and digits kept in lower case, all else one '-'; never empty."""
    dashed = F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))
    return F.coalesce(blank_to_null(dashed), F.lit("job"))


# placeholders that stand for numbers, which are padded on the left
NUMBERS = ("page", "offset", "limit")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """``{name}`` placeholders replaced, with a fill and width as in ``{page:02d}``; ``{{`` and
    ``}}`` stand for braces. '' when any other brace is left or a number is asked of a text."""
    marked = F.replace(F.replace(template, F.lit("{{"), F.lit("\u0001")), F.lit("}}"), F.lit("\u0002"))
    spec = r"^\{(\w+)(?::([<>]?)(0?)(\d*)([ds]?))?\}$"

    def padded(t: Column) -> Column:
        value, side, zero, kind = t["value"], t["side"], t["zero"], t["kind"]
        width = F.greatest(F.coalesce(t["width"].try_cast("int"), F.lit(0)), F.length(value))
        left = (side == "<") | ((side == "") & (kind != "d") & (zero == "") & ~t["name"].isin(*NUMBERS))
        fill = F.when(zero == "0", "0").otherwise(" ")
        return F.when((kind != "d") | value.rlike(r"^-?\d+$"), F.when(left, F.rpad(value, width, fill)).otherwise(F.lpad(value, width, fill)))

    def fill(v: Column) -> Column:
        def part(token: Column) -> Column:
            name, side, zero, width, kind = (F.regexp_extract(token, spec, i) for i in range(1, 6))
            value = F.lit(None).cast("string")
            for one in values:
                value = F.when(name == one, v[one]).otherwise(value)
            named = F.struct(
                name.alias("name"), value.alias("value"), side.alias("side"), zero.alias("zero"), width.alias("width"), kind.alias("kind")
            )
            return F.when(~token.rlike(r"[{}]"), token).otherwise(let(named, padded))

        return F.transform(F.regexp_extract_all(marked, F.lit(r"\{[^{}]*\}|[^{}]+|[{}]"), F.lit(0)), part)

    def join(parts: Column) -> Column:
        filled = F.replace(F.replace(F.array_join(parts, ""), F.lit("\u0001"), F.lit("{")), F.lit("\u0002"), F.lit("}"))
        return F.when(F.exists(parts, lambda p: p.isNull()), F.lit("")).otherwise(filled)

    return let(let(F.struct(*[v.cast("string").alias(n) for n, v in values.items()]), fill), join)


def lenient_int(c: Column, default: int, minimum: int) -> Column:
    """Whole-number text to INT, anything else to ``default``, then clamped."""
    number = F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("int"))
    return F.greatest(F.coalesce(number, F.lit(default)), F.lit(minimum))


# --------------------------------------------------------------------------
# timestamps

# Accepted ISO shapes: YYYY-MM-DD or YYYYMMDD, optionally any one separator and
# HH[:MM[:SS[.fraction]]] (colons optional as a whole), optionally Z or +HH[:MM].
_ISO = (
    r"^(\d{4})(-?)(\d{2})\2(\d{2})"
    r"(?:.([01]\d|2[0-3])(?:(:?)([0-5]\d)(?:\6([0-5]\d)(?:[.,](\d{1,6})\d*)?)?)?"
    r"(?:Z|([+-])(\d{2})(?::?([0-5]\d))?)?)?$"
)
# Accepted mail-header shape: [Weekday,] D Month YYYY H:MM[:SS] [zone].
_MAIL = (
    r"(?i)^(?:[a-z]+[,.]?\s*)?(\d{1,2})[ -]"
    r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[ -](\d{4}|\d{2})\s+"
    r"([01]?\d|2[0-3]):([0-5]\d)(?::([0-5]\d))?(?:\s+(?:([+-])(\d{2})(\d{2})|([a-z]+)))?$"
)
# fixed values: the zone names of mail headers, in hours from UTC
_MAIL_ZONES = {
    "AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5,
    "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"


def _int(c: Column) -> Column:
    return F.coalesce(blank_to_null(c).try_cast("int"), F.lit(0))


def _utc(year, month, day, hour, minute, second, sign, off_h, off_m) -> Column:
    moment = F.try_make_timestamp(year, month, day, hour, minute, second, F.lit("UTC"))
    shift = _int(off_h) * 60 + _int(off_m)
    shift = F.when(sign == "-", -shift).otherwise(shift)
    return moment - F.make_dt_interval(F.lit(0), F.lit(0), shift)


def timestamp_of_text(c: Column) -> Column:
    """Compacted text to a UTC timestamp, null when no accepted shape fits."""
    dashed = F.replace(c, F.lit("/"), F.lit("-"))

    def iso(text: Column) -> Column:
        parts = F.split(F.regexp_replace(text, _ISO, "$1|$3|$4|$5|$7|$8|$9|$10|$11|$12"), r"\|", -1)
        return let(
            parts,
            lambda p: _utc(
                _int(p[0]), _int(p[1]), _int(p[2]), _int(p[3]), _int(p[4]),
                F.concat(
                    F.coalesce(blank_to_null(p[5]), F.lit("0")), F.lit("."),
                    F.coalesce(blank_to_null(p[6]), F.lit("0")),
                ).cast("decimal(16,6)"),
                p[7], p[8], p[9],
            ),
        )

    def mail(text: Column) -> Column:
        parts = F.split(F.regexp_replace(text, _MAIL, "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"), r"\|", -1)

        def build(p: Column) -> Column:
            year = _int(p[2])
            century = F.when(F.length(p[2]) > 2, 0).when(year < 69, 2000).otherwise(1900)
            month = (F.instr(F.lit(_MONTHS), F.lower(p[1])) - 1) / 4 + 1
            named = F.lit(0)
            for name, hours in _MAIL_ZONES.items():
                named = F.when(F.upper(p[9]) == name, hours).otherwise(named)
            return _utc(
                year + century, month.cast("int"), _int(p[0]), _int(p[3]), _int(p[4]),
                _int(p[5]).cast("decimal(16,6)"), p[6], p[7], p[8],
            ) - F.make_dt_interval(F.lit(0), named)

        return let(parts, build)

    # texts of no shape stop here: a time made of their missing parts would be an exception for each
    shaped = F.when(c.rlike(_ISO), c).when(dashed.rlike(_ISO), dashed)
    return let(shaped, lambda s: F.when(s.isNotNull(), iso(s)).when(c.rlike(_MAIL), mail(c)))


def parse_datetime(c: Column) -> Column:
    # bound once: the shapes ask for the text a dozen times
    return let(compact(c), timestamp_of_text)
