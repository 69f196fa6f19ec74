"""Natural keys of postings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesift.functions.text import blank_to_null, clean


def canonical_hash(source_id: Column, external_id: Column, url: Column, title: Column, location: Column) -> Column:
    """SHA-256 over the identifying fields; ``url`` is already canonical."""
    return F.sha2(
        F.concat_ws(
            "|",
            source_id,
            F.coalesce(external_id, F.lit("")),
            url,
            F.lower(clean(title)),
            F.lower(clean(location)),
        ),
        256,
    )


def location_or_hint(location: Column, country_hint: Column) -> Column:
    return F.coalesce(blank_to_null(clean(location)), clean(country_hint))
