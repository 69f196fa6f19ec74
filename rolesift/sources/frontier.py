"""Follow-up page URLs of a source, as an array per source: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions.text import fill_template
from rolesift.functions.urls import set_query_params
from rolesift.functions.variants import is_object, member, scalar_text
from rolesift.sources.configs import OFFSET_STRATEGY, PAGE_STRATEGIES, page_strategy, read_int


def page_urls(careers_url: Column, pagination: Column) -> Column:
    """URLs after the first page, in page order, without repeats and the careers URL."""

    def text(key: str) -> Column:
        return F.coalesce(F.trim(scalar_text(member(pagination, key))), F.lit(""))

    def or_else(c: Column, other: Column) -> Column:
        return F.when(c != "", c).otherwise(other)

    pages = read_int(member(pagination, "max_pages"), 1, 1)
    base, template = or_else(text("base_url"), careers_url), text("url_template")
    first = read_int(member(pagination, "start_page"), 1, 0)
    limit = read_int(member(pagination, "limit"), 15, 1)
    offset = read_int(member(pagination, "start_offset"), 0, 0)
    param = or_else(text("page_param"), F.lit("page"))

    def paged(i: Column) -> Column:
        page = (first + i).cast("string")
        made = fill_template(template, {"page": page})
        return F.when(template != "", made).otherwise(set_query_params(base, [(param, page)]))

    def shifted(i: Column) -> Column:
        at, size = (offset + i * limit).cast("string"), limit.cast("string")
        made = fill_template(template, {"offset": at, "limit": size, "page": (i + 1).cast("string")})
        plain = set_query_params(base, [(F.lit("offset"), at), (F.lit("limit"), size)])
        return F.when(template != "", made).otherwise(plain)

    steps = F.sequence(F.lit(1), pages - 1)
    strategy = page_strategy(pagination)
    urls = F.when(pages > 1, F.when(strategy.isin(PAGE_STRATEGIES), F.transform(steps, paged)).when(
        strategy == OFFSET_STRATEGY, F.transform(steps, shifted)
    ))
    fresh = F.filter(F.array_distinct(urls), lambda u: (u != "") & (u != careers_url))
    return F.coalesce(fresh, F.array().cast("array<string>"))


def page_frontier(configs: DataFrame) -> DataFrame:
    """source_id, page_index, url: the careers URL as page 0, then its follow-ups."""
    paging = F.when(is_object(F.col("pagination")), F.col("pagination")).when(
        is_object(F.try_element_at("extra", F.lit("pagination"))), F.try_element_at("extra", F.lit("pagination"))
    )
    listed = F.concat(F.array("careers_url"), page_urls(F.col("careers_url"), paging))
    return configs.select("source_id", F.posexplode_outer(listed).alias("page_index", "url"))
