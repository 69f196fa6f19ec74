"""Source configuration files: reading, shaping, validation.

One JSON file describes one source. Text is kept whole per file, as the order of
keyword overrides is data; broken files become violations, not failures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.functions.text import blank_to_null, lenient_int
from rolesift.functions.variants import is_object, kind, member, scalar_text, strict_json, truthy_text
from rolesift.operators.html_nodes import unsupported_selectors
from rolesift.operators.extraction import PARSER_TYPES

# fixed values: the configuration vocabulary
REQUIRED_KEYS = ["id", "company_name", "careers_url", "parser_type"]
OPTIONAL_KEYS = [
    "country_hint", "enabled", "selectors", "pagination", "parser_options", "matching_profile",
    "job_url_template", "json_job_url_template",
]
SELECTOR_KEYS = ["job_card", "title", "link", "location", "description", "posted_at", "external_id"]
PARSER_OPTIONS = {"generic_json": ["jobs_path", "fields", "url_base"]}
PAGE_STRATEGIES = ["query_param", "attrax_page_query"]
OFFSET_STRATEGY = "offset_limit"


def read_configs(spark: SparkSession, folder: str) -> DataFrame:
    """``file`` and ``config_text`` per JSON file; a missing folder is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "file string, config_text string")
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("config_text"))


def _doc() -> Column:
    return strict_json(F.col("config_text"))


def _text(key: str) -> Column:
    return F.trim(scalar_text(member(F.col("doc"), key)))


def _truthy(v: Column) -> Column:
    """Absent counts as true, null, 0 and blanks as false."""
    return F.when(v.isNull(), True).otherwise(truthy_text(v).isNotNull())


def _string_map(v: Column) -> Column:
    entries = F.when(is_object(v), F.try_variant_get(v, "$", "map<string,variant>"))
    return F.transform_values(entries, lambda _, x: scalar_text(x))


def shape_configs(files: DataFrame) -> DataFrame:
    """Typed columns; unknown keys stay in ``extra``."""
    options = member(F.col("doc"), "parser_options")
    template = F.coalesce(member(F.col("doc"), "job_url_template"), member(F.col("doc"), "json_job_url_template"))
    every = F.try_variant_get(F.col("doc"), "$", "map<string,variant>")
    return files.withColumn("doc", _doc()).select(
        "file",
        _text("id").alias("source_id"),
        _text("company_name").alias("company_name"),
        _text("careers_url").alias("careers_url"),
        _text("parser_type").alias("parser_type"),
        F.trim(truthy_text(member(F.col("doc"), "country_hint"))).alias("country_hint"),
        _truthy(member(F.col("doc"), "enabled")).alias("enabled"),
        F.coalesce(_string_map(member(F.col("doc"), "selectors")), F.create_map().cast("map<string,string>")).alias(
            "selectors"
        ),
        member(F.col("doc"), "pagination").alias("pagination"),
        options.alias("parser_options"),
        scalar_text(member(options, "jobs_path")).alias("jobs_path"),
        truthy_text(member(options, "url_base")).alias("url_base"),
        _string_map(member(options, "fields")).alias("fields"),
        F.get_json_object("config_text", "$.matching_profile").alias("matching_profile"),
        blank_to_null(F.trim(scalar_text(template))).alias("job_url_template"),
        F.map_filter(every, lambda k, _: ~k.isin(REQUIRED_KEYS + OPTIONAL_KEYS)).alias("extra"),
    )


def _int_text(v: Column) -> Column:
    """What reads as a whole number: numbers (cut off), digit strings, booleans."""
    cut = F.try_variant_get(v, "$", "double").cast("long").cast("string")
    return (
        F.when(kind(v).isin("BIGINT", "DECIMAL", "DOUBLE"), cut)
        .when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("string"))
        .when(kind(v) == "STRING", F.trim(F.try_variant_get(v, "$", "string")))
    )


def read_int(v: Column, default: int, minimum: int) -> Column:
    """Lenient whole number: anything unreadable is ``default``, then clamped."""
    return lenient_int(_int_text(v), default, minimum)


def _strict_int(v: Column, default: int | None = None) -> Column:
    number = F.when(_int_text(v).rlike(r"^[+-]?\d+$"), _int_text(v).try_cast("long"))
    return number if default is None else F.when(v.isNull(), F.lit(default)).otherwise(number)


def page_strategy(pagination: Column) -> Column:
    return F.coalesce(F.lower(F.trim(scalar_text(member(pagination, "strategy")))), F.lit(""))


def config_violations(files: DataFrame) -> DataFrame:
    """Every broken rule of every file: file, source_id, severity, rule, message."""
    shaped = _with_shape(files)
    shaped = shaped.withColumn("odd_forms", unsupported_selectors(F.map_values("selectors")))
    doc, paging = F.col("doc"), F.col("pagination")
    options, fields = F.col("parser_options"), member(F.col("parser_options"), "fields")
    generic_json = F.col("parser_type") == "generic_json"
    known = F.coalesce(F.col("parser_type").isin(PARSER_TYPES), F.lit(False))
    absent = F.filter(F.array(*map(F.lit, REQUIRED_KEYS)), lambda k: ~F.array_contains(F.map_keys("every"), k))
    complete = is_object(doc) & (F.size(absent) == 0)
    checked = complete & known
    paged = checked & is_object(paging) & (F.size(F.try_variant_get(paging, "$", "map<string,variant>")) > 0)
    strategy = page_strategy(paging)

    def bad(v: Column, minimum: int) -> Column:
        return v.isNull() | (v < minimum)

    def found(condition: Column, severity: str, rule: str, message) -> Column:
        text = message if isinstance(message, Column) else F.lit(message)
        return F.when(
            F.coalesce(condition, F.lit(False)),
            F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), text.alias("message")),
        )

    def unknown(keys: Column, allowed: list[str]) -> Column:
        return F.array_sort(F.filter(keys, lambda k: ~k.isin(allowed)) if allowed else keys)

    odd_selectors = unknown(F.map_keys("selectors"), SELECTOR_KEYS)
    option_keys = F.map_keys(F.when(is_object(options), F.try_variant_get(options, "$", "map<string,variant>")))
    odd_options = F.when(generic_json, unknown(option_keys, PARSER_OPTIONS["generic_json"])).otherwise(unknown(option_keys, []))
    rules = [
        found(~is_object(doc), "error", "json", "not a JSON object"),
        found(is_object(doc) & ~complete, "error", "required_keys",
              F.concat(F.lit("Missing required keys: "), F.array_join(F.array_sort(absent), ", "))),
        *[
            found(member(doc, k).isNotNull() & (kind(member(doc, k)) != "VOID") & ~is_object(member(doc, k)),
                  "error", f"container_{k}", f"{k} must be an object")
            for k in ("selectors", "parser_options", "matching_profile", "pagination")
        ],
        found(complete & ~known, "error", "parser_type",
              F.concat(F.lit("unknown parser type '"), F.col("parser_type"), F.lit("'"))),
        found(checked & ~F.startswith(F.col("careers_url"), F.lit("http")), "error", "careers_url",
              "careers_url must be absolute URL"),
        found(checked & generic_json & ((F.coalesce(kind(member(options, "jobs_path")), F.lit("")) != "STRING")
                                        | truthy_text(member(options, "jobs_path")).isNull()),
              "error", "jobs_path", "generic_json requires parser_options.jobs_path"),
        found(checked & generic_json & ~is_object(fields), "error", "fields",
              "generic_json requires parser_options.fields"),
        found(checked & generic_json & is_object(fields) & truthy_text(member(fields, "title")).isNull(),
              "error", "fields_title", "generic_json requires parser_options.fields.title"),
        found(checked & generic_json & is_object(fields) & truthy_text(member(fields, "url")).isNull()
              & F.col("job_url_template").isNull(),
              "error", "fields_url", "generic_json requires parser_options.fields.url or job_url_template"),
        found(paged & ~strategy.isin(*PAGE_STRATEGIES, OFFSET_STRATEGY), "error", "pagination_strategy",
              "pagination.strategy must be one of query_param, attrax_page_query, offset_limit"),
        found(paged & bad(_strict_int(member(paging, "max_pages")), 1), "error", "pagination_max_pages",
              "pagination.max_pages must be an integer >= 1"),
        found(paged & strategy.isin(PAGE_STRATEGIES) & bad(_strict_int(member(paging, "start_page"), 1), 0),
              "error", "pagination_start_page", "pagination.start_page must be an integer >= 0"),
        found(paged & (strategy == OFFSET_STRATEGY) & bad(_strict_int(member(paging, "limit"), 15), 1),
              "error", "pagination_limit", "pagination.limit must be an integer >= 1"),
        found(paged & (strategy == OFFSET_STRATEGY) & bad(_strict_int(member(paging, "start_offset"), 0), 0),
              "error", "pagination_start_offset", "pagination.start_offset must be an integer >= 0"),
        found(checked & (F.size("odd_forms") > 0), "error", "selector_forms",
              F.concat(F.lit("selectors that cannot be matched: "), F.array_join(F.array_sort("odd_forms"), "; "))),
        found(checked & (F.size(odd_selectors) > 0), "warning", "selectors",
              F.concat(F.lit("unknown selector keys: "), F.array_join(odd_selectors, ", "))),
        found(checked & (F.size(odd_options) > 0), "warning", "parser_options",
              F.concat(F.lit("unsupported parser_options: "), F.array_join(odd_options, ", "))),
    ]
    each = shaped.select("file", "source_id", F.explode_outer(F.array_compact(F.array(*rules))).alias("v"))
    single = each.filter(F.col("v").isNotNull()).select("file", "source_id", "v.*")
    return single.unionByName(duplicate_ids(shaped))


def _with_shape(files: DataFrame) -> DataFrame:
    shaped = shape_configs(files.withColumn("file", F.struct("file", "config_text")))
    doc = strict_json(F.col("file.config_text"))
    return shaped.withColumns({"doc": doc, "every": F.try_variant_get(doc, "$", "map<string,variant>")}).withColumn(
        "file", F.col("file.file")
    )


def duplicate_ids(shaped: DataFrame) -> DataFrame:
    """An id used by several files is an error of the id."""
    repeated = shaped.filter(F.col("source_id").isNotNull()).groupBy("source_id").agg(
        F.count("*").alias("n"), F.max("file").alias("file")
    ).filter(F.col("n") > 1)
    return repeated.select(
        "file",
        "source_id",
        F.lit("error").alias("severity"),
        F.lit("duplicate_id").alias("rule"),
        F.concat(F.lit("Duplicate source id '"), F.col("source_id"), F.lit("'")).alias("message"),
    )
