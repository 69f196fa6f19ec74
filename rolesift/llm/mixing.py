"""Mixing sources to target weights.

The words of every source are counted, the mix is dealt to the sources by weight, and
what a source would get beyond ``cap`` times its own words is dealt again to the others
by weight until none is above. A source's target over its words is its repetition rate:
each of its documents is emitted ``floor(rate)`` times, and once more where a number
between 0 and 1, made by hash from the seed and the document, lies below the fraction.

Documents are read once, into a narrow table of ids, sources and sizes; the emission
reads the documents once more without a shuffle. Only sums of all sources reach the
driver, never the list of sources, which is numbered by ranges and joined like any table.

A null text has no words and a null id is stood for by its text's hash. A null source is
a source, the last. Rows that share an id are documents of their own but draw the same
number. A source without words has target 0. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.llm.base import table
from rolesift.session import broadcast_if_small, materialize, release

WORD = r"[^\x20\x09-\x0D]+"
# what the query is asked: weights of the sources in order, share of all words, most a document repeats
WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2, "mix"
_DIGITS = 13  # hexadecimal digits of a draw: 52 bits, whole in a double


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str) -> Column:
    """A number in [0, 1) that depends on the seed and the document alone."""
    known = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), known)), 1, _DIGITS), 16, 10).cast("long")
    return bits / F.lit(float(16**_DIGITS))


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """Adds ``number``, the place of each row in the order of a column, nulls last, and keeps the result as a table.

    Ranges are sorted by themselves; only the number of rows of each range is gathered.
    """
    order = F.col(column).asc_nulls_last()
    part = F.spark_partition_id()
    at = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order)
    placed = materialize(ranged.select("*", part.alias("_part"), at.alias("_at")))
    before, offsets = 0, []
    for r in placed.groupBy("_part").count().orderBy("_part").collect():  # one row a range
        offsets.append((r["_part"], before))
        before += r["count"]
    starts = placed.sparkSession.createDataFrame(offsets, "_part int, _start long")
    out = materialize(placed.join(F.broadcast(starts), "_part").withColumn("number", F.col("_at") + F.col("_start")))
    release(placed)
    return out.drop("_part", "_at", "_start")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of rows with a source and a size."""
    sources = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source")
    named = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", named.cast("double"))
    most, total = cap * F.col("source_size"), sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = most < level * F.col("weight")
        row = sources.agg(
            F.sum(F.when(above, F.col("source_size"))).alias("held"),
            F.sum(F.when(~above, F.col("weight"))).alias("open"),
            F.count(F.when(above, 1)).alias("full"),
        ).first()
        if row["full"] == full or not row["open"]:  # nothing more is above, or all are
            break
        full, level = row["full"], (share * total - cap * (row["held"] or 0)) / row["open"]
    target = F.least(most, level * F.col("weight")) if row["open"] else most
    return sources.select("source", "source_size", target.cast("double").alias("target"))


def _dealt(docs: DataFrame, weights: Sequence[int], share: float, cap: float, seed: str) -> DataFrame:
    """The documents with a struct ``_mix`` of size, source_size, target and copies."""
    size = n_words(F.col("text")).alias("size")
    sized = materialize(docs.select("source", size).groupBy("source").agg(F.sum("size").alias("size")))
    targets = source_targets(sized, weights, share, cap).select(
        F.col("source").alias("_source"), F.col("source_size").alias("_size"), F.col("target").alias("_target")
    )
    held = docs.join(broadcast_if_small(targets), F.col("source").eqNullSafe(F.col("_source")))
    release(sized)
    rate = F.coalesce(F.try_divide("_target", "_size"), F.lit(0.0))
    copies = F.floor(rate) + F.when(draw(seed) < rate - F.floor(rate), 1).otherwise(0)
    named = [F.col("_size").alias("source_size"), F.col("_target").alias("target"), copies.cast("long").alias("copies")]
    return held.select(*docs.columns, F.struct(size, *named).alias("_mix"))


def with_copies(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED
) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target`` and ``copies``, how often the mix holds each.

    Columns of these names that the documents have already give way.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    return _dealt(docs, weights, share, cap, seed).select(*own, "_mix.*")


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED
) -> DataFrame:
    """Every document as often as the mix holds it, with ``copy`` from 0; other columns of the documents stay."""
    dealt = _dealt(docs, weights, share, cap, seed).filter(F.col("_mix.copies") > 0)
    kept = [c for c in docs.columns if c != "copy"]
    return dealt.select(*kept, F.explode(F.sequence(F.lit(0), F.col("_mix.copies").cast("int") - 1)).alias("copy"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = with_copies(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 13))::BIGINT
      / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM s),
k AS (
  SELECT *, row_number() OVER o AS place, sum(n) OVER () AS total,
    coalesce(sum(n) OVER (ORDER BY n / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    sum(weight) OVER (ORDER BY n / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w WINDOW o AS (ORDER BY n / weight, source)),
l AS (
  SELECT arg_min((1.5::DOUBLE * total - 2 * held) / open, place) AS level
  FROM k WHERE NOT 2 * n < (1.5::DOUBLE * total - 2 * held) / open * weight),
t AS (SELECT source, n, least(2::DOUBLE * n, level * weight) AS target FROM k, l),
r AS (SELECT d.*, n, target, coalesce(target / nullif(n, 0), 0) AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM r)
SELECT doc_id, size, n AS source_size, target, size * copies AS taken, copies FROM c
"""

QUERIES = {"op12_source_mix": (op12_source_mix, _SQL)}
