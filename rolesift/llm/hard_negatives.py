"""Hard negatives by Four-Russians scoring.

Vectors are made of whole numbers and cut into groups of eight dimensions. For an anchor
and a group the sums of all 256 subsets of its eight components are tabled once. A
candidate is kept as the bytes of its bit planes: byte ``g`` of plane ``p`` holds bit ``p``
of the eight components of group ``g``. Its inner product with the anchor is then a shift
and add over planes (two's complement, so the sign plane counts negative) of looked-up
subset sums, exact, without a multiplication of components.

Anchors are the stated queries; they are dealt to blocks of about ``ANCHORS``, and a block's
vectors are broadcast and scored against all rows where the rows lie. A task sends only its
best rows of each slot (an anchor, or an anchor and one of its positives), ties by the smaller
id, so what is shuffled depends on anchors and tasks, never on the pairs scored. Each block's
result is written to the shared folder before the next one starts.

Rows with a null id, label or vector, or a null or non-finite component take no part. Of rows
that share an id the one with the least label, then the least plane bytes, counts. Shorter vectors are as if
filled with zeros. Whole numbers and scores are of 64 bits and wrap. An empty table, or one
without anchors, gives an empty result; so does an anchor without positives or without
negatives in range. Other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolesift.llm.base import arrow_map, best_of_slots, table
from rolesift.session import materialize, release, shared_folder

ANCHORS = 1024  # anchors of a block: 8 MB of subset sums for 64 dimensions
ROWS = 512  # rows scored at a time
TASK_ROWS = 50_000  # rows of a task, where the table holds more than one for each core
RESULT = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"


def whole(rows: DataFrame, scale: int) -> DataFrame:
    """``vec_id``, ``label`` and ``v``, the components times ``scale`` rounded down, of rows that take part."""
    x = F.col("embedding")
    # null components make these null, infinite ones the sum null or non-finite
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    taking = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    ints = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return taking.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), ints.alias("v"))


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Lists of whole numbers as rows of ``dims``, short ones filled with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims)[None, :] < lengths[:, None]] = values
    return out


def plane_bytes(ints: np.ndarray, planes: int) -> np.ndarray:
    """Rows of ``planes`` times ``dims / 8`` bytes: the bit planes of the numbers, lowest first."""
    bits = (ints[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").reshape(len(ints), -1)


def subset_sums(anchors: np.ndarray, planes: int) -> np.ndarray:
    """For each group of eight dimensions and each byte the sum of the components it names, for each anchor."""
    groups = anchors.shape[1] // 8
    # 32 bits where no score of the block can leave them
    narrow = float(np.abs(anchors.astype(np.float64)).sum(axis=1).max(initial=0)) * 2.0**planes < 2**31
    out = np.zeros((groups, 256, len(anchors)), np.int32 if narrow else np.int64)
    for j in range(8):
        out[:, 1 << j : 2 << j] = out[:, : 1 << j] + anchors[:, j::8].T[:, None, :].astype(out.dtype)
    return out


def scores(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Inner products of rows (their plane bytes) and anchors (their subset sums)."""
    groups = len(tables)
    planes = packed.shape[1] // groups
    out = np.zeros((len(packed), tables.shape[2]), tables.dtype)
    for p in reversed(range(planes)):
        out <<= 1
        for g in range(groups):
            looked_up = tables[g][packed[:, p * groups + g]]
            if p == planes - 1:
                out -= looked_up
            else:
                out += looked_up
    return out


def _chunks(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        ids, labels = (batch.column(c).to_numpy() for c in ("vec_id", "label"))
        packed = np.frombuffer(b"".join(batch.column("packed").to_pylist()), np.uint8).reshape(batch.num_rows, width)
        for at in range(0, batch.num_rows, ROWS):
            yield ids[at : at + ROWS], labels[at : at + ROWS], packed[at : at + ROWS]


def positives_of(rows: DataFrame, block, planes: int, k: int) -> DataFrame:
    """The ``k`` best other rows of an anchor's own label: ``slot`` (the anchor's place), ``id``, ``score``."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, anchor_labels, anchors = sent.value
        own = {}
        for label in np.unique(anchor_labels):
            places = np.flatnonzero(anchor_labels == label)
            own[label] = places, subset_sums(anchors[places], planes)

        def part(ids, labels, packed):
            def entries(least):
                for label in np.unique(labels):
                    if label in own:
                        places, tables = own[label]
                        mine = np.flatnonzero(labels == label)
                        got = scores(tables, packed[mine]).astype(np.int64)
                        r, c = np.nonzero((got >= least[places]) & (ids[mine][:, None] != anchor_ids[places]))
                        yield places[c], got[r, c], ids[mine][r]

            return entries

        width = planes * (anchors.shape[1] // 8)
        slots, values, ids = best_of_slots((part(*c) for c in _chunks(batches, width)), len(anchor_ids), k)
        yield pa.RecordBatch.from_pydict({"slot": slots, "id": ids, "score": values})

    return _top(rows.mapInArrow(task, "slot long, id long, score long"), k)


def negatives_of(rows: DataFrame, block, ranges, planes: int, k: int) -> DataFrame:
    """The ``k`` best rows of another label for each range: ``slot`` (the range's place), ``id``, ``score``.

    ``ranges`` are arrays of anchors' places and of the lowest and highest score.
    """
    sent = rows.sparkSession.sparkContext.broadcast((block, ranges))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, anchor_labels, anchors), (places, low, high) = sent.value
        tables = subset_sums(anchors, planes)
        # ranges by their number among the anchor's own: each turn compares one range of every anchor that has it
        order = np.argsort(places, kind="stable")
        first = np.searchsorted(places[order], places[order])
        turn = np.empty(len(places), int)
        turn[order] = np.arange(len(places)) - first

        def part(ids, labels, packed):
            def entries(least):
                got = scores(tables, packed).astype(np.int64)
                other = labels[:, None] != anchor_labels[None, :]
                for t in range(turn.max(initial=-1) + 1):
                    mine = np.flatnonzero(turn == t)
                    one = got[:, places[mine]]
                    fits = (one >= np.maximum(low[mine], least[mine])) & (one <= high[mine]) & other[:, places[mine]]
                    r, c = np.nonzero(fits)
                    yield mine[c], one[r, c], ids[r]

            return entries

        width = planes * (anchors.shape[1] // 8)
        slots, values, ids = best_of_slots((part(*c) for c in _chunks(batches, width)), len(places), k)
        yield pa.RecordBatch.from_pydict({"slot": slots, "id": ids, "score": values})

    return _top(rows.mapInArrow(task, "slot long, id long, score long"), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    """Of the tasks' best rows the best of all; ``k`` rows a task and slot at most come here."""
    place = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` have ``vec_id``, ``label`` and ``embedding``; ``is_anchor`` is a condition on
    ``vec_id``. A negative's score lies between ``low`` and ``high`` hundredths of the positive's.
    """
    spark = rows.sparkSession
    taking = whole(rows, scale)
    least = lambda c: F.least(F.min(F.array_min(c)), F.lit(0))
    most = lambda c: F.greatest(F.max(F.array_max(c)), F.lit(0))
    seen = taking.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), least("v").alias("least"), most("v").alias("most"))
    shape = seen.first()
    dims = 8 * math.ceil(max(shape["dims"] or 0, 1) / 8)
    planes = 1 + max(shape["most"].bit_length(), (-1 - shape["least"]).bit_length()) if shape["n"] else 1

    def pack(batch: pa.RecordBatch) -> dict:
        packed = plane_bytes(matrix(batch.column("v"), dims), planes)
        return {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "packed": [r.tobytes() for r in packed]}

    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(shape["n"] / TASK_ROWS))
    packed = arrow_map(taking, pack, "vec_id long, label long, packed binary").repartition(tasks, "vec_id")
    index = materialize(packed.groupBy("vec_id").agg(F.min(F.struct("label", "packed")).alias("r")).select("vec_id", "r.*"))
    asked = index.filter(is_anchor)
    blocks = max(1, math.ceil(asked.count() / ANCHORS))
    folder = f"{shared_folder(spark)}/staged/{uuid.uuid4().hex}"
    for b in range(blocks):
        mine_of_block = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        found = _of_block(index, mine_of_block, planes, dims, positives, negatives, low, high)
        found.write.parquet(f"{folder}/block={b}")
    release(index)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    got = spark.read.schema(f"{RESULT}, block int").parquet(folder)
    return got.select("anchor_id", "positive_id", F.row_number().over(order).alias("rank"), *RESULT.replace(" long", "").split(", ")[2:])


def numbers(packed: np.ndarray, planes: int, dims: int) -> np.ndarray:
    """The whole numbers of plane bytes: what :func:`plane_bytes` was given."""
    bits = np.unpackbits(packed.reshape(len(packed), planes, dims // 8), axis=2, bitorder="little").astype(np.int64)
    weights = np.left_shift(np.int64(1), np.arange(planes, dtype=np.int64))
    weights[-1] = -weights[-1]
    return np.einsum("rpd,p->rd", bits, weights)


def _of_block(index, anchors, planes, dims, positives, negatives, low, high) -> DataFrame:
    """The result of one block: its vectors and their few positives pass the driver, rows and scores do not."""
    spark = index.sparkSession
    got = anchors.orderBy("vec_id").toArrow()  # about ANCHORS rows
    packed = np.frombuffer(b"".join(got.column("packed").to_pylist()), np.uint8).reshape(got.num_rows, planes * dims // 8)
    ids, labels = (got.column(c).to_numpy() for c in ("vec_id", "label"))
    block = ids, labels, numbers(packed, planes, dims)
    near = positives_of(index, block, planes, positives).orderBy("slot", "rank").toArrow()
    places, near_ids, near_scores = (near.column(c).to_numpy() for c in ("slot", "id", "score"))
    lows = np.array([-(-low * int(s) // 100) for s in near_scores], np.int64)
    highs = np.array([high * int(s) // 100 for s in near_scores], np.int64)
    found = negatives_of(index, block, (places, lows, highs), planes, negatives)
    named = zip(range(len(places)), ids[places].tolist(), near_ids.tolist(), near_scores.tolist())
    pairs = spark.createDataFrame(list(named), "slot long, anchor_id long, positive_id long, positive_score long")
    return found.join(F.broadcast(pairs), "slot").select(
        "anchor_id", "positive_id", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM s JOIN p USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

QUERIES = {"op13_hard_negatives": (op13_hard_negatives, _SQL)}
