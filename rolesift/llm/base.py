"""What the operators share: tables, word bytes, sharding bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# white space of the word contracts is \x20 and \x09-\x0D, just what bytes.split() cuts at
SPACES = " \t\n\r\x0b\x0c"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """A-Z lower-cased, every other character as it is."""
    return F.translate(column, UPPER, LOWER)


class Shared:
    """A broadcast value whose class travels with it, so that executors need no copy of this package.

    A plain broadcast names the class of an instance and leaves its import to the worker.
    The value is opened once a task.
    """

    def __init__(self, context: SparkContext, value):
        self.sent = context.broadcast(cloudpickle.dumps(value))
        self.opened = None

    def __getstate__(self):
        return {"sent": self.sent, "opened": None}

    @property
    def value(self):
        if self.opened is None:
            self.opened = cloudpickle.loads(self.sent.value)
        return self.opened


def arrow_map(
    rows: DataFrame, batch: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str
) -> DataFrame:
    """``mapInArrow`` over single batches; a dict of columns becomes a batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            if one.num_rows:
                out = batch(one)
                yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out

    return rows.mapInArrow(run, schema)


def keep_best(slots: np.ndarray, values: np.ndarray, ids: np.ndarray, k: int):
    """Of every slot the ``k`` entries of highest value, ties by smaller id, in that order."""
    order = np.lexsort((ids, -values, slots))
    slots, values, ids = slots[order], values[order], ids[order]
    starts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]]) if len(slots) else np.zeros(0, int)
    place = np.arange(len(slots)) - np.repeat(starts, np.diff(np.r_[starts, len(slots)]))
    return slots[place < k], values[place < k], ids[place < k]


def best_of_slots(parts: Iterator, n_slots: int, k: int):
    """The best of all parts; ``parts`` get the least value that still counts for each slot and give new entries."""
    least = np.full(n_slots, np.iinfo(np.int64).min)
    held = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for part in parts:
        for found in part(least):
            held = keep_best(*(np.concatenate(pair) for pair in zip(held, found)), k)
            full = np.bincount(held[0], minlength=n_slots) >= k
            lowest = np.full(n_slots, np.iinfo(np.int64).max)
            np.minimum.at(lowest, held[0], held[1])
            least[full] = lowest[full]
    return held
