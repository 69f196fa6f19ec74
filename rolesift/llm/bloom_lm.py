"""Language-model scores from a log-frequency Bloom filter.

Counts are quantised to ``1 + floor(log2(count))`` levels; a key of level q is in the
filter with each of 1..q, and its level is read back by probing 1, 2, ... until a
miss. The filter holds the bigrams of the training texts, how often each history
occurred and how many different words followed it. Scores are Witten-Bell smoothed:
``(c(h, w) + T(h) P0(w)) / (c(h) + T(h))``, with ``P0`` the add-one share of the word,
taken from exact counts, which also give the base score.

Counts are combined in the tasks, sent as packed arrays by slices of the key space,
and each slice becomes a row of exact word counts or of filter bits in the shared
folder, so model building grows with the corpus and has no central step. The model
goes to the workers by broadcast in shards of at most ``MAX_BYTES``: word counts by
word, filter by history. Each pass adds the words whose word and history lie in its
shards, so scores do not depend on the number of shards; what they cost is one pass
over the texts for each pair of shards.

Null text counts as empty: one token, the end. A null ``doc_id`` is not held out.
Repeated rows are counted, and scored, each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.llm.base import table
from rolesift.llm.dart_minhash import mix
from rolesift.session import materialize

FOLDS, HELD_OUT = 7, 2
BITS, PROBES = 8, 5  # of the filter, for each key and level: 2 % false positives
MAX_BYTES = 96 * 1024 * 1024
SLICES = 256  # of the key space, at least; a power of two
_CHUNK = 3_000_000  # tokens counted at once
_START = np.uint64(0x243F6A8885A308D3)
_HISTORY, _TYPES = np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0)
_ROWS = "kind int, slice int, keys binary, counts binary"
_MODEL = "kind int, slice int, tokens long, types long, keys binary, counts binary, bits binary, size long"


def token_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of some texts one after another, and how many each has.

    Tokens are the words, A-Z lower-cased, and an end, which hashes as the empty word.
    """
    import xxhash

    hashed, sizes = [], []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        words.append(b"")
        hashed.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        sizes.append(len(words))
    return np.concatenate(hashed) if hashed else np.zeros(0, np.uint64), np.array(sizes, np.int64)


def bigrams(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each token the key of its bigram: 32 bits of the history, 32 of the word."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = _START
    return (before >> np.uint64(32) << np.uint64(32)) | (tokens >> np.uint64(32))


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    waiting: list[str | None] = []
    held = 0
    for batch in batches:
        for text in batch.column("text"):
            waiting.append(text.as_py())
            held += len(waiting[-1] or "") // 6 + 1
            if held > _CHUNK:
                yield token_hashes(waiting)
                waiting, held = [], 0
    if waiting:
        yield token_hashes(waiting)


def _counted(slices: int):
    shift = np.uint64(65 - slices.bit_length())

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, sizes in _chunks(batches):
            for kind, keys in ((0, tokens), (1, bigrams(tokens, sizes))):
                keys, counts = np.unique(keys, return_counts=True)
                of = (keys >> shift).astype(np.int64)
                cuts = np.searchsorted(of, np.arange(slices + 1))
                some = [s for s in range(slices) if cuts[s] < cuts[s + 1]]
                spans = [slice(cuts[s], cuts[s + 1]) for s in some]
                counts = counts.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(some), pa.int32()), pa.array(some, pa.int32()),
                     pa.array([keys[x].tobytes() for x in spans], pa.binary()),
                     pa.array([counts[x].tobytes() for x in spans], pa.binary())],
                    names=["kind", "slice", "keys", "counts"],
                )

    return count


def _summed(parts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in parts.column("keys")])
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in parts.column("counts")])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(float))[1].astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The mean of the counts of a level: 0, 1, 2.5, 5.5, ..."""
    return np.where(levels > 0, (3 * np.exp2(levels - 1.0) - 1) / 2, 0)


def _probes(keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
    a = mix(keys ^ mix(np.array([level], np.uint64) + np.uint64(1)))
    b = mix(a) | np.uint64(1)
    for i in range(PROBES):
        yield a + np.uint64(i) * b


def filter_bits(keys: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, int]:
    """The bits of a filter of keys, each with all levels up to its own."""
    size = max(64, int(levels.sum()) * BITS)
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in _probes(keys[levels >= level], level):
            bits[(at % np.uint64(size)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little"), size


def _slice_model(key: tuple, parts: pa.Table) -> pa.Table:
    kind = key[0].as_py()
    keys, counts = _summed(parts)
    row = {"kind": kind, "slice": key[1].as_py(), "tokens": int(counts.sum()), "types": len(keys)}
    if kind == 0:
        row |= {"keys": keys.tobytes(), "counts": counts.astype(np.uint32).tobytes(), "bits": None, "size": 0}
    else:
        history = keys >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], history[1:] != history[:-1])))
        seen, types = np.add.reduceat(counts, first), np.diff(np.append(first, len(keys)))
        every = np.concatenate((mix(keys), mix(history[first] ^ _HISTORY), mix(history[first] ^ _TYPES)))
        bits, size = filter_bits(every, levels_of(np.concatenate((counts, seen, types))))
        row |= {"keys": None, "counts": None, "bits": bits.tobytes(), "size": size}
    schema = pa.schema(
        [("kind", pa.int32()), ("slice", pa.int32()), ("tokens", pa.int64()), ("types", pa.int64()),
         ("keys", pa.binary()), ("counts", pa.binary()), ("bits", pa.binary()), ("size", pa.int64())]
    )
    return pa.Table.from_pylist([row], schema=schema)


def train(texts: DataFrame) -> tuple[DataFrame, int]:
    """The model, one row for each slice of the words (kind 0) and of the bigrams (kind 1), and the number of slices."""
    tasks = max(1, texts.rdd.getNumPartitions())
    slices = max(SLICES, 1 << (4 * tasks - 1).bit_length())
    parts = texts.select("text").mapInArrow(_counted(slices), _ROWS)
    return materialize(parts.groupBy("kind", "slice").applyInArrow(_slice_model, _MODEL)), slices


def word_arrays(rows: pa.Table) -> tuple:
    """Keys and counts of a shard of the words: plain arrays, which any worker can read."""
    parts = rows.sort_by("slice")
    keys = np.frombuffer(b"".join(x.as_py() for x in parts.column("keys")), np.uint64)
    return keys, np.frombuffer(b"".join(x.as_py() for x in parts.column("counts")), np.uint32)


class Words:
    """Exact counts of a shard of the words."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts

    def of(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.keys, tokens), len(self.keys) - 1)
        return np.where(self.keys[at] == tokens, self.counts[at], 0).astype(np.int64)


def filter_arrays(rows: pa.Table, slices: int) -> tuple:
    """Shift, sizes, starts and bits of a shard of the histories: plain arrays, which any worker can read."""
    size, start = np.zeros(slices, np.uint64), np.zeros(slices, np.int64)
    parts, at = [], 0
    for s, n, bits in zip(*(rows.column(c).to_pylist() for c in ("slice", "size", "bits"))):
        size[s], start[s] = n, at
        parts.append(bits)
        at += len(bits)
    return np.uint64(65 - slices.bit_length()), size, start, np.frombuffer(b"".join(parts) or b"\0", np.uint8)


class Filter:
    """The filters of a shard of the histories, one a slice."""

    def __init__(self, shift: np.uint64, size: np.ndarray, start: np.ndarray, bits: np.ndarray):
        self.shift, self.size, self.start, self.bits = shift, size, start, bits

    def levels(self, histories: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The level of each key, stored with its history (the upper 32 bits of a bigram's key)."""
        out = np.zeros(len(keys), np.int64)
        of = (histories >> self.shift).astype(np.int64)
        open_ = np.flatnonzero(self.size[of] > 0)
        level = 1
        while len(open_):
            size, start = self.size[of[open_]], self.start[of[open_]]
            found = np.ones(len(open_), bool)
            for at in _probes(keys[open_], level):
                bit = (at % size).astype(np.int64)
                found &= (self.bits[start + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 == 1
            open_ = open_[found]
            out[open_] = level
            level += 1
        return out


def _shards(model: DataFrame, kind: int) -> list[tuple[int, int]]:
    """Ranges of slices whose rows come to at most ``MAX_BYTES`` together (a slice is small)."""
    weight = F.coalesce(F.octet_length("keys"), F.lit(0)) + F.coalesce(F.octet_length("counts"), F.lit(0))
    sizes = model.filter(F.col("kind") == kind).select("slice", (weight + F.col("size") / 8).alias("n")).collect()
    ranges, lo, held = [], 0, 0.0
    for s, n in sorted((r["slice"], r["n"]) for r in sizes):
        if held and held + n > MAX_BYTES:
            ranges.append((lo, s))
            lo, held = s, 0.0
        held += n
    return [*ranges, (lo, 1 << 31)]


def _pass(texts: DataFrame, words, filters, totals, in_words, in_history, slices: int, base: bool) -> DataFrame:
    """What the words of one shard of words and one of histories add to each text's score."""
    n_all, v_all = totals
    shift = np.uint64(65 - slices.bit_length())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                yield score(whole.slice(start, 1000))

    def score(rows: pa.RecordBatch) -> pa.RecordBatch:
        tokens, sizes = token_hashes(rows.column("text").to_pylist())
        keys = bigrams(tokens, sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        of_word = (tokens >> shift).astype(np.int64)
        mine = np.flatnonzero((of_word >= in_words[0]) & (of_word < in_words[1]))
        word, back = np.unique(tokens[mine], return_inverse=True)
        count = Words(*words.value).of(word)[back]
        share = (count + 1) / (n_all + v_all + 1)
        known = np.bincount(owner[mine], count > 0, len(sizes)).astype(np.int64)
        # without words of this shard the counts would be whole numbers
        base_sum = np.bincount(owner[mine], np.log10(share), len(sizes)).astype(float)
        of_history = (keys[mine] >> shift).astype(np.int64)
        here = (of_history >= in_history[0]) & (of_history < in_history[1])
        pair, back = np.unique(keys[mine][here], return_inverse=True)
        history, of = np.unique(pair >> np.uint64(32), return_inverse=True)
        lookup = Filter(*filters.value).levels
        at = history << np.uint64(32)
        seen = count_of(lookup(at, mix(history ^ _HISTORY)))
        types = np.where(seen > 0, count_of(lookup(at, mix(history ^ _TYPES))), 0)
        both = np.minimum(count_of(lookup(pair, mix(pair))), seen[of])
        p0 = share[here]
        below = (seen + types)[of][back]
        p = np.where(below > 0, (both[back] + types[of][back] * p0) / np.maximum(below, 1e-300), p0)
        p = np.where(p > 0, p, p0)  # a false positive of a history without followers
        total = np.bincount(owner[mine][here], np.log10(p), len(sizes)).astype(float)
        zero = np.zeros(len(sizes))
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), rows.column("node"), rows.column("held_out"), pa.array(sizes),
             pa.array(known if base else zero.astype(np.int64)), pa.array(base_sum if base else zero), pa.array(total)],
            names=["doc_id", "node", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    schema = "doc_id long, node long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return texts.mapInArrow(run, schema)


def score(documents: DataFrame, model: DataFrame, slices: int) -> DataFrame:
    """One row a document (``doc_id``, ``held_out``, ``text``) with its base score and its score."""
    context = documents.sparkSession.sparkContext
    of_words = model.filter("kind = 0").agg(
        F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))
    ).first()
    word_shards = _shards(model, 0)
    texts = documents.select("doc_id", F.xxhash64("text").alias("node"), "held_out", "text")
    filters = []
    for lo, hi in _shards(model, 1):
        rows = model.filter((F.col("kind") == 1) & (F.col("slice") >= lo) & (F.col("slice") < hi))
        filters.append(((lo, hi), context.broadcast(filter_arrays(rows.select("slice", "size", "bits").toArrow(), slices))))
    passes = None
    for lo, hi in word_shards:
        rows = model.filter((F.col("kind") == 0) & (F.col("slice") >= lo) & (F.col("slice") < hi))
        words = context.broadcast(word_arrays(rows.select("slice", "keys", "counts").toArrow()))
        for number, (of_history, sent) in enumerate(filters):
            one = _pass(texts, words, sent, (of_words[0], of_words[1]), (lo, hi), of_history, slices, number == 0)
            passes = one if passes is None else passes.union(one)
    n_passes = len(filters) * len(word_shards)
    if n_passes > 1:
        # rows that repeat id and text fall together here and are dealt out again
        times = (F.count("*") / n_passes).cast("int")
        passes = passes.groupBy("doc_id", "node", "held_out", "n_tokens").agg(
            *[(F.sum(c) / times).alias(c) for c in ("n_known", "base_score", "score")], times.alias("times")
        )
        passes = passes.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return passes.select(
        "doc_id", "held_out", "n_tokens", F.col("n_known").cast("long").alias("n_known"),
        F.lit(of_words[0]).cast("long").alias("train_tokens"), "base_score", "score",
    )


def with_fold(documents: DataFrame) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    return documents.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "text")


def op8_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = with_fold(table(spark, sf_dir, "documents"))
    return score(documents, *train(documents.filter(~F.col("held_out"))))


QUERIES = {"op8_bloom_lm": (op8_bloom_lm, None)}
