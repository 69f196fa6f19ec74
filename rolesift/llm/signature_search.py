"""Ranked lexical search over bit-sliced Bloom signatures.

A document's signature is a Bloom filter of its terms, and again of those terms that occur
twice, four, eight and sixteen times or more. Signatures of one size are stored in blocks
as slices: one bitmap over the block's documents for each bit. The documents that may hold
a term so often are the AND of a few slices; they are all that do and a few that do not.

For an item the weights of its terms are summed over these bitmaps, level by level, and
each level's sum counts with the most that a document of this length gains from so many
occurrences. That is an upper bound of the score. The documents of the highest bounds are
scored exactly from their whole texts, which gives each item a score its twentieth document
reaches for certain; every document whose bound does not fall short of it is scored exactly
as well. What is left out is provably not among the best, so the ranking is exact.

The index is made once in a pass over the texts, holds every document and knows nothing of the items,
which are searched in blocks of bounded size; an item block's terms are all that is broadcast.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.
Documents of a null or empty text have no terms and are never found; those without an id
count in the statistics but are not ranked. Rows that share an id are documents of their
own. Items of the same id and text are one; an item without terms finds nothing. Empty
tables give an empty ranking. Other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolesift.llm.base import best_of_slots, table
from rolesift.session import broadcast_if_small, materialize, release, shared_folder

TOP = 20
HASHES = 4  # slices a term and level names
LEVELS = 5  # occurrences 1, 2, 4, 8 and 16 or more
KEY_BITS = 8  # bits a key at least; sizes are powers of two
BLOCK_DOCS, BLOCK_BITS = 4096, 1 << 22  # documents and bits of a block at most
ITEMS, ITEM_TERMS = 512, 1 << 15  # items and terms of an item block, about
CACHED = 1 << 19  # terms whose hash a task remembers
INDEX = "size int, ids array<long>, lengths array<long>, most array<long>, slices binary"

_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_SPLIT).split() if text else []


def places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    """The slices of each key: ``HASHES`` rows of one column a key."""
    x = hashes ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    step = (x >> np.uint64(32)) | np.uint64(1)
    rounds = np.arange(HASHES, dtype=np.uint64)[:, None]
    return ((x + rounds * step) & np.uint64(size - 1)).astype(np.int64)


def slices_of(hashes: list[np.ndarray], counts: list[np.ndarray], size: int) -> np.ndarray:
    """The bitmaps of a block, one row a bit of the signature, one bit a document."""
    bits = np.zeros((size, -(-len(hashes) // 8) * 8), bool)
    docs = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    keys, often = np.concatenate(hashes), np.concatenate(counts)
    for level in range(LEVELS):
        held = often >= 1 << level
        bits[places(keys[held], level, size), docs[held]] = True
    return np.packbits(bits, axis=1, bitorder="little")


def build_index(docs: DataFrame) -> DataFrame:
    """Blocks of signatures of all documents that have an id or a term; statistics are read from it as well."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        waiting: dict[int, list] = {}

        def block(size: int) -> pa.RecordBatch:
            ids, lengths, most, hashes, counts = zip(*waiting.pop(size))
            bitmaps = slices_of(list(hashes), list(counts), size)
            return pa.RecordBatch.from_pydict(
                {
                    "size": pa.array([size], pa.int32()), "ids": pa.array([ids], pa.list_(pa.int64())),
                    "lengths": pa.array([lengths], pa.list_(pa.int64())), "most": pa.array([most], pa.list_(pa.int64())),
                    "slices": pa.array([bitmaps.tobytes()], pa.binary()),
                }
            )

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                terms = terms_of(text.as_py())
                if not terms:
                    continue
                held = Counter(terms)
                if len(known) > CACHED:
                    known.clear()
                for term in held:
                    if term not in known:
                        known[term] = xxhash.xxh3_64_intdigest(term)
                hashes = np.fromiter(map(known.__getitem__, held), np.uint64, len(held))
                counts = np.fromiter(held.values(), np.int64, len(held))
                keys = sum(int((counts >= 1 << level).sum()) for level in range(LEVELS))
                size = max(64, 1 << (KEY_BITS * keys - 1).bit_length())
                waiting.setdefault(size, []).append((doc_id, len(terms), int(counts.max()), hashes, counts))
                if len(waiting[size]) >= max(8, min(BLOCK_DOCS, BLOCK_BITS // size)):
                    yield block(size)
        for size in sorted(waiting):
            yield block(size)

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, INDEX))


def statistics(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)
    row = index.agg(F.sum(F.size("lengths")), F.sum(total)).first()
    return row[0] or 0, row[1] or 0


def frequencies(docs: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """In how many documents each term of a bounded vocabulary occurs; counted in the tasks first."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, found = frozenset(sent.value), Counter()
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                found.update(asked.intersection(terms_of(text.as_py())))
        yield pa.RecordBatch.from_pydict({"term": pa.array(found.keys(), pa.binary()), "df": pa.array(found.values(), pa.int64())})

    got = docs.select("text").mapInArrow(task, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r["term"]): r["df"] for r in got.collect()}  # no more rows than the vocabulary


def slice_sums(bitmaps: np.ndarray, terms: np.ndarray, postings, n_items: int) -> np.ndarray:
    """For each item and document of a block the weights of the item's terms whose bitmap has the document.

    ``postings`` are, by term, where its items start, the items and the weights. Dense
    bitmaps are summed as one matrix product, the few bits of the others one by one.
    """
    starts, items, weights = postings
    n_docs = bitmaps.shape[1] * 8
    dense = np.bitwise_count(bitmaps).sum(axis=1) * 16 > n_docs
    matrix = np.zeros((n_items, int(dense.sum())))
    for column, term in enumerate(terms[dense]):
        at = slice(starts[term], starts[term + 1])
        matrix[items[at], column] = weights[at]
    out = matrix @ np.unpackbits(bitmaps[dense], axis=1, bitorder="little").astype(np.float64)
    row, byte = np.nonzero(bitmaps[~dense])
    entry, bit = np.nonzero(np.unpackbits(bitmaps[~dense][row, byte][:, None], axis=1, bitorder="little"))
    term, doc = terms[~dense][row[entry]], byte[entry] * 8 + bit
    often = starts[term + 1] - starts[term]
    at = np.repeat(starts[term] - np.r_[0, np.cumsum(often)[:-1]], often) + np.arange(often.sum()) if len(term) else term
    cells = items[at] * n_docs + np.repeat(doc, often)
    return out + np.bincount(cells, weights[at], n_items * n_docs).reshape(n_items, n_docs)


def gain(often, length_factor):
    """What ``often`` occurrences of a term count."""
    return 1_000_000_000 * often // (1000 * often + 12 * length_factor)


def upper_bounds(size: int, lengths, most, slices: np.ndarray, asked) -> np.ndarray:
    """Bounds of the scores of all items (rows) for all documents of a block (columns)."""
    hashes, postings, n_items, n_docs, n_terms = asked
    factor = 75 + 25 * lengths * n_docs // max(n_terms, 1)
    terms, bitmaps = np.arange(len(hashes)), None
    out = np.zeros((n_items, slices.shape[1] * 8), np.int64)
    before = np.zeros_like(lengths)
    for level in range(LEVELS):
        found = np.bitwise_and.reduce(slices[places(hashes[terms], level, size)], axis=0)
        if bitmaps is not None:
            found &= bitmaps
        some = found.any(axis=1)
        terms, bitmaps = terms[some], found[some]
        if not len(terms):
            break
        most_here = most if level == LEVELS - 1 else np.minimum(most, (2 << level) - 1)
        gained = gain(most_here, factor)
        sums = slice_sums(bitmaps, terms, postings, n_items).astype(np.int64)
        out[:, : len(lengths)] += sums[:, : len(lengths)] * (gained - before)
        before = gained
    return out[:, : len(lengths)]


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Size, ids, lengths, most frequent term's count, slices, of documents that have an id."""
    for batch in batches:
        for row in range(batch.num_rows):
            size, ids, lengths, most, raw = (batch.column(c)[row] for c in ("size", "ids", "lengths", "most", "slices"))
            slices = np.frombuffer(raw.as_buffer(), np.uint8).reshape(size.as_py(), -1)
            named = ids.values.is_valid().to_numpy(zero_copy_only=False)
            yield (
                size.as_py(), np.where(named, ids.values.fill_null(0).to_numpy(), 0), lengths.values.to_numpy(),
                most.values.to_numpy(), slices, named,
            )


def highest_bounds(index: DataFrame, sent, k: int) -> DataFrame:
    """For each item the ``k`` documents of the highest bounds: ``item``, ``doc_id``."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(size, ids, lengths, most, slices, named):
            def entries(least):
                bounds = upper_bounds(size, lengths, most, slices, sent.value)
                item, doc = np.nonzero((bounds >= np.maximum(least, 1)[:, None]) & named)
                yield item, bounds[item, doc], ids[doc]

            return entries

        n_items = sent.value[2]
        items, bounds, ids = best_of_slots((part(*b) for b in _blocks(batches)), n_items, k)
        yield pa.RecordBatch.from_pydict({"item": items, "doc_id": ids, "bound": bounds})

    found = index.mapInArrow(task, "item long, doc_id long, bound long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k).select("item", "doc_id")


def not_excluded(index: DataFrame, sent, least: np.ndarray, least_id: np.ndarray) -> DataFrame:
    """All documents whose bound is above an item's certain score, or equals it with no greater id."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, ids, lengths, most, slices, named in _blocks(batches):
            bounds = upper_bounds(size, lengths, most, slices, sent.value)
            fits = (bounds > least[:, None]) | ((bounds == least[:, None]) & (ids <= least_id[:, None]))
            item, doc = np.nonzero(fits & named)
            yield pa.RecordBatch.from_pydict({"item": item, "doc_id": ids[doc]})

    return index.mapInArrow(task, "item long, doc_id long")


def exact_scores(docs: DataFrame, pairs: DataFrame, items: list[Counter], weights: dict[bytes, int], n_docs: int, n_terms: int) -> DataFrame:
    """``item``, ``doc_id`` and ``score`` above 0 of pairs of an item and an id, from the whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(([dict(i) for i in items], weights))
    # an id meets the items of one block at most
    by_doc = broadcast_if_small(materialize(pairs.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("item").alias("items"))))
    rows = docs.select("doc_id", "text").join(by_doc, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "items")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = sent.value
        for batch in batches:
            found = []
            texts = batch.column("text").cast(pa.binary())
            for doc_id, text, wanted in zip(batch.column("doc_id").to_pylist(), texts, batch.column("items").to_pylist()):
                terms = terms_of(text.as_py())
                held, factor = Counter(terms), 75 + 25 * len(terms) * n_docs // max(n_terms, 1)
                for item in wanted:
                    score = sum(n * weight[t] * gain(held[t], factor) for t, n in asked[item].items() if t in held)
                    if score > 0:
                        found.append((item, doc_id, score))
            columns = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(("item", "doc_id", "score"), columns)})

    return rows.mapInArrow(task, "item long, doc_id long, score long")


def best(scored: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", place).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, index: DataFrame, asked: list[tuple], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The ranking of one block of items: ``item_id, rank, doc_id, score``."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    items = [Counter(terms) for _, terms in asked]
    vocabulary = sorted(set().union(*items))
    df = frequencies(docs, vocabulary)
    weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in vocabulary if t in df}
    known = [t for t in vocabulary if t in df]
    number = {t: i for i, t in enumerate(known)}
    triples = np.array(
        sorted((number[t], i, n * weights[t]) for i, item in enumerate(items) for t, n in item.items() if t in df), np.int64
    ).reshape(-1, 3)
    starts = np.searchsorted(triples[:, 0], np.arange(len(known) + 1))
    hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in known], np.uint64)
    postings = starts, triples[:, 1], triples[:, 2].astype(np.float64)
    sent = context.broadcast((hashes, postings, len(items), n_docs, n_terms))
    exact = lambda pairs: exact_scores(docs, pairs, items, weights, n_docs, n_terms)
    # the k-th exact score of each item among the documents of the highest bounds; at most k rows an item
    least, least_id = np.zeros(len(items), np.int64), np.full(len(items), -(2**63))
    for r in best(exact(highest_bounds(index, sent, k)), k).filter(F.col("rank") == k).collect():
        least[r["item"]], least_id[r["item"]] = r["score"], r["doc_id"]
    ranked = best(exact(not_excluded(index, sent, least, least_id)), k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(asked)], "item long, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item, score above 0.

    ``docs`` have ``doc_id`` and ``text``, ``items`` ``item_id`` and ``text``.
    """
    spark = docs.sparkSession

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [terms_of(t.as_py()) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_pydict(
                {"item_id": batch.column("item_id"), "terms": pa.array(terms, pa.list_(pa.binary())), "h": batch.column("h")}
            )

    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    wanted = materialize(wanted.withColumn("h", F.xxhash64("item_id", "text")).mapInArrow(cut, "item_id long, terms array<binary>, h long"))
    size = wanted.agg(F.count("*"), F.sum(F.size("terms"))).first()
    blocks = max(math.ceil(size[0] / ITEMS), math.ceil((size[1] or 0) / ITEM_TERMS))
    folder = f"{shared_folder(spark)}/staged/{uuid.uuid4().hex}"
    schema = "item_id long, rank int, doc_id long, score long"
    index = build_index(docs)
    n_docs, n_terms = statistics(index)
    for b in range(blocks):
        rows = wanted.filter(F.pmod("h", F.lit(blocks)) == b).select("item_id", "terms").collect()  # of bounded size
        asked = sorted(((r["item_id"], [bytes(t) for t in r["terms"]]) for r in rows), key=repr)
        if asked:
            _search_block(docs, index, asked, n_docs, n_terms, k).write.parquet(f"{folder}/block={b}")
    release(index, wanted)
    if not blocks or not _holds(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema + ", block int").parquet(folder).drop("block")


def _holds(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def op11_signature_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SQL = f"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS terms
  FROM documents),
d AS (SELECT *, len(terms) AS n FROM cut WHERE len(terms) > 0),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS all_terms FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (
  SELECT item_id, text, term, count(*) AS often FROM (
    SELECT item_id, text, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
s AS (
  SELECT item_id, text, r, sum(often * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // all_terms))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN d USING (r), c GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id, s.text ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM s JOIN d USING (r) WHERE score > 0 AND doc_id IS NOT NULL
QUALIFY rank <= 20
"""

QUERIES = {"op11_signature_search": (op11_signature_search, _SQL)}
