"""Near-duplicate documents by DartMinHash.

A document is the weighted set of its shingles of five words. Darts are thrown, the
same ones for every document, into the space of elements, weights and ranks: each
unit of an element's weight is cut along the rank axis into regions of doubling
width, and a hash of the region says how many darts fall there and where. A document
keeps the darts below its weights; of those that name a coordinate the one of least
rank is the document's value there. Two documents agree in a coordinate with
probability equal to their weighted Jaccard similarity. About ``k ln k + 2 k`` darts
fill ``k`` coordinates, however long the text is.

Coordinates are grouped in bands; texts that agree in a band are candidates. With 67
bands of 7, a pair of similarity 0.8 shares none with probability 1.4e-7. Each bucket
first compares its members with one pivot, the member that meets most others, so a
large group of near copies costs one comparison a member. Members that still share a
bucket with another class may be linked to it by a text other than the pivot. They are
joined exactly, whatever the size of the bucket: shingles are ordered by how few of
these texts hold them, similar texts must share one of their rarest fifth, and its
places in the two orders bound what they share in all. A passage that many texts quote
comes last in this order, and a copy with many changes of its own has nothing but them
among its rarest, so neither brings near misses together.
Candidates are verified on the whole texts, and classes are the connected components
of the links. Equal texts are one node throughout (by a 64-bit hash).

A text of fewer than five words is one shingle. A text without words is in no link
but with its exact copies. Null text counts as empty. Every row gets a class;
``class_id`` is the least ``doc_id`` in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolesift.llm.base import arrow_map, table
from rolesift.llm.components import components
from rolesift.session import broadcast_if_small, materialize, release

SHINGLE = 5
SIMILARITY = 0.8
# no band of 67 is shared with probability 1.4e-7 at that similarity
BANDS, ROWS = 67, 7
# words and texts whose signatures or shingles are made at once: darts are many for each text, short or long
_CHUNK, _CHUNK_TEXTS = 100_000, 150
# two numbers a row: 16 MB
_BROADCAST_IDS = 1_000_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _word_table() -> bytes:
    """Words are runs of letters, digits and bytes beyond ASCII; A-Z become a-z, the rest spaces."""
    return bytes(
        c | 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
    )


_WORDS = _word_table()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: Sequence[Sequence[bytes]], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of every shingle of some texts given as words, repeats included."""
    import xxhash

    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for t in texts for w in t), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(hashed)) - (ends - sizes)[owner]
    count = np.minimum(width, sizes)[owner]
    kept = place + count <= sizes[owner]
    out = np.zeros(len(hashed), np.uint64)
    for k in range(width):
        shifted = np.zeros(len(hashed), np.uint64)
        shifted[: max(0, len(hashed) - k)] = hashed[k:]
        out = np.where(k < count, mix(out * np.uint64(31) + shifted), out)
    return owner[kept], out[kept]


def weighted(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, times) of each distinct shingle of each owner."""
    if not len(owner):
        return owner, hashes, np.zeros(0, np.int64)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1]))))
    return owner[first], hashes[first], np.diff(np.append(first, len(owner)))


# a plain table, not a cache of functools, which workers could only import
_POISSON: dict[float, np.ndarray] = {}


def _poisson(mean: float) -> np.ndarray:
    """The distribution function of a Poisson number, as far as it matters."""
    if mean not in _POISSON:
        top = int(mean + 12 * math.sqrt(mean) + 20)
        logs = [i * math.log(mean) - mean - math.lgamma(i + 1) for i in range(top)]
        _POISSON[mean] = np.cumsum(np.exp(logs))
    return _POISSON[mean]


def signatures(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """The ``n`` owners' signatures of ``k`` coordinates from sorted (owner, element, weight) rows.

    Weights are positive reals. An owner without elements has zeros.
    """
    best = np.full(n * k, np.inf)
    value = np.zeros(n * k, np.uint64)
    total = np.bincount(owner, weights, n)
    darts = k * math.log(k) + 2 * k
    todo = np.flatnonzero(total > 0)
    while len(todo):
        # in units of 1 / k: below this rank an owner expects so many darts
        limit = np.zeros(n)
        limit[todo] = darts / total[todo]
        mine = limit[owner] > 0
        units = np.ceil(weights[mine]).astype(np.int64)
        of = np.repeat(np.flatnonzero(mine), units)
        level_of_weight = np.arange(len(of)) - np.repeat(np.cumsum(units) - units, units)
        slot = mix(elements[of] + (level_of_weight.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
        top = limit[owner[of]]
        low, width, region = 0.0, 1.0, 0
        while len(of):
            seed = mix(slot ^ np.uint64((region + 1) * 0xD1B54A32D192ED03 & (2**64 - 1)))
            share = (seed >> np.uint64(11)).astype(float) * 2.0**-53
            number = np.searchsorted(_poisson(width), share, "right")
            at = np.repeat(np.arange(len(of)), number)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)
            dart = mix(seed[at] + (nth.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
            rank = low + width * ((dart >> np.uint64(32)).astype(float) * 2.0**-32)
            keep = rank < top[at]
            at, dart, rank = at[keep], dart[keep], rank[keep]
            height = (mix(dart) >> np.uint64(11)).astype(float) * 2.0**-53 + level_of_weight[at]
            keep = height < weights[of[at]]
            at, dart, rank = at[keep], dart[keep], rank[keep]
            place = owner[of[at]] * k + ((dart & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, place, rank)
            won = rank == best[place]
            value[place[won]] = dart[won]
            low, width, region = low + width, low + width, region + 1
            more = top > low
            of, slot, top, level_of_weight = of[more], slot[more], top[more], level_of_weight[more]
        filled = np.isfinite(best).reshape(n, k).all(1)
        todo = todo[~filled[todo]]
        darts *= 2
    return value.reshape(n, k)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band."""
    parts = signature.reshape(len(signature), bands, rows)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN), parts.shape[:2]).copy()
    for r in range(rows):
        out = mix(out * np.uint64(31) + parts[:, :, r])
    return out.view(np.int64)


def _signed(rows: pa.RecordBatch, bands: int, n_rows: int) -> pa.RecordBatch:
    """Hash of the text, number of shingles and band keys of each row."""
    texts = rows.column("text")
    sizes, keys = [], []
    chunk: list[list[bytes]] = []
    held = 0

    def flush():
        nonlocal chunk, held
        owner, hashed = shingles(chunk)
        sizes.append(np.bincount(owner, minlength=len(chunk)))
        keys.append(band_keys(signatures(*weighted(owner, hashed), len(chunk), bands * n_rows), bands, n_rows))
        chunk, held = [], 0

    for text in texts:
        chunk.append(words_of(text.as_py()))
        held += len(chunk[-1])
        if held > _CHUNK or len(chunk) >= _CHUNK_TEXTS:
            flush()
    if chunk:
        flush()
    flat = np.concatenate(keys)
    offsets = pa.array(np.arange(len(flat) + 1) * bands, pa.int32())
    return pa.RecordBatch.from_arrays(
        [rows.column("doc_id"), rows.column("node"), pa.array(np.concatenate(sizes), pa.int64()),
         pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))],
        names=["doc_id", "node", "n", "bands"],
    )


def similarity(a: Sequence[bytes], b: Sequence[bytes]) -> float:
    """Weighted Jaccard similarity of two texts' shingles, each as often as it occurs."""
    owner, hashed = shingles([a, b])
    owner, hashed, times = weighted(owner, hashed)
    x, y, cx, cy = hashed[owner == 0], hashed[owner == 1], times[owner == 0], times[owner == 1]
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(cx[i], cy[j]).sum())
    return shared / max(1, int(times.sum()) - shared)


def _texts_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``(node, text)`` of the nodes, once each, staged."""
    mine = broadcast_if_small(nodes, _BROADCAST_IDS)
    return materialize(texts.join(mine, "node", "left_semi").dropDuplicates(["node"]))


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose texts ``(node, text)`` are similar enough, staged."""

    def batch(rows: pa.RecordBatch) -> dict:
        keep, last, words = [], None, []
        for a, b in zip(rows.column("ta"), rows.column("tb")):
            ta = a.as_py()
            if ta != last:
                last, words = ta, words_of(ta)
            keep.append(similarity(words, words_of(b.as_py())) >= least)
        mask = pa.array(keep, pa.bool_())
        return {"a": rows.column("a").filter(mask), "b": rows.column("b").filter(mask)}

    mine = _texts_of(pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("node")), texts)
    joined = pairs.join(mine.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(
        mine.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a"
    )
    links = materialize(arrow_map(joined.select("a", "b", "ta", "tb"), batch, "a long, b long"))
    release(mine)
    return links


def _elements(texts: DataFrame) -> DataFrame:
    """``(node, element)`` of each shingle of the texts; each further copy of a shingle is an element of its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            owner, hashed, times = weighted(*shingles(chunk))
            nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            element = mix(np.repeat(hashed, times) + nth.astype(np.uint64) * _GOLDEN)
            node = np.array(of, np.int64)[np.repeat(owner, times)]
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(element.view(np.int64))], ["node", "element"])

        for rows in batches:
            chunk, of, held = [], [], 0
            for node, text in zip(rows.column("node"), rows.column("text")):
                of.append(node.as_py())
                chunk.append(words_of(text.as_py()))
                held += len(chunk[-1])
                if held > _CHUNK:
                    yield flush()
                    chunk, of, held = [], [], 0
            if chunk:
                yield flush()

    return texts.mapInArrow(run, "node long, element long")


def _across(unsettled: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs of nodes of different classes that can be similar enough, from ``(node, n, root)``, staged.

    The elements of two such texts, in any one order, have a first one in common. It
    is among the first ``n - least * n + 1`` of both, and no more follow it in either
    than the similarity needs. In order of frequency few texts share it.
    """
    mine = _texts_of(unsettled.select("node"), texts)
    elements = _elements(mine)
    frequent = elements.groupBy("element").agg(F.count("*").alias("of")).filter("of > 1")
    common = materialize(elements.join(frequent, "element"))
    release(mine)
    # elements of one text only come first and match nothing
    order = Window.partitionBy("node").orderBy("of", "element")
    ranked = common.withColumn("nth", F.row_number().over(order)).withColumn(
        "common", F.count("*").over(Window.partitionBy("node"))
    )
    prefix = ranked.join(unsettled, "node").select(
        "element", "node", "n", "root", (F.col("n") - F.col("common") + F.col("nth") - 1).alias("at")
    ).filter(F.col("n") - F.col("at") >= F.lit(least) * F.col("n") - 1e-6)
    prefix = materialize(prefix)
    release(common)
    mixed = prefix.groupBy("element").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    placed = materialize(prefix.join(mixed.select("element"), "element"))
    release(prefix)
    other = placed.select(
        "element", F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("at").alias("bt")
    )
    needed = F.lit(least / (1 + least)) * (F.col("n") + F.col("m")) - 1e-6
    pairs = placed.join(other, "element").filter(
        (F.col("root") < F.col("other")) & (F.least(F.col("n") - F.col("at"), F.col("m") - F.col("bt")) >= needed)
    )
    pairs = materialize(pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct())
    release(placed)
    return pairs


def _classes(documents: DataFrame, least: float, bands: int, rows: int) -> DataFrame:
    """``(doc_id, node, root)`` of every document, staged."""
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("node"), "text")
    signed = arrow_map(texts, lambda b: _signed(b, bands, rows), "doc_id long, node long, n long, bands array<long>")
    signed = materialize(signed.withColumn("nth", F.monotonically_increasing_id()))
    # the first row of each text stands for it; only the numbers of texts that come again are moved for that
    again = signed.filter("n > 0").groupBy("node").agg(F.min("nth").alias("first"), F.count("*").alias("times"))
    again = materialize(again.filter("times > 1").select("node", "first"))
    nodes = signed.filter("n > 0").join(broadcast_if_small(again, _BROADCAST_IDS), "node", "left")
    nodes = nodes.filter("first is null or first = nth")
    buckets = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    # bands move once: a bucket is counted where its rows are
    met = buckets.withColumn("of", F.count("*").over(Window.partitionBy("bucket"))).filter("of > 1")
    met = materialize(met.select("bucket", "node", "n", "of"))
    release(again)
    # the member that meets most others is the likeliest to be near all of them: of many
    # copies of one text, each changed elsewhere, it is that text
    degree = met.groupBy("node").agg(F.sum("of").alias("degree"))
    ranked = met.join(degree, "node").select("bucket", "node", "n", "degree")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "node", "n")).alias("p"))
    pivots = pivots.select("bucket", F.col("p.node").alias("pivot"), F.col("p.n").alias("m"))
    first = materialize(
        met.join(pivots, "bucket")
        .filter((F.col("node") != F.col("pivot")) & (F.least("n", "m") >= least * F.greatest("n", "m")))
        .select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))
        .distinct()
    )
    by_text = texts.select("node", "text")
    links = verified(first, by_text, least)
    roots = components(links)
    placed = met.join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    open_buckets = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    unsettled = materialize(placed.join(open_buckets.select("bucket"), "bucket").select("node", "n", "root").distinct())
    release(met, first)
    rest = _across(unsettled, by_text, least)
    more = verified(rest, by_text, least)
    release(unsettled, rest)
    if more.limit(1).count():
        release(roots)
        roots = components(links.union(more))
    labelled = signed.select("doc_id", "node").join(roots, "node", "left")
    labelled = materialize(labelled.select("doc_id", "node", F.coalesce("root", "node").alias("root")))
    release(signed, links, more, roots)
    return labelled


def near_duplicates(
    documents: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``doc_id, class_id, class_size`` of every document, with the hash of its text and that naming its class."""
    return _sized(_classes(documents, least, bands, rows))


def _sized(labelled: DataFrame) -> DataFrame:
    classes = labelled.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return labelled.join(classes, "root").select(
        "doc_id", "class_id", "class_size", "node", F.col("root").alias("class_node")
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each class of near duplicates, that of the least ``doc_id``, with all columns.

    Documents without words have nothing in common and stay. Of rows that repeat
    both id and text one stays.
    """
    labelled = _classes(documents, SIMILARITY, BANDS, ROWS)
    classes = labelled.withColumnRenamed("root", "class_node")
    first = classes.groupBy("class_node").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "node")).alias("first")
    )
    counted = classes.groupBy("doc_id", "node", "class_node").agg(F.count("*").alias("times"))
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "node")
    marked = materialize(
        counted.join(first, "class_node").select("doc_id", "node", "times", (place == F.col("first")).alias("stays"))
        .filter("times > 1 or not stays")
    )
    release(labelled)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.struct(*documents.columns).alias("row"), F.col("doc_id").alias("d"), F.xxhash64(text).alias("h"))

    def among(some: DataFrame, how: str) -> DataFrame:
        side = broadcast_if_small(some.select("doc_id", "node"), _BROADCAST_IDS)
        return rows.join(side, rows["d"].eqNullSafe(side["doc_id"]) & (rows["h"] == side["node"]), how)

    alone = among(marked, "left_anti").select("row.*")
    again = marked.filter("stays")  # rows that repeat id and text of one that stays
    if again.limit(1).count():
        alone = alone.union(among(again, "left_semi").dropDuplicates(["d", "h"]).select("row.*"))
    return alone


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("node", "class_node")


_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM d),
s AS (SELECT r, unnest([array_to_string(w[i:i + 4], ' ') for i in generate_series(1, greatest(len(w) - 4, 1))]) AS s
      FROM w WHERE len(w) > 0),
c AS (SELECT r, s, count(*) AS c FROM s GROUP BY ALL),
n AS (SELECT r, sum(c) AS n FROM c GROUP BY r),
p AS (SELECT x.r AS a, y.r AS b, sum(least(x.c, y.c)) AS m FROM c x JOIN c y ON x.s = y.s AND x.r < y.r GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE m >= 0.8 * (na.n + nb.n - m)
      UNION SELECT x.r, y.r FROM d x JOIN d y ON x.text = y.text AND x.r < y.r),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t AS (SELECT r AS a, r AS b FROM d UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
k AS (SELECT a, min(b) AS root FROM t GROUP BY a),
z AS (SELECT root, min(doc_id) AS class_id, count(*) AS class_size FROM k JOIN d ON d.r = k.a GROUP BY root)
SELECT doc_id, class_id, class_size FROM d JOIN k ON k.a = d.r JOIN z USING (root)
"""

QUERIES = {"op4_dart_minhash": (op4_dart_minhash, _SQL)}
