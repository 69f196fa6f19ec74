"""URL filter by a cascade of Bloom filters.

Level 0 holds the listed keys, level 1 those other keys of the corpus that level 0
takes for listed, level 2 the listed keys that level 1 takes for others, and so on
until a level has no false positive left. A key of the universe is listed just when
the first level that misses it has an odd number (counting a miss after the last
level), so membership is exact for every key the corpus can ask about, and judging
a URL is a probe of bit arrays: no join, no shuffle.

The bits come to about ``1.44 * log2(others / listed)`` a listed key. They are
broadcast, so their size is bounded: beyond ``MAX_BITS`` the keys are dealt to
shards by hash and judged shard by shard, each with a broadcast within the bound.

A null URL, or one without ``://``, has an empty host and path and fits no rule.
Empty tables of pages or of listed keys give empty results and empty cascades.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift.llm.base import Shared, arrow_map, ascii_lower, table
from rolesift.session import materialize, release

# bits of all levels of one shard: 16 MB
MAX_BITS = 1 << 27
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# a host is put on the block list if one of its words is among these
BAD_WORDS = ("casino", "bet", "bets", "pills", "porn", "xxx", "viagra", "poker", "warez")
_SEED = 7


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(_SEED)).alias("h2")]


def places(h1: np.ndarray, h2: np.ndarray, level: int, n_hashes: int, size: int) -> Iterator[np.ndarray]:
    """The bits of keys in a filter; each level hashes anew, or its false positives would stay."""
    for i in range(n_hashes):
        x = h1.view(np.uint64) ^ np.uint64((64 * level + i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
        x ^= (x >> np.uint64(31)) ^ h2.view(np.uint64)
        yield (x % np.uint64(size)).astype(np.int64)


@dataclass
class Level:
    """One Bloom filter: ``n_hashes`` bits a key among ``size``."""

    number: int
    size: int
    n_hashes: int
    words: np.ndarray

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), bool)
        for bit in places(h1, h2, self.number, self.n_hashes, self.size):
            found &= (self.words[bit >> 6] >> (bit & 63)) & 1 == 1
        return found


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether each key of the universe is listed, by its two hashes."""
        first_miss = np.full(len(h1), len(self.levels))
        open_ = np.arange(len(h1))
        for i, level in enumerate(self.levels):
            held = level.holds(h1[open_], h2[open_])
            first_miss[open_[~held]] = i
            open_ = open_[held]
        return first_miss % 2 == 1


def _size(keys: int, rate: float) -> tuple[int, int]:
    n_hashes = max(1, round(-math.log2(rate)))
    return max(64, math.ceil(keys * n_hashes / math.log(2))), n_hashes


def _level(keys: DataFrame, number: int, count: int, rate: float) -> Level:
    """A filter of the keys. Tasks combine their bits to words of 64 before the shuffle;
    the driver gets the words of a filter of bounded size, never the keys."""
    size, n_hashes = _size(count, rate)

    def batch(rows: pa.RecordBatch) -> dict:
        h1, h2 = (rows.column(c).to_numpy() for c in ("h1", "h2"))
        bits = np.unique(np.concatenate(list(places(h1, h2, number, n_hashes, size))))
        words, first = np.unique(bits >> 6, return_index=True)
        return {"word": words, "bits": np.bitwise_or.reduceat(np.left_shift(1, bits & 63), first)}

    parts = arrow_map(keys.select("h1", "h2"), batch, "word long, bits long")
    got = parts.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros((size >> 6) + 1, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return Level(number, size, n_hashes, out)


def build(listed: DataFrame, universe: DataFrame) -> list[Cascade]:
    """Cascades over the universe of keys, one a shard; both frames have a column ``key``.

    Listed keys outside the universe do no harm; they are encoded as well.
    """
    both = listed.select(*hashes(F.col("key")), F.lit(1).alias("on")).union(
        universe.select(*hashes(F.col("key")), F.lit(0).alias("on"))
    )
    keys = materialize(both.groupBy("h1", "h2").agg(F.max("on").alias("on")))
    counts = {r["on"]: r["count"] for r in keys.groupBy("on").count().collect()}
    n_on, n_off = counts.get(1, 0), counts.get(0, 0)
    # a first level this tight leaves about as many others as half the listed keys
    first = min(0.5, max(2.0**-30, n_on / (2 * max(n_off, 1))))
    shards = max(1, math.ceil(3 * _size(n_on, first)[0] / MAX_BITS))
    cascades = []
    for shard in range(shards):
        mine = keys.filter(shard_of(shards) == shard)
        cascade = Cascade()
        while n_on:
            i = len(cascade.levels)
            alive = mine.filter(F.col("on") == 1 - i % 2)
            if i:
                alive = arrow_map(alive, _held_by_all(cascade.levels), "h1 long, h2 long, on int")
            count = alive.count()
            if not count:
                break
            cascade.levels.append(_level(alive, i, count, first if i == 0 else 0.5))
        cascades.append(cascade)
    release(keys)
    return cascades


def shard_of(shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned("h2", 17), F.lit(shards))


def _held_by_all(levels: Sequence[Level]):
    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        h1, h2 = (rows.column(c).to_numpy() for c in ("h1", "h2"))
        keep = np.ones(len(h1), bool)
        for level in levels:
            keep &= level.holds(h1, h2)
        return rows.filter(pa.array(keep))

    return batch


def probe(rows: DataFrame, cascades: Sequence[Cascade], name: str) -> DataFrame:
    """Add to rows with arrays ``h1`` and ``h2`` of key hashes the array ``name``: which keys are listed."""
    context = rows.sparkSession.sparkContext
    kind = rows.schema
    for shard, cascade in enumerate(cascades):
        sent = Shared(context, cascade)
        columns = rows.columns

        def batch(part: pa.RecordBatch, shard=shard, sent=sent, n=len(cascades), columns=columns) -> dict:
            lists = part.column(columns.index("h1"))
            h1, h2 = (part.column(columns.index(c)).flatten().to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            found = sent.value.listed(h1, h2) & ((h2.view(np.uint64) >> np.uint64(17)) % np.uint64(n) == shard)
            if shard:
                found |= part.column(columns.index(name)).flatten().to_numpy(zero_copy_only=False)
            lengths = np.diff(lists.offsets.to_numpy())
            offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
            out = {c: part.column(k) for k, c in enumerate(columns)}
            out[name] = pa.ListArray.from_arrays(offsets, pa.array(found))
            return out

        schema = kind if shard else T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.BooleanType()))])
        rows = arrow_map(rows, batch, schema)
        kind = rows.schema
        if shard < len(cascades) - 1:  # one shard's bits in a task at a time
            rows = materialize(rows)
    return rows


def candidates(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """The strings a rule of this URL can be: each domain the host lies in, with each
    path prefix of a length that rules have."""
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull()
    )
    return F.flatten(F.transform(domains, lambda d: F.transform(prefixes, lambda p: F.concat(d, p))))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], bad_hosts: DataFrame) -> DataFrame:
    """Host, path, rule and verdict of each page's url, beside its ``page_id``.

    ``rules`` are strings of a host and a path, each to allow or block; the longest
    that fits wins, for a tie the later string in order. Without a rule a page is
    blocked just when its host is among ``bad_hosts`` (column ``key``). Rules and
    hosts are looked up in cascades only.
    """
    spark = pages.sparkSession
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    lengths = sorted({len(rule) - rule.index("/") for rule, _ in rules})
    rows = urls.withColumn("keys", candidates(F.col("host"), F.col("path"), lengths))
    fits = []
    universe = rows.select(F.explode("keys").alias("key"))
    for verdict in ("allow", "block"):
        mine = [(rule,) for rule, v in rules if v == verdict]
        fits.append((verdict, build(spark.createDataFrame(mine, "key string"), universe)))
    hosts = build(bad_hosts.select("key"), urls.select(F.col("host").alias("key")))
    h1 = F.transform("keys", lambda k: F.xxhash64(k))
    h2 = F.transform("keys", lambda k: F.xxhash64(k, F.lit(_SEED)))
    rows = rows.withColumns({"h1": h1, "h2": h2})
    for verdict, cascades in fits:
        rows = probe(rows, cascades, verdict)
    at_host = {"h1": F.array(F.xxhash64("host")), "h2": F.array(F.xxhash64("host", F.lit(_SEED)))}
    rows = probe(rows.withColumns(at_host), hosts, "bad")
    hits = F.filter(
        F.transform(F.arrays_zip("keys", "allow", "block"), lambda k: F.struct(
            F.length(k["keys"]).alias("n"), k["keys"].alias("rule"), k["allow"].alias("allow"),
            (k["allow"] | k["block"]).alias("hit"))),
        lambda k: k["hit"],
    )
    best = F.array_max(hits)
    own = F.when(F.element_at("bad", 1), "block").otherwise("allow")
    return rows.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.when(F.col("best").isNull(), own).when(F.col("best.allow"), "allow").otherwise("block").alias("verdict"),
    )


def hosts_with_words(pages: DataFrame, words: Sequence[str] = BAD_WORDS) -> DataFrame:
    """The block list of a corpus: its hosts with a word (between dots and hyphens) of a list."""
    host = host_of(F.col("url"))
    return pages.filter(F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*map(F.lit, words)))).select(
        host.alias("key")
    )


def op1_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, RULES, hosts_with_words(pages))


_SQL = """
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '(^|[.-])(casino|bet|bets|pills|porn|xxx|viagra|poker|warez)([.-]|$)') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""

QUERIES = {"op1_url_cascade": (op1_url_cascade, _SQL)}
