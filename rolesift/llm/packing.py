"""Packing of tokenised documents into sequences by a grouping genetic algorithm.

A chromosome is a packing, its genes are whole sequences ("bins"). Crossover injects
well-filled bins of one parent into the other, takes out the bins that hold any of
their documents again, and places the displaced documents by best fit. The documents
are dealt at random to shards of about ``SHARD`` pieces, each a problem of its own
size wherever the corpus grows to. Best fit makes each shard's first packing. Where it
needs more bins than the tokens do, several islands evolve the shard in tasks of their
own and pass their elite on to the next island between epochs; ``generations`` says how
many children the winning island had, 0 where best fit was proved the best. The emptiest
bins of all shards are dissolved and packed again together, level by level, until
one shard is left, so little room is lost at the borders of shards.

Only documents longer than a sequence are cut; full pieces are sequences at once.
Null text counts as empty and is its end token alone. Repeated rows are packed each.
An empty table gives no rows.

Words are tokenised once in a worker: the tokenizer drops white space and cuts marks from
words, so the ids of a text are those of its parts, and parts come again.
"""

from __future__ import annotations

import json as json_
import math
import os
import random
import sys
import unicodedata
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.functions.slices import slices
from rolesift.llm.base import arrow_map, table
from rolesift.session import materialize, release

LENGTH = 4096
END = 1
SHARD = 4096
ISLANDS, EPOCHS, POPULATION, CHILDREN = 3, 2, 6, 24
# bins of each shard that are packed again with those of the others
REMNANT = 3
TOKENIZER = "word_bpe_49k.json"
# a worker knows at most twice as many parts, besides those of one call
_CACHE_WORDS = 200_000
# words of one call of the tokenizer
_CALL = 5000
# texts are cut up and put together in Arrow and numpy, which take less room than Python values
_SLICE_BYTES = 2 << 20
# a run of marks between a letter and white space is a unit of its own; letters that lower case or
# composing makes end in a mark (as in Turkish or Hindi) are left out
_MARKS = (r"([a-zß-öø-įı-ž])([!-/:-@\[-`{-~]+)([ \t\n\r])", r"\1 \2\3")


def tokenizer_json(name: str = TOKENIZER) -> str:
    """The tokenizer's file, read on the driver and sent along; a few megabytes."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


class WordIds:
    """Ids of texts as little-endian 32-bit numbers, by a bounded memory of their parts."""

    def __init__(self, json: str):
        from tokenizers import Tokenizer, pre_tokenizers

        # a task has one core, and threads keep memory of their own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(json)
        # the same model for units that the normaliser would not change and the pre-tokeniser not cut
        self.units = Tokenizer.from_str(json_.dumps(json_.loads(json) | {"normalizer": None}))
        self.units.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith("</w>")
        # byte-level models write these bytes as the letters from 256 on, in their order, others as themselves
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(256 + i) for i, b in enumerate(hidden) if b != 32}
        self.known: dict[str, bytes] = {}
        # parts known earlier, which come back when met again
        self.older: dict[str, bytes] = {}

    def learn(self, parts: Sequence[str]) -> None:
        """Tokenise new parts. Plain words, which are one unit of the tokenizer each, go in calls of
        many and are told apart by the ids that end a unit; the rest go one by one."""
        plain, beyond, rest = [], [], []
        for part in parts:
            if not part.isalpha() or part.lower() != part:
                rest.append(part)
            elif part.isascii():
                plain.append(part)
            else:
                (beyond if unicodedata.is_normalized("NFC", part) else rest).append(part)
        for words in (plain, beyond):
            for start in range(0, len(words), _CALL):
                units = words[start : start + _CALL]
                line = " ".join(units)
                if words is beyond:  # the model knows bytes beyond ASCII by letters of theirs
                    line = line.encode().decode("latin-1").translate(self.letters)
                ids = np.array(self.units.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
                ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
                if len(ends) != len(units):
                    rest += units
                else:
                    data, ends = ids.tobytes(), ends.tolist()
                    self.known.update(zip(units, [data[a:b] for a, b in zip([0, *ends], ends)]))
        for start in range(0, len(rest), _CALL):
            some = rest[start : start + _CALL]
            for part, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.known[part] = np.array(found.ids, np.uint32).tobytes()

    @staticmethod
    def parts(texts: pa.Array) -> pa.ListArray:
        """The parts of texts: between white space, A-Z in lower case as the tokenizer has them, marks
        after a word apart from it. Texts where a special token may be written keep cases and marks."""
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), *_MARKS)
        special = pc.match_substring(texts, "<|")
        return pc.ascii_split_whitespace(pc.if_else(special, texts, plain) if pc.any(special).as_py() else plain)

    def of(self, texts: pa.Array | Sequence[str | None]) -> Iterator[bytes]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        lists = self.parts(texts.fill_null(""))
        places = lists.flatten().dictionary_encode()
        # an object array is made many times faster than a list
        met = places.dictionary.to_numpy(zero_copy_only=False)
        if len(self.known) > _CACHE_WORDS:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, met))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        again = [(part, ids) for part in met[gaps] if (ids := self.older.get(part)) is not None]
        self.known.update(again)
        self.learn([part for part in met[gaps] if part not in self.known])
        for i in gaps:
            found[i] = self.known[met[i]]
        # the ids of each place, one after the other
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, of = np.cumsum(lengths) - lengths, places.indices.to_numpy()
        ends = np.r_[0, np.cumsum(lengths[of])]
        ids = np.repeat(starts[of] - ends[:-1], lengths[of])
        ids += np.arange(len(ids))
        ids = np.frombuffer(b"".join(found), "<u4")[ids]
        cuts = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        for start, stop in zip(cuts, cuts[1:]):
            yield ids[start:stop].tobytes()


def _word_ids(json: str) -> WordIds:
    """One for each worker process: functions travel by value, so what tasks share lives in the interpreter."""
    shared = sys.__dict__.setdefault("_rolesift_word_ids", {})
    key = zlib.crc32(json.encode())
    if key not in shared:
        shared[key] = WordIds(json)
    return shared[key]


def pieces(documents: DataFrame, json: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each piece of each document."""
    sent = documents.sparkSession.sparkContext.broadcast(json)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _word_ids(sent.value)
        last = end.to_bytes(4, "little")
        for whole in batches:
            for doc_ids, texts in slices((whole.column("doc_id"), whole.column("text")), _SLICE_BYTES):
                out = []
                for doc_id, ids in zip(doc_ids.to_pylist(), ids_of.of(texts)):
                    ids += last
                    for piece, start in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[start : start + 4 * length]
                        out.append((doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids_crc32")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


class Bins:
    """A packing under way: best fit finds the fullest bin with room by one big-integer shift."""

    def __init__(self, sizes: Sequence[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: dict[int, list[int]] = {}
        self.room: dict[int, int] = {}
        self.by_room: dict[int, set[int]] = {}
        self.mask = 0
        self.number = 0

    def _file(self, one: int, room: int) -> None:
        self.room[one] = room
        self.by_room.setdefault(room, set()).add(one)
        self.mask |= 1 << room

    def _take(self, one: int) -> None:
        room = self.room[one]
        others = self.by_room[room]
        others.discard(one)
        if not others:
            self.mask &= ~(1 << room)

    def add(self, items: Sequence[int]) -> None:
        self.bins[self.number] = list(items)
        self._file(self.number, self.capacity - sum(self.sizes[i] for i in items))
        self.number += 1

    def remove(self, one: int) -> list[int]:
        self._take(one)
        del self.room[one]
        return self.bins.pop(one)

    def fit(self, items: Iterable[int]) -> None:
        for i in items:
            size = self.sizes[i]
            fitting = self.mask >> size
            if not fitting:
                self.add([i])
                continue
            room = size + (fitting & -fitting).bit_length() - 1
            one = next(iter(self.by_room[room]))
            self._take(one)
            self.bins[one].append(i)
            self._file(one, room - size)

    def packing(self) -> list[list[int]]:
        return list(self.bins.values())


def fitness(packing: Sequence[Sequence[int]], sizes: Sequence[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins that are as unevenly filled as can be."""
    return -len(packing), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in packing)


def first_packing(sizes: Sequence[int], capacity: int, draw: random.Random, noise: float) -> list[list[int]]:
    bins = Bins(sizes, capacity)
    bins.fit(sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * draw.random())))
    return bins.packing()


def crossover(mother, father, sizes: Sequence[int], capacity: int, draw: random.Random) -> list[list[int]]:
    """The mother with well-filled bins of the father injected whole."""
    child = Bins(sizes, capacity)
    filled = sorted(father, key=lambda b: -sum(sizes[i] for i in b) - draw.random())
    injected = [b for b in filled[: max(1, len(filled) // 2)] if draw.random() < 0.4]
    taken = {i for b in injected for i in b}
    displaced = []
    for b in mother:
        if taken.isdisjoint(b):
            child.add(b)
        else:
            displaced += [i for i in b if i not in taken]
    for b in injected:
        child.add(b)
    # the emptiest bins are dissolved as well
    for one in sorted(child.room, key=child.room.get, reverse=True)[: draw.randint(1, 6)]:
        displaced += child.remove(one)
    child.fit(sorted(displaced, key=lambda i: -sizes[i] * (1 + 0.05 * draw.random())))
    return child.packing()


def bound(sizes: Sequence[int], capacity: int) -> int:
    """No packing has fewer bins."""
    return math.ceil(sum(sizes) / capacity)


def breed(sizes: Sequence[int], elite: list, capacity: int, seed: str) -> tuple[list[list[list[int]]], int]:
    """Some generations of one island, the best packings first, and how many children they had."""
    draw = random.Random(seed)
    least = bound(sizes, capacity)
    rank = lambda p: fitness(p, sizes, capacity)
    people = sorted(elite or [first_packing(sizes, capacity, draw, 0.0)], key=rank, reverse=True)
    if len(people[0]) > least:
        while len(people) < POPULATION:
            people.append(first_packing(sizes, capacity, draw, 0.02 * len(people)))
        people.sort(key=rank, reverse=True)
    for bred in range(CHILDREN):
        if len(people[0]) <= least:
            return people[:2], bred
        mother, father = draw.sample(people[: max(2, len(people) // 2 + 1)], 2)
        child = crossover(mother, father, sizes, capacity, draw)
        if rank(child) > rank(people[-1]):
            people[-1] = child
            people.sort(key=rank, reverse=True)
    return people[:2], CHILDREN


def evolve(sizes: Sequence[int], elite: list, capacity: int, seed: str) -> list[list[list[int]]]:
    """Some generations of one island; its best packings come first."""
    return breed(sizes, elite, capacity, seed)[0]


_STATE = "shard long, island int, sizes array<int>, ids array<long>, elite array<array<int>>, bins int, generations int"


def _labels(packing: Sequence[Sequence[int]], n: int) -> list[int]:
    out = [0] * n
    for number, items in enumerate(packing):
        for i in items:
            out[i] = number
    return out


def _unlabelled(labels: Sequence[int]) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, number in enumerate(labels):
        bins.setdefault(number, []).append(i)
    return list(bins.values())


def _epoch(state: DataFrame, level: int, epoch: int, capacity: int) -> DataFrame:
    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row in rows.to_pylist():
            elite = [_unlabelled(labels) for labels in row["elite"]]
            best, bred = breed(row["sizes"], elite, capacity, f"{level}/{row['shard']}/{row['island']}/{epoch}")
            elite = [_labels(p, len(row["sizes"])) for p in best]
            out.append(row | {"elite": elite, "bins": len(best[0]), "generations": row["generations"] + bred})
        return pa.RecordBatch.from_pylist(out, schema=rows.schema)

    return arrow_map(state, batch, _STATE)


def _best_fit(lists: DataFrame, capacity: int) -> DataFrame:
    """Each shard's best fit as the first of its elite, and the bound on its bins."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row in rows.to_pylist():
            sizes = row["sizes"]
            packing = first_packing(sizes, capacity, random.Random(0), 0.0)
            out.append(row | {"elite": [_labels(packing, len(sizes))], "bins": len(packing), "least": bound(sizes, capacity)})
        return pa.RecordBatch.from_pylist(out, schema=schema)

    fields = [("shard", pa.int64()), ("sizes", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))]
    fields += [("elite", pa.list_(pa.list_(pa.int32()))), ("bins", pa.int32()), ("least", pa.int32())]
    schema = pa.schema(fields)
    return arrow_map(
        lists, batch, "shard long, sizes array<int>, ids array<long>, elite array<array<int>>, bins int, least int"
    )


def pack_shards(items: DataFrame, level: int, shards: int, capacity: int) -> DataFrame:
    """``mid, length, shard, bin, generations``: the items ``(mid, length)`` packed shard by shard.

    Only shards whose best fit has more bins than their tokens need get islands.
    """
    of = F.pmod(F.xxhash64("mid", F.lit(level)), F.lit(shards))
    # a shard has about SHARD items, whatever the number of documents
    lists = items.groupBy(of.alias("shard")).agg(F.array_sort(F.collect_list(F.struct("length", "mid"))).alias("all"))
    lists = lists.select(
        "shard", F.transform("all", lambda x: x["length"].cast("int")).alias("sizes"),
        F.transform("all", lambda x: x["mid"]).alias("ids"),
    )
    first = materialize(_best_fit(lists, capacity))
    best = first.filter("bins <= least").select("shard", "sizes", "ids", "elite", F.lit(0).alias("generations"))
    wanting = first.filter("bins > least")
    if wanting.limit(1).count():
        state = wanting.select(
            "shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "sizes", "ids", "elite", "bins",
            F.lit(0).alias("generations"),
        )
        for epoch in range(EPOCHS):
            # islands are tasks of their own
            state = materialize(_epoch(state.repartition("shard", "island"), level, epoch, capacity))
            if epoch < EPOCHS - 1:  # each island takes in the best of the one before it
                guests = state.select(
                    "shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.element_at("elite", 1).alias("guest")
                )
                state = state.join(guests, ["shard", "island"]).withColumn("elite", F.concat("elite", F.array("guest")))
                state = state.drop("guest")
        won = F.struct("sizes", "ids", "elite", "generations")
        evolved = state.groupBy("shard").agg(F.min_by(won, F.struct("bins", "island")).alias("best"))
        best = best.union(evolved.select("shard", "best.*"))
    rows = best.select(
        "shard", "generations", F.explode(F.arrays_zip("ids", "sizes", F.element_at("elite", 1).alias("bin"))).alias("x")
    )
    return rows.select(
        F.col("x.ids").alias("mid"), F.col("x.sizes").alias("length"), "shard", F.col("x.bin").alias("bin"), "generations"
    )


def pack(documents: DataFrame, json: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    tokenised = materialize(pieces(documents, json, length, end))
    numbered = materialize(tokenised.withColumn("mid", F.monotonically_increasing_id()))
    release(tokenised)
    items = numbered.filter(F.col("length") < length).select("mid", "length")
    placed, level = None, 0
    measure = lambda x: x.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    count, tokens = measure(items)
    while count:
        # of tiny pieces a shard takes more, so that it fills some bins besides those passed on
        shards = max(1, min(math.ceil(count / SHARD), tokens // (2 * REMNANT * length)))
        packed = materialize(pack_shards(items, level, shards, length))
        key = F.struct(F.lit(level).alias("level"), "shard", "bin", "generations").alias("sequence")
        done = packed
        if shards > 1:
            bins = packed.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
            worst = bins.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("fill", "bin"))).alias("bins"))
            # at most half of the bins, the emptiest: the tokens left halve at each level, so the levels end
            passed = F.least(F.lit(REMNANT), (F.size("bins") / 2).cast("int"))
            worst = materialize(worst.select("shard", F.explode(F.slice("bins", F.lit(1), passed)).alias("b")).select("shard", "b.bin"))
            items = materialize(packed.join(worst, ["shard", "bin"], "left_semi").select("mid", F.col("length").cast("long")))
            done = packed.join(worst, ["shard", "bin"], "left_anti")
            count, tokens = measure(items)
        else:
            count = 0
        done = done.select("mid", "length", key)
        placed = done if placed is None else placed.union(done)
        level += 1
    whole = numbered.filter(F.col("length") == length).select(
        *numbered.columns, (-1 - F.col("mid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.lit(0).alias("generations"),
    )
    if placed is not None:
        # a sequence holds at most as many pieces as tokens
        lists = placed.groupBy("sequence").agg(F.array_sort(F.collect_list(F.struct("mid", "length"))).alias("all"))
        before = lambda i: F.aggregate(
            F.slice("all", 1, i), F.lit(0).cast("long"), lambda acc, x: acc + x["length"]
        )
        offsets = lists.select(
            (F.col("sequence.level") * (1 << 58) + F.col("sequence.shard") * (1 << 16) + F.col("sequence.bin")).alias("sequence_id"),
            "sequence.generations", F.explode(F.transform("all", lambda x, i: F.struct(x["mid"].alias("mid"), before(i).alias("offset")))).alias("x"),
        )
        rest = numbered.join(offsets.select("sequence_id", "x.mid", "x.offset", "generations"), "mid")
        whole = whole.unionByName(rest.select(*whole.columns))
    return whole.drop("mid")


def op9_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_json())


QUERIES = {"op9_grouping_packing": (op9_grouping_packing, None)}
