"""Repeated passages by common-prefix intervals of suffix arrays.

Two equal strings of ``least`` bytes have the same minimiser (their least-hashed gram,
the first of equals) at the same offset. Runs of windows with one minimiser are
therefore cut out as pieces and dealt by the minimiser's hash, which brings all
occurrences of a repeated string to one bucket. A bucket sorts the suffixes of its
pieces, computes the common prefixes of neighbours and scans them with a stack: every
interval of the tree with a common prefix of at least ``least`` bytes whose members
are preceded by different bytes is a maximal repeat group, with all its occurrences
and not just neighbours. (Groups are maximal within pieces; spans that touch across
pieces of a document are joined at the end.)

An occurrence is removed when its group also occurs in a document of smaller id. Of
pieces that are equal within a load (some blocks of documents) only those of the least id
travel; the others are resolved on the spot, so a copy or a hot passage costs a load one
piece. Pieces travel compressed, as a row for each load and bucket, and what is found
returns by block, so no row is made for a position and no text is shuffled unless the
spans outgrow a broadcast.

Memory does not grow with the table: texts are cut a few at a time, buckets grow in number
and not in size, and a bucket holds its pieces as plain bytes. Its windows are compared in
turns, each with all windows of some contexts: equal windows have their minimiser at one
offset, so they share the bytes to the right of it, or those to the left where the right
side is short.

Null text counts as empty. A null id counts as larger than any other. Equal ids are
not smaller than each other, so repeated rows do not remove each other.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.llm.base import table
from rolesift.llm.dart_minhash import mix
from rolesift.session import broadcast_if_small, materialize, shuffles_removed

LEAST = 50
GRAM = 12
BUCKETS = 512  # at least; more for more input
# texts cut at once, of a block, in which what is found returns, and blocks of a load, in which pieces travel
_CUT_BYTES = 1 << 18
_BLOCK_BYTES = 8 << 20
_LOAD_BLOCKS = 2
_ROWS_BYTES = 4 << 20  # of rows sent at once
_TURN = 4096  # pieces whose windows are compared at once
_TEXTS = 256  # out of which spans are cut at once
_BATCH_BYTES = 4 << 20  # of an Arrow batch; Spark's own bounds are 10,000 rows and 64 MB
_NO_ID = 2**63 - 1
_BASE = 0x9E3779B97F4A7C15
_M64 = 2**64 - 1
_BROADCAST_SPANS = 200_000
_PARTS = "bucket int, block long, data binary"
_FOUND = "block long, directory boolean, data binary"


def string_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of the ``width`` bytes at each place that has them, by doubling."""
    powers = {1: mix(data.astype(np.uint64) + np.uint64(1))}
    w = 1
    while 2 * w <= width:
        n = len(data) - 2 * w + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = powers[w]
        powers[2 * w] = h[:n] * np.uint64(pow(_BASE, w, 2**64)) + h[w : w + n]
        w *= 2
    out, have = None, 0
    for w in sorted(powers, reverse=True):
        if width & w:
            n = len(data) - have - w + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            out = powers[w] if out is None else out[:n] * np.uint64(pow(_BASE, w, 2**64)) + powers[w][have : have + n]
            have += w
    return out


def windows_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each window, by doubling."""
    w, out = 1, values
    while 2 * w <= width:
        out = np.minimum(out[:-w], out[w:])
        w *= 2
    return np.minimum(out[: len(out) - (width - w)], out[width - w :]) if width > w else out


def cut_pieces(texts: list[bytes], least: int, gram: int = GRAM):
    """(owner, start in text, length, offset of the minimiser, its hash, hash of the piece) and the joined bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < least:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64), data, none
    ends = np.cumsum(sizes)
    begins = ends - sizes
    grams = mix(string_hashes(data, gram))
    packed = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    at = (windows_minimum(packed, least - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = string_hashes(data, least)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    valid = np.arange(len(at)) + least <= ends[owner]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | ~valid[:-1]
    first = np.flatnonzero(fresh & valid)
    if not len(first):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64), data, none
    stop = np.flatnonzero(valid & np.append(fresh[1:] | ~valid[1:], True))
    length = stop - first + least
    # a piece is no longer than two windows, so its first and last window tell it
    key = mix(whole[first] + mix(whole[stop] + length.astype(np.uint64)))
    of = owner[first]
    return of, first - begins[of], length, at[first] - first, grams[at[first]], key, data, first


def _bytes_at(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> bytes:
    skipped = np.cumsum(lengths) - lengths
    return data[np.repeat(starts - skipped, lengths) + np.arange(int(lengths.sum()))].tobytes()


def _packed(arrays: Iterable[np.ndarray], tail: bytes = b"") -> bytes:
    import zstandard

    arrays = list(arrays)
    head = struct.pack("<BI", len(arrays), len(arrays[0]))
    kinds = "".join(a.dtype.str[1:] for a in arrays).encode()
    return zstandard.ZstdCompressor(level=3).compress(head + kinds + b"".join(a.tobytes() for a in arrays) + tail)


def _unpacked(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    import zstandard

    plain = zstandard.ZstdDecompressor().decompress(data)
    n_arrays, n = struct.unpack_from("<BI", plain)
    at = 5 + 2 * n_arrays
    kinds, out = plain[5:at].decode(), []
    for k in range(n_arrays):
        kind = np.dtype("<" + kinds[2 * k : 2 * k + 2])
        out.append(np.frombuffer(plain, kind, n, at))
        at += n * kind.itemsize
    return out, np.frombuffer(plain, np.uint8, offset=at)


def _columns(rows: list[tuple]) -> list[np.ndarray]:
    """The columns of some rows of arrays, joined; takes the rows, so that a column is held twice at a time."""
    columns = [list(c) for c in zip(*rows)]
    rows.clear()
    return [np.concatenate([c.pop(0) for _ in range(len(c))]) for c in columns]


def _cut(least: int, buckets: int):
    """Loads of documents -> a row for each bucket, and for each block one with the ids, one with what is resolved at once."""

    def cut_some(texts: list[bytes], turn: int, owner_from: int, data_from: int) -> tuple:
        owner, start, length, offset, gram, key, data, at = cut_pieces(texts, least)
        bucket = (mix(gram + np.uint64(77)) % np.uint64(buckets)).astype("u2" if buckets < 1 << 16 else "u4")
        return (np.full(len(owner), turn, "u1"), (owner + owner_from).astype("u4"), start.astype("u4"), length.astype("u1"),
                offset.astype("u1"), bucket, key, at + data_from, data)

    def above_least(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether an equal key has a smaller id."""
        order = np.argsort(key)
        key, ids = key[order], ids[order]
        lead = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        out = np.zeros(len(order), bool)
        out[order] = ids > np.repeat(np.minimum.reduceat(ids, lead), np.diff(np.append(lead, len(order))))
        return out

    def load_rows(first_block: int, blocks: list[tuple], cuts: list[tuple]) -> Iterator[tuple]:
        for turn, (ids, nodes) in enumerate(blocks):
            block = first_block + turn
            yield -1 - block % 1_000_000, block, _packed([ids, nodes])
        turn, owner, start, length, offset, bucket, key, at, data = _columns(cuts)
        if not len(owner):
            return
        ids = np.concatenate([ids for ids, _ in blocks])[owner + np.cumsum([0, *(len(ids) for ids, _ in blocks)])[turn]]
        # of equal pieces only those of the least id go on
        resolved = above_least(key, ids)
        del key
        for k in range(len(blocks)):
            mine = np.flatnonzero(resolved & (turn == k))
            if len(mine):
                block = first_block + k
                yield -1 - block % 1_000_000, block, b"r" + _packed([owner[mine], start[mine], length[mine].astype("u2")])
        on = np.flatnonzero(~resolved)
        bucket = bucket[on]
        on = on[np.argsort(bucket, kind="stable")]
        ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        for b in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
            mine = on[ends[b - 1] if b else 0 : ends[b]]
            arrays = [turn[mine], owner[mine], np.diff(ids[mine], prepend=0), start[mine], length[mine], offset[mine]]
            yield b, first_block, _packed(arrays, _bytes_at(data, at[mine], length[mine].astype(np.int64)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, blocks, cuts, cut_bytes = 0, [], [], 0
        ids, nodes, texts, held, block_bytes = [], [], [], 0, 0

        def cut() -> None:
            nonlocal texts, held, block_bytes, cut_bytes
            if texts:
                cuts.append(cut_some(texts, len(blocks), len(ids) - len(texts), cut_bytes))
                cut_bytes += len(cuts[-1][-1])
                texts, held, block_bytes = [], 0, block_bytes + held

        def close() -> None:
            nonlocal ids, nodes, block_bytes
            cut()
            blocks.append((np.array(ids, np.int64), np.array(nodes, np.int64)))
            ids, nodes, block_bytes = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            # reading the same files again gives the same blocks, so a task that runs again agrees
            nonlocal number, blocks, cuts, cut_bytes
            rows, size = [], 0
            for row in load_rows((part << 24) + number, blocks, cuts):
                rows.append(row)
                size += len(row[2])
                if size > _ROWS_BYTES:
                    yield sent(rows)
                    rows, size = [], 0
            yield sent(rows)
            number, blocks, cuts, cut_bytes = number + len(blocks), [], [], 0

        for batch in batches:
            for doc_id, node, text in zip(*(batch.column(k) for k in range(3))):
                doc_id = doc_id.as_py()
                ids.append(_NO_ID if doc_id is None else doc_id)
                nodes.append(node.as_py())
                texts.append(text.as_py().encode())
                held += len(texts[-1]) + 16
                if held > _CUT_BYTES:
                    cut()
                if block_bytes > _BLOCK_BYTES:
                    close()
                    if len(blocks) == _LOAD_BLOCKS:
                        yield from flush()
        if ids:
            close()
        if blocks:
            yield from flush()

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary()))],
            names=["bucket", "block", "data"],
        )

    return run


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a big-endian number."""
    w = np.concatenate((data, np.zeros(16, np.uint8))).astype(np.uint64)
    for k in (1, 2, 4):
        w = w[:-k] << np.uint64(8 * k) | w[k:]
    return w


def suffix_array(data: np.ndarray, places: np.ndarray, room: np.ndarray, least: int, words: np.ndarray | None = None):
    """(order, lcp) of the suffixes at some places, each ``room`` bytes long and no less than ``least``.

    ``lcp[i]`` is the length of the prefix that suffix i shares with the one before it, or less
    than ``least`` as that is. Suffixes with a common prefix of ``least`` bytes are in order and together.
    """
    words, keys = _words(data) if words is None else words, []
    for k in range((int(room.max(initial=least)) + 7) // 8):
        word = words[np.minimum(places + 8 * k, len(words) - 1)]
        if 8 * k + 8 > least:
            left = np.clip(room - 8 * k, 0, 8).astype(np.uint64)
            mask = np.where(left > 0, np.uint64(_M64) << (np.uint64(8) * (np.uint64(8) - np.maximum(left, np.uint64(1)))), np.uint64(0))
            word = word & mask
        keys.append(word)
    # every suffix has these words; suffixes that share them meet by one hash of them
    whole = least // 8
    head = np.zeros(len(places), np.uint64)
    for key in keys[:whole]:
        head = mix(head * np.uint64(31) + key)
    order = np.lexsort((room, *reversed(keys[whole:]), head))
    a, b = order[:-1], order[1:]
    open_ = np.flatnonzero(head[a] == head[b]) + 1
    if any((key[order[open_ - 1]] != key[order[open_]]).any() for key in keys[:whole]):  # two heads of one hash
        order, whole = np.lexsort((room, *reversed(keys))), 0
        open_ = np.arange(1, len(order))
    lcp = np.zeros(len(order), np.int64)
    lcp[open_] = 8 * whole
    for key in keys[whole:]:
        a, b = key[order[open_ - 1]], key[order[open_]]
        differ = a ^ b
        some = differ != 0
        shared = (~some).astype(np.int64)
        for k in range(1, 8):
            shared += differ < np.uint64(1 << 64 - 8 * k)
        lcp[open_] += shared
        open_ = open_[~some]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(room[order[1:]], room[order[:-1]]))
    return order, lcp


def even_runs(lcp: np.ndarray, before: np.ndarray, docs: np.ndarray, least: int):
    """Runs of neighbours that share at least ``least`` bytes: the maximal repeats, as arrays ``(first, last,
    length, least document)``, among those that are one interval of the tree, and the starts of the others."""
    high = np.concatenate((lcp >= least, [False]))
    starts = np.flatnonzero(high & ~np.concatenate(([False], high[:-1])))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return (none, none, none, none), none
    ends = np.flatnonzero(~high & np.concatenate(([False], high[:-1])))
    over = lambda f, values, first: f.reduceat(np.append(values, 0), np.stack((first, ends), 1).ravel())[::2]
    length = over(np.minimum, lcp, starts)
    even = length == over(np.maximum, lcp, starts)
    first = starts - 1
    low, byte = over(np.minimum, docs, first), over(np.minimum, before, first)
    maximal = even & (low < over(np.maximum, docs, first)) & ((byte < 0) | (byte != over(np.maximum, before, first)))
    return (first[maximal], ends[maximal] - 1, length[maximal], low[maximal]), starts[~even]


def maximal_repeats(lcp: np.ndarray, before: np.ndarray, docs: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """(first, last, length, least document) of the intervals of the tree that are maximal repeats
    and lie in more than one document. ``before`` is the byte before each suffix, or a number of
    its own (below 0) where none is known. Inner intervals come first."""
    even, uneven = even_runs(lcp, before, docs, least)
    return [*zip(*(c.tolist() for c in even)), *_scanned(uneven, lcp, before, docs, least)]


def _scanned(starts: np.ndarray, lcp: np.ndarray, before: np.ndarray, docs: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """The maximal repeats of the runs that start there, by a stack of open intervals."""
    found = []
    n = len(lcp)
    values, left, doc = lcp.tolist(), before.tolist(), docs.tolist()
    for run_first in starts.tolist():
        # suffixes run_first - 1 .. run_last share at least ``least`` bytes
        stack: list[list] = []  # [length, first, byte before or None if they differ, least id, greatest id]
        i = run_first
        leaf = (left[i - 1], doc[i - 1], doc[i - 1])
        while True:
            height = values[i] if i < n and values[i] >= least else 0
            first = i - 1
            carried = leaf
            while stack and stack[-1][0] > height:
                length, first, byte, low, high = stack.pop()
                byte = byte if byte == carried[0] and byte is not None and byte >= 0 else None
                low, high = min(low, carried[1]), max(high, carried[2])
                if byte is None and high > low:
                    found.append((first, i - 1, length, low))
                carried = (byte, low, high)
            if not height:
                break
            if stack and stack[-1][0] == height:
                top = stack[-1]
                top[2] = top[2] if top[2] == carried[0] and top[2] is not None and top[2] >= 0 else None
                top[3], top[4] = min(top[3], carried[1]), max(top[4], carried[2])
            else:
                stack.append([height, first, carried[0], carried[1], carried[2]])
            leaf = (left[i], doc[i], doc[i])
            i += 1
    return found


def _in_bucket(least: int):
    # a shared string holds the minimiser and at least ``side`` bytes to the right of it, or else more than ``far`` to the left
    side = (least - GRAM + 1) // 2
    far = least - GRAM - side

    def sides(length: np.ndarray, offset: np.ndarray, tail: np.ndarray) -> Iterator[tuple]:
        """(pieces, first window, last window, context) of the windows that reach far to the right, and of the others."""
        length, offset = length.astype(np.int64), offset.astype(np.int64)
        anchor, words = np.cumsum(length) - length + offset, _words(tail)
        last = length - least
        for first, to, back, salt in ((np.maximum(offset - far, 0), last, 0, 0), (0 * last, np.minimum(last, offset - far - 1), side, 1)):
            some = np.flatnonzero(first <= to)
            if len(some):
                context = mix(_context(words, anchor[some] - back, GRAM + side) + np.uint64(salt))
                yield some, first[some].astype("u1"), to[some].astype("u1"), context

    def spans(text: np.ndarray, ids: np.ndarray, first: np.ndarray, last: np.ndarray, length: np.ndarray, begin: np.ndarray) -> tuple:
        """(place among these, first byte, end) of what is removed of some pieces, by their windows ``first`` to ``last``."""
        text = np.frombuffer(_bytes_at(text, begin, length), np.uint8)
        words, begin = _words(text), np.cumsum(length) - length
        n_windows = last - first + 1
        piece = np.repeat(np.arange(len(begin)), n_windows)
        step = np.arange(len(piece)) + np.repeat(first - np.cumsum(n_windows) + n_windows, n_windows)
        place = begin[piece] + step
        live = _shared(_context(words, place, least), ids[piece])
        piece, step, place = piece[live], step[live], place[live]
        cover = np.zeros(len(piece), np.int64)
        if len(piece):
            order, lcp = suffix_array(text, place, length[piece] - step, least, words)
            before = np.where(step > 0, text[np.maximum(place - 1, 0)].astype(np.int64), -1)[order]
            docs, covered = ids[piece[order]], np.zeros(len(piece), np.int64)
            even, uneven = even_runs(lcp, before, docs, least)
            # these do not overlap
            many = even[1] - even[0] + 1
            at = np.repeat(even[0] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            covered[at] = np.where(docs[at] > np.repeat(even[3], many), np.repeat(even[2], many), 0)
            for low, high, size, least_id in _scanned(uneven, lcp, before, docs, least):
                span = slice(low, high + 1)
                covered[span] = np.maximum(covered[span], np.where(docs[span] > least_id, size, 0))
            cover[order] = covered
        hit = np.flatnonzero(cover)
        lead = np.flatnonzero(np.diff(piece[hit], prepend=-1))
        # all windows of a piece overlap, so what is removed of it is one span
        return piece[hit[lead]], step[hit[lead]], np.maximum.reduceat((step + cover)[hit], lead) if len(lead) else lead

    def find(key: tuple, parts: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:  # ids and what was resolved at once pass through
            data = [x.as_py() for x in parts.column("data")]
            return _table([(b, not x.startswith(b"r"), x.removeprefix(b"r")) for b, x in zip(parts.column("block").to_pylist(), data)])
        pieces, entries, n = [], [], 0
        for block, x in zip(parts.column("block"), parts.column("data")):
            (turn, owner, ids, start, length, offset), tail = _unpacked(x.as_py())
            ends = np.cumsum(length, dtype=np.int64)
            for a in range(0, len(owner), _TURN):
                b = min(a + _TURN, len(owner))
                for some, first, last, context in sides(length[a:b], offset[a:b], tail[ends[a] - length[a] : ends[b - 1]]):
                    entries.append(((some + n + a).astype("u4"), first, last, context))
            pieces.append((turn + np.int64(block.as_py()), owner, np.cumsum(ids), start, length, tail))
            n += len(owner)
        block, owner, ids, start, length, text = _columns(pieces)
        piece, first, last, context = _columns(entries)
        live = np.flatnonzero(_shared(context, ids[piece]))
        live = live[np.argsort(context[live])]
        ends = np.append(np.flatnonzero(np.diff(context[live])) + 1, len(live))
        # all pieces of a context are in one turn
        ends = ends[np.append(np.diff(ends // _TURN) > 0, True)] if len(live) else ends[:0]
        piece, first, last, begin = piece[live], first[live].astype(np.int64), last[live].astype(np.int64), np.cumsum(length, dtype=np.int64) - length
        found = []
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            p = piece[a:b]
            at, low, high = spans(text, ids[p], first[a:b], last[a:b], length[p].astype(np.int64), begin[p])
            found.append((p[at], (start[p[at]] + low).astype("u4"), (high - low).astype("u2")))
        if not found:
            return _table([])
        p, start, size = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(block[p], kind="stable")
        cuts = np.flatnonzero(np.diff(block[p[order]])) + 1
        rows = [(int(block[p[mine[0]]]), False, _packed([owner[p[mine]], start[mine], size[mine]])) for mine in np.split(order, cuts) if len(mine)]
        return _table(rows)

    return find


def _context(words: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes (eight at least) at each place, from the words of all places."""
    out = mix(words[places])
    for k in [*range(8, width - 7, 8), width - 8]:
        out = mix(out + words[places + k])
    return out


def _shared(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether each key occurs with more than one document."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys)
    keys, docs = keys[order], docs[order]
    lead = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    several = np.minimum.reduceat(docs, lead) != np.maximum.reduceat(docs, lead)
    out = np.zeros(len(keys), bool)
    out[order] = np.repeat(several, np.diff(np.append(lead, len(keys))))
    return out


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.bool_(), pa.binary())
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "directory", "data"])


def _merged(key: tuple, parts: pa.Table) -> pa.Table:
    """The removed spans of each document of a block that has any, as pairs of 32-bit numbers."""
    ids, found = None, []
    for directory, data in zip(parts.column("directory").to_pylist(), parts.column("data")):
        arrays, _ = _unpacked(data.as_py())
        if directory:
            ids = arrays
        else:
            found.append([a.astype(np.int64) for a in arrays])
    out = []
    if found:
        owner, start, length = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((start, owner))
        owner, start, end = owner[order], start[order], (start + length)[order]
        for mine in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1):
            s, reach = start[mine], np.maximum.accumulate(end[mine])
            lead = np.concatenate(([True], s[1:] > reach[:-1]))
            stop = reach[np.append(np.flatnonzero(lead)[1:] - 1, len(s) - 1)]
            spans = np.stack((s[lead], stop), 1).astype("<u4").tobytes()
            doc_id = int(ids[0][owner[mine[0]]])
            out.append((None if doc_id == _NO_ID else doc_id, int(ids[1][owner[mine[0]]]), spans))
    kinds = (pa.int64(), pa.int64(), pa.binary())
    columns = list(zip(*out)) or [(), (), ()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "node", "spans"])


def repeated_spans(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, node, spans) of texts ``(doc_id, node, text)`` that repeat earlier documents."""
    spark = texts.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))
    buckets = max(BUCKETS, 3 * texts.rdd.getNumPartitions())
    parts = texts.mapInArrow(_cut(least, buckets), _PARTS)
    with shuffles_removed(spark):
        found = materialize(parts.groupBy("bucket").applyInArrow(_in_bucket(least), _FOUND))
        spans = found.groupBy("block").applyInArrow(_merged, "doc_id long, node long, spans binary")
        return materialize(spans.dropDuplicates(["doc_id", "node"]))


def without_repeats(documents: DataFrame, least: int = LEAST, kept: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document, and ``kept`` (the bytes that stay) if asked for."""
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("node"), "text")
    spans = broadcast_if_small(repeated_spans(texts, least), _BROADCAST_SPANS)
    other = spans.select(F.col("doc_id").alias("d"), F.col("node").alias("h"), "spans")
    joined = texts.join(other, texts["doc_id"].eqNullSafe(other["d"]) & (texts["node"] == other["h"]), "left")

    def some(rows: pa.RecordBatch) -> pa.RecordBatch:
        out = {name: [] for name in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")[: 4 + kept]}
        for text, spans_ in zip(rows.column("text").to_pylist(), rows.column("spans").to_pylist()):
            data = text.encode()
            cuts = np.frombuffer(spans_ or b"", "<u4").reshape(-1, 2).tolist()
            parts, last = [], 0
            for a, b in cuts:
                parts.append(data[last:a])
                last = b
            left = b"".join([*parts, data[last:]])
            values = (len(data), len(data) - len(left), len(cuts), hashlib.sha256(left).hexdigest(), left)
            for column, value in zip(out.values(), values):
                column.append(value)
        return pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), **{k: pa.array(v) for k, v in out.items()}})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                yield some(batch.slice(at, _TEXTS))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept
    return joined.select("doc_id", "text", "spans").mapInArrow(run, schema)


def op7_repeat_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), kept=False)


QUERIES = {"op7_repeat_intervals": (op7_repeat_intervals, None)}
