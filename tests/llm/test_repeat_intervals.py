import hashlib
import random
import re

from rolesift.llm import repeat_intervals as m


def brute(rows, least):
    ids = [(2**63 - 1 if i is None else i, i, (t or "").encode()) for i, t in rows]
    first = {}
    for key, _, data in ids:
        for p in range(len(data) - least + 1):
            s = data[p : p + least]
            first[s] = min(first.get(s, key), key)
    out = []
    for key, i, data in ids:
        mark = bytearray(len(data))
        for p in range(len(data) - least + 1):
            if first[data[p : p + least]] < key:
                mark[p : p + least] = b"\1" * least
        kept = bytes(c for c, x in zip(data, mark) if not x)
        spans = len(re.findall(b"\1+", bytes(mark)))
        out.append((i, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(docs, least=50):
    got = m.without_repeats(docs, least).drop("kept").collect()
    return sorted(map(tuple, got), key=repr)


def test_tricky(tricky, nothing):
    rows = [(r["doc_id"], r["text"]) for r in tricky.collect()]
    assert run(tricky) == brute(rows, 50)
    assert run(nothing) == []


def test_few_letters_many_repeats(spark):
    draw = random.Random(3)
    passages = ["".join(draw.choice("ab") for _ in range(90)) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = ["".join(draw.choice("abé ") for _ in range(draw.randint(0, 80)))]
        for _ in range(draw.randint(0, 3)):
            p = draw.choice(passages)
            parts += [p[draw.randint(0, 30) :], "".join(draw.choice("ab") for _ in range(draw.randint(0, 9)))]
        rows.append((draw.randint(0, 30), "".join(parts)))
    rows += [(50, "a" * 300), (51, "a" * 200), (52, "ab" * 100), (53, "ab" * 60 + "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(docs) == brute(rows, 50)


def test_groups_are_maximal_and_whole():
    import numpy as np

    texts = [b"xxHELLOWORLD1yy", b"zzHELLOWORLD2", b"qHELLOWaa", b"tHELLOWORLD1p"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum([0, *map(len, texts)])[:-1]
    places = np.concatenate([b + np.arange(len(t) - 4) for b, t in zip(begin, texts)])
    docs = np.repeat(np.arange(4), [len(t) - 4 for t in texts])
    room = np.concatenate([len(t) - np.arange(len(t) - 4) for t in texts])
    order, lcp = m.suffix_array(data, places, room, 5)
    before = np.where(places == begin[docs], -1, data[np.maximum(places - 1, 0)])
    groups = m.maximal_repeats(lcp, before[order].astype(np.int64), docs[order], 5)
    named = {(bytes(data[places[order[f]] : places[order[f]] + n]), tuple(sorted(docs[order[f : last + 1]].tolist()))) for f, last, n, _ in groups}
    assert named == {(b"HELLOWORLD1", (0, 3)), (b"HELLOWORLD", (0, 1, 3)), (b"HELLOW", (0, 1, 2, 3))}


def _suffixes(texts, least):
    import numpy as np

    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum([0, *map(len, texts)])[:-1]
    n = [len(t) - least + 1 for t in texts]
    places = np.concatenate([b + np.arange(k) for b, k in zip(begin, n)])
    docs = np.repeat(np.arange(len(texts)), n)
    room = np.concatenate([len(t) - np.arange(k) for t, k in zip(texts, n)])
    before = np.where(places == begin[docs], -1, data[np.maximum(places - 1, 0)].astype(np.int64))
    return data, places, room, docs, before


def test_only_uneven_runs_are_scanned():
    import numpy as np

    draw = random.Random(8)
    base = "".join(draw.choice("abcd") for _ in range(400)).encode()
    texts = [base[a : a + draw.randint(12, 60)] for a in (draw.randrange(330) for _ in range(60))]
    data, places, room, docs, before = _suffixes(texts, 10)
    order, lcp = m.suffix_array(data, places, room, 10)
    before, docs = before[order], docs[order]
    every = np.flatnonzero((lcp >= 10) & (np.concatenate(([0], lcp[:-1])) < 10))
    even, uneven = m.even_runs(lcp, before, docs, 10)
    assert 0 < len(even[0]) and 0 < len(uneven) < len(every)
    assert sorted(m.maximal_repeats(lcp, before, docs, 10)) == sorted(m._scanned(every, lcp, before, docs, 10))


def test_heads_of_one_hash_are_told_apart(monkeypatch):
    import numpy as np

    draw = random.Random(4)
    texts = [bytes(draw.choice(b"ab") for _ in range(draw.randint(17, 40))) for _ in range(30)]
    found = []
    for same in (False, True):
        if same:
            monkeypatch.setattr(m, "mix", lambda x: x * np.uint64(0))
        data, places, room, docs, before = _suffixes(texts, 16)
        order, lcp = m.suffix_array(data, places, room, 16)
        groups = m.maximal_repeats(lcp, before[order], docs[order], 16)
        name = lambda f, n: bytes(data[places[order[f]] : places[order[f]] + n])
        found.append({(name(f, n), tuple(sorted(places[order[f : last + 1]].tolist()))) for f, last, n, _ in groups})
    assert found[0] == found[1]


def test_small_blocks_and_turns_find_the_same(spark, monkeypatch):
    for name, value in (("_CUT_BYTES", 200), ("_BLOCK_BYTES", 600), ("_LOAD_BLOCKS", 2), ("_ROWS_BYTES", 500), ("_TURN", 3), ("_TEXTS", 2)):
        monkeypatch.setattr(m, name, value)
    draw = random.Random(5)
    passages = ["".join(draw.choice("abc") for _ in range(120)) for _ in range(3)]
    rows = []
    for i in range(50):
        p = draw.choice(passages)
        rows.append((draw.choice((None, i, i // 2)), "".join(draw.choice("ab ") for _ in range(draw.randint(0, 60))) + p[draw.randint(0, 70) :] + p[: draw.randint(0, 90)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(docs) == brute(rows, 50)


def test_memory_of_a_bucket_is_a_few_times_its_pieces(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(m, "TaskContext", Task)
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(500)]
    lines = [" ".join(draw.choices(words, k=40)) for _ in range(200)]
    texts = [" ".join([*draw.choices(words, k=150), draw.choice(lines), *draw.choices(words, k=150), draw.choice(lines)]) for _ in range(1200)]
    ids = range(len(texts))
    docs = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids), "node": pa.array(ids), "text": pa.array(texts)})
    rows = [row for batch in m._cut(50, 1)(iter([docs])) for row in batch.to_pylist() if row["bucket"] == 0]
    parts = pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary())]))
    held = sum(len(m._unpacked(row["data"])[1]) for row in rows)
    tracemalloc.start()
    try:
        found = m._in_bucket(50)((pa.scalar(0),), parts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert held > 8_000_000 and found.num_rows > 0
    assert peak < 8 * held, peak / held


def test_shuffle_files_go_with_what_was_found(spark):
    from rolesift.session import shuffles_removed

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    with shuffles_removed(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == before
