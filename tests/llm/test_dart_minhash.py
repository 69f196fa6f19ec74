import numpy as np

from samples import prose
from rolesift.llm import dart_minhash as m


def shingle_bag(text):
    words = m.words_of(text)
    if not words:
        return {}
    bag = {}
    for i in range(max(1, len(words) - 4)):
        key = tuple(words[i : i + 5])
        bag[key] = bag.get(key, 0) + 1
    return bag


def exact(a, b):
    a, b = shingle_bag(a), shingle_bag(b)
    shared = sum(min(n, b.get(k, 0)) for k, n in a.items())
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


def brute(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1] or "", rows[j][1] or ""
            if a == b or exact(a, b) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(find(i), []).append(i)
    out = []
    for members in classes.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], min(ids) if ids else None, len(members)) for i in members]
    return sorted(out, key=repr)


def test_classes_match_brute_force(tricky):
    rows = [(r["doc_id"], r["text"]) for r in tricky.collect()]
    got = m.near_duplicates(tricky).select("doc_id", "class_id", "class_size").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_chains_and_bridges(spark):
    words = prose(11, 200).split()
    rows = []
    for i in range(12):  # each near its neighbours only
        words = list(words)
        for j in range(3):
            words[(17 * i + 61 * j) % 190] = f"new{i}x{j}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, prose(50 + i, 60)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = m.near_duplicates(docs).select("doc_id", "class_id", "class_size").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_keep_one(tricky, nothing):
    rows = m.keep_one(tricky)
    assert rows.columns == tricky.columns
    got = rows.collect()
    ids = [r["doc_id"] for r in got]
    assert 1 in ids and 2 not in ids and 3 not in ids and ids.count(4) == 1 and ids.count(6) <= 1 and None in ids
    assert m.keep_one(nothing).count() == 0


def test_agreement_estimates_similarity():
    draw = np.random.default_rng(5)
    elements = draw.integers(1, 2**63, 300).astype(np.uint64)
    a, b = draw.uniform(0.1, 3, 300), draw.uniform(0.1, 3, 300)
    a[:150] = b[:150]
    owner = np.repeat([0, 1], 300)
    k = 2048
    signature = m.signatures(owner, np.concatenate((elements, elements)), np.concatenate((a, b)), 2, k)
    expected = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((signature[0] == signature[1]).mean() - expected) < 0.05
    alone = m.signatures(np.zeros(300, int), elements, a, 1, k)
    assert (alone[0] == signature[0]).all()


def test_large_buckets_lose_no_link(spark):
    # copies of one text with few or many changes, and texts around one passage: many just miss the similarity
    draw = np.random.default_rng(9)
    base, passage = prose(21, 120).split(), prose(22, 60).split()
    rows = []
    for i in range(120):
        words = list(base)
        for j in draw.choice(120, i % 6 + 1, replace=False):
            words[j] = f"x{i}y{j}"
        rows.append((i, " ".join(words)))
    for i in range(120):
        own = prose(500 + i // 2, 12 + i % 5).split()
        rows.append((200 + i, " ".join(passage + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = m.near_duplicates(docs).select("doc_id", "class_id", "class_size").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_similar_texts_share_a_band():
    p = m.SIMILARITY**m.ROWS
    assert (1 - p) ** m.BANDS < 2e-7


def test_signatures_are_made_for_few_texts_at_once(monkeypatch):
    import pyarrow as pa

    made, signatures = [], m.signatures
    monkeypatch.setattr(m, "signatures", lambda *rest: made.append(rest[3]) or signatures(*rest))
    texts = [f"only four short words {i}" for i in range(1000)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(range(1000)), pa.array(texts)], ["doc_id", "node", "text"])
    assert m._signed(rows, m.BANDS, m.ROWS).num_rows == 1000
    assert sum(made) == 1000 and max(made) <= 200


def test_bands_and_texts_are_not_moved_twice(spark, monkeypatch):
    # only the columns of a bucket's rows are sorted into buckets, and whole texts only where ids are too many to send
    bounds, plans, materialize, small = [], [], m.materialize, m.broadcast_if_small
    monkeypatch.setattr(m, "broadcast_if_small", lambda side, *most: bounds.append(most) or small(side, *most))
    monkeypatch.setattr(m, "materialize", lambda rows: plans.append(rows) or materialize(rows))
    base = prose(31, 60)
    docs = spark.createDataFrame([(i, base if i % 3 else prose(40 + i, 60)) for i in range(12)], "doc_id long, text string")
    got = m.near_duplicates(docs).select("doc_id", "class_size").collect()
    assert sorted(map(tuple, got)) == [(i, 8 if i % 3 else 1) for i in range(12)]
    met = next(p for p in plans if p.columns == ["bucket", "node", "n", "of"])
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(bucket") == 1 and "first(bands" not in plan
    assert (m._BROADCAST_IDS,) in bounds and () not in bounds
