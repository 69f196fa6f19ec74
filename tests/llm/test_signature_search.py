import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rolesift.llm import signature_search as s
from samples import prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=20):
    cut = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(i, len(cut(t)), Counter(cut(t))) for i, t in docs]
    held = [d for d in held if d[1]]
    n_docs, n_terms = len(held), sum(d[1] for d in held)
    df = Counter(t for d in held for t in d[2])
    out = []
    for item_id, text in set(items):
        ranked = []
        for i, n, tf in held:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
                for t in cut(text) if t in tf
            )
            if score > 0 and i is not None:
                ranked.append((-score, i))
        out += [(item_id, r + 1, i, -score) for r, (score, i) in enumerate(sorted(ranked)[:k])]
    return sorted(out, key=repr)


def both(spark, docs, items):
    got = s.search(
        spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item string"),
        spark.createDataFrame([(i, t, 1.5) for i, t in items], "item_id long, text string, score double"),
    )
    return sorted(map(tuple, got.collect()), key=repr), brute(docs, items)


def corpus(n):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(draw.choice(words[: draw.choice((5, 60, 400))]) for _ in range(draw.choice((3, 40, 300)))) for _ in range(n)]
    return list(enumerate(texts + texts[:40] * 3)), [(i, " ".join(draw.choices(words, k=12))) for i in range(30)]


def test_against_brute_force(spark):
    docs, items = corpus(600)
    got, want = both(spark, docs, items)
    assert got == want and len(want) == 600


def test_small_blocks_change_nothing(spark, monkeypatch):
    docs, items = corpus(150)
    monkeypatch.setattr(s, "BLOCK_DOCS", 8)
    monkeypatch.setattr(s, "ITEMS", 9)
    got, want = both(spark, docs, items)
    assert got == want


def test_tricky_rows(spark):
    docs = [
        (1, None), (2, ""), (3, " \t"), (4, "Ünï ñ 日本 ÜNÏ"), (5, "Ünï ñ 日本 ÜNÏ"), (5, "alpha beta"), (5, "alpha beta"), (None, "alpha gamma"),
        (6, "ALPHA_beta-x9 x9 x9"), (7, prose(3, 9000)), (-8, prose(3, 200)), (2**62, "alpha"), *[(100 + i, "same text here") for i in range(60)],
    ]
    items = [(1, "Alpha beta"), (1, "Alpha beta"), (2, None), (3, ""), (4, "日本 x9"), (5, prose(3, 50)), (None, "same"), (6, "same HERE here"), (7, "nowhere")]
    got, want = both(spark, docs, items)
    assert got == want


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")])])
def test_empty(spark, docs, items):
    assert both(spark, docs, items) == ([], [])


def test_bounds_hold_and_are_close():
    """No bound is below the score; on ordinary texts few documents beyond the best are scored."""
    docs, items = corpus(300)
    cut = [s.terms_of(t.encode()) for _, t in docs]
    held = [Counter(c) for c in cut]
    words = sorted({t for c in held for t in c})
    hashes = [np.array([s.xxhash.xxh3_64_intdigest(t) for t in c], np.uint64) for c in held]
    counts = [np.array(list(c.values())) for c in held]
    lengths, most = np.array([len(c) for c in cut]), np.array([max(c.values()) for c in held])
    slices = s.slices_of(hashes, counts, 4096)
    n_items = len(items)
    triples = np.array(sorted((words.index(t), i, 7 + len(t)) for i, (_, text) in enumerate(items) for t in set(s.terms_of(text.encode())) if t in words))
    starts = np.searchsorted(triples[:, 0], np.arange(len(words) + 1))
    asked = np.array([s.xxhash.xxh3_64_intdigest(t) for t in words], np.uint64), (starts, triples[:, 1], triples[:, 2].astype(float)), n_items, len(docs), int(lengths.sum())
    bounds = s.upper_bounds(4096, lengths, most, slices, asked)
    factor = 75 + 25 * lengths * len(docs) // int(lengths.sum())
    for t, i, w in triples:
        often = np.array([c[words[t]] for c in held])
        bounds[i] -= w * s.gain(often, factor)
    assert (bounds >= 0).all()
