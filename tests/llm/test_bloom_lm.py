import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rolesift.llm import bloom_lm as m


def brute(rows):
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted(
        (
            (i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6))
            for i, ws in tokens
        ),
        key=repr,
    )


def base(rows):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows), key=repr)


def test_base_and_shards(tricky, nothing, monkeypatch):
    docs = m.with_fold(tricky)
    model = m.train(docs.filter(~F.col("held_out")))
    one = m.score(docs, *model).collect()
    assert base(one) == brute([(r["doc_id"], r["text"]) for r in tricky.collect()])
    monkeypatch.setattr(m, "MAX_BYTES", 700)
    assert len(m._shards(model[0], 0)) > 1 and len(m._shards(model[0], 1)) > 1
    many = m.score(docs, *model).collect()
    key = lambda r: (repr(r["doc_id"]), r["n_tokens"])
    for a, b in zip(sorted(one, key=key), sorted(many, key=key), strict=True):
        assert a["n_known"] == b["n_known"] and a["score"] == pytest.approx(b["score"]) and a["base_score"] == pytest.approx(b["base_score"])
    empty = m.with_fold(nothing)
    assert m.score(empty, *m.train(empty)).count() == 0


def test_score_follows_the_unquantised_model(spark):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    rows = m.op8_bloom_lm(spark, sf).collect()
    docs = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in docs.items()}
    train = [i for i in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    count, pairs = Counter(), Counter()
    for i in train:
        count.update(tokens[i])
        pairs.update(zip([None, *tokens[i][:-1]], tokens[i]))
    seen, types = Counter(), Counter()
    for (h, _), n in pairs.items():
        seen[h] += n
        types[h] += 1
    n, v = sum(count.values()), len(count)
    errors, held = [], [0.0, 0.0]
    for r in rows:
        words = tokens[r["doc_id"]]
        exact = 0.0
        for h, w in zip([None, *words[:-1]], words):
            p0 = (count[w] + 1) / (n + v + 1)
            exact += math.log10((pairs[h, w] + types[h] * p0) / (seen[h] + types[h]) if seen[h] else p0)
        errors.append(abs(r["score"] - exact) / abs(exact))
        if r["held_out"]:
            held = [held[0] + r["base_score"], held[1] + r["score"]]
    assert sum(errors) / len(errors) < 0.05
    assert held[1] > held[0]  # unseen texts are better foretold than by single words
