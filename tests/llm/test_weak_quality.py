import re
from collections import Counter

from rolesift.llm import weak_quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_and_base_rule(tricky):
    got = q.judge(tricky, q.fit(q.pattern_counts(tricky))).collect()
    assert len(got) == tricky.count()
    texts = [r["text"] for r in tricky.collect()]
    assert sorted(tuple(r[c] for c in q.COUNTS) for r in got) == sorted(map(brute, texts))
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and (not r["kept"] or not failed)


def test_keep_good_keeps_columns_and_agrees(tricky):
    kept = {r["doc_id"] for r in q.judge(tricky, q.fit(q.pattern_counts(tricky))).filter("kept").collect()}
    rows = q.keep_good(tricky)
    assert rows.columns == tricky.columns and {r["doc_id"] for r in rows.collect()} == kept
    assert 5 not in kept and 6 not in kept and 10 not in kept


def test_empty(nothing):
    assert q.keep_good(nothing).count() == 0 and q.fit([]) == {}


def test_estimates_follow_planted_quality():
    good = sum(2 * 3**k for k in range(10))
    poor = sum((0 if k % 2 else 1) * 3**k for k in range(10))
    post = q.fit([(good, 90), (poor, 10)])
    assert post[good] > 0.9 > 0.1 > post[poor]


def test_labels_agree(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        return
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label").drop("toxic")
    rows = q.op5_weak_quality(spark, sf).join(labels, "doc_id").filter("not base_failed").collect()
    good = [r["kept"] for r in rows if r["label"]]
    poor = [r["kept"] for r in rows if not r["label"]]
    assert sum(good) > 0.99 * len(good) and sum(poor) < 0.1 * len(poor)
