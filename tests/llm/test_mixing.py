import pytest

from rolesift.llm.mixing import mix, source_targets, with_copies


def fill(sizes, weights, share, cap):
    """Targets by dealing the excess again until none is above, as the words say."""
    left, out, open_ = share * sum(sizes), {}, dict(enumerate(weights))
    while open_:
        level = left / sum(open_.values())
        full = [i for i, w in open_.items() if level * w > cap * sizes[i]]
        if not full:
            out.update({i: level * w for i, w in open_.items()})
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
            del open_[i]
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [5, 1000, 40, 7, 0, 300, 9], [1], [10**12, 3, 5 * 10**9, 1, 1, 1], [0, 0]])
def test_targets_against_plain_dealing(spark, sizes):
    names = [f"s{i:02d}" for i in range(len(sizes))]
    if len(names) > 1:
        names[-1] = None  # the last in order
    rows = spark.createDataFrame(list(zip(names, sizes)), "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(rows, (3, 1, 2), 1.5, 2).collect()}
    want = fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5, 2)
    assert [got[n] for n in names] == pytest.approx(want)


def test_order_is_by_code_point(spark):
    rows = spark.createDataFrame([(n, 1000) for n in ("b", "B", "\U0001f600", "￮", None, "")], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(rows, (3, 1, 2), 0.5, 2).collect()}
    level = 3000 / 12
    order = ["", "B", "b", "￮", "\U0001f600", None]
    assert got == {n: pytest.approx(level * w) for n, w in zip(order, (3, 1, 2, 3, 1, 2))}


def test_mix_repeats_whole_rows_near_targets(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (1 + i % 7), "hot" if i % 3 else f"s{i % 5}", "kept") for i in range(6000)],
        "doc_id long, text string, source string, copies string",
    )
    counted = with_copies(docs)
    taken = {
        r[0]: (r[1], r[2])
        for r in counted.groupBy("source").agg({"target": "max", "*": "count"}).select("source", "max(target)", "count(1)").collect()
    }
    sums = {r["source"]: r["n"] for r in counted.selectExpr("source", "size * copies n").groupBy("source").sum("n").toDF("source", "n").collect()}
    for source, (target, _) in taken.items():
        assert sums[source] == pytest.approx(target, rel=0.1)
    emitted = mix(docs)
    assert emitted.columns == [*docs.columns, "copy"] and emitted.select("copies").distinct().collect() == [("kept",)]
    assert emitted.count() == counted.agg({"copies": "sum"}).first()[0]
    assert counted.agg({"copies": "max"}).first()[0] <= 2
    assert sorted(map(tuple, emitted.collect())) == sorted(map(tuple, mix(docs.repartition(5)).collect()))


def test_tricky_rows(tricky, nothing):
    docs = tricky.withColumnRenamed("node", "source")
    rows = with_copies(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["size"] == len((r["text"] or "").encode().split()) for r in rows)
    assert len({(r["doc_id"], r["text"], r["copies"]) for r in rows}) == len({(r["doc_id"], r["text"]) for r in rows})
    assert with_copies(nothing.withColumnRenamed("node", "source")).count() == 0
