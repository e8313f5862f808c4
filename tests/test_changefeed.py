"""The change feed against a sequential model."""

import random

from pyspark.sql import functions as F

from cairn.operators import changefeed as C

FEED = "key string, op string, instant long, place long, action string"


def model(events):
    """Apply events one by one, by definition."""
    ops = {}
    for key, op, instant, place, action in sorted(events, key=lambda e: e[3]):
        if None in (key, op, instant, place, action):
            continue
        ops.setdefault(op, (key, instant, place, action, op))
    state = {}
    for key, instant, place, action, op in ops.values():
        if key not in state or (instant, place) > state[key][:2]:
            state[key] = (instant, place, action, op)
    return {k: (v[2], v[3]) for k, v in state.items()}


def random_feed(seed, n=400):
    r = random.Random(seed)
    ops = {f"op{i}": (r.choice(["a", "b", "c", "hot", "hot", "hot"]), r.randint(0, 60), r.choice(["confirm", "dismiss", "reopen"])) for i in range(n // 2)}
    rows = []
    for place in range(n):
        op = r.choice(list(ops))
        key, instant, action = ops[op]
        rows.append((key, op, instant, place, action))
    r.shuffle(rows)
    return rows


def heads(df):
    return {r["key"]: (r["action"], r["op"]) for r in df.filter("is_head").collect()}


def test_matches_model_with_hot_key_repeats_and_ties(spark):
    for seed in range(2):
        rows = random_feed(seed)
        df = spark.createDataFrame(rows, FEED).repartition(5)
        assert heads(C.apply_changes(df, ("reopen",))) == model(rows)


def test_batches_out_of_order_equal_one_batch(spark, tmp_path):
    rows = random_feed(7, 300)
    table = C.ChangeTable(spark, f"file://{tmp_path}/t")
    for i in range(3):
        state = table.apply(spark.createDataFrame(rows[i::3], FEED), ("reopen",))
    assert heads(state) == model(rows)  # action and op
    assert heads(table.apply(spark.createDataFrame(rows, FEED), ("reopen",))) == model(rows)


def by_place(rows):
    return model([(key, op, min(r[3] for r in rows if r[1] == op), place, action) for key, op, _, place, action in rows])


def test_fold_by_place_over_any_batches(spark, tmp_path):
    rows = [("k", "o1", 9, 1, "confirm"), ("k", "o2", 1, 2, "dismiss"), ("k", "o1", 9, 3, "confirm")]
    table = C.ChangeTable(spark, f"file://{tmp_path}/two", by_place=True)
    table.apply(spark.createDataFrame(rows[:2], FEED), ("reopen",))
    assert heads(table.apply(spark.createDataFrame(rows[2:], FEED), ("reopen",))) == {"k": ("dismiss", "o2")}
    rows = random_feed(3, 240)
    for n in (1, 2, 7):
        order = random.Random(n).sample(rows, len(rows))
        table = C.ChangeTable(spark, f"file://{tmp_path}/p{n}", by_place=True)
        for i in range(n):
            state = table.apply(spark.createDataFrame(order[i::n], FEED), ("reopen",))
        assert heads(state) == by_place(rows)


def test_stream_of_several_files_equals_one(spark, tmp_path):
    from cairn.streaming import logs

    r = random.Random(5)
    rows = [(seq, f"op{seq % 60}", f"2024-01-01T00:00:{r.randint(10, 59)}Z", f"x_{seq % 60 % 11}", r.choice(["confirm", "dismiss", "reopen"]), None, None, None) for seq in range(150)]
    first = {}
    for x in rows:
        first.setdefault(x[1], x)
    want = {}
    for x in sorted(first.values()):
        want[x[3]] = (x[4], x[1])
    for n in (1, 7):
        order, folder = random.Random(n).sample(rows, len(rows)), f"file://{tmp_path}/in{n}"
        for i in range(n):
            spark.createDataFrame(order[i::n], logs.DECISIONS).coalesce(1).write.mode("append").parquet(folder)
        logs.start(spark, folder, f"file://{tmp_path}/s{n}", f"file://{tmp_path}/c{n}", once=True).awaitTermination()
        assert heads(C.ChangeTable(spark, f"file://{tmp_path}/s{n}").state()) == want


def test_only_touched_buckets_are_rewritten_and_old_versions_go(spark, tmp_path):
    table = C.ChangeTable(spark, f"file://{tmp_path}/t", buckets=16)
    table.apply(spark.createDataFrame([(f"k{i}", f"o{i}", 1, i, "confirm") for i in range(200)], FEED))
    before = table._manifest()["folders"]
    for i in range(4):
        state = table.apply(spark.createDataFrame([("k7", f"n{i}", 2 + i, 500 + i, "dismiss")], FEED))
    after = table._manifest()["folders"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert heads(state)["k7"] == ("dismiss", "n3") and len(heads(state)) == 200
    assert len([x for x in (tmp_path / "t").iterdir() if x.name.startswith("v-")]) == 3  # the first and the last two


def test_memory_does_not_follow_the_bucket():
    """Many more keys than fit at once, in one bucket and in order; and the partial pass over as many unordered ones."""
    import numpy as np
    import pyarrow as pa

    def batches(n, order):
        for a in range(0, n, 50_000):
            k = np.arange(a, min(n, a + 50_000)) if order else np.random.default_rng(a).integers(0, n, 50_000)
            key = pa.array(np.char.add("key-number-", np.char.zfill(k.astype(str), 9)))
            yield pa.RecordBatch.from_arrays([key, key, pa.array(k), pa.array(k), pa.array(["confirm"] * len(k))], names=C.FEED)

    assert sum(b.num_rows for b in C._upsert(batches(1_500_000, True), (), "256MB", True)) == 1_500_000
    assert sum(b.num_rows for b in C._upsert(batches(600_000, False), (), "256MB", False)) > 300_000


def test_a_key_over_many_batches_in_order(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(C, "KEYS", 4)
    rows = [("a", "o1", 1, 1, "confirm"), ("b", "o2", 5, 2, "confirm"), ("b", "o3", 7, 3, "dismiss"), ("b", "o4", 6, 4, "confirm"), ("b", "o5", 7, 5, "confirm"), ("c", "o6", 1, 6, "reopen")]
    parts = [pa.RecordBatch.from_pylist([dict(zip(C.FEED, r)) for r in rows[i : i + 2]]) for i in range(0, 6, 2)]
    got = [r for b in C._upsert(iter(parts), ("reopen",), "64MB", True) for r in b.to_pylist()]
    assert sorted((r["key"], r["op"], r["is_head"], r["is_deleted"]) for r in got) == [("a", "o1", True, False), ("b", "o3", False, False), ("b", "o5", True, False), ("c", "o6", True, True)]


def test_tombstones_stay_and_old_changes_do_not_revive(spark, tmp_path):
    table = C.ChangeTable(spark, f"file://{tmp_path}/t")
    table.apply(spark.createDataFrame([("k", "o2", 20, 2, "reopen")], FEED), ("reopen",))
    state = table.apply(spark.createDataFrame([("k", "o1", 10, 3, "confirm")], FEED), ("reopen",))
    row = state.first()
    assert row["is_deleted"] and row["op"] == "o2"


def test_empty_null_and_extra_columns(spark):
    empty = spark.createDataFrame([], FEED)
    assert C.apply_changes(empty).count() == 0
    nulls = spark.createDataFrame([(None, "o", 1, 1, "confirm"), ("k", None, 1, 1, "confirm"), ("k", "p", None, 1, "confirm"), ("k", "q", 1, None, "confirm"), ("k", "r", 1, 1, None)], FEED)
    assert C.apply_changes(nulls.withColumn("head", F.lit(1))).count() == 0


def test_failed_publication_keeps_the_old_version(spark, tmp_path):
    table = C.ChangeTable(spark, f"file://{tmp_path}/t")
    table.apply(spark.createDataFrame([("k", "o1", 1, 1, "confirm")], FEED))
    broken = spark.createDataFrame([("k", "o2", 2, 2, "confirm")], FEED).withColumn("instant", F.raise_error(F.lit("lost")).cast("long"))
    try:
        table.apply(broken)
    except Exception:
        pass
    assert table.state().first()["op"] == "o1"


def test_instants(spark):
    cases = {
        "2024-03-02T16:35:02Z": 1709397302000000, "2024-03-02 16:35:02": 1709397302000000, "2024-03-02T16:35:02.5+12:45": 1709351402500000, "1710076585000": 1710076585000000, "2024-03-02T16:35Z": 1709397300000000,
        "2024-02-30T10:00:00Z": None, "2024-03-02": None, "yesterday": None, "": None, "1738121-45T10:00:00Z": None, "2024-03-02T16:35:02+25:00": None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", C.parse_instant(F.col("t")).alias("i")).collect()
    assert {r["t"]: r["i"] for r in got} == cases
