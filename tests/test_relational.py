"""Skewed joins, dedupe, anti join, upsert, windows, holdout: against brute force."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import bag, plan
from lineforge import session
from lineforge.operators import increments, sampling
from lineforge.operators.antijoin import not_in
from lineforge.operators.dedupe import dedupe_latest, dedupe_max_max
from lineforge.sources import runs
from lineforge.sources.files import write_parquet
from lineforge.sources.runs import BEFORE, RunTable
from lineforge.sources.tables import BUCKET, Buckets, overwrite_table, scan_table
from lineforge.operators.upsert import DUPLICATE, latest_lines, merge_statement, repeated_keys, unique_or_error, upsert


def skewed(spark, rows=3000, seed=1):
    """A third of the rows on key 7, a few without a key, the rest spread."""
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        key = 7 if i % 3 == 0 else None if i % 50 == 0 else rng.randrange(400)
        data.append((key, f"{rng.randrange(30)} ", f" {rng.randrange(12)}", i))
    return data, spark.createDataFrame(
        data, "k int, JOTSTP string, JOSEQN string, i int"
    ).repartition(8)


def max_max(data):
    tops = {}
    for k, t, s, _ in data:
        a, b = tops.get(k, ("", ""))
        tops[k] = (max(a, t.strip()), max(b, s.strip()))
    return sorted([r for r in data if (r[1].strip(), r[2].strip()) == tops[r[0]]], key=repr)


def test_dedupe_max_max_with_a_frequent_key(spark):
    data, df = skewed(spark)
    expected = max_max(data)
    assert {r[0] for r in expected} < {r[0] for r in data}  # some keys keep nothing
    assert bag(dedupe_max_max(df, ["k"])) == expected


@pytest.mark.parametrize("share", [0.005, 0.9])
def test_no_task_joins_a_whole_frequent_group(spark, share):
    """Rows of one key arrive in many partitions of the join, whatever its share."""
    n = 4000
    rows = [("hot" if i < share * n else f"k{i}", str(i % 97), str(i % 13), i) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, JOTSTP string, JOSEQN string, i int").repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(dedupe_max_max(df, ["k"]))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Window" not in text
    # Rows are dealt out by key, stamp and sequence; only partial maxima by the key alone.
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 3 and sum("trim(JOTSTP" in x or "__stamp" in x for x in exchanges) == 2
    assert bag(dedupe_max_max(df, ["k"])) == max_max(rows)


def test_dedupe_max_max_compares_text_and_keeps_ties(spark):
    data = [("a", "9", "1", 0), ("a", "10", "1", 1), ("b", "1", "2", 2), ("b", "1", "2", 3),
            ("c", "1", "2", 4), ("c", "2", "1", 5), ("d", None, "1", 6)]
    df = spark.createDataFrame(data, "k string, JOTSTP string, JOSEQN string, i int")
    assert [r["i"] for r in dedupe_max_max(df, ["k"]).orderBy("i").collect()] == [0, 2, 3]


def test_dedupe_latest(spark):
    data, df = skewed(spark)
    latest = dedupe_latest(df, ["k"], [F.col("i").desc()])
    best = {}
    for r in data:
        best[r[0]] = max(best.get(r[0], r), r, key=lambda x: x[3])
    assert bag(latest) == sorted(best.values(), key=repr)
    kept = dedupe_latest(df, ["k"], [F.col("i").desc()], keep_null_keys=True)
    assert kept.filter("k is null").count() == sum(r[0] is None for r in data)


def test_dedupe_latest_is_repeatable_on_ties(spark):
    df = spark.createDataFrame([(1, f"v{i}") for i in range(200)], "k int, v string")
    picks = {
        dedupe_latest(df.repartition(n), ["k"], [F.col("k")]).first()["v"] for n in (1, 3, 8)
    }
    assert len(picks) == 1


@pytest.mark.parametrize("excluded", [[], [2, 3, 3], [2, None], [None]])
def test_not_in_matches_sql(spark, excluded):
    rows = [(1, "a"), (2, "b"), (None, "c"), (2, "d")]
    df = spark.createDataFrame(rows, "k int, v string")
    out = spark.createDataFrame([(k,) for k in excluded], "k int")
    df.createOrReplaceTempView("outer_rows")
    out.createOrReplaceTempView("excluded_rows")
    expected = spark.sql("select * from outer_rows where k not in (select k from excluded_rows)")
    assert bag(not_in(df, out, "k")) == bag(expected)


def test_not_in_with_a_hot_key(spark):
    data, df = skewed(spark)
    out = spark.createDataFrame([(k,) for k in [7, 7, *range(0, 400, 3)]], "k int")
    gone = {7, *range(0, 400, 3)}
    kept = [r for r in data if r[0] is not None and r[0] not in gone]
    assert bag(not_in(df, out, "k")) == sorted(kept, key=repr)


def test_upsert_spreads_rows_without_a_key(spark):
    rows = [(None, f"v{i}", "t", None) for i in range(400)]
    batch = batch_of(spark, [(f"w{i}", "T", None) for i in range(400)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        merged = upsert(snapshot_of(spark, rows), batch)
        sizes = merged.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in sizes) == 800 and max(r["count"] for r in sizes) < 400


COLUMNS = "polExternalID string, v string, insertDateTime string, changedDateTime string"


def snapshot_of(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def batch_of(spark, rows):
    return spark.createDataFrame(rows, "v string, insertDatetime string, polExternalID string")


def test_upsert(spark):
    snapshot = snapshot_of(
        spark, [("1", "a", "t0", None), ("2", "b", None, "c0"), (None, "n", "t0", None)]
    )
    batch = batch_of(spark, [("B", "t1", "2"), ("C", "t1", "3"), ("N", "t1", None), (None, "t1", "1")])
    assert bag(upsert(snapshot, batch)) == sorted(
        [
            ("1", None, "t0", "t1"),
            ("2", "B", None, "t1"),
            ("3", "C", "t1", None),
            (None, "n", "t0", None),
            (None, "N", "t1", None),
        ],
        key=repr,
    )


def test_upsert_twice_changes_nothing_more(spark):
    snapshot = snapshot_of(spark, [(str(i), f"v{i}", "t0", None) for i in range(20)])
    batch = batch_of(spark, [(f"w{i}", "t1", str(i)) for i in range(10, 30)])
    once = upsert(snapshot, batch)
    twice = upsert(once, batch)
    values = ("polExternalID", "v", "insertDateTime")
    assert bag(once, *values) == bag(twice, *values)
    assert once.count() == 30


def test_upsert_random_with_hot_snapshot_key(spark):
    rng = random.Random(3)
    rows = [
        ("hot" if i % 3 == 0 else None if i % 10 == 0 else str(rng.randrange(500)), f"v{i}", f"t{i}", None)
        for i in range(1500)
    ]
    new = {k: f"w{k}" for k in ["hot", *map(str, range(300, 700))]}
    expected = [
        (k, new[k], at, "T") if k in new else (k, v, at, changed) for k, v, at, changed in rows
    ]
    present = {r[0] for r in rows}
    expected += [(k, v, "T", None) for k, v in new.items() if k not in present]
    expected += [(None, "x", "T", None)]
    snapshot = snapshot_of(spark, rows).repartition(8)
    batch = batch_of(spark, [(v, "T", k) for k, v in new.items()] + [("x", "T", None)])
    assert bag(upsert(snapshot, batch)) == sorted(expected, key=repr)


def test_upsert_refuses_duplicates_and_missing_columns(spark):
    snapshot = snapshot_of(spark, [("1", "a", "t0", None)])
    twice = batch_of(spark, [("x", "t1", "1"), ("y", "t1", "1")])
    with pytest.raises(Exception, match=DUPLICATE):
        upsert(snapshot, twice).collect()
    nameless = batch_of(spark, [("x", "t", None), ("x", "t", None)])
    assert unique_or_error(nameless, "polExternalID").count() == 2
    with pytest.raises(ValueError, match="lacks"):
        upsert(snapshot, twice.drop("v"))


def test_merge_statement_is_sql_and_says_the_same(spark):
    text = merge_statement("`db`.`parts`", "batch", ["polExternalID", "v", "insertDateTime", "changedDateTime"])
    spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    matched, new = text.split("WHEN NOT MATCHED")
    assert "t.`changedDateTime` = s.`insertDateTime`" in matched and "t.`v` = s.`v`" in matched
    assert "t.`insertDateTime` =" not in matched
    assert "NULL" in new


def test_latest_lines(spark):
    rows = [
        ("1", "Open", "2024-01-02", "m9"), ("1", "Closed", "2024-01-02", "m1"),
        ("1", "Closed", "2024-01-01", "m9"), ("2", "Open", None, "m1"), ("2", "Open", None, "m2"),
        (None, "Open", "x", "y"), (None, "Open", "x", "y"),
    ]
    df = spark.createDataFrame(
        rows, "polExternalID string, catOrderStatus string, insertDateTime string, modifiedDateTime string"
    )
    assert bag(latest_lines(df)) == sorted([rows[1], rows[4], rows[5], rows[6]], key=repr)


def test_fetch_windows(spark):
    anchor = spark.sql("select date '2024-03-01' as as_of")
    assert bag(increments.fetch_windows(anchor)) == sorted(
        (s, date(2024, *a), date(2024, *b))
        for s in ("Open", "Closed")
        for a, b in [((2, 28), (2, 29)), ((2, 29), (3, 1)), ((3, 1), (3, 2))]
    )


def test_select_windows_is_half_open(spark):
    df = spark.sql(
        """select * from values (timestamp '2024-01-12 23:59:59'), (timestamp '2024-01-13 00:00:00'),
        (timestamp '2024-01-15 23:59:59'), (timestamp '2024-01-16 00:00:00') as t(ts)"""
    )
    days = increments.select_windows(df, "ts", date(2024, 1, 15)).select("from_date").collect()
    assert [r[0] for r in days] == [date(2024, 1, 13), date(2024, 1, 15)]


@pytest.mark.parametrize("n", [1, 10, 999, 1000, 5000])
def test_holdout_parts_are_disjoint_and_complete(spark, n):
    rng = random.Random(n)
    data = [(rng.choice(["2024-01-0%d" % d for d in range(1, 9)] + [None]), i) for i in range(1000)]
    df = spark.createDataFrame(data, "d string, i int").repartition(8)
    tail = sampling.holdout_tail(df, ["d", "i"], n)
    head = sampling.holdout_head(df, ["d", "i"], n)
    ordered = sorted(data, key=lambda r: (r[0] or "", r[1]))
    assert bag(tail) == sorted(ordered[-n:], key=repr)
    assert bag(head) == sorted(ordered[: max(0, 1000 - n)], key=repr)


def test_holdout_of_one_day_and_of_nulls(spark):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [("d", i) for i in range(5)], "d string, i int")
    assert bag(sampling.holdout_tail(df, ["d", "i"], 8)) == sorted(
        [("d", i) for i in range(5)] + [(None, i) for i in (47, 48, 49)], key=repr
    )
    assert sampling.holdout_head(df, ["d", "i"], 8).count() == 47
    assert sampling.holdout_tail(df.filter("false"), ["d", "i"], 8).count() == 0


def test_holdout_sorts_no_whole_partition(spark, folder):
    df = spark.range(2000).selectExpr("cast(id % 40 as string) as d", "id as i")
    df.write.parquet(folder + "/h")
    text = plan(sampling.holdout_tail(spark.read.parquet(folder + "/h"), ["d", "i"], 100))
    assert "TakeOrderedAndProject(limit=100" in text and "RoundRobin" not in text
    lines = [line.strip(" :+-*()0123456789") for line in text.splitlines()]
    # What is sorted in full are the distinct first values, and the last hundred rows.
    below = {lines[i + 1].split()[0] for i, line in enumerate(lines) if line.startswith("Sort ")}
    assert below <= {"Exchange", "TakeOrderedAndProject"} and "FileScan" not in below


def orders_of(kind, rng):
    """Values of one type in their order's own terms, nulls as None."""
    text = {
        "prefix": lambda i: f"order-line-of-2024-{rng.randrange(10**6):07d}-{i}",
        "odd": lambda i: rng.choice(["", "\0", "a", "a\0", "a\0\0", "é", "😀", "zzzzzzz", "zzzzzzz\0", "zzzzzzza"]),
    }
    if kind in text:
        return "string", text[kind]
    if kind in ("timestamp", "timestamp_ntz"):
        start = datetime(1969, 12, 28)
        return kind, lambda i: start + timedelta(microseconds=rng.randrange(10**12))
    if kind == "date":
        return "date", lambda i: date(1960, 1, 1) + timedelta(days=rng.randrange(40_000))
    if kind == "hot":
        return "long", lambda i: 7 if rng.random() < 0.7 else rng.randrange(-(2**63), 2**63)
    return "long", lambda i: rng.choice([-1, 1]) * int(10 ** (18 * rng.random()))


@pytest.mark.parametrize("kind", ["prefix", "odd", "timestamp", "timestamp_ntz", "date", "hot", "skewed"])
def test_holdout_by_sketches_against_sorting(spark, kind):
    rng = random.Random(kind)
    dtype, value = orders_of(kind, rng)
    data = [(value(i) if rng.random() < 0.9 else None, i) for i in range(2000)]
    df = spark.createDataFrame(data, f"`a.b` {dtype}, i int").repartition(5).cache()
    bytes_of = (lambda v: v.encode()) if dtype == "string" else (lambda v: v)
    ordered = sorted(data, key=lambda r: (r[0] is not None, bytes_of(r[0]) if r[0] is not None else 0, r[1]))
    for n in (1, 1000, 1900, 2001):
        tail, head = sampling.holdout_parts(df, ["a.b", "i"], n, at_once=16)
        assert sorted(r.i for r in tail.collect()) == sorted(r[1] for r in ordered[-n:])
        assert sorted(r.i for r in head.collect()) == sorted(r[1] for r in ordered[: max(0, 2000 - n)])


def test_holdout_by_sketches_of_few_equal_or_no_rows(spark):
    df = spark.createDataFrame([(5,)] * 40, "k int")
    assert sampling.find_cut(df, ["k"], 3, at_once=4) == (5,)
    tail, head = sampling.holdout_parts(df.filter("false"), ["k"], 3)
    assert (tail.count(), head.count()) == (0, 0)
    for order, n in ((["k"], 0), (["x"], 3)):
        with pytest.raises(ValueError):
            sampling.find_cut(df.selectExpr("k", "cast(k as double) as x"), order, n)


def test_holdout_by_sketches_leaves_no_window_and_reaches_the_scan(spark, folder):
    spark.range(20_000).selectExpr("id * 7919 % 20011 as k", "id as v").write.parquet(folder + "/u")
    seen = spark.read.parquet(folder + "/u")
    tail, head = sampling.holdout_parts(seen, ["k"], 5000, at_once=100)
    cut = sampling.find_cut(seen, ["k"], 5000, at_once=100)[0]
    for part in (tail, head):
        text = plan(part)
        assert not any(word in text for word in ("Window", "Sort", "Exchange")) and f"(k,{cut})" in text
    assert (tail.count(), head.count()) == (5000, 15_000)


def test_split_is_repeatable_disjoint_and_complete(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    train, test = sampling.split_train_test(df, "k")
    a, b = bag(train), bag(test)
    assert not set(a) & set(b) and len(a) + len(b) == 4000
    assert 0.30 < len(b) / 4000 < 0.36
    assert bag(sampling.split_train_test(df.repartition(5), "k")[1]) == b
    assert bag(sampling.split_train_test(df, "k", seed=1)[1]) != b


def run_table(folder, name, buckets=None):
    return RunTable("lines", name, f"{folder}/{name}/lines", "polExternalID", f"{folder}/{name}", buckets)


def keyed(spark, rows):
    return spark.createDataFrame(rows, "polExternalID string, v int, insertDateTime string, changedDateTime string")


def test_runs_give_what_upserts_give(spark, folder):
    """A dozen batches over all buckets, with compactions between them; rows without a key always stay."""
    table = run_table(folder, "by_runs", Buckets(4, "polExternalID"))
    rng = random.Random(3)
    expected = keyed(spark, [(str(i), i, None if i % 3 else "d0", None) for i in range(80)] + [(None, -1, "d0", None)])
    table.create(expected)
    rows = {}
    for r in expected.collect():
        rows.setdefault(r[0], []).append(tuple(r))
    for day in range(1, 9):
        batch = [(str(k), rng.randrange(99), f"d{day}", "ignored") for k in rng.sample(range(120), 30)]
        batch.append((None, day, f"d{day}", "ignored"))
        files = set(table.base(spark).inputFiles())
        changes = table.upsert(keyed(spark, batch), remember=["v"])
        assert set(table.base(spark).inputFiles()) == files
        seen = {r["polExternalID"]: r[BEFORE] and r[BEFORE]["v"] for r in changes.collect()}
        for key, value, at, _ in batch:
            old = rows.get(key) if key is not None else None
            assert seen[key] == (old[0][1] if old else None)
            if key is None:
                rows[key].append((None, value, at, None))
            else:
                rows[key] = [(key, value, old[0][2], at) if old else (key, value, at, None)]
        assert bag(table.content(spark)) == sorted((r for some in rows.values() for r in some), key=repr)
        if table.crowded(spark, 4, 9.0):
            before = bag(table.content(spark))
            assert table.numbers(spark) == [1, 2, 3, 4]
            assert bag(table.compact(spark)) == before and table.numbers(spark) == []


def test_a_run_is_as_large_as_its_batch(spark, folder):
    table = run_table(folder, "small", Buckets(4, "polExternalID"))
    table.create(keyed(spark, [(str(i), i, "d0", None) for i in range(20_000)]))
    table.upsert(keyed(spark, [(str(i * 500), 0, "d1", None) for i in range(40)]))
    assert table.runs(spark).count() == 40 and table.content(spark).count() == 20_000
    # The base is neither shuffled nor sorted to be read.
    text = plan(table.content(spark))
    assert "BroadcastHashJoin" in text or "isFinalPlan=false" in text
    assert not table.crowded(spark, 4) and table.crowded(spark, 1)


@pytest.mark.parametrize("sent, marked", [(250_000, 1 << 30), (10, 1 << 30), (10, 10)])
def test_changed_rows_of_the_base_go_without_shuffling_the_others(spark, folder, monkeypatch, sent, marked):
    monkeypatch.setattr(runs, "MOST_SENT", sent)
    monkeypatch.setattr(runs, "MOST_MARKED", marked)
    table = run_table(folder, f"marked_{sent}_{marked}", Buckets(2, "polExternalID"))
    n = 150_000  # more rows in a bucket than one bitmap has bits
    base = spark.range(n).selectExpr(
        "nullif(cast(id as string), '9') as polExternalID", "cast(id as int) as v",
        "'d0' as insertDateTime", "cast(null as string) as changedDateTime",
    ).coalesce(2)
    table.create(base)
    for day, divisor in ((1, 3), (2, 7)):
        batch = base.filter(f"v % {divisor} = 0 and v <> 9").withColumn("v", -F.col("v") - day)
        table.upsert(batch.withColumn("insertDateTime", F.lit(f"d{day}")))
    found = table.content(spark)
    text = plan(found)
    assert ("LeftAnti, BuildRight" in text) == (sent > 10)
    assert ("LeftOuter, BuildRight" in text) == (sent == 10 and marked > 10)
    got = {r.v for r in found.collect()}
    assert got == {-i - 2 if i % 7 == 0 else -i - 1 if i % 3 == 0 and i != 9 else i for i in range(n)}
    assert found.count() == n and found.filter("polExternalID is null").count() == 1


def test_runs_refuse_repeated_keys_and_missing_columns(spark, folder):
    table = run_table(folder, "strict")
    table.create(keyed(spark, [("1", 1, "d0", None)]))
    with pytest.raises(Exception, match=DUPLICATE):
        table.upsert(keyed(spark, [("1", 1, "d1", None), ("1", 2, "d1", None)]))
    with pytest.raises(ValueError, match="lacks"):
        table.upsert(spark.createDataFrame([("1",)], "polExternalID string"))
    assert table.numbers(spark) == [] and bag(table.content(spark)) == [("1", 1, "d0", None)]


def test_a_base_folded_by_a_job_that_died_reads_the_same(spark, folder):
    table = run_table(folder, "died")
    table.create(keyed(spark, [("1", 1, "d0", None), ("2", 2, "d0", None)]))
    table.upsert(keyed(spark, [("1", 5, "d1", None), ("3", 3, "d1", None)]))
    before = bag(table.content(spark))
    overwrite_table(table.content(spark), table.path, table.table, table.database)
    assert table.numbers(spark) == [1] and bag(table.content(spark)) == before


def test_latest_lines_shuffles_only_the_rows_of_repeated_keys(spark):
    rng = random.Random(4)
    rows = [
        (None if i % 40 == 0 else str(rng.randrange(300)), f"d{rng.randrange(3)}", rng.choice(["Open", "Closed"]), f"m{i}")
        for i in range(400)
    ]
    names = "polExternalID string, insertDateTime string, catOrderStatus string, modifiedDateTime string"
    batch = spark.createDataFrame(rows, names)
    again = repeated_keys(batch)
    keys = [r[0] for r in rows if r[0] is not None]
    assert bag(again) == sorted((k,) for k in set(keys) if keys.count(k) > 1)
    latest = latest_lines(batch, repeated=again)
    assert bag(latest) == bag(latest_lines(batch))
    text = plan(latest)
    assert text.index("Window") < text.index("LeftSemi") and "LeftAnti, BuildRight" in text


def shuffled_bytes(spark):
    """What shuffle files take on disk just now."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = [files.apply(i) for i in range(files.size())]
    return sum(f.length() for f in found if f.getName().startswith("shuffle_"))


def test_shuffle_files_go_once_their_rows_are_written(spark, folder):
    rows = spark.range(200_000).withColumn("text", F.sha2(F.col("id").cast("string"), 256))
    before = shuffled_bytes(spark)
    write_parquet(rows.repartition(4, "id"), f"{folder}/plain")
    table = run_table(folder, "dropped", Buckets(4, "polExternalID"))
    lines = rows.selectExpr(
        "cast(id as string) as polExternalID", "cast(id as int) as v", "text as insertDateTime",
        "cast(null as string) as changedDateTime",
    )
    table.create(lines)
    assert shuffled_bytes(spark) <= before + 1_000_000
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == "false"


def test_a_run_is_written_once(spark, folder, monkeypatch):
    written = []
    monkeypatch.setattr(runs, "run_dir", lambda _, purpose: written.append(purpose) or f"{folder}/{purpose}")
    table = run_table(folder, "once", Buckets(2, "polExternalID"))
    table.create(keyed(spark, [(str(i), i, "d0", None) for i in range(20)]))
    batch = write_parquet(keyed(spark, [("3", -3, "d1", None), ("x", -4, "d1", None)]), f"{folder}/batch")
    changes = table.upsert(batch, remember=["v"], stored=True)
    assert written == []
    assert {r["polExternalID"]: r[BEFORE] and r[BEFORE]["v"] for r in changes.collect()} == {"3": 3, "x": None}
    assert BEFORE not in table.runs(spark).columns and table.numbers(spark) == [1]
    assert bag(table.content(spark).filter("v < 0"), "polExternalID", "v", "changedDateTime") == [
        ("3", -3, "d1"), ("x", -4, None),
    ]


@pytest.mark.parametrize("sent, least, buckets", [(250_000, 0, 3), (10, 0, 3), (10, 1 << 40, 3), (10, 0, 4)])
def test_folding_runs_shuffles_only_their_rows(spark, folder, monkeypatch, sent, least, buckets):
    """Unless the base's files are small, or its rows lie in other buckets than they should."""
    monkeypatch.setattr(runs, "MOST_SENT", sent)
    monkeypatch.setattr(runs, "LEAST_KEPT", least)
    name = f"folded_{sent}_{least}_{buckets}"
    table = run_table(folder, name, Buckets(3, "polExternalID"))
    n = 100_000
    base = spark.range(n).selectExpr(
        "nullif(cast(id as string), '9') as polExternalID", "cast(id as int) as v",
        "sha2(cast(id as string), 256) as insertDateTime", "cast(null as string) as changedDateTime",
    )
    table.create(base)
    for day, divisor in ((1, 50), (2, 70), (3, 80)):
        batch = base.filter(f"v % {divisor} = 0 and v <> 9").withColumn("v", -F.col("v") - day)
        table.upsert(batch.withColumn("insertDateTime", F.lit(f"d{day}")))
    table = run_table(folder, name, Buckets(buckets, "polExternalID"))
    before = bag(table.content(spark))
    if buckets == 3:
        held = shuffled_bytes(spark)
        table._folded(spark, table.numbers(spark)).write.format("noop").mode("overwrite").save()
        # The base's hashes alone take more than that.
        assert (shuffled_bytes(spark) - held < 5_000_000) == (least == 0)
    assert bag(table.compact(spark)) == before and table.numbers(spark) == []
    rows = scan_table(spark, table.table, table.database).filter("polExternalID is not null")
    placed = table.buckets.assign(rows.withColumnRenamed(BUCKET, "was"))
    assert placed.filter(F.col(BUCKET) != F.col("was")).isEmpty() and rows.count() == n - 1
