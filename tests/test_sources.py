import json
import random
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F, types as T

from conftest import bag, plan
from lineforge import session
from lineforge.sources import files, pages, seeds, tables, zones
from lineforge.workload import scans
from lineforge.workload.all import QUERIES


def test_empty_path_raises(spark):
    for call in (
        lambda: files.read_parquet(spark),
        lambda: files.read_parquet(spark, ""),
        lambda: files.write_parquet(spark.range(1), ""),
        lambda: files.append_parquet(spark.range(1), ""),
        lambda: files.read_delimited(spark, ""),
        lambda: files.write_delimited(spark.range(1), ""),
    ):
        with pytest.raises(ValueError):
            call()


def test_read_delimited_multi_line_and_escape(spark, folder):
    path = Path(folder) / "a.csv"
    path.write_text('k|v\n1|"two\nlines"\n2|"say \\"hi\\""\n')
    assert bag(files.read_delimited(spark, str(path), multi_line=True)) == [
        ("1", "two\nlines"), ("2", 'say "hi"'),
    ]


def test_read_delimited_field_ending_in_a_backslash(spark, folder):
    path = Path(folder) / "b.csv"
    path.write_text('k|v\n1|"HOSE 42\\"\n2|"x"\n')
    assert bag(files.read_delimited(spark, str(path), escape="ϡ")) == [("1", "HOSE 42\\"), ("2", "x")]


def test_write_delimited(spark, folder):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "k int, v string").repartition(4)
    files.write_delimited(df, folder + "/many")
    files.write_delimited(df, folder + "/one", single_file=True)
    assert len(list(Path(folder, "many").glob("*.csv"))) > 1
    (one,) = Path(folder, "one").glob("*.csv")
    assert one.read_text().splitlines()[0] == '"k"|"v"'
    assert bag(files.read_delimited(spark, folder + "/many", schema="k int, v string")) == bag(df)


def test_quotes_survive_only_when_escaped(spark, folder):
    df = spark.createDataFrame([("a", 'say "hi" | ok\nnext')], "k string, v string")
    files.write_delimited(df, folder + "/q", escape_quotes=True)
    assert bag(files.read_delimited(spark, folder + "/q", multi_line=True)) == bag(df)


def test_zone_path():
    base = "abfss://raw@lake.dfs.core.windows.net/"
    assert zones.zone_path("lake", "raw") == base
    assert zones.zone_path("lake", "raw", dataset="ignored") == base
    assert zones.zone_path("lake", "raw", "parts") == base + "parts"
    assert zones.zone_path("lake", "raw", "parts", "d/x") == base + "parts/d/x"
    assert zones.landing_dataset("parts", date(2024, 1, 2)) == "20240102/parts.snappy.parquet"


def test_raw_landing_by_day(spark, folder):
    uri = folder + "/{account}/{zone}"
    first, second = date(2024, 1, 1), date(2024, 1, 2)
    zones.land_raw(spark.range(3), "a", "parts", first, uri)
    zones.land_raw(spark.range(9), "a", "parts", second, uri)
    zones.land_raw(spark.range(2), "a", "parts", second, uri)
    landed = zones.read_raw(spark, "a", "parts", uri=uri)
    assert bag(landed.groupBy("landing_date").count()) == [(first, 3), (second, 2)]
    assert zones.read_raw(spark, "a", "parts", [first], uri).count() == 3


def test_table_replaces_itself_with_another_schema(spark, folder):
    args = (folder + "/t", "t", "db_replace")
    tables.overwrite_table(spark.range(3), *args, database_location=folder)
    same = tables.overwrite_table(tables.scan_table(spark, "t", "db_replace").filter("id > 0"), *args)
    assert same.count() == 2
    wider = tables.overwrite_table(same.withColumn("x", F.lit("a")), *args)
    assert bag(wider) == [(1, "a"), (2, "a")]


def test_append_goes_by_name_and_creates(spark, folder):
    args = (folder + "/t", "t", "db_append")
    tables.append_table(
        spark.createDataFrame([(1, "a")], "k int, v string"), *args, database_location=folder
    )
    done = tables.append_table(spark.createDataFrame([("b", 2)], "v string, k int"), *args)
    assert bag(done) == [(1, "a"), (2, "b")]


def test_append_refuses_other_columns(spark, folder):
    args = (folder + "/t", "t", "db_strict")
    tables.append_table(spark.createDataFrame([(1, "a")], "k int, v string"), *args, database_location=folder)
    with pytest.raises(tables.SchemaMismatch, match="extra"):
        tables.append_table(spark.createDataFrame([(1, "a", 2)], "k int, v string, extra int"), *args)
    with pytest.raises(tables.SchemaMismatch, match="'v'"):
        tables.append_table(spark.createDataFrame([(1,)], "k int"), *args)
    assert tables.scan_table(spark, "t", "db_strict").count() == 1


def bucket_files(df):
    found = {}
    for name in df.inputFiles():
        path = Path(name.removeprefix("file://"))
        found.setdefault(path.parent.name, {})[path.name] = path.stat().st_mtime_ns
    return found


def test_only_touched_buckets_are_written(spark, folder):
    layout = tables.Buckets(4, "id")
    args = (folder + "/t", "t", "db_buckets")
    first = tables.overwrite_table(spark.range(200), *args, database_location=folder, buckets=layout)
    before = bucket_files(first)
    assert len(before) == 4 and all(len(files_) == 1 for files_ in before.values())
    rows = first.filter(f"{tables.BUCKET} = 2").filter("id % 2 = 0")
    kept = first.filter(f"{tables.BUCKET} <> 2 or id % 2 = 0").count()
    after = tables.replace_buckets(rows, "t", "db_buckets", [2])
    assert after.count() == kept
    now = bucket_files(after)
    same = [name for name in before if before[name] == now[name]]
    assert sorted(same) == [f"{tables.BUCKET}={n}" for n in (0, 1, 3)]
    assert tables.overwrite_table(spark.range(5), *args).columns == ["id"]
    left = [t.name for t in spark.catalog.listTables("db_buckets") if not t.isTemporary]
    assert left == ["t"]


def test_a_large_bucket_is_written_by_several_tasks(spark, folder):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    layout, args = tables.Buckets(2, "id"), (folder + "/t", "t", "db_large_buckets")
    spark.conf.set(size, "4k")
    try:
        first = tables.overwrite_table(
            spark.range(0, 40_000, 1, 8), *args, database_location=folder, buckets=layout
        )
        written = bucket_files(first)
        after = tables.replace_buckets(first.filter("id < 30000"), "t", "db_large_buckets", [0, 1])
    finally:
        spark.conf.unset(size)
    assert len(written) == 2 and all(len(files_) > 2 for files_ in written.values())
    assert all(len(files_) > 2 for files_ in bucket_files(after).values())
    assert after.select("id").distinct().count() == after.count() == 30_000


def test_rows_without_a_key_are_spread_over_buckets(spark):
    df = spark.range(400).select(F.lit(None).cast("string").alias("k"), "id")
    assert len(tables.buckets_in(tables.Buckets(8, "k").assign(df))) == 8


def test_old_versions_go_when_asked(spark, folder):
    args = (folder + "/t", "t", "db_old")
    for n in range(4):
        table = tables.overwrite_table(spark.range(n + 1), *args, database_location=folder)
    assert tables.drop_old_versions(spark, *args, keep=1) == []  # all are young
    gone = tables.drop_old_versions(spark, *args, keep=1, older_than_hours=0)
    assert len(gone) == 2 and table.count() == 4
    assert len([p for p in Path(folder, "t").iterdir() if p.name.startswith("version-")]) == 2


def test_seed_loses_its_byte_order_mark(spark, folder):
    path = Path(folder) / "s.csv"
    path.write_bytes(b"\xef\xbb\xbfsequence,status\n1,Future Dated\n0,Null\n")
    assert bag(seeds.read_seed(spark, str(path))) == [("0", "Null"), ("1", "Future Dated")]


LINE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("empty", T.StringType()),
        T.StructField(
            "carrier",
            T.StructType(
                [T.StructField("code", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))]
            ),
        ),
    ]
)


def put_page(folder, status, day, *texts):
    at = Path(folder) / f"orderStatus={status}" / f"fromDate={day}"
    at.mkdir(parents=True, exist_ok=True)
    (at / f"p{len(list(at.iterdir()))}.json").write_text("\n".join(texts))


def test_pages(spark, folder):
    put_page(
        folder, "Open", "2024-01-01",
        '{"lastRecordID":"2","partOrderLines":[{"id":"1","empty":null,'
        '"carrier":{"code":"c","tags":["x"]}},{"carrier":{"code":"d"},"id":"2"}]}',
        '{"partOrderLines":[],"lastRecordID":""}',
        '{"lastRecordID": broken',
    )
    put_page(folder, "Closed", "2024-01-02", '{"partOrderLines":[{"id":3}],"lastRecordID":"3"}')
    put_page(folder, "Closed", "2023-12-31", '{"partOrderLines":[{"id":"old"}],"lastRecordID":""}')
    read = pages.read_pages(spark, folder, as_of=date(2024, 1, 2), days_back=1)
    lines = pages.page_lines(read, LINE)
    assert lines.columns == [
        "id", "empty", "carrier.code", "carrier.tags", "otherFields", "orderStatus", "fromDate",
    ]
    assert bag(lines.select("id", "empty", "`carrier.code`", "orderStatus")) == [
        ("1", None, "c", "Open"), ("2", None, "d", "Open"), ("3", None, None, "Closed"),
    ]
    assert [(r[0], r[2]) for r in pages.bad_pages(read).collect()] == [
        ("Open", '{"lastRecordID": broken')
    ]


def test_multi_line_page(spark, folder):
    put_page(folder, "Open", "2024-01-01", '{\n"partOrderLines":\n[{"id":"1"}]\n}')
    read = pages.read_pages(spark, folder, multi_line=True)
    assert pages.page_lines(read, LINE).count() == 1


def test_new_fields_and_whole_lines_of_damaged_pages_are_kept(spark, folder):
    put_page(
        folder, "Open", "2024-01-01",
        '{"partOrderLines":[{"id":"1","size":{"w":1,"h":[2]},"note":"a \\"b\\" } {"},{"id":"2"}]}',
        '{"lastRecordID":"9","partOrderLines":[{"id":"3","note":"x}"},{"id":"4","carrier":{"code":"c"}},{"id":"5","no',
        '{"partOrderLines":[',
        "[]",
        "",
    )
    read = pages.read_pages(spark, folder)
    rows = {r["id"]: r for r in pages.page_lines(read, LINE).collect()}
    assert set(rows) == {"1", "2", "3", "4"}
    assert rows["1"]["otherFields"] == {"size": '{"w":1,"h":[2]}', "note": 'a "b" } {'}
    assert rows["2"]["otherFields"] is None and rows["3"]["otherFields"] == {"note": "x}"}
    assert rows["4"]["carrier.code"] == "c"
    assert sorted(r["legible_lines"] for r in pages.bad_pages(read).collect()) == [0, 0, 2]
    assert tuple(pages.page_counts(read).first()) == (4, 3)


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_records_are_cut_right_wherever_blocks_begin(spark, folder, block):
    """One file read in blocks of few bytes, some without any line, some inside a long field."""
    rng = random.Random(block)
    pieces = ["a", "b|c", '"', "\n", "\\", "é", " ", "\n\n", '\\"', "\r\n", ""]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randrange(1, 12))) + "x", str(i)) for i in range(60)]
    rows[7] = (7, "long\n" * 60 + '"', "7")

    def quote(value):
        return '"' + str(value).replace("\\", "\\\\").replace('"', '\\"') + '"'

    text = '"id"|"te\nxt"|"n"\n' + "\n".join("|".join(map(quote, row)) for row in rows) + "\n"
    Path(folder, "one.csv").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        frame = files.read_records(spark, folder + "/one.csv", "id int, text string, n string")
        tasks = spark.read.text(folder + "/one.csv").rdd.getNumPartitions()
        found = bag(frame)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks > 1
    assert found == sorted(rows, key=repr)
    named = files.read_records(spark, folder + "/one.csv")
    assert named.columns == ["id", "te\nxt", "n"] and named.count() == 60


def test_a_page_may_break_off_inside_a_character(spark, folder):
    """The whole lines before it are taken, also beside a sound page and fields no schema names."""
    head = '{"partOrderLines":[{"polExternalID":"1","new":{"a":[1]}},{"polExternalID":"2"},{"status":"'.encode()
    Path(folder, "orderStatus=Open/fromDate=2024-01-01").mkdir(parents=True)
    sound = b'{"partOrderLines":[{"polExternalID":"3","new":null},{"polExternalID":"4"}]}'
    Path(folder, "orderStatus=Open/fromDate=2024-01-01/a.txt").write_bytes(head + "é".encode()[:1] + b"\n" + sound)
    line = T.StructType([T.StructField(c, T.StringType()) for c in ("polExternalID", "status")])
    found = pages.page_lines(pages.read_pages(spark, folder), line)
    rows = bag(found, "polExternalID", "status", F.to_json(pages.UNKNOWN))
    assert rows == [
        ("1", None, '{"new":"{\\"a\\":[1]}"}'), ("2", None, None), ("3", None, '{"new":null}'), ("4", None, None),
    ]


def test_damaged_pages_are_cut_by_a_function_not_by_nested_expressions(spark, small):
    text = plan(pages.cut_pages(pages.read_pages(spark, scans.some_pages(spark, small))))
    assert "ArrowEvalPython" in text and "aggregate(" not in text


def test_large_texts_go_to_several_files(spark, small, folder, monkeypatch):
    """No task writes much more than the bytes a file should take; the records are the same."""
    docs = spark.read.parquet(small + "/documents.parquet").repartition(8)
    docs.write.parquet(folder + "/in/documents.parquet")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    monkeypatch.setattr(scans, "FILE_BYTES", size // 3)
    path, schema = scans.large_files_of_odd_texts(spark, folder + "/in")
    assert 3 <= len(list(Path(path.removeprefix("file://")).glob("*.csv"))) <= 4
    wanted = bag(QUERIES["csv_multi_line"](spark, folder + "/in"))
    assert bag(files.read_records(spark, path, schema)) == wanted
    monkeypatch.setattr(scans, "FILE_BYTES", size * 2)
    path, _ = scans.large_files_of_odd_texts(spark, folder + "/in")
    assert len(list(Path(path.removeprefix("file://")).glob("*.csv"))) == 1


LINES_OF_A_PAGE = (
    {"id": "1", "route": {"code": "a", "at": {"z": 1, "legs": [[1, {"q": "}]"}], []]}}},
    {"id": "2", "note": 'a "quoted" } { ] [ \\\\'},
    {},
    {"route": {"partOrderLines": [{"id": "inner"}]}, "id": "4"},
    {"id": "5", "tags": ["x", {"id": "no line"}]},
)


def test_a_page_may_break_off_anywhere(spark):
    """Exactly the lines whose text is complete are taken, at every length of the page."""
    texts = [json.dumps(line) for line in LINES_OF_A_PAGE]
    head = '{"note":"partOrderLines","lastRecordID":"7", "partOrderLines" : ['
    page = head + ", ".join(texts) + "]"
    ends, at = [], len(head)
    for text in texts:
        ends.append(at + len(text))
        at += len(text) + 2
    cuts = spark.createDataFrame([(n, page[:n]) for n in range(1, len(page) + 1)], "n int, value string")
    found = cuts.select("n", pages.whole_lines(F.col("value")).alias("lines")).collect()
    for row in found:
        whole = sum(end <= row["n"] for end in ends)
        assert [json.loads(x) for x in row["lines"]] == list(LINES_OF_A_PAGE[:whole]), page[: row["n"]]


def test_what_is_not_a_line_is_not_taken(spark):
    odd = [
        "", "oops", '{"other":[{"id":"1"}]}', '{"partOrderLines":{"id":"1"}', '["partOrderLines",[{"id":"1"}]',
        '{"partOrderLines":[{"id":"1"}],"more":[{"id":"2"}],"cut', '{"partOrderLines":[[{"id":"1"}],{"id":"2"},',
        '{"partOrderLines":[{"id":"1" "broken"},{"id":"3"},{"x', '{"partOrderLines":[{"id":"1"]},{"id":"3"},',
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, value string")
    found = {r["i"]: r["lines"] for r in frame.select("i", pages.whole_lines(F.col("value")).alias("lines")).collect()}
    assert [found[i] for i in range(7)] == [[], [], [], [], [], ['{"id":"1"}'], ['{"id":"2"}']]
    assert found[7] == ['{"id":"3"}'] and '{"id":"1"]}' not in found[8]


def test_written_cuts_serve_in_place_of_pages(spark, folder):
    put_page(folder, "Open", "2024-01-01", '{"partOrderLines":[{"id":"1"}],"lastRecordID":"1"}', '{"partOrderLines":[{"id":"2"},{"i')
    read = pages.read_pages(spark, folder)
    path = folder + "-cut"
    pages.cut_pages(read).write.parquet(path)
    cut = spark.read.parquet(path)
    assert bag(pages.page_lines(cut, LINE), "id") == bag(pages.page_lines(read, LINE), "id") == [("1",), ("2",)]
    assert tuple(pages.page_counts(cut).first()) == (2, 1)
    assert pages.bad_pages(cut).first()["legible_lines"] == 1


def page_text(asked, given, lines=1):
    page = {"partOrderLines": [{"id": str(i)} for i in range(lines)]}
    page |= {} if asked is None else {"afterRecordID": asked}
    return json.dumps(page | ({} if given is None else {"lastRecordID": given}))


def chain_report(spark, folder, **options):
    return bag(pages.chain_faults(pages.read_pages(spark, folder), **options).drop("fromDate"))


def test_a_whole_chain_has_no_faults(spark, folder):
    texts = [page_text("", "a"), page_text("a", "b"), page_text("b", "", 0)]
    put_page(folder, "Open", "2024-01-01", *texts)
    put_page(folder, "Closed", "2024-01-01", page_text("", None, 0))
    # The server may also repeat the cursor it was asked with.
    put_page(folder, "Closed", "2024-01-02", page_text("", "a"), page_text("a", "a", 0))
    assert chain_report(spark, folder) == []
    assert chain_report(spark, folder, expected=spark.createDataFrame(
        [("Open", date(2024, 1, 1)), ("Open", date(2024, 1, 2))], "orderStatus string, fromDate date"
    )) == [("Open", "missing start", "", 0)]


def test_chain_faults_are_named_where_they_are(spark, folder):
    put_page(folder, "Lost", "2024-01-01", page_text("", "a"), page_text("b", ""))
    put_page(folder, "NoStart", "2024-01-01", page_text("a", ""))
    put_page(folder, "Twice", "2024-01-01", page_text("", "a"), page_text("", "a"), page_text("a", ""))
    put_page(folder, "Fork", "2024-01-01", page_text("", "a"), page_text("", "b"), page_text("a", ""), page_text("b", ""))
    put_page(folder, "Loop", "2024-01-01", page_text("", "a"), page_text("a", "b"), page_text("b", "a"))
    put_page(folder, "Bare", "2024-01-01", page_text(None, "a"), page_text(None, ""))
    put_page(folder, "Cut", "2024-01-01", page_text("", "a"), '{"afterRecordID":"a","partOrderLines":[{"id', page_text("b", ""))
    put_page(folder, "CutAfter", "2024-01-01", '{"afterRecordID":"","lastRecordID":"a","partOrderLines":[{', page_text("a", ""))
    assert chain_report(spark, folder) == sorted([
        ("Lost", "missing after", "a", 1), ("Lost", "missing before", "b", 1),
        ("NoStart", "missing before", "a", 1), ("NoStart", "missing start", "", 0),
        ("Twice", "repeated", "", 2), ("Fork", "fork", "", 2), ("Loop", "merge", "a", 2),
        ("Bare", "unlinked", None, 2), ("Cut", "broken", "a", 1), ("Cut", "missing before", "b", 1),
    ], key=repr)


def test_any_change_of_a_chain_is_a_fault(spark, folder):
    """Chains of up to six pages with one page lost, sent elsewhere or asked for otherwise."""
    whole = {}
    for n in range(2, 7):
        links = [("" if i == 0 else f"r{i}", "" if i == n - 1 else f"r{i + 1}") for i in range(n)]
        for i in range(n):
            changes = [links[:i] + links[i + 1 :]]
            changes += [links[:i] + [(links[i][0], g)] + links[i + 1 :] for _, g in links if g != links[i][1]]
            changes += [links[:i] + [(a, links[i][1])] + links[i + 1 :] for a, _ in links if a != links[i][0]]
            for change in changes:
                whole[f"s{len(whole)}"] = change
    rows = [(s, a, g) for s, links in whole.items() for a, g in links]
    cut = spark.createDataFrame(rows, "orderStatus string, afterRecordID string, lastRecordID string").selectExpr(
        "*", "date'2024-01-01' as fromDate", "false as damaged", "array('{}') as texts", "'' as value"
    )
    found = {r[0] for r in pages.chain_faults(cut).select("orderStatus").distinct().collect()}

    def walks(links):
        """Whether following the cursors from the empty one uses each page once and ends."""
        at, used = "", 0
        while used <= len(links):
            ways = {(a, "" if g == a else g) for a, g in links if a == at}
            if len(ways) != 1:
                return False
            used, at = used + 1, ways.pop()[1]
            if at == "":
                return used == len(links)
        return False

    assert found == {s for s, links in whole.items() if not walks(links)}
    assert len(found) > 100


def test_shared_dir_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert session.run_dir(spark, "x").startswith(configured + "/lineforge/x-")


def test_old_intermediates_go_when_asked(spark, folder, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: folder)
    assert session.drop_runs(spark) == []
    path = session.run_dir(spark, "kept")
    spark.range(3).write.parquet(path)
    assert session.drop_runs(spark) == [] and spark.read.parquet(path).count() == 3
    assert session.drop_runs(spark, 0) == [Path(path).name] and not Path(path).exists()


class Context:
    """Stands in for a Spark context without a configured folder."""

    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder + "/own"


class Session:
    def __init__(self, master):
        self.sparkContext, self.conf = Context(master), {}


def test_only_a_local_session_gets_a_temporary_folder():
    local = Session("local[2]")
    first = session.shared_dir(local)
    assert first.endswith("/own") and session.shared_dir(local) == first
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session("spark://cluster:7077"))
