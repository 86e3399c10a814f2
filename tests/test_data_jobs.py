from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalith.operators import profile as P
from stratalith.operators import records as R
from stratalith.operators import snapshots as S
from stratalith.plans import data_jobs

T0 = datetime(2031, 1, 1)


def _builds(spark):
    rows = [("b1", "sealed", T0), ("b3", "sealed", T0 + timedelta(2)), ("bx", "failed", T0 + timedelta(1)), ("b4", "sealed", T0 + timedelta(3))]
    return spark.createDataFrame(rows, "build_id string, state string, created_at timestamp")


ART = "build_id string, id string, relative_path string, content_hash string, status string, authority int, supersedes array<string>, delivered_at timestamp, ord string"
CHUNK = "build_id string, id string, artifact_id string, revision_hash string, delivered_at timestamp"
TABLE = "build_id string, table_id string, table_name string, row_count bigint, column_names array<string>, delivered_at timestamp"


def test_changes_between_snapshots(spark):
    arts = [
        ("b1", "1", "./a/é.md", "AB", "active", 50, ["x", "y"], T0, "z"),
        ("b3", "1", "a\\é.md", "sha256:ab", "active", 50, ["y", "x", "x"], T0, "z"),
        ("b4", "1", "a/é.md", "cd", "draft", 50, [], T0, "z"),
        ("b1", "2", "gone.md", "1", "active", 50, None, T0, "z"),
        ("b4", "2", "gone.md", "1", "active", 50, None, T0, "z"),
        ("bx", "3", "failed.md", "1", "active", 50, [], T0, "z"),
        ("b4", "4", "late.md", "1", "active", 50, [], T0, "z"),
        ("b3", "4", "late.md", "2", "active", 50, [], T0, "z"),
        ("b3", "4", "late.md", "1", "active", 50, [], T0 + timedelta(99), "z"),
        ("b3", "5", None, "1", "active", 50, [], T0, "z"),
    ]
    chunks = [("b1", "c", "1", None, T0), ("b3", "c", "1", None, T0), ("b4", "c", "1", "", T0), ("b4", "c", "1", "", T0)]
    tables = [("b1", "t", "n", 0, ["a", "b"], T0), ("b3", "t", "n", None, ["a", "b"], T0), ("b4", "t", "n", None, ["b", "a"], T0)]
    got = S.snapshot_changes(
        spark.createDataFrame(arts, ART), spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(tables, TABLE), _builds(spark)
    )
    assert {tuple(r) for r in got.collect()} == {
        ("artifact", "b3", "b4", "a/é.md", "changed"), ("rule", "b3", "b4", "a/é.md", "changed"),
        ("artifact", "b1", "b3", "gone.md", "removed"), ("artifact", "b3", "b4", "gone.md", "added"),
        ("artifact", "b1", "b3", "late.md", "added"), ("chunk", "b3", "b4", "c", "changed"),
        ("table", "b1", "b3", "t", "changed"), ("table", "b3", "b4", "t", "changed"),
    }


def test_intervals_and_empty_snapshots(spark):
    states = spark.createDataFrame([("k", "a", i, h) for i, h in ((1, 5), (2, 5), (4, 5), (5, 6), (6, 6))], "record_kind string, record_key string, ord int, row_hash bigint")
    got = sorted((r.first_ord, r.last_ord) for r in S.validity_intervals(states).collect())
    assert got == [(1, 2), (4, 4), (5, 6)]
    none = S.snapshot_changes(spark.createDataFrame([], ART), spark.createDataFrame([], CHUNK), spark.createDataFrame([], TABLE), _builds(spark))
    assert none.count() == 0


PRICE = "build_id string, table_id string, row_no bigint, sku string, list_price string, currency string, discontinued string, valid_from string, owner_team string, loaded_at timestamp, ordinal int"
NOTED = "build_id string, table_id string, ordinal int, column_name string, null_count bigint, distinct_estimate bigint, distinct_is_exact boolean, min_value string, max_value string"


def test_profile_findings(spark):
    def row(b, n, sku="AB-123", price="1.5", cur="EUR", day="2031-02-28"):
        return (b, "t", n, sku, price, cur, "TRUE", day, "a-b", T0, 9)

    rows = [row("b1", 1, price=" 10 "), row("b1", 2, price="9.50"), row("b1", 2, price="9.50"), row("b1", 3, price="n/a"), row("b1", 4, price="007")]
    rows += [row("b3", i, price="30", cur="USD", day="2031-02-30" if i == 1 else "2031-02-28") for i in range(1, 5)] + [("b3", "t", 9, None, None, None, None, None, None, None, 1)]
    noted = [
        ("b1", "t", 2, "list_price", 1, 3, True, "9.5", "10.0"), ("b1", "t", 1, "sku", 0, 9, False, "AB-123", "AB-123"),
        ("b3", "t", 2, "list_price", 1, 1, True, "30", "31"), ("b1", "t", 3, "currency", 1, 1, True, "EUR", "EUR"),
    ]
    df = spark.createDataFrame(rows, PRICE)
    got = {tuple(r)[0:1] + tuple(r)[2:] for r in P.findings(df, spark.createDataFrame(noted, NOTED), _builds(spark)).collect()}
    assert got == {
        ("b1", 2, "pattern"), ("b1", 1, "distinct_estimate"), ("b1", 3, "null_count"), ("b3", 2, "max_value"), ("b3", 2, "drift"),
        ("b3", 3, "drift"), ("b3", 5, "pattern"), *{("b3", i, "drift") for i in (1, 4, 5, 6)},
    }
    assert P.findings(df.where("false"), spark.createDataFrame([], NOTED), _builds(spark)).count() == 0


def test_states_merge(spark):
    rows = [("b1", "t", i, f"AB-{100 + i % 3}", str(i), "EUR", None, None, None, T0, 1) for i in range(20)]
    df = spark.createDataFrame(rows, PRICE)
    whole = {tuple(r) for r in P.column_states(df).collect()}
    parts = P.merge_states(P.column_states(df.where("row_no < 7")), P.column_states(df.where("row_no >= 7")))
    assert {(r.build_id, r.table_id, r.ordinal, r.value, r.n, r.fit) for r in parts.collect()} == {(a, b, c, d, e, f) for a, b, c, d, e, f in whole}


def test_kept_states_give_the_same_profile(spark, tmp_path):
    rows = [(b, "t", i % 19, f"AB-{100 + i % 3}", str(i + k), "EUR" if i % (k + 2) else None, "true", "2031-02-28", "a-b", T0, 1) for k, b in enumerate(("b1", "bx", "b4")) for i in range(20)]
    spark.createDataFrame(rows, PRICE).write.parquet(str(tmp_path / "price_rows.parquet"))
    _builds(spark).write.parquet(str(tmp_path / "builds.parquet"))
    whole, merged = (sorted(map(str, data_jobs.QUERIES[q](spark, str(tmp_path)).collect())) for q in ("p3_profile", "p3_incremental"))
    assert len(whole) == 18 and whole == merged
    df, builds = spark.createDataFrame(rows, PRICE), _builds(spark)
    columns = ["build_id", "ordinal", "load_no", "null_shift", "distance", "median_before"]
    parts = P.profile(df.where("build_id = 'b4'"), builds, kept=P.column_states(df.where("build_id <> 'b4'")))
    assert sorted(map(str, parts.select(columns).collect())) == sorted(map(str, P.profile(df, builds).select(columns).collect()))


def test_states_in_a_folder_are_made_once(spark, tmp_path):
    def rows(b, n):
        return [(b, f"t{i % 3}", i, f"AB-{100 + i % 3}", str(i), None, "true", "2031-02-28", "a-b", T0, 1) for i in range(n)]

    def same(df):
        names = ["build_id", "table_id", "ordinal", "value", "n", "fit"]
        return sorted(map(str, P.keep_states(df, root).select(names).collect())) == sorted(map(str, P.column_states(df).select(names).collect()))

    root = str(tmp_path / "states")
    first, second = spark.createDataFrame(rows("b1", 20), PRICE), spark.createDataFrame(rows("b4", 9) + rows(None, 2), PRICE)
    assert same(first) and same(first.unionByName(second))
    # A build that is known isn't scanned again; one that has grown is.
    other = first.withColumn("sku", F.lit("ZZ-999"))
    assert P.keep_states(other.unionByName(second), root).where("value = 'ZZ-999'").count() == 0
    grown = first.unionByName(spark.createDataFrame(rows("b1", 21)[20:], PRICE)).unionByName(second)
    assert same(grown)


def test_control_limits(spark):
    rows = [("b", "t", 1, i, 0.1, 10, 0) for i in range(1, 6)] + [("b", "t", 1, 6, 0.9, 10, 0)]
    df = spark.createDataFrame(rows, "build_id string, table_id string, ordinal int, load_no int, null_share double, distinct_count bigint, violations bigint")
    got = P.control_limits(df).where("anomaly").collect()
    assert [(r.metric, r.value) for r in got] == [("null_share", 0.9)]


LINES = "record_id bigint, file_path string, record_no int, raw_record string, received_at timestamp"


def test_records(spark):
    head = "﻿Need;\"PRIORITY\";segment\r"
    rows = [
        (1, "f", 1, head), (2, "f", 2, 'x;high;a-1\r'), (3, "f", 3, '"a ""b"";\nc";low;b'), (4, "f", 4, '"open;low;b'), (5, "f", 5, 'a"b;low;b'),
        (6, "f", 6, '"a" ;low;b'), (7, "f", 7, "a;low"), (8, "f", 8, "n/a;low;b"), (9, "f", 9, "x;LOW ; b"), (10, "f", 10, "x;low;B"), (11, "f", 11, " \t"),
        (12, "f", 12, None), (13, "g", 2, "seg,need,high"), (13, "g", 2, "seg,need,high"), (14, "f", 13, "x;urgent;b"), (15, "f", 14, '""'), (16, "f", 15, "x" * 100_000 + ";low;b"),
    ]
    df = spark.createDataFrame([(*r, T0) for r in rows], LINES).withColumn("reason", F.lit("clash"))
    got = {r.record_id: r.reason for r in R.parse_records(df).collect()}
    assert got == {
        2: None, 3: None, 4: "quoting", 5: "quoting", 6: "quoting", 7: "column_count", 8: "value", 9: None, 10: "value", 13: None, 14: "value",
        15: "column_count", 16: None,
    }
    typed = {r.record_id: (r.segment, r.need, r.priority) for r in R.valid(df).collect()}
    assert typed[3] == ("b", 'a "b";\nc', "low") and typed[9] == ("b", "x", "low")
    assert R.parse_records(df.where("false")).count() == 0


def test_stream_recovers_at_the_next_record():
    text = 'a,need,high\nb,"broken,low\nc,fine,low\nd,"two\nlines",low\n'
    got = list(R.RecordParser(text, ",").records())
    assert [r.fields[0] if not r.fault else None for r in got] == ["a", None, "c", "d"]
    assert got[1].fault.what == "quoted field isn't closed" or got[1].fault.at > 0


RAW = st.lists(st.text(alphabet='ab,"\n\r x', max_size=12).filter(lambda t: t.strip()), max_size=12)


@settings(deadline=None, max_examples=300)
@given(RAW)
def test_whole_files_give_the_verdicts_of_single_records(raws):
    found, _ = R.parse_block(raws, ",")
    for raw, got in zip(raws, found, strict=True):
        alone = R.RecordParser(raw, ",", single=True).record(0)
        assert (got.fault is None) == (alone.fault is None) and (alone.fault is not None or got.fields == alone.fields)


def test_faults_are_located_and_resumed_after(spark):
    raws = ["need,segment,priority", "x,a,high", 'y,"b,low', "z,c,low", 'w,"d",low', 'v,e"f,low', "u,g,high"]
    df = spark.createDataFrame([(i, "f", i + 1, r, T0) for i, r in enumerate(raws)], LINES)
    got = [tuple(r) for r in R.located_faults(df).orderBy("record_no").collect()]
    assert got == [("f", 3, 5, 3, "text after a closing quote", 1), ("f", 6, 6, 3, "quote inside a bare field", 1)]
    assert {r.record_id: r.reason for r in R.rejected(df).collect()} == {2: "quoting", 5: "quoting"}
    small = {r.record_id: r.reason for r in R.parse_records(df, block=2).collect()}
    assert small == {r.record_id: r.reason for r in R.parse_records(df).collect()} and len(small) == 6
