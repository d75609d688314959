"""Panel rollup paths, uploads, sinks and the shared folder."""

import datetime

import pytest
from pyspark.sql import functions as F

from shelfspark import session
from shelfspark.sources import files as S
from shelfspark.sources import panel as P


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_rollup_without_broadcast_is_the_same(spark, tables):
    small = P.rollup(tables.lineitem, tables.part)
    large = P.rollup(tables.lineitem, tables.part, part_rows=0)
    assert rows(small) == rows(large)


def test_rollup_with_a_hot_part(spark, tables):
    hot = tables.lineitem.withColumn("l_partkey", F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(F.col("l_partkey")))
    assert rows(P.rollup(hot, tables.part)) == rows(P.rollup(hot, tables.part, part_rows=0))


def test_panel_key_is_unique(tables):
    p = tables.panel
    assert p.count() == p.select("product_name", "week_start").distinct().count()


def test_header_names():
    assert S.deduped_names(["Date", "Date", "Sales_Qty", "Product"]) == ["date", "date_dup1", "sales_qty", "product"]
    assert S.deduped_names([" Unit Price", "unit-price", "A/B"]) == ["unit_price", "unit_price_1", "a_b"]


def test_mapping_by_candidates():
    m = S.guess_mapping(["week_start", "item_name", "qty"])
    assert m == {"date": "week_start", "product": "item_name", "sales_qty": "qty"}


def upload(tmp_path, text):
    f = tmp_path / "u.csv"
    f.write_text(text)
    return str(f)


def test_ingest_coerces_and_rejects(spark, tmp_path):
    path = upload(tmp_path, "Date,Date,Sales_Qty,Product\n2024-01-01,x,100,Milk\nbad,x,n/a,Milk\n01/02/2024,x,7,Tea\n")
    df = S.ingest_canonical(spark, path)
    got = {(r.date, r["product"], r.sales_qty) for r in df.collect()}
    assert (datetime.date(2024, 1, 1), "Milk", 100.0) in got
    assert (None, "Milk", 0.0) in got
    assert (datetime.date(2024, 1, 2), "Tea", 7.0) in got
    assert [r.reason for r in S.ingest_rejects(df).collect()] == ["date"]


def test_ingest_turns_to_day_first(spark, tmp_path):
    path = upload(tmp_path, "date,product,sales\n25/01/2024,A,1\n26/01/2024,A,2\n03/02/2024,A,3\n")
    got = sorted(r.date for r in S.ingest_canonical(spark, path).collect())
    assert got == [datetime.date(2024, 1, 25), datetime.date(2024, 1, 26), datetime.date(2024, 2, 3)]


def test_ingest_needs_required_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="sales_qty"):
        S.ingest_canonical(spark, upload(tmp_path, "date,product\n2024-01-01,A\n"))


class FakeSession:
    """Only what `shared_dir` looks at."""

    def __init__(self, master, setting):
        self.sparkContext = type("Context", (), {"applicationId": "app-1", "master": master})()
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: setting if key == "spark.checkpoint.dir" else default)})()


def test_shared_folder_comes_from_the_session(monkeypatch):
    monkeypatch.setattr(session, "_DIRS", {})
    assert session.shared_dir(FakeSession("spark://host:7077", "hdfs://nn/ck/")) == "hdfs://nn/ck/shelfspark-app-1"


def test_a_cluster_without_the_setting_is_refused(monkeypatch):
    monkeypatch.setattr(session, "_DIRS", {})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(FakeSession("spark://host:7077", None))


def test_written_survives_and_prunes(spark):
    df = session.written(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.select("x").agg(F.sum("x")).first()[0] == 90
    assert "ReadSchema: struct<x:bigint>" in df.select("x")._jdf.queryExecution().toString()


def test_panel_follows_its_files(spark, tables, tmp_path):
    from shelfspark.session import delete
    from shelfspark.sources.panel import refresh_panel, rollup, stored_panel

    source, target = str(tmp_path / "lines"), str(tmp_path / "panel")
    lines = tables.lineitem.withColumn("y", F.year("l_shipdate"))
    put = lambda rows, name: rows.drop("y").coalesce(1).write.mode("overwrite").parquet(f"{source}/{name}")
    put(lines.where("y < 1996"), "a")
    put(lines.where("y >= 1996 AND y < 1998"), "b")
    same = lambda want: sorted(map(tuple, stored_panel(spark, target).collect())) == sorted(map(tuple, rollup(want, tables.part).collect()))
    first = refresh_panel(spark, source, tables.part, target)
    assert first["files"] == first["read"] == 2 and same(lines.where("y < 1998"))
    assert refresh_panel(spark, source, tables.part, target) == {"files": 0, "periods": [], "read": 0}
    put(lines.where("y >= 1998"), "c")  # a new file: its weeks alone, and the file that shares the week of new year
    added = refresh_panel(spark, source, tables.part, target)
    assert added["files"] == 1 and added["read"] == 2 and min(added["periods"]) == datetime.date(1997, 12, 29) and same(lines)
    put(lines.where("y >= 1996 AND y < 1998 AND l_orderkey % 2 = 0"), "b")  # a changed file
    changed = refresh_panel(spark, source, tables.part, target)
    assert changed["files"] == 1 and {p.year for p in changed["periods"]} <= {1995, 1996, 1997, 1998}
    assert same(lines.where("y < 1996 OR y >= 1998 OR l_orderkey % 2 = 0"))
    delete(spark, f"{source}/a")  # a file that went takes its weeks along
    gone = refresh_panel(spark, source, tables.part, target)
    assert gone["files"] == 0 and same(lines.where("y >= 1998 OR y >= 1996 AND l_orderkey % 2 = 0"))


def test_source_of_the_followed_panel_is_split_as_its_lines(spark, tmp_path, monkeypatch):
    from shelfspark.plans import files as plans

    monkeypatch.setattr(plans, "new_path", lambda spark, name: str(tmp_path / name))
    day = lambda i: datetime.datetime(1997, 12, 1) + datetime.timedelta(days=i % 1100)
    line = lambda i: (i, i % 7, 1.0 + i % 5, 10.0 * (1 + i % 9), 0.01 * (i % 11), "ANR"[i % 3], "FO"[i % 2], day(37 * i))
    schema = "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    lines = [line(i) for i in range(600)] + [line(5), line(5)]  # a line that comes three times
    spark.createDataFrame(lines, schema).repartition(6).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(i, f"Brand#{11 + i}", 1 + i) for i in range(6)]  # part 6 is missing
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # the cost of opening a file: every file is a task
    try:
        t = P.Tables(spark, str(tmp_path))
        got = plans.followed(t)
        assert rows(got) == rows(P.rollup(t.lineitem, t.part))
        copies = spark.read.parquet(*[f"{tmp_path}/lines/{name}" for name in ("first", "wrong", "more")])
        assert rows(copies) == rows(t.lineitem)
        most = lambda df: df.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
        assert most(copies) <= most(t.lineitem) < 200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rollup_is_built_anew_when_a_source_changes(spark, tables, tmp_path):
    from shelfspark.sources.panel import weekly_panel

    tables.part.write.parquet(str(tmp_path / "part.parquet"))
    tables.lineitem.where("l_orderkey % 2 = 0").write.parquet(str(tmp_path / "lineitem.parquet"))
    half = weekly_panel(spark, str(tmp_path)).agg(F.sum("sales_qty")).first()[0]
    tables.lineitem.write.mode("overwrite").parquet(str(tmp_path / "lineitem.parquet"))
    assert weekly_panel(spark, str(tmp_path)).agg(F.sum("sales_qty")).first()[0] > 1.5 * half
