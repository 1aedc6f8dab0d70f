"""Readers, sinks, maintenance, registered queries and the stream."""

import xml.etree.ElementTree as ET

import pytest

import __spark_entry__ as entry
from corpusloom.operators import community, report, resolve, stages
from corpusloom.sources import readers, sinks, sqlite
from corpusloom.streaming import ingest


def test_conform(spark):
    d = spark.createDataFrame([("7", "A", '["x", "y"]', "bad")], "id string, NAME string, authors string, has_info string")
    r = readers.conform(d, readers.TT.StructType.fromDDL("id bigint, name string, authors array<string>, has_info int, bio string")).first()
    assert tuple(r) == (7, "A", ["x", "y"], None, None)


def test_warehouse_types():
    got = [readers.warehouse_type(x) for x in ("INTEGER", "VARCHAR(20)", "text", "DOUBLE", "BLOB", "DATETIME", "DATE", "BOOL", "", "POINT")]
    assert got == ["INTEGER", "VARCHAR(20)", "TEXT", "REAL", "BYTEA", "TIMESTAMP", "DATE", "BOOLEAN", "TEXT", "INTEGER"]


def test_csv_round_trip_and_directory(spark, tmp_path):
    d = spark.createDataFrame([("o", " B ", "Anna"), ("o", "A", "Anna"), ("o", "B", "Anna"), ("o", "", " ")], "organization string, department string, name string").coalesce(1)
    sinks.write_csv(d, str(tmp_path / "c"))
    back = readers.read_csv(spark, str(tmp_path / "c"), "staff")
    assert [tuple(r) for r in readers.staff_directory(back).collect()] == [("Anna", ["B", "A"])]


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "name": "x"},\n {"id": 2}]')
    assert readers.read_json(spark, str(tmp_path / "a.json")).count() == 2


def test_copy_and_updates(spark, tmp_path):
    d = spark.createDataFrame([(1, "a\0b"), (1, "c"), (2, None)], "id long, t string")
    sinks.copy_table(d, str(tmp_path / "t"), "id")
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 2 and not [r for r in back.collect() if r["t"] and "\0" in r["t"]]
    u = sinks.apply_updates(spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, t string, n long"), spark.createDataFrame([(2, "z"), (3, "q")], "id long, t string"), "id")
    assert [tuple(r) for r in u.orderBy("id").collect()] == [(1, "a", 5), (2, "z", 6)]


def test_drawing_files(spark, tmp_path):
    n = spark.createDataFrame([(1, 'a & "b" <c>\x01', None, ["x", "y"]), (2, None, 0.5, None), (10, "é", float("nan"), [])], "id long, label string, size double, tags array<string>")
    e = spark.createDataFrame([(1, 2, 3, "x,y"), (2, 10, 1, None)], "src long, dst long, weight long, layers string")
    sinks.write_gexf(n.repartition(3), e.repartition(2), str(tmp_path / "g.gexf"), "label")
    g = ET.fromstring((tmp_path / "g.gexf").read_bytes())
    assert [(x.get("id"), x.get("label")) for x in g.findall(".//{*}node")] == [("1", 'a & "b" <c>'), ("2", ""), ("10", "é")]
    assert [x.get("value") for x in g.findall(".//{*}node/{*}attvalues/{*}attvalue")] == ['a & "b" <c>', "", "x,y", "", "0.5", "", "é", "", ""]
    edges = g.findall(".//{*}edge")
    assert [(x.get("source"), x.get("target"), x.get("weight")) for x in edges] == [("1", "2", "3.0"), ("2", "10", "1.0")] and len({x.get("id") for x in edges}) == 2
    sinks.write_graphml(n, e, str(tmp_path / "g.graphml"))
    m = ET.fromstring((tmp_path / "g.graphml").read_bytes())
    assert len(m.findall(".//{*}edge")) == 2 and len(m.findall("{*}key")) == 5 and [x.text for x in m.findall(".//{*}edge/{*}data")] == ["3", "x,y", "1", None]
    assert sinks.gexf_layers(n, {"one": e}, str(tmp_path / "p")) == [str(tmp_path / "p_one.gexf")]
    sinks.write_gexf(n.limit(0), e.limit(0), str(tmp_path / "g.gexf"))  # an empty graph takes the place of the old file
    assert not ET.fromstring((tmp_path / "g.gexf").read_bytes()).findall(".//{*}node") and not (tmp_path / "g.gexf.writing").exists()


def test_sqlite_files(spark, tmp_path):
    rows = [(i, f"a{i}", None if i % 3 else f"r{i}", i / 2, i * 10**12) for i in range(25)]
    d = spark.createDataFrame(rows, "id long, article_id string, related_articles string, price double, big long")
    path = str(tmp_path / "articles.db")
    sqlite.write_sqlite(d, path, "odd name")
    got = sqlite.read_sqlite(spark, path, "odd name", parts=4)
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == rows and got.dtypes == d.dtypes
    some = sqlite.read_sqlite(spark, path, "odd name", not_null="related_articles", parts=100)
    assert sorted(r["id"] for r in some.collect()) == [i for i in range(25) if i % 3 == 0]
    assert sqlite.read_sqlite(spark, path, "odd name", "articles").columns[:2] == ["id", "article_id"]
    none = str(tmp_path / "none.db")
    sqlite.write_sqlite(d.limit(0), none, "t")
    assert sqlite.read_sqlite(spark, none, "t").count() == 0
    with pytest.raises(Exception, match="no table"):
        sqlite.read_sqlite(spark, none, "missing")


def test_rings_and_reset(spark):
    import math

    part = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, -1), (6, None)], "id long, cluster int")
    at = {r["id"]: (r["x"], r["y"]) for r in community.ring_positions(part).collect()}
    r = 5 * math.sqrt(3)
    assert at[1] == pytest.approx((100 + r, 0), abs=1e-6) and at[2] == pytest.approx((100 + r * math.cos(2 * math.pi / 3), r * math.sin(2 * math.pi / 3)), abs=1e-6)
    assert at[4] == pytest.approx((-95, 0), abs=1e-6) and at[5] == at[6] == (0, 0)
    with pytest.warns(UserWarning, match="odd"):
        left = stages.reset({"articles": part, "articles_raw": part, "odd": part})
    assert {k: v.count() for k, v in left.items()} == {"articles": 0, "articles_raw": 6, "odd": 6}


def test_upsert_rules(spark):
    kind = "k long, t string, d string"
    old = spark.createDataFrame([(1, "a", "x"), (None, "b", "y")], kind)
    new = spark.createDataFrame([(1, None, ""), (None, "c", "z"), (3, "n", None)], kind)
    assert sorted(resolve.upsert(old, new, ["k"], ["t"], ["d"]).collect(), key=str) == sorted([(1, None, "x"), (None, "c", "z"), (3, "n", None)], key=str)


def test_delete_with_links(spark):
    t = spark.createDataFrame([(1,), (2,)], "id long")
    links = spark.createDataFrame([(1, 9), (2, 9)], "a long, b long")
    got = resolve.delete(t, spark.createDataFrame([(1,)], "id long"), "id", links=(links, "a"))
    assert got["table"].count() == 1 and got["links"].count() == 1


def test_references_keep_order_and_repeats(spark):
    items = spark.createDataFrame([(1, [5, 9, 5, 1]), (2, []), (3, None), (4, [9])], "id long, refs array<long>")
    f = resolve.referential_filter(items, "id", "refs", spark.createDataFrame([(1,), (5,)], "id long"))
    assert {r["id"]: r["refs_filtered"] for r in f.collect()} == {1: [5, 5, 1], 2: None, 3: None, 4: None}


def test_recent_keeps_unknown_dates(spark):
    d = spark.sql("select * from values (timestamp'2024-06-01 00:00:00'), (timestamp'2024-05-31 23:59:59'), (null) as t(ts)")
    assert report.recent(d, "ts", "2025-06-01 00:00:00").count() == 2


def test_registered_queries_and_sql_agree_on_names():
    q, sql = entry.queries(), entry.oracle_sql()
    assert len(q) > 150 and set(sql) <= set(q)


@pytest.mark.parametrize("name", ["coauthor_topk", "d2_related_edges", "e15_golden_records", "j10_departments", "l1_components"])
def test_queries_match_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "supplier", "part", "nation", "region", "events"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    cols = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name]).project(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, want))


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    kind = "page_id long, url string, html string, fetched_at timestamp"
    rows = "select 1L page_id, 'https://h/a/x-ld.1' url, '<h1>A</h1>' html, timestamp'2025-01-01 00:00:00' fetched_at union all select 1L, 'https://h/a/x-ld.1', '<h1>A</h1>', timestamp'2025-01-01 00:00:00' union all select 2L, 'https://h/a/y-ld.2', '<h1>B</h1><time datetime=\"2020-01-01T00:00:00Z\">', timestamp'2025-01-01 00:00:00'"
    spark.sql(rows).coalesce(1).write.parquet(str(src))
    articles = ingest.articles_stream(ingest.pages_stream(spark, str(src), kind))
    q = articles.writeStream.foreachBatch(ingest.merge_into(out, ["article_id"], ["title"], ["category"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = sorted((tmp_path / "out").glob("v=*"), key=lambda p: int(p.name[2:]))[-1]
    assert [tuple(r) for r in spark.read.parquet(str(last)).collect()] == [("1", "A", "a")]


def test_last_wins_by_its_number(spark, tmp_path):
    """Part keys of a million and more outweigh a line, as in the SQL's number."""
    rows = [(1, 3_000_000, 5, 1), (1, 7, 6, 2), (2, 7, 8, 2), (2, 9, 4, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert {tuple(r) for r in entry.queries()["f2_last_wins"](spark, str(tmp_path)).collect()} == {(1, 5), (2, 8)}


def test_titles_decode_what_their_sql_decodes(spark, tmp_path):
    rows = [(1, "u/1", "<h1>a &quot;b&quot; &amp;&lt;&gt; c&amp</h1>"), (2, "u/2", "<h1> d &amp;lt;  &#233; </h1>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {tuple(r) for r in entry.queries()["b4_titles"](spark, str(tmp_path)).collect()} == {(1, "a &quot;b&quot; &<> c&amp"), (2, "d < &#233;")}


def test_sqlite_parts(spark, tmp_path, monkeypatch):
    """Tasks write and read the files: no row passes through the driver, and types, nulls and odd names come back."""
    from pyspark.sql import functions as F

    d = spark.range(0, 25, 1, 3).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("x'"), F.col("id"))).alias('odd "name'), (F.col("id") / 4).alias("price"), F.col("id").cast("int").alias("n"), F.expr("cast('b' as binary)").alias("raw"))
    monkeypatch.setattr(type(d), "toLocalIterator", None)
    monkeypatch.setattr(type(d), "collect", None, raising=False)
    path = str(tmp_path / "parts")
    sqlite.write_parts(d, path, "odd name", rows=4)
    got = sqlite.read_parts(spark, path, "odd name", d.schema)
    monkeypatch.undo()
    assert got.schema == d.schema and sorted(map(str, got.collect())) == sorted(map(str, d.collect()))
    assert spark.read.parquet(path).count() == 7 and spark.read.parquet(path).agg(F.max("rows")).first()[0] == 4
    assert sqlite.read_parts(spark, path, "odd name", d.schema, not_null='odd "name').count() == 16
    none = str(tmp_path / "none")
    sqlite.write_parts(d.limit(0), none, "t")
    assert sqlite.read_parts(spark, none, "t", d.schema).count() == 0
