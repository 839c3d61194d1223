import json

from pyspark.sql import functions as F

from folio.functions import values
from folio.operators import flows
from folio.sources.catalog import evolved


def test_values(spark):
    df = spark.createDataFrame([("12",), ("1.9",), ("1e3",), ("x",), ("",), (None,), ("1d",), ("2f",), ("3D",), ("0x1",), ("NaN",), ("Infinity",), (" -4.9\t",), (".5",), ("6.",), ("1 2",)], "x string")
    assert [r[0] for r in df.select(values.lenient_int(F.col("x"), 7)).collect()] == [12, 1, 1000, 7, 7, 7, 7, 7, 7, 7, 7, 7, -4, 0, 6, 7]
    months = spark.createDataFrame([("2018-3",), ("2018-13x",), (None,)], "x string")
    assert [tuple(r[0]) if r[0] else None for r in months.select(values.month_of(F.col("x"))).collect()] == [(2018, 3), None, None]
    row = spark.range(1).select(values.month_shift(F.lit("2018-01"), -1), values.save_path("/a/", F.lit(2018)), values.run_id(F.lit(5), F.lit("p"))).first()
    assert tuple(row) == ("2017-12", "/a/2018", "5:p")


def test_first_values_in_json(spark):
    docs = ['{"a": {"id": " "}, "b": [{"id": "x "}]}', '{"uid": "7", "a": {"id": 8}}', '{"a": [1, {"n": "12"}]}', "bad", None, '{"a": true}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").orderBy("i")
    assert [r[0] for r in df.select(values.first_text(F.col("d"), ["id", "uid"])).collect()] == ["x", "7", None, None, None, None]
    assert [r[0] for r in df.select(values.first_int(F.col("d"), ["n", "uid", "a"])).collect()] == [None, 7, 12, None, None, 1]


def test_hostile_json_is_passed_over(spark):
    deep = '{"a": ' * 50_000 + "1" + "}" * 50_000
    docs = ['{"n": 9223372036854775808, "a": {"n": 5}}', '{"n": "' + "9" * 6000 + '", "a": [{"n": "7"}]}', deep, "[" * 900 + '{"n": 3}' + "]" * 900]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, d string").orderBy("i")
    got = [tuple(r) for r in df.select(values.first_int(F.col("d"), ["n"]), values.first_text(F.col("d"), ["n"])).collect()]
    assert got == [(5, None), (7, "9" * 6000), (None, None), (3, None)]


def test_ingest(spark):
    old = evolved(spark.createDataFrame([("2018-01", "Old", "M")], "date string, name string, company string"))
    row = lambda n, m: f'<tr bgcolor="#ffffff"><td></td><td>{n}</td><td>{m}</td></tr>'
    pages = spark.createDataFrame([("2018-01", row("Old", "M") + row("New LE", "M") + row("New LE box", "M") + row("skip", "M") + row("", "M"))], "date string, html string")
    catalog, counts = flows.ingest(old, pages, ["skip"], ["LE"])
    assert sorted(r["name"] for r in catalog.collect()) == ["New", "Old"]  # "New  box" follows its parent
    assert tuple(counts.first()) == (2, 1, 1, True)


def test_enrich(spark):
    data = [("2018-01", "A-B", "M-x", None, "sz", "mn", "c"), ("2018-01", "C!", "M-x", "", "sz", "mn", "c"), ("2018-01", "D", "M", "has", "sz", "mn", "c"), ("2018-01", "E", "M", None, "sz", "mn", "keep"), ("2018-01", None, "N", None, "sz", "mn", "c"), (None, "F", "M", "", "sz", "mn", "c")]
    catalog = evolved(spark.createDataFrame(data, "date string, name string, company string, link string, size string, match_name string, comment string"))
    found = [("AB+M-x", "tag 1801", "l1", "1 GB", "2018-01-05 00:00", 0), ("AB+M-x", "1801 other", "l2", "2 GB", "2018-02-05 00:00", 1), ("AB+M x", "tag 1801", "l9", "9 GB", "2019-01-05 00:00", 0)]
    found += [("C+M x", "1712", "l3", "3 GB", None, 0), ("D+M", "1801", "l4", "", None, 0), ("N", "1801", "l5", "", None, 0), ("F+M", "1801", "l6", "", None, 0)]
    candidates = spark.createDataFrame(found, "query string, name string, link string, size string, d string, ordinal int").withColumn("date", F.try_to_timestamp("d", F.lit("yyyy-MM-dd HH:mm")))
    table, counts = flows.enrich_months(catalog, candidates, ["tag"])
    got = {r["name"]: (r["link"], r["size"], r["match_name"], r["comment"]) for r in table.collect()}
    assert got["A-B"] == ("l1", "1 GB", "tag 1801", "c") and got["C!"] == (None, "3 GB", "1712", "c")
    # Without a candidate, with a link or with a null in the key nothing changes.
    assert got["D"] == ("has", "sz", "mn", "c") and got["E"] == (None, "sz", "mn", "keep") and got[None] == (None, "sz", "mn", "c") and got["F"] == ("", "sz", "mn", "c")
    assert [tuple(r) for r in counts.collect()] == [("2018-01", 2)]


def test_magnet_report(spark):
    link = "magnet:?xt=urn:btih:" + "ab" * 20
    df = spark.createDataFrame([(link,), (None,)], "magnet string")
    meta = spark.createDataFrame([(link, "cd" * 20, "n", 3, [])], "magnet string, infohash_hex string, name string, total_size long, files array<struct<path: string, size: bigint>>")
    got = [json.loads(r[0]) for r in flows.magnet_report(df, meta).collect()]
    assert sorted(g["errors"][0] for g in got) == ["infohash_mismatch", "not_magnet"]
    assert [json.loads(r[0])["ok"] for r in flows.magnet_report(df).collect()] == [True, False]


def test_enrich_deals_out_a_query_and_asks_for_no_nulls(spark, monkeypatch):
    from folio.operators import joins

    monkeypatch.setattr(joins, "DEALT_ROWS", 3)
    keyed = spark.createDataFrame([("2020-01", "a", "q", "r"), ("2020-02", "b", "q", "r"), ("2020-01", None, "n", "n"), (None, "d", "n", "n"), ("2020-01", "e", "x", "r")], "date string, name string, search string, relaxed string")
    found = spark.createDataFrame([(q, f"{2001 + i % 2} t", f"l{q}{i}", "s", i) for q in ("q", "r", "n", "nothing", None) for i in range(20)], "query string, name string, link string, size string, ordinal int")
    got = {r["_name"]: (r["tier"], r["new_link"]) for r in flows._chosen(keyed, found.withColumn("date", F.lit(None).cast("timestamp")), ["t"]).collect()}
    assert got == {"a": (1, "lq0"), "b": (1, "lq1"), "e": (1, "lr0")}
