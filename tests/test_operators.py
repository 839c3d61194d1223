import random

import pytest
from pyspark.sql import functions as F

from folio.functions import html
from folio.operators import catalog, changes, editions, enrich, joins, match, progress
from folio.sources.catalog import evolved, read_catalog, read_config, read_status, write_months, write_status


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def shop(spark, data):
    return evolved(spark.createDataFrame(data, "date string, name string, company string, link string"))


def test_catalog_views(spark):
    c = shop(spark, [("2018-01", "a", "x", None), ("2018-01", "b", "x", ""), ("2017-12", "c", "x", "l"), ("2017-01", "d", "x", "m")])
    assert [r["year"] for r in catalog.years(c).collect()] == [2018, 2017]
    assert tuple(catalog.latest_month(c).first()) == (2018, 1)
    assert tuple(catalog.latest_month(c.limit(0)).first()) == (None, None)
    names = lambda **k: [r["name"] for r in catalog.catalog_page(c, **k).collect()]
    assert names(page=0, per_page=2) == ["a", "b"] and names(page=2, per_page=2) == ["c", "d"] and names(page=9) == []
    assert names(year=2017) == ["c", "d"] and names(month=1) == ["a", "b", "d"] and names(year=0, month=0) == ["a", "b", "c", "d"]
    assert catalog.links_to_check(c, 2017, None).count() == 2 and catalog.links_to_check(c, 2017, 12).count() == 1
    assert catalog.missing_links(c, 2018, 1).count() == 2
    assert catalog.catalog_page(c).first()["downloaded"] == 0


def loop(items):
    """The sequential rule."""
    seen, out = set(), []
    for company, name, ordinal in sorted(items, key=lambda x: (x[0], len(x[1]), x[2])):
        key = " ".join(name.split())
        parent = key.rsplit(" ", 1)[0] if " " in key else key
        if key not in seen and parent not in seen:
            out.append((name, company))
            seen.add(key)
    return sorted(out)


@pytest.mark.parametrize("heavy", [1 / 200, 1 / 20, 1])
def test_editions_equal_the_sequential_rule(spark, monkeypatch, heavy):
    monkeypatch.setattr(joins, "HEAVY_PART", heavy)
    rng = random.Random(5)
    groups = {f"g{g}": [(rng.choice("xy"), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 4))), i) for i in range(rng.randint(1, 12))] for g in range(60)}
    groups["fixed"] = [("x", "A", 0), ("x", "A B", 1), ("x", "A B C", 2)]
    df = spark.createDataFrame([(g, c, n, i) for g, its in groups.items() for c, n, i in its], "date string, company string, name string, ordinal int")
    got = {}
    for r in editions.dedup_editions(df).collect():
        got.setdefault(r["date"], []).append((r["name"], r["company"]))
    assert {g: sorted(v) for g, v in got.items()} == {g: loop(v) for g, v in groups.items()}
    assert sorted(got["fixed"]) == [("A", "x"), ("A B C", "x")]


def test_insert_or_ignore(spark):
    old = spark.createDataFrame([("d", "a", "old")], "date string, name string, company string")
    batch = spark.createDataFrame([("d", "a", "new", 0), ("d", "b", "first", 1), ("d", "b", "second", 2), (None, "b", "n1", 3), (None, "b", "n2", 4)], "date string, name string, company string, ordinal int")
    assert rows(changes.insert_or_ignore(old, batch)) == sorted([("d", "a", "old"), ("d", "b", "first"), (None, "b", "n1"), (None, "b", "n2")], key=repr)
    assert tuple(changes.insert_counts(old, batch).first()) == (5, 3, 2)
    assert tuple(changes.insert_counts(old, batch.limit(0)).first()) == (0, 0, 0)


def test_updates_and_deletes(spark):
    c = shop(spark, [("d", "a", "x", "l"), ("d", "b", "x", "l")])
    patch = spark.createDataFrame([("d", "a", "", None), ("d", "zz", "q", "q")], "date string, name string, new_link string, new_company string")
    got = {r["name"]: (r["link"], r["company"]) for r in changes.update_rows(c, patch, ["link", "company"]).collect()}
    assert got == {"a": ("", "x"), "b": ("l", "x")}
    rename = spark.createDataFrame([("d", "a", "b")], "date string, name string, new_name string")
    with pytest.raises(ValueError):
        changes.checked(changes.update_rows(c, rename, ["name"]))
    assert [r["name"] for r in changes.delete_rows(c, rename).collect()] == ["b"]
    marks = spark.createDataFrame([("d", "a", 1, ""), ("d", "b", 1, "h")], "date string, name string, new_downloaded int, new_infohash_hex string")
    assert rows(changes.set_downloaded(c, marks).select("name", "downloaded", "infohash_hex")) == sorted([("a", 1, None), ("b", 1, "h")], key=repr)


def test_repeated_patches_apply_in_order(spark):
    c = shop(spark, [("d", "a", "x", "l"), ("d", "b", "x", "l")])
    patch = spark.createDataFrame([("d", "a", "first", "q", 1), ("d", "a", None, "r", 2), ("d", "a", "", None, 3), ("d", "a", "late", None, 0)], "date string, name string, new_link string, new_company string, o int")
    got = changes.update_rows(c, patch, ["link", "company"], ordinal="o")
    assert rows(got.select("name", "company", "link")) == [("a", "r", ""), ("b", "x", "l")]
    with pytest.raises(Exception, match="several patches"):
        changes.update_rows(c, patch, ["link", "company"]).collect()


def test_edits_leave_what_is_not_supplied(spark):
    c = shop(spark, [("d", "a", "x", "l"), ("d", "b", "y", "m")])
    edits = spark.createDataFrame([("d", "a", "", "", "", "", 3), ("d", "b", "e", "n", None, None, None)], "date string, old_name string, new_date string, new_name string, new_company string, new_link string, new_downloaded int")
    assert rows(changes.edit_rows(c, edits).select("date", "name", "company", "link", "downloaded")) == [("d", "a", "x", "", 1), ("e", "n", "y", "m", 0)]


def test_best_candidates(spark):
    data = [
        (1, "tagA 1801", "2018-01-01 00:00", 0, "l0"), (1, "tagA 1801", "2018-01-02 00:00", 1, ""), (1, "1801", "2018-02-01 00:00", 2, "l2"),
        (2, "tagB 1801", None, 0, "l3"), (2, "tagB 1801", "2018-01-01 00:00", 1, "l4"), (3, "tagA 1712", "2018-01-01 00:00", 0, "l5"),
    ]
    df = spark.createDataFrame(data, "id int, name string, d string, ordinal int, link string").withColumn("date", F.try_to_timestamp("d", F.lit("yyyy-MM-dd HH:mm")))
    best = enrich.best_candidates(df, ["id"], enrich.tier(F.col("name"), F.lit("1801"), ["tagA", "tagB"]), F.col("date"), ["ordinal"], ["name", "link"], last_tier=4)
    assert {r["id"]: (r["tier"], r["link"]) for r in best.collect()} == {1: (1, ""), 2: (2, "l4"), 3: (4, None)}


def test_fallback_only_without_a_first_match(spark):
    items = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "id int, k string, f string")
    first = spark.createDataFrame([("a", "x", 10)], "k string, f string, v int")
    second = spark.createDataFrame([("x", 20)], "f string, v int")
    assert rows(enrich.lookup_with_fallback(items, first, second, ["k", "f"], ["f"], "id").select("id", "level", "v")) == [(1, 1, 10), (2, 2, 20)]


def test_containment_equals_all_pairs(spark):
    rng = random.Random(3)
    words = ["ab", "b", "abc", "c d", "", "日本", "aab"]
    left = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))).strip()) for i in range(40)]
    right = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 7))).strip()) for i in range(60)]
    got = match.containment_pairs(spark.createDataFrame(left, "a int, x string"), spark.createDataFrame(right, "b int, y string"), "x", "y", ("a", "b"))
    assert rows(got) == sorted(((i, j) for i, x in left for j, y in right if x and y and (x in y or y in x)), key=repr)


def test_needles_that_are_too_long_are_left_out_of_the_last_join(spark):
    needles, texts = spark.createDataFrame([(1, "b c"), (2, "a b c d"), (3, "a b c"), (4, "a x c")], "a int, x string"), spark.createDataFrame([(1, "a b c"), (2, "b")], "b int, y string")
    pairs = match.contained_in(needles, texts, "x", "y", ("a", "b"))
    assert rows(pairs) == [(1, 1), (3, 1)]
    assert "length(" in pairs._jdf.queryExecution().optimizedPlan().toString()  # not only where distinct needles are kept


def test_few_rows_are_dealt_to_all_tasks(spark):
    assert joins.spread(spark.range(1000)).select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_match_existing_cascade(spark):
    h = "ab" * 20
    magnets = spark.createDataFrame(
        [
            (1, "magnet:?1", "[180126] [Maker] Title", h), (2, "magnet:?2", "[180126] [Other] Thing", "cd" * 20), (3, "magnet:?3", "Some Bare Title [x]", "ef" * 20),
            (4, "magnet:?4", "[170101] [Nobody] None", "12" * 20), (5, "MAGNET:?5", None, "34" * 20), (6, "magnet:?6", "[160101] [Hash] Only", "56" * 20),
        ],
        "magnet_id int, magnet string, dn string, infohash_hex string",
    )
    files = spark.createDataFrame(
        [(1, "[180126] [Maker] Title (disc 1)"), (2, "x 180126 misc"), (3, "some bare title [x]"), (4, "5656565656565656 [160101] [hash] only"), (5, "q [170101 z")], "file_id int, file_name string"
    )
    tasks = spark.createDataFrame([(1, "xx magnet:?5 yy"), (2, None)], "task_id int, url string")
    got = {r["magnet_id"]: (r["exists"], r["confidence"], [f["name"] for f in r["matched_files"]]) for r in match.match_existing(magnets, files, tasks).collect()}
    assert got[1][:2] == (True, "high") and got[1][2] == ["[180126] [Maker] Title (disc 1)"]
    assert got[2] == (False, "low", [])  # the date search found files, so the title search does not run
    assert got[5] == (True, "high", [])
    assert got[6] == (True, "high", ["5656565656565656 [160101] [hash] only"])
    assert got[4] == (False, "none", [])  # the shortened keyword is "[170101]", bracket included


def test_html_rows(spark):
    listing = '<table><tr bgcolor="#ffffff"><td>1</td><td> Name <b>x</b></td><td>Maker</td></tr><tr bgcolor="#ffffff"><td>1</td><td>skip me</td><td>M</td></tr><tr><td>1</td><td>n</td><td>m</td></tr><tr bgcolor="#ffffff"><td>2</td></tr></table>'
    pages = spark.createDataFrame([("2018-01", listing), ("2018-02", None)], "date string, html string")
    assert rows(html.listings(pages, ["skip"]).select("date", "name", "company")) == [("2018-01", "Name x", "Maker")]
    search = '<tr><td>c</td><td><a href="/view/1#c" title="comments">3</a><a href="/view/1" title="T &amp; U">t</a></td><td><a href="/x.torrent">d</a><a href="magnet:?xt=urn:btih:aa">m</a></td><td>1 GB</td><td>2018-1-2 3:04</td></tr><tr><td>1</td><td>bare</td><td></td><td></td><td>bad</td></tr>'
    got = html.candidates(spark.createDataFrame([(7, search)], "id int, html string"), key_cols=["id"]).orderBy("ordinal").collect()
    assert [(r["name"], r["link"], r["size"], str(r["date"])) for r in got] == [("T & U", "magnet:?xt=urn:btih:aa", "1 GB", "2018-01-02 03:04:00"), ("bare", "", "", "None")]


def test_progress(spark):
    grid = progress.month_grid(spark, 2002, 2001, 0, 0)
    assert grid.count() == 24 and grid.orderBy("date").first()["date"] == "2001-01"
    months = spark.createDataFrame([(True,), (None,), (False,)], "ok boolean")
    assert tuple(progress.run_summary(months).first()) == (2, 3, False)
    checks = spark.createDataFrame([(True, None), (False, "e2"), (False, "e1")], "exists boolean, error string")
    assert tuple(progress.check_summary(checks, 1).first()) == (3, 1, ["e1"])
    assert tuple(progress.check_summary(checks.where("exists")).first()) == (1, 1, [])


def test_streaming_counters(spark, tmp_path):
    from folio.streaming.progress import streaming_counters

    spark.createDataFrame([("d", True), ("d", False)], "day string, inserted boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("day string, inserted boolean").parquet(str(tmp_path / "in"))
    query = streaming_counters(stream, "day", F.col("inserted")).writeStream.format("memory").queryName("counters").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("counters").select("day", "fetched", "inserted", "skipped", "progress").collect()] == [("d", 2, 1, 1, 50.0)]


def test_stored_catalog(spark, tmp_path):
    path = str(tmp_path / "catalog")
    write_months(shop(spark, [("2018-01", "a", "x", None), ("2018-02", "b", "x", None)]), path)
    write_months(shop(spark, [("2018-02", "c", "x", None)]), path)
    assert rows(read_catalog(spark, path).select("date", "name")) == [("2018-01", "a"), ("2018-02", "c")]
    assert read_config(str(tmp_path / "none.json")) == {}


def test_status_files(spark, tmp_path):
    path = tmp_path / "status" / "run.json"
    write_status(str(path), {"running": True, "name": "雨"})
    with pytest.raises(TypeError):
        write_status(str(path), {"running": object()})
    assert read_config(str(path)) == {"running": True, "name": "雨"} and [p.name for p in path.parent.iterdir()] == ["run.json"]
    assert tuple(read_status(spark, str(path), "running boolean, name string").first()) == (True, "雨")


def test_containment_deals_out_a_word_that_every_text_has(spark):
    names = [(i, f"the {i} x of all") for i in range(300)]
    got = match.contained_in(spark.createDataFrame([(1, "the"), (2, " of "), (3, "7 x of"), (4, " "), (5, "e 1")], "a int, x string"), spark.createDataFrame(names, "b int, y string"), "x", "y", ("a", "b"))
    counts = {r["a"]: r["count"] for r in got.groupBy("a").count().collect()}
    assert counts == {1: 300, 2: 300, 3: 30, 4: 300, 5: sum(str(i).startswith("1") for i in range(300))}


def test_parts_of_words_are_found_by_runs_of_their_length(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("ab\u65e5\U0001f600") for _ in range(rng.choice((1, 5, 17, 40, 64, 100, 300, 700)))) for _ in range(60)]
    parts = sorted({w[i : i + n] for w in words for n in (1, 3, 16, 17, 31, 48, 70, 97, 257, 400, 700) for i in (rng.randrange(len(w)),)} | {"abab" * 300, "x"})
    vocabulary = spark.createDataFrame([(w, 1) for w in sorted(set(words))], "_k string, df long")
    got = match._words_with(spark.createDataFrame([(p, p) for p in parts], "_h string, _e string"), vocabulary)
    assert rows(got) == sorted(((p, w) for p in parts for w in set(words) if p in w), key=repr)
    # A part of six characters meets only words that have it, and no others with three of its characters.
    codes = spark.createDataFrame([(f"{n:06d}",) for n in range(500)], "_k string")
    met = codes.select("_k", F.explode(match._runs(F.col("_k"), [6])).alias("g")).join(codes.select(F.xxhash64("_k").alias("g")), "g")
    assert met.count() == 500


def test_matching_sends_no_staged_table_to_every_task(spark):
    some = match._kept(spark.range(10).withColumnRenamed("id", "k"), "some")
    plan = spark.range(1000).withColumnRenamed("id", "k").join(some.where("k > 3").groupBy("k").count(), "k")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
