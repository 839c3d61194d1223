"""Outcomes of edits, month-wise runs, verification with a ledger, folder trees, gram indexes and streams."""

import datetime
import hashlib
import json

from pyspark.sql import functions as F

from folio.operators import catalog, changes, folders, grams, match, verify
from folio.sources.catalog import evolved, first_torrents, read_catalog, write_shared_status
from folio.sources.runs import read_ledger, run_months

KEYS = "date string, name string"


def table(spark, names):
    return evolved(spark.createDataFrame([("d", n, f"c{n}") for n in names], f"{KEYS}, company string"))


def test_edit_outcomes(spark):
    edits = [("d", "a", "b", None, 1), ("d", "c", "x", None, 2), ("d", "e", "x", None, 3), ("d", "f", "f", "new", 4), ("d", "gone", "z", None, 5), ("d", "g", None, None, 6), (None, "h", "y", None, 7), ("d", "i", "j", None, 8), ("d", "j", "k", None, 9), ("d", "l", None, "p", 10), ("d", "l", "m", None, 11)]
    df = spark.createDataFrame(edits, "date string, old_name string, new_name string, new_company string, n int")
    rows, said = changes.edit_outcomes(table(spark, "abcefghijl"), df, "n")
    assert {r["n"]: r["outcome"] for r in said.collect()} == {1: "collision", 2: "affected", 3: "collision", 4: "affected", 5: "not_found", 6: "empty", 7: "not_found", 8: "collision", 9: "affected", 10: "affected", 11: "affected"}
    got = sorted((r["name"], r["company"]) for r in rows.collect())
    assert got == [("a", "ca"), ("b", "cb"), ("e", "ce"), ("f", "new"), ("g", "cg"), ("h", "ch"), ("i", "ci"), ("k", "cj"), ("m", "p"), ("x", "cc")]
    assert changes.collisions(rows).count() == 0


def test_delete_outcomes(spark):
    asked = spark.createDataFrame([("d", "a", 1), ("d", "a", 2), ("d", "z", 3), ("d", None, 4)], f"{KEYS}, n int")
    rows, said = changes.delete_outcomes(table(spark, "ab"), asked)
    assert {r["n"]: r["outcome"] for r in said.collect()} == {1: "affected", 2: "affected", 3: "not_found", 4: "not_found"} and [r["name"] for r in rows.collect()] == ["b"]


def test_a_poisoned_month_leaves_the_others_committed(spark, tmp_path):
    store, ledger = str(tmp_path / "store"), str(tmp_path / "ledger")
    months = [f"2001-{m:02d}" for m in range(1, 10)]
    rows = evolved(spark.createDataFrame([(m, f"n{i}") for m in months for i in range(3)], KEYS))
    asked = []

    def work(part, bad):
        asked.append(part)
        out = rows.where(F.col("date").isin(part)).withColumn("name", F.when(F.col("date") == bad, F.raise_error(F.lit("poisoned"))).otherwise(F.col("name")))
        return out, out.groupBy("date").agg(F.count(F.lit(1)).alias("fetched"))

    said = {r["date"]: r for r in run_months(spark, "r1", months, lambda p: work(p, "2001-04"), store, ledger).collect()}
    assert {m: r["ok"] for m, r in said.items()} == {m: m != "2001-04" for m in months} and "poisoned" in said["2001-04"]["error"]
    assert sorted({r["date"] for r in read_catalog(spark, store).select("date").collect()}) == [m for m in months if m != "2001-04"]
    asked.clear()
    said = {r["date"]: r["ok"] for r in run_months(spark, "r1", months, lambda p: work(p, None), store, ledger).collect()}
    assert asked == [["2001-04"]] and all(said.values())  # only what was left
    assert read_catalog(spark, store).count() == 27 and read_ledger(spark, ledger).count() == 9
    asked.clear()
    run_months(spark, "r1", months, lambda p: work(p, None), store, ledger)
    assert asked == []
    assert run_months(spark, "r2", ["2001-01"], lambda p: work(p, None), store, ledger).count() == 1 and read_catalog(spark, store).count() == 27


def test_check_all_checks_only_what_has_changed(spark):
    link = lambda h: f"magnet:?xt=urn:btih:{h * 40}&dn=%5B180101%5D%20{h}%20title"
    rows = [("2018-1", "A", link("a")), ("2018-01", "B", link("b")), ("2018-02", "C", "nothing"), ("2018-02", "D", None), (None, "E", link("e"))]
    c = evolved(spark.createDataFrame(rows, f"{KEYS}, link string"))
    files = spark.createDataFrame([(1, "[180101] a title")], "file_id int, file_name string")
    tasks = spark.createDataFrame([], "task_id int, url string")
    first = verify.check_all(c, files, tasks, year=2018, month=1)
    assert tuple(first.summary.first())[:2] == (2, 1) and {r["name"]: r["downloaded"] for r in first.catalog.collect()}["A"] == 1
    second = verify.check_all(first.catalog, files, tasks, first.ledger)
    assert tuple(second.summary.first())[:2] == (2, 0)  # the other month's, and the one without a month
    assert {r["name"]: r["message"] for r in second.ledger.collect()}["C"] == "磁链解析失败: not_magnet"
    third = verify.check_all(second.catalog, files, tasks, second.ledger)
    assert tuple(third.summary.first())[:2] == (0, 0) and third.ledger.count() == 4
    more = files.union(spark.createDataFrame([(2, "[180101] b title")], files.schema))
    fourth = verify.check_all(third.catalog, more, tasks, third.ledger)
    assert tuple(fourth.summary.first())[:2] == (4, 2) and fourth.ledger.count() == 4
    assert {r["name"]: r["downloaded"] for r in fourth.catalog.collect()} == {"A": 1, "B": 1, "C": 0, "D": 0, "E": 0}


def test_check_all_sends_no_results_to_every_task(spark):
    c = evolved(spark.createDataFrame([("2018-01", "A", "magnet:?xt=urn:btih:" + "a" * 40)], f"{KEYS}, link string"))
    files, tasks = spark.createDataFrame([(1, "[180101] a title")], "file_id int, file_name string"), spark.createDataFrame([(1, "magnet:?xt=urn:btih:" + "a" * 40)], "task_id int, url string")
    run = verify.check_all(c, files, tasks)
    plan = run.catalog._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert run.catalog.first()["downloaded"] == 1


def test_a_second_check_sends_no_ledger_to_every_task(spark, monkeypatch):
    c = evolved(spark.createDataFrame([("2018-01", n, f"magnet:?xt=urn:btih:{n * 40}") for n in "ab"], f"{KEYS}, link string"))
    files, tasks = spark.createDataFrame([(1, "[180101] a title")], "file_id int, file_name string"), spark.createDataFrame([], "task_id int, url string")
    first = verify.check_all(c.where("name = 'a'"), files, tasks)
    plans, staged = {}, verify.staged

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return staged(df, name)

    monkeypatch.setattr(verify, "staged", seen)
    second = verify.check_all(c, files, tasks, first.ledger)
    assert "Broadcast" not in plans["links"] and "SortMergeJoin" in plans["links"]
    assert second.summary.first()["checked"] == 1 and second.ledger.count() == 2


def test_nothing_is_sought_for_links_that_are_none(spark, monkeypatch):
    monkeypatch.setattr(match, "_found", None)  # a call would fail
    c = evolved(spark.createDataFrame([("2018-01", "a", "no link"), ("2018-01", "b", None)], f"{KEYS}, link string"))
    files, tasks = spark.createDataFrame([(1, "no link")], "file_id int, file_name string"), spark.createDataFrame([], "task_id int, url string")
    first = verify.check_all(c, files, tasks)
    assert tuple(first.summary.first())[:2] == (1, 0)
    got = first.ledger.first()
    assert (got["name"], got["exists"], got["confidence"], got["message"]) == ("a", False, "none", "磁链解析失败: not_magnet")
    second = verify.check_all(c, files, tasks, first.ledger)
    assert tuple(second.summary.first())[:2] == (0, 0) and second.ledger.count() == 1


def test_verdicts_in_a_folder(spark):
    from folio.operators.match import match_existing, parsed_links

    links = parsed_links(spark.createDataFrame([(1, "magnet:?xt=urn:btih:" + "a" * 40 + "&dn=%5B180101%5D%20title"), (2, "magnet:?xt=urn:btih:" + "b" * 40 + "&dn=%5B180101%5D%20title%20two")], "magnet_id int, link string"))
    files = spark.createDataFrame([(n, "[180101] title", n * 10, f"p{n}", n % 3) for n in range(12)] + [(50, "[180101] other", 1, "q", 1)], "file_id int, file_name string, size long, pick_code string, parent_id int")
    tasks = spark.createDataFrame([], "task_id int, url string")
    tree = spark.createDataFrame([(0, None, "root"), (1, 0, "in"), (2, None, "out")], "folder_id int, parent_id int, name string")
    inside = {r["magnet_id"]: r for r in match_existing(links, files, tasks, folders=tree, save_path="/root/in/", most_files=2).collect()}
    assert inside[1]["n_matched"] == 4 and [tuple(f) for f in inside[1]["matched_files"]] == [("[180101] title", 10, "p1"), ("[180101] title", 40, "p4")]
    assert match_existing(links, files, tasks, folders=tree, save_path="root").where("magnet_id = 1").first()["n_matched"] == 8
    unknown = match_existing(links, files.where("file_id = 50"), tasks, folders=tree, save_path="nowhere").where("magnet_id = 1").first()
    known = match_existing(links, files.where("file_id = 50"), tasks, folders=tree, save_path="root/in").where("magnet_id = 1").first()
    assert (unknown["confidence"], known["confidence"]) == ("none", "low")  # without a folder there is no low confidence


def test_folder_trees(spark):
    chain = [(i, i - 1 if i else None, f"f{i}") for i in range(40)] + [(100, 101, "x"), (101, 100, "y"), (102, 102, "self"), (103, 999, "lost"), (None, 1, "null"), (104, 3, None)]
    df = spark.createDataFrame(chain, "folder_id int, parent_id int, name string")
    paths = {r["folder_id"]: r["path"] for r in folders.folder_paths(df).collect()}
    assert paths[39] == "/" + "/".join(f"f{i}" for i in range(40)) and paths[102] == "/self" and paths[103] == "/lost" and paths[104] == "/f0/f1/f2/f3/" and len(paths) == 45
    assert sorted(r[0] for r in folders.subtree(df, 37).collect()) == [37, 38, 39] and sorted(r[0] for r in folders.subtree(df, 100).collect()) == [100, 101] and folders.subtree(df, 7777).count() == 0
    assert folders.folder_of(df, "f0/f1") == 1 and folders.folder_of(df, "f1") is None


def test_gram_index_follows_changes(spark, tmp_path):
    path = str(tmp_path / "grams")
    rows = [("m1", "Spring"), ("m1", "ab"), ("m2", "ring"), ("m3", "東京ring"), (None, "ring"), ("m3", None), ("m1", "rinxing")]
    grams.write_grams(spark.createDataFrame(rows, KEYS), path)
    find = lambda part: sorted(map(tuple, grams.names_with(grams.read_grams(spark, path), part).collect()))
    assert find("ring") == [("m1", "Spring"), ("m2", "ring"), ("m3", "東京ring")] and find("京r") == [("m3", "東京ring")] and find("b") == [("m1", "ab")] and find("zzz") == [] and len(find("")) == 5
    grams.write_grams(spark.createDataFrame([("m1", "string"), ("m3", "東京ring")], KEYS), path, ["m1", "m2"])
    assert find("ring") == [("m1", "string"), ("m3", "東京ring")]


def test_places_and_deep_pages(spark):
    c = evolved(spark.createDataFrame([(f"{2000 + i % 7}-{i % 12 + 1:02d}", f"n{i:03d}", "m", f"l{i}") for i in range(230)], f"{KEYS}, company string, link string"))
    placed = catalog.with_places(c)
    for page in (1, 3, 5, 9):
        plain = [tuple(r) for r in catalog.catalog_page(c, page).collect()]
        assert [tuple(r)[:-1] for r in catalog.deep_page(placed, page).orderBy("place").collect()] == plain


def test_long_names_take_room_in_proportion(spark):
    from folio.operators.editions import dedup_editions

    words = " ".join(f"w{i}" for i in range(20_000))
    items = spark.createDataFrame([("d", words, "m", 1), ("d", words + " more", "m", 2), ("d", "w0", "m", 0), ("d", "w0 w1 w2", "m", 3)], "date string, name string, company string, ordinal int")
    assert sorted(len(r["name"]) for r in dedup_editions(items).collect()) == [2, 8, len(words)]


def test_stored_torrents_of_a_folder(spark, tmp_path):
    from folio.sources.catalog import read_torrents

    info = b"d6:lengthi7e4:name1:ae"
    for name, data in (("b.torrent", b"d4:info" + info + b"e"), ("sub/a.torrent", b"d4:info" + info + b"e"), ("bad.torrent", b"d4:info"), ("other.txt", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = read_torrents(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: (r["infohash_hex"], r["total_size"], r["error"] is None) for r in rows.collect()}
    wanted = hashlib.sha1(info).hexdigest()
    assert got["b.torrent"] == got["a.torrent"] == (wanted, 7, True) and not got["bad.torrent"][2] and len(got) == 3
    first = first_torrents(rows, spark.createDataFrame([(wanted,)], "infohash_hex string")).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in first] == ["b.torrent"]  # by path


def test_first_torrent_of_a_hash(spark):
    rows = spark.createDataFrame([("b", "h1", "n1", None), ("a", "h1", "n2", None), ("0", "h1", "n3", "bad"), ("c", "h2", "n4", None)], "path string, infohash_hex string, name string, error string")
    wanted = spark.createDataFrame([("h1",), ("h1",), ("h3",)], "infohash_hex string")
    assert [(r["infohash_hex"], r["path"], r["name"]) for r in first_torrents(rows, wanted).collect()] == [("h1", "a", "n2")]


def test_shared_status_replaces_the_file(spark, tmp_path):
    path = "file://" + str(tmp_path / "status.json")
    for n in (1, 2):
        write_shared_status(spark, path, {"n": n, "text": "東京"})
        assert json.loads((tmp_path / "status.json").read_text()) == {"n": n, "text": "東京"}
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["status.json"]


def test_requests_are_answered_once_over_restarts(spark, tmp_path):
    from folio.streaming.requests import answer_requests

    asked, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    asked.mkdir()
    for n in range(3):
        (asked / f"{n}.txt").write_text(json.dumps({"magnet": f"magnet:?xt=urn:btih:{str(n) * 40}"}) + "\nbad\n")
        for _ in range(2):  # the second start finds nothing new
            answer_requests(spark, str(asked), out, checkpoint).awaitTermination()
    got = [json.loads(r[0]) for r in spark.read.text(out).collect()]
    assert sorted(g.get("infohash_hex", "") for g in got) == ["", "", "", "0" * 40, "1" * 40, "2" * 40]


def beats(rows):
    return [(run, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s), event) for run, s, event in rows]


def test_runs_now(spark):
    rows = beats([("a", 0, "beat"), ("a", 5, "beat"), ("a", 100, "beat"), ("b", 0, "beat"), ("b", 4, "finish"), ("b", 90, "beat"), ("c", 95, "beat"), ("d", 0, "beat"), ("e", 0, "beat"), ("e", 3, "finish"), (None, 1, "beat")])
    from folio.streaming.heartbeats import runs_now

    df = spark.createDataFrame(rows, "run string, ts timestamp, event string")
    got = {r["run"]: (r["state"], r["reason"], r["stops"]) for r in runs_now(df, 10).collect()}
    assert got == {"a": ("running", None, 1), "b": ("running", None, 0), "c": ("running", None, 0), "d": ("stopped", "not_running", 1), "e": ("finished", None, 0)}
    assert runs_now(df.limit(0), 10).collect() == []


def test_a_silent_run_is_stopped_by_its_timer(spark, tmp_path):
    from folio.streaming.heartbeats import run_states

    schema = "run string, ts timestamp, event string"
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    steps = [
        [("a", 0, "beat"), ("b", 0, "beat"), ("c", 0, "beat")],
        [("a", 5, "beat"), ("b", 3, "finish")],
        [("c", 8, "beat"), ("x", 60, "beat")],  # the watermark moves on: a and c have fallen silent
        [("x", 65, "beat")],
        [("a", 64, "beat"), ("x", 70, "beat"), ("c", 9, "beat")],  # a beats again; c's beat is too late
        [("x", 72, "finish"), ("y", 200, "beat")],
        [("y", 201, "beat")],
    ]
    for rows in steps:
        spark.createDataFrame(beats(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = run_states(spark.readStream.schema(schema).parquet(source), 10, "2 seconds")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    zero = datetime.datetime(2024, 1, 1)
    got = sorted((r["run"], int((r["at"] - zero).total_seconds()), r["state"], r["reason"]) for r in spark.read.parquet(out).collect())
    assert got == [
        ("a", 0, "running", None), ("a", 15, "stopped", "not_running"), ("a", 64, "running", None), ("a", 74, "stopped", "not_running"),
        ("b", 0, "running", None), ("b", 3, "finished", None), ("c", 0, "running", None), ("c", 18, "stopped", "not_running"),
        ("x", 60, "running", None), ("x", 72, "finished", None), ("y", 200, "running", None),
    ]
