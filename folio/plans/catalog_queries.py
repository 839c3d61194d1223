"""Registered queries: each operator on the analogous columns of the test tables, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import bencode, html, magnet, text, values
from folio.operators import catalog, changes, editions, enrich, flows, folders, grams, joins, match, progress, verify
from folio.sources.catalog import evolved, read_catalog, read_status, status_rows, to_json_lines, write_months
from folio.sources.runs import run_months
from folio.sources.staging import scratch_path
from folio.streaming.heartbeats import runs_now
from folio.streaming.requests import answer_requests

SKIP = ["ring", "gear"]
DELETE = ["small", "red", "small red", "ECONOMY"]
STOP = ["The ", "der", "-"]
TAGS = ["R", "A"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the shape of the catalog: some without a link, some unmarked."""
    o = _t(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    rows = o.select(
        F.date_format("o_orderdate", "yyyy-MM").alias("date"),
        F.concat(F.lit("order "), key).alias("name"),
        F.concat(F.lit("maker "), F.col("o_custkey").cast("string")).alias("company"),
        F.when(F.col("o_orderstatus") == "P", "").when(F.col("o_orderstatus") == "O", F.concat(F.lit("link "), key)).alias("link"),
        F.col("o_orderpriority").alias("comment"),
        F.when(F.col("o_orderpriority").startswith("1"), 1).when(F.col("o_orderpriority").startswith("2"), 0).alias("downloaded"),
    )
    return evolved(rows)


def catalog_listing(spark, sf_dir):
    return catalog.listing(orders_catalog(spark, sf_dir))


def catalog_years(spark, sf_dir):
    return catalog.years(orders_catalog(spark, sf_dir))


def catalog_latest_month(spark, sf_dir):
    return catalog.latest_month(orders_catalog(spark, sf_dir))


def catalog_page(spark, sf_dir):
    return catalog.catalog_page(orders_catalog(spark, sf_dir), page=2, year=1996, month=3)


def catalog_month_total(spark, sf_dir):
    return catalog.totals_by_month(orders_catalog(spark, sf_dir)).withColumn("pages", catalog.page_count(F.col("total")))


def links_to_check(spark, sf_dir):
    return catalog.links_to_check(orders_catalog(spark, sf_dir))


def missing_enrichment(spark, sf_dir):
    return changes.delete_rows(_t(spark, sf_dir, "documents").select("doc_id", "source"), _t(spark, sf_dir, "labels"), ["doc_id"])


def present_enrichment(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "source")
    none = _t(spark, sf_dir, "labels").limit(0)
    return enrich.lookup_with_fallback(d, _t(spark, sf_dir, "labels"), none, ["doc_id"], ["doc_id"], "doc_id").select("doc_id", "source", "quality", "toxic")


def skip_list_filter(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.where((F.col("p_name") != "") & (F.col("p_brand") != "") & ~text.contains_any(F.col("p_name"), SKIP)).select("p_partkey", "p_name", "p_brand")


def delete_list_clean(spark, sf_dir):
    name = F.concat_ws(" ", "p_name", "p_type")
    return _t(spark, sf_dir, "part").select("p_partkey", text.remove_literals(name, DELETE).alias("name"))


def normalize_name(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.normalize_name(F.col("text"), STOP).alias("name"))


def keyword_relax(spark, sf_dir):
    t = F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", text.words_only(t).alias("words"), F.length(text.without_hyphens(t)).cast("long").alias("bare_length"), F.length(text.hyphens_to_spaces(t)).cast("long").alias("spaced_length"))


def greedy_prefix_dedup(spark, sf_dir):
    words = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    items = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("date"), F.array_join(F.slice(words, 1, F.col("p_size") % 3 + 1), " ").alias("name"), F.concat(F.lit("m"), (F.col("p_size") % 5).cast("string")).alias("company"), F.col("p_partkey").alias("ordinal"))
    return editions.dedup_editions(items, ordered=True)


def _event_keys(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    old = e.where(F.col("ts").cast("timestamp_ntz") < cut).groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return old, e.where(F.col("ts").cast("timestamp_ntz") >= cut).select("user_id", "event_type", "event_id")


def insert_or_ignore(spark, sf_dir):
    old, batch = _event_keys(spark, sf_dir)
    return changes.insert_or_ignore(old, batch, ["user_id", "event_type"], "event_id")


def insert_counts(spark, sf_dir):
    return changes.insert_counts(*_event_keys(spark, sf_dir), ["user_id", "event_type"])


def partial_update(spark, sf_dir):
    """Every order is a patch of its customer, so keys repeat; the last value of each field counts."""
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    patch = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(status == "P", "").when(status == "O", "OPEN").alias("new_c_mktsegment"), F.when(price > 300000, price).alias("new_c_acctbal"))
    return changes.update_rows(_t(spark, sf_dir, "customer"), patch, ["c_mktsegment", "c_acctbal"], ["c_custkey"], "o_orderkey")


def delete_by_key(spark, sf_dir):
    gone = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return changes.delete_rows(_t(spark, sf_dir, "customer"), gone, ["c_custkey"])


def tiered_top1(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.lpad((F.col("p_size") % 12 + 1).cast("string"), 2, "0").alias("month"))
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.concat_ws(" ", F.concat(F.lit("m"), F.date_format("l_shipdate", "MM")), "l_returnflag").alias("name"), "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", F.concat(F.lit("link "), F.col("l_orderkey").cast("string")).alias("link"))
    rows = p.join(li, "p_partkey")
    best = enrich.best_candidates(rows, ["p_partkey"], enrich.tier(F.col("name"), F.concat(F.lit("m"), F.col("month")), TAGS), F.col("l_shipdate"), ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"], ["name", "l_orderkey", "l_linenumber", "l_suppkey", "link"], last_tier=4)
    return best.withColumn("tier", F.col("tier").cast("int"))


def early_release_flag(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM").alias("date"))
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    early = enrich.older_than_month(F.col("l_shipdate").cast("timestamp"), F.col("date"))
    return li.join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", early.alias("early"), F.when(early, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("comment"))


def fallback_lookup(spark, sf_dir):
    step = lambda c: F.floor(F.col(c) / 1000).cast("long")
    items = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), step("s_acctbal").alias("step"))
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), step("c_acctbal").alias("step"), "c_custkey")
    first = c.groupBy("nation", "step").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("least"))
    second = c.groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("least"))
    return enrich.lookup_with_fallback(items, first, second, ["nation", "step"], ["nation"], "s_suppkey").select("s_suppkey", "level", "n", "least")


def url_params(spark, sf_dir):
    u = F.col("url")
    return _t(spark, sf_dir, "pages").select("page_id", *(F.get(magnet.query_values(u, n), 0).alias(n) for n in ("page", "ref", "utm_source")))


def magnet_parts(spark, sf_dir):
    hashed = F.sha1(F.concat_ws("|", "p_name", F.col("p_partkey").cast("string")))
    uri = F.concat(F.lit("magnet:?xt=urn:btih:"), F.upper(hashed), F.lit("&dn="), F.replace("p_name", F.lit(" "), F.lit("+")), F.lit("&tr=udp%3A%2F%2Ft"), F.col("p_size").cast("string"), F.lit("#x"))
    m = joins.spread(_t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")).select("p_partkey", magnet.parse_magnet(uri).alias("m"))
    return m.select("p_partkey", "m.ok", "m.btih", "m.dn", F.array_join("m.trackers", ",").alias("trackers"), "m.infohash_hex", F.array_join("m.errors", ",").alias("errors"))


def compare_normalize(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.comparable(F.col("text")).alias("name"))


def compare_normalize_all(spark, sf_dir):
    """The comparison form of every document, of any script; the same rows as ``compare_normalize``."""
    return _t(spark, sf_dir, "documents").select("doc_id", text.comparable(F.col("text")).alias("name"))


def _titles(spark, sf_dir):
    key = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    size = F.col("p_size").cast("string")
    dn = F.concat(F.lit("up ["), key, F.lit("] [1234567] ["), size, F.lit(" MB] ["), "p_name", F.lit("] "), "p_type", F.lit(" + extra"))
    plain = F.concat("p_name", F.lit(" "), "p_type", F.lit(" + extra"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, plain).otherwise(dn).alias("dn"))


def bracket_keyword(spark, sf_dir):
    return _titles(spark, sf_dir).select("p_partkey", text.search_keyword(F.col("dn")).alias("keyword"))


def containment_match(spark, sf_dir):
    b = _t(spark, sf_dir, "benchmark").select("item_id", text.normalize_name(F.lower("text")).alias("item_name"))
    d = _t(spark, sf_dir, "documents").select("doc_id", text.normalize_name(F.lower("text")).alias("doc_name"))
    return match.containment_pairs(b, d, "item_name", "doc_name", ("item_id", "doc_id"))


def _links(spark, sf_dir):
    """A link of each part, one of ten with a hash that is none."""
    hashed = F.sha1(F.concat_ws("|", F.lit("m"), F.col("p_partkey").cast("string")))
    uri = F.concat(F.lit("magnet:?xt=urn:btih:"), F.when(F.col("p_partkey") % 10 == 0, "none").otherwise(hashed), F.lit("&dn="), F.url_encode("dn"))
    return _titles(spark, sf_dir).select(F.col("p_partkey").alias("magnet_id"), uri.alias("link"))


def _stored_files(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    key = F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    name = F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("["), key, F.lit("] [x"), "s_name", F.lit("]"))).otherwise(F.concat_ws(" ", F.lit("old red"), key, "s_name"))
    files = s.select(F.col("s_suppkey").alias("file_id"), name.alias("file_name"), (F.col("s_nationkey") * 1000).cast("long").alias("size"), F.concat(F.lit("pc"), F.col("s_suppkey").cast("string")).alias("pick_code"), (F.col("s_suppkey") % 11).alias("parent_id"))
    tasks = s.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("task_id"), F.concat(F.lit("MAGNET:?xt=urn:btih:"), F.upper(F.sha1(F.concat_ws("|", F.lit("m"), F.col("s_suppkey").cast("string"))))).alias("url"))
    return files, tasks


def _verdict_rows(verdicts):
    shown = F.transform("matched_files", lambda f: F.concat_ws("|", f["name"], f["size"].cast("string"), f["pick_code"]))
    return verdicts.withColumn("matched_files", F.array_join(shown, ","))


def existence_confidence(spark, sf_dir):
    files, tasks = _stored_files(spark, sf_dir)
    return _verdict_rows(match.match_existing(match.parsed_links(_links(spark, sf_dir)), files, tasks))


def _folders(spark, sf_dir):
    """Folders 0 to 10 in a tree: folder k lies in folder k // 2."""
    s = _t(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 11).alias("folder_id")).agg(F.min("s_suppkey").alias("_least"))
    return s.select("folder_id", F.floor(F.col("folder_id") / 2).cast("long").alias("parent_id"), F.concat(F.lit("f"), F.col("folder_id").cast("string")).alias("name"))


def existence_in_folder(spark, sf_dir):
    """Verdicts where only a folder and what lies below it is searched."""
    files, tasks = _stored_files(spark, sf_dir)
    return _verdict_rows(match.match_existing(match.parsed_links(_links(spark, sf_dir)), files, tasks, folders=_folders(spark, sf_dir), save_path="f0/f1/f2"))


def _customer_tree(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("folder_id"), F.floor(F.col("c_custkey") / 3).cast("long").alias("parent_id"), F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("name"))


def folder_paths(spark, sf_dir):
    return folders.folder_paths(_customer_tree(spark, sf_dir))


def folder_subtree(spark, sf_dir):
    return folders.subtree(_customer_tree(spark, sf_dir), 7)


def _linked_catalog(spark, sf_dir):
    links = _links(spark, sf_dir)
    key = F.col("magnet_id").cast("string")
    return evolved(links.select(F.concat(F.lit("2001-"), F.lpad((F.col("magnet_id") % 12 + 1).cast("string"), 2, "0")).alias("date"), F.concat(F.lit("title "), key).alias("name"), F.lit("m").alias("company"), F.when(F.col("magnet_id") % 5 != 0, F.col("link")).alias("link")))


def check_all_marks(spark, sf_dir):
    """The catalog after all its links were checked."""
    files, tasks = _stored_files(spark, sf_dir)
    return verify.check_all(_linked_catalog(spark, sf_dir), files, tasks).catalog.select("date", "name", "downloaded", "infohash_hex")


def check_all_runs(spark, sf_dir):
    """What four runs did: the first checks one month, the second the others, the third nothing, the fourth the links that have changed."""
    files, tasks = _stored_files(spark, sf_dir)
    before = _linked_catalog(spark, sf_dir)
    after = before.withColumn("link", F.when(F.substring("name", 7, 20).cast("long") % 9 == 0, F.lit("no link")).otherwise(F.col("link")))
    first = verify.check_all(before, files, tasks, year=2001, month=3)
    second = verify.check_all(before, files, tasks, first.ledger)
    third = verify.check_all(before, files, tasks, second.ledger)
    fourth = verify.check_all(after, files, tasks, third.ledger)
    out = None
    for n, run in enumerate((first, second, third, fourth), 1):
        row = run.summary.select(F.lit(n).alias("run"), "checked", "found_downloaded")
        out = row if out is None else out.unionByName(row)
    return out


def check_all_ledger(spark, sf_dir):
    files, tasks = _stored_files(spark, sf_dir)
    return verify.check_all(_linked_catalog(spark, sf_dir), files, tasks).ledger.select("date", "name", "link_hash", "exists", "confidence", "infohash_hex", "message")


def infohash_base32(spark, sf_dir):
    h = F.sha1(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    rows = _t(spark, sf_dir, "documents").select("doc_id", h.alias("infohash_hex"), magnet.infohash_to_base32(h).alias("infohash_base32"))
    return rows.withColumn("back", magnet.base32_to_infohash(F.col("infohash_base32")))


def bencode_infohash(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha1(F.encode(bencode.single_file_info(F.col("source"), F.col("n_chars")), "UTF-8")).alias("infohash_hex"))


def torrent_metadata(spark, sf_dir):
    info = bencode.single_file_info(F.col("source"), F.col("n_chars"))
    data = F.encode(F.concat(F.lit("d8:announce3:udp4:info"), info, F.lit("e")), "UTF-8")
    meta = _t(spark, sf_dir, "documents").select("doc_id", bencode.parse_torrent(data).alias("m"))
    return meta.select("doc_id", "m.infohash_hex", F.col("m.name").alias("name"), "m.total_size", F.col("m.files")[0]["path"].alias("path"))


def torrent_total_size(spark, sf_dir):
    f = F.struct(F.col("turn").alias("path"), F.length("text").cast("long").alias("size"))
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(f).alias("files")).select("conv_id", F.size("files").cast("long").alias("n_files"), bencode.total_size(F.col("files")).alias("total_size"))


def html_links(spark, sf_dir):
    links = html.anchors(F.col("html"))
    return _t(spark, sf_dir, "pages").select("page_id", links.alias("l")).select("page_id", F.size("l").cast("long").alias("n_links"), F.array_join("l", " ").alias("links"))


def ingest_progress(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return progress.counters(e, "day", F.col("event_type") == "click").withColumn("progress", F.round("progress", 1))


def _year_bounds(spark, sf_dir, start_month, end_month):
    """The years of the orders, the last one first."""
    year = F.year("o_orderdate")
    return _t(spark, sf_dir, "orders").agg(F.max(year).alias("start_year"), F.min(year).alias("end_year")).select("*", F.lit(start_month).alias("start_month"), F.lit(end_month).alias("end_month"))


def month_grid(spark, sf_dir):
    return progress.month_grid_between(_year_bounds(spark, sf_dir, 11, 3))


def json_first_key(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", values.first_int(F.col("props"), ["id", "key", "k"]).alias("found"))


def additive_schema(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("company"))
    return evolved(c).select("name", "company", "link", "match_name", "downloaded", "infohash_hex")


def duplicate_links(spark, sf_dir):
    return catalog.with_link_uses(_t(spark, sf_dir, "documents"), "doc_id", "text")


def missing_links(spark, sf_dir):
    return catalog.missing_links(orders_catalog(spark, sf_dir), 1996, 3).select("date", "name", "link")


def catalog_page_of_year(spark, sf_dir):
    return catalog.catalog_page(orders_catalog(spark, sf_dir), page=3, year=1997)


def catalog_page_of_month(spark, sf_dir):
    return catalog.catalog_page(orders_catalog(spark, sf_dir), page=2, month=2)


def listing_html_rows(spark, sf_dir):
    row = F.concat(F.lit('<table><tr bgcolor="#ffffff"><td>1</td><td> <b>'), "p_name", F.lit("</b> </td><td>"), "p_brand", F.lit("</td></tr>"))
    other = F.lit('<tr><td>1</td><td>no</td><td>colour</td></tr><tr bgcolor="#ffffff"><td>short</td></tr></table>')
    pages = _t(spark, sf_dir, "part").select("p_partkey", F.concat(row, other).alias("html"))
    return html.listings(pages, SKIP, date_col="p_partkey").select("p_partkey", "name", "company", F.col("ordinal._r").alias("row"))


def candidate_html_rows(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    day = F.when(F.col("o_orderkey") % 5 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-M-d H:m"))
    link = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit('<a href="magnet:?xt=urn:btih:'), F.sha1(key), F.lit('">m</a>')))
    row = F.concat(F.lit('<tr><td>c</td><td><a href="/view/1#c" title="3">3</a><a href="/view/1" title="A &amp; '), key, F.lit('">t</a></td><td><a href="/x">d</a>'), link, F.lit("</td><td> 1 GB </td><td>"), day, F.lit("</td></tr><tr><td>short</td></tr>"))
    found = html.candidates(_t(spark, sf_dir, "orders").select("o_orderkey", row.alias("html")), key_cols=["o_orderkey"])
    return found.select("o_orderkey", "name", "link", "size", F.date_format("date", "yyyy-MM-dd HH:mm").alias("released"), "ordinal")


def json_first_at_any_depth(spark, sf_dir):
    kind, props = F.col("event_type"), F.coalesce("props", F.lit("{}"))
    nested = F.concat(F.lit('{"id": " ", "a": [[], {"b": {"id": ["x"]}}, {"c": '), props, F.lit(', "id": " '), kind, F.lit(' "}], "uid": true}'))
    return _t(spark, sf_dir, "events").select("event_id", values.first_text(nested, ["id"]).alias("kind"), values.first_int(nested, ["k", "none"]).alias("k"))


def lenient_numbers(spark, sf_dir):
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 7
    raw = F.when(kind == 0, size).when(kind == 1, F.concat(size, F.lit(".75"))).when(kind == 2, F.concat(F.lit("x"), size)).when(kind == 3, F.concat(size, F.lit("d"))).when(kind == 4, F.concat(F.lit(" "), size, F.lit("e1 "))).when(kind == 5, F.concat(size, F.lit("F"))).otherwise(F.lit(" "))
    return _t(spark, sf_dir, "part").select("p_partkey", values.lenient_int(raw, 7).alias("number"))


def month_arithmetic(spark, sf_dir):
    day = F.col("o_orderdate")
    date, loose = F.date_format(day, "yyyy-MM"), F.date_format(day, "yyyy-M")
    m = values.month_of(loose)
    return _t(spark, sf_dir, "orders").select("o_orderkey", values.month_shift(date, -1).alias("before"), values.month_shift(date, 13).alias("after"), m["year"].alias("year"), m["month"].alias("month"), text.month_tag(date).alias("tag"), text.month_text(m["year"], m["month"]).alias("date"))


def run_ids(spark, sf_dir):
    day = F.col("o_orderdate")
    return _t(spark, sf_dir, "orders").select("o_orderkey", values.save_path("/store/", F.year(day)).alias("path"), values.run_id(values.epoch_seconds(day), F.col("o_orderkey"), F.year(day), F.month(day)).alias("run"))


def month_grid_of_all_months(spark, sf_dir):
    return progress.month_grid_between(_year_bounds(spark, sf_dir, 0, 0))


def magnet_escapes(spark, sf_dir):
    hashed = F.sha1(F.col("p_partkey").cast("string"))
    uri = F.concat(F.lit("magnet:?xt=urn:btih:"), magnet.infohash_to_base32(hashed), F.lit("&dn=%zz%41+"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("%4"))
    m = joins.spread(_t(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", magnet.parse_magnet(uri, accept_base32=True).alias("m"))
    return m.select("p_partkey", "m.dn", "m.infohash_hex", "m.ok")


def magnet_mismatch(spark, sf_dir):
    wanted = F.sha1(F.col("p_partkey").cast("string"))
    found = F.when(F.col("p_size") % 3 == 0, wanted).when(F.col("p_size") % 3 == 1, F.sha1(F.col("p_name")))
    errors = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("timeout"), F.lit("infohash_mismatch"))).otherwise(F.array().cast("array<string>"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(magnet.with_mismatch(errors, wanted, found), ",").alias("errors"))


def _request_lines(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    uri = F.concat(F.lit("magnet:?xt=urn:btih:"), F.sha1(key), F.lit("&dn="), key)
    line = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit('{"magnet": '), key)).otherwise(F.to_json(F.struct(uri.alias("magnet"))))
    return _t(spark, sf_dir, "part").select("p_partkey", line.alias("value"))


def _answer_fields(said):
    field = lambda name: F.get_json_object("value", f"$.{name}").alias(name)
    return said.select(field("ok"), field("dn"), field("infohash_hex"), F.get_json_object("value", "$.errors[0]").alias("error"))


def request_answers(spark, sf_dir):
    """JSON request lines in, JSON answers out, one of four requests malformed."""
    return _answer_fields(flows.answers(_request_lines(spark, sf_dir)))


def status_lines(spark, sf_dir):
    """Status rows written as JSON lines and read back."""
    lines = to_json_lines(ingest_progress(spark, sf_dir))
    return status_rows(lines, "day string, fetched long, inserted long, skipped long")


def stored_status(spark, sf_dir):
    """Status rows from a folder of JSON lines."""
    path = scratch_path(spark, "status")
    to_json_lines(ingest_progress(spark, sf_dir)).write.text(path)
    return read_status(spark, path, "day string, fetched long, inserted long, skipped long")


def stored_months(spark, sf_dir):
    """A catalog stored by months, of which one is written again with fewer rows."""
    path, c = scratch_path(spark, "months"), orders_catalog(spark, sf_dir)
    write_months(c, path)
    write_months(c.where("date = '1996-03' AND link <> ''").withColumn("comment", F.lit("again")), path)
    return read_catalog(spark, path).select("date", "name", "link", "comment")


def torrent_files(spark, sf_dir):
    name, size = F.col("source"), F.col("n_chars")
    entry = lambda n, path: F.concat(F.lit("d6:lengthi"), n.cast("string"), F.lit("e4:pathl1:a"), F.octet_length(path).cast("string"), F.lit(":"), path, F.lit("ee"))
    info = F.concat(F.lit("d5:filesl"), entry(size, name), entry(F.lit(7), F.col("lang")), F.lit("i3ee4:name2:dde"))
    meta = bencode.parse_torrent(F.encode(F.concat(F.lit("d4:info"), info, F.lit("1:zd1:aleee")), "UTF-8"))
    m = _t(spark, sf_dir, "documents").select("doc_id", meta.alias("m"))
    return m.select("doc_id", "m.infohash_hex", F.col("m.name").alias("name"), "m.total_size", F.array_join(F.transform("m.files", lambda f: f["path"]), ",").alias("paths"), F.col("m.error").alias("error"))


def _shipped(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.lpad((F.col("p_size") % 12 + 1).cast("string"), 2, "0").alias("month"))
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.concat_ws(" ", F.concat(F.lit("m"), F.date_format("l_shipdate", "MM")), "l_returnflag").alias("name"), "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", F.concat(F.lit("link "), F.col("l_orderkey").cast("string")).alias("link"))
    return p.join(li, "p_partkey")


_TIES = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]


def tiered_one_tag(spark, sf_dir):
    """One tag only, and the link of a candidate without the month stays."""
    tier = enrich.tier(F.col("name"), F.concat(F.lit("m"), F.col("month")), TAGS[:1])
    return enrich.best_candidates(_shipped(spark, sf_dir), ["p_partkey"], tier, F.col("l_shipdate"), _TIES, ["name", "l_orderkey", "link"])


def tiered_month_first(spark, sf_dir):
    """Candidates of the month if there are any, and among them the tagged ones."""
    tier = enrich.month_before_tag(F.col("name"), F.concat(F.lit("m"), F.col("month")), TAGS[0])
    return enrich.best_candidates(_shipped(spark, sf_dir), ["p_partkey"], tier, F.col("l_shipdate"), _TIES, ["name", "l_orderkey", "link"])


def run_summary(spark, sf_dir):
    months = _t(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("date")).agg(F.when(F.min("o_totalprice") < 1500, F.count_if(F.col("o_orderstatus") == "P") < 40).alias("ok"))
    return progress.run_summary(months)


def check_summary(spark, sf_dir):
    c = orders_catalog(spark, sf_dir)
    results = c.select((F.col("downloaded") == 1).alias("exists"), F.when(F.col("link") == "", F.concat("date", F.lit("/"), "name", F.lit(": timeout"))).alias("error"))
    return progress.check_summary(results).withColumn("errors", F.array_join("errors", ","))


def key_collisions(spark, sf_dir):
    return changes.collisions(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def mark_downloaded(spark, sf_dir):
    """Found links; a record found twice has its later mark."""
    c = orders_catalog(spark, sf_dir)
    number = F.col("name").substr(7, 20).cast("long")
    found = c.where(number % 7 == 0).select("date", "name", F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal"))
    marks = found.select("date", "name", "ordinal", F.when(F.col("ordinal") == 2, 1).alias("new_downloaded"), F.when((number % 2 == 0) | (F.col("ordinal") == 1), F.sha1(F.concat_ws("|", "name", F.col("ordinal").cast("string")))).otherwise("").alias("new_infohash_hex"))
    return changes.set_downloaded(c, marks, ordinal="ordinal").select("date", "name", "downloaded", "infohash_hex")


def _edits(spark, sf_dir):
    """A catalog and edits: an empty name or company is not supplied, an empty link is a value; some want a name that is taken, some are for records that aren't there, some say nothing."""
    c = orders_catalog(spark, sf_dir)
    number = F.col("name").substr(7, 20).cast("long")
    asked = c.where(number % 11 == 0).select("date", "name", number.alias("n"))
    new_name = F.when(F.col("n") % 7 == 0, "order 1").when(F.col("n") % 2 == 0, F.concat("name", F.lit(" b"))).otherwise("")
    edits = asked.select(
        F.when(F.col("n") % 13 == 0, "1900-01").otherwise(F.col("date")).alias("date"), F.col("name").alias("old_name"), F.when(F.col("n") % 7 == 0, first_month(c)).alias("new_date"), new_name.alias("new_name"), F.lit("").alias("new_company"),
        F.when(F.col("n") % 3 == 0, "").when(F.col("n") % 3 == 1, "l").alias("new_link"), F.when(F.col("n") % 5 == 0, F.lit(4)).alias("new_downloaded"),
    )
    return c, edits


def first_month(c):
    """The month of order 1, which the edits of some other orders want with its name."""
    return F.lit(c.where("name = 'order 1'").select("date").first()["date"])


def edit_rows(spark, sf_dir):
    return changes.edit_rows(*_edits(spark, sf_dir)).select("date", "name", "company", "link", "downloaded")


def edit_outcomes(spark, sf_dir):
    return changes.edit_outcomes(*_edits(spark, sf_dir))[1].select("date", "name", "outcome")


def delete_outcomes(spark, sf_dir):
    """Every order asks for its customer to go; half of the requests are for customers beyond the last."""
    key = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 100_000_000)
    return changes.delete_outcomes(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders").select("o_orderkey", key.alias("c_custkey")), ["c_custkey"])[1]


def month_run(spark, sf_dir):
    """The ledger of a run over the years of the orders, in which one year fails and the others are committed; the year is mended, and the run goes on."""
    store, ledger = scratch_path(spark, "store"), scratch_path(spark, "ledger")
    c = orders_catalog(spark, sf_dir).withColumn("date", F.substring("date", 1, 4))
    years = [r["date"] for r in c.select("date").distinct().collect()]

    def work(part, poisoned):
        rows = c.where(F.col("date").isin(part))
        if poisoned:
            rows = rows.withColumn("name", F.when(F.col("date") == "1996", F.raise_error(F.lit("poisoned"))).otherwise(F.col("name")))
        return rows, rows.groupBy("date").agg(F.count(F.lit(1)).alias("fetched"), F.count("link").alias("inserted"), F.count_if(F.col("link") == "").alias("updated"))

    broken = run_months(spark, "a", years, lambda part: work(part, True), store, ledger).select(F.lit(1).alias("attempt"), "date", "ok", "fetched", "inserted", "updated", F.col("error").contains("poisoned").alias("told"))
    broken = spark.createDataFrame(broken.collect(), broken.schema)  # a row a year, read before the ledger goes on
    mended = run_months(spark, "a", years, lambda part: work(part, False), store, ledger).select(F.lit(2).alias("attempt"), "date", "ok", "fetched", "inserted", "updated", F.col("error").contains("poisoned").alias("told"))
    return broken.unionByName(mended)


def deep_pages(spark, sf_dir):
    """Pages far back in the listing of all months, from the rows' places."""
    placed = catalog.with_places(orders_catalog(spark, sf_dir))
    return catalog.deep_page(placed, 7).unionByName(catalog.deep_page(placed, 23)).select("place", "year", "month", "name", "company", "download_url")


def run_states(spark, sf_dir):
    """Users as runs and their events as beats, a purchase as the end; silent for a day means stopped."""
    e = _t(spark, sf_dir, "events")
    beats = e.select(F.col("user_id").cast("string").alias("run"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "purchase", "finish").otherwise("beat").alias("event"))
    return runs_now(beats, 86_400).select("run", "state", "reason", F.date_format("last_beat", "yyyy-MM-dd HH:mm:ss").alias("last_beat"), "stops")


def request_answers_streamed(spark, sf_dir):
    """The requests as files, answered by a stream that is stopped and started again with more files."""
    asked, said, checkpoint = (scratch_path(spark, n) for n in ("requests", "answers", "checkpoint"))
    lines = _request_lines(spark, sf_dir)
    for half in (0, 1):
        lines.where(F.col("p_partkey") % 2 == half).select("value").write.mode("append").text(asked)
        answer_requests(spark, asked, said, checkpoint).awaitTermination()
    return _answer_fields(spark.read.text(said))


def gram_search(spark, sf_dir):
    """Names with a text in them, from a stored index, before and after inserts, an edit of names and deletes in some months."""
    path = scratch_path(spark, "grams")
    n = F.col("p_partkey")
    date = lambda k: F.concat(F.lit("2001-"), F.lpad((k % 12 + 1).cast("string"), 2, "0"))
    before = _t(spark, sf_dir, "part").select(date(n).alias("date"), F.concat_ws(" ", "p_name", n.cast("string")).alias("name"))
    grams.write_grams(before, path)
    found = grams.names_with(grams.read_grams(spark, path), "ring")
    first = found.select(F.lit("before").alias("when"), "date", "name")
    kept = scratch_path(spark, "found")
    first.write.parquet(kept)  # the index goes on
    touched = F.col("date").isin("2001-02", "2001-05")
    edited = before.where("date <> '2001-07'").withColumn("name", F.when(touched, F.concat("name", F.lit(" string"))).otherwise(F.col("name")))
    inserted = _t(spark, sf_dir, "supplier").select(F.lit("2001-09").alias("date"), F.concat(F.lit("spring "), "s_name").alias("name"))
    after = edited.unionByName(inserted)
    grams.write_grams(after, path, ["2001-02", "2001-05", "2001-07", "2001-09"])
    again = grams.names_with(grams.read_grams(spark, path), "ring").select(F.lit("after").alias("when"), "date", "name")
    return spark.read.parquet(kept).unionByName(again)


def _short_titles(spark, sf_dir):
    words = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    name = F.array_join(F.slice(words, 1, F.col("p_size") % 3 + 1), " ")
    date = F.concat(F.lit("2001-"), F.lpad((F.col("p_size") % 12 + 1).cast("string"), 2, "0"))
    return _t(spark, sf_dir, "part").select("p_partkey", date.alias("date"), name.alias("name"), F.concat(F.lit("m"), (F.col("p_size") % 5).cast("string")).alias("company"))


def _ingested(spark, sf_dir):
    items = _short_titles(spark, sf_dir)
    old = items.where(F.col("p_partkey") % 9 == 0).groupBy("date", "name").agg(F.min("company").alias("company"))
    row = F.concat(F.lit('<tr bgcolor="#ffffff"><td></td><td>'), "name", F.lit("</td><td>"), "company", F.lit("</td></tr>"))
    return flows.ingest(old, items.select("date", F.col("p_partkey").alias("page"), row.alias("html")), SKIP)


def ingest_listings(spark, sf_dir):
    return _ingested(spark, sf_dir)[0]


def ingest_counts(spark, sf_dir):
    return _ingested(spark, sf_dir)[1]


def enrich_catalog(spark, sf_dir):
    """Open records get the best of the candidates of their query, or of their relaxed query where it has none; without any, or without a name, they stay as they are."""
    n = F.col("p_partkey")
    date = F.concat((F.col("p_size") % 3 + 1995).cast("string"), F.lit("-"), F.lpad((F.col("p_size") % 12 + 1).cast("string"), 2, "0"))
    title = F.when(n % 17 != 0, F.concat_ws("-", "p_name", n.cast("string")))
    own = evolved(_t(spark, sf_dir, "part").select("p_partkey", date.alias("date"), title.alias("name"), F.lit("sz").alias("size"), F.lit("mn").alias("match_name"), F.concat(F.lit("M-"), "p_brand").alias("company"), F.when(n % 4 == 0, "has").when(n % 4 == 1, "").alias("link"), F.lit("old").alias("comment")))
    lines = _t(spark, sf_dir, "lineitem").join(flows.with_search_keys(own).select(n.alias("l_partkey"), "search", "relaxed"), "l_partkey")
    kind = F.col("l_partkey") % 3
    query = F.when((kind == 0) & (F.col("l_linenumber") <= 5), F.col("search")).when(kind < 2, F.col("relaxed")).otherwise("nothing")
    name = F.concat_ws(" ", F.date_format("l_shipdate", "yyMM"), "l_returnflag")
    found = lines.select(query.alias("query"), name.alias("name"), F.concat(F.lit("link "), F.col("l_orderkey").cast("string")).alias("link"), F.concat(F.col("l_linenumber").cast("string"), F.lit(" GB")).alias("size"), F.col("l_shipdate").cast("timestamp").alias("date"), F.struct("l_orderkey", "l_linenumber", "l_returnflag").alias("ordinal"))
    return flows.enrich(own.drop("p_partkey"), found, TAGS).select("date", "name", "link", "size", "match_name", "comment")


QUERIES = {
    f.__name__: f
    for f in (
        catalog_listing, catalog_years, catalog_latest_month, catalog_page, catalog_month_total, links_to_check, missing_enrichment, present_enrichment,
        skip_list_filter, delete_list_clean, normalize_name, keyword_relax, greedy_prefix_dedup, insert_or_ignore, insert_counts, partial_update, delete_by_key,
        tiered_top1, early_release_flag, fallback_lookup, url_params, magnet_parts, compare_normalize, compare_normalize_all, bracket_keyword, containment_match, existence_confidence,
        infohash_base32, bencode_infohash, torrent_metadata, torrent_total_size, html_links, ingest_progress, month_grid, json_first_key, additive_schema, duplicate_links,
        missing_links, catalog_page_of_year, catalog_page_of_month, listing_html_rows, candidate_html_rows, json_first_at_any_depth, lenient_numbers, month_arithmetic, run_ids,
        month_grid_of_all_months, magnet_escapes, magnet_mismatch, request_answers, status_lines, stored_status, stored_months, torrent_files, tiered_one_tag, tiered_month_first, run_summary, check_summary,
        key_collisions, mark_downloaded, edit_rows, ingest_listings, ingest_counts, enrich_catalog,
        existence_in_folder, folder_paths, folder_subtree, check_all_marks, check_all_runs, check_all_ledger, edit_outcomes, delete_outcomes, month_run, deep_pages, run_states,
        request_answers_streamed, gram_search,
    )
}
