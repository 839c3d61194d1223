import base64
import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.functions import bencode, magnet

HASH = hashlib.sha1(b"x").hexdigest()


def test_parse_magnet(spark):
    b32 = base64.b32encode(bytes.fromhex(HASH)).decode()
    rows = [
        None, "http://x", "magnet:?dn=a", "magnet:?xt=urn:btih:abc", f"magnet:?xt=urn:btih:{HASH.upper()}&dn=a+b%20c&tr=u1&tr=&tr=u%32#dn=z",
        f"magnet:?xt=urn:btih:{b32}", f"magnet:?xt=urn:btih:{HASH}&dn=%zz&dn=second",
    ]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(rows)], "i int, m string")
    got = [r[0] for r in df.orderBy("i").select(magnet.parse_magnet(F.col("m"))).collect()]
    assert [g["errors"] for g in got] == [["not_magnet"], ["not_magnet"], ["missing_btih"], ["invalid_btih"], [], ["invalid_btih"], []]
    assert (got[4]["dn"], got[4]["trackers"], got[4]["infohash_hex"]) == ("a b c", ["u1", "u2"], HASH)
    assert got[4]["infohash_base32"] == b32.lower()
    assert got[6]["dn"] == "%zz"
    half = df.where("i = 6").select(magnet.query_values(F.lit("magnet:?dn=%zz%41+%&dn=%E3%81%82%ff"), "dn")).first()[0]
    assert half == ["%zzA %", "\u3042\ufffd"]
    opened = df.where("i = 5").select(magnet.parse_magnet(F.col("m"), accept_base32=True)["infohash_hex"]).first()[0]
    assert opened == HASH


def test_a_link_is_evaluated_once(spark):
    df = spark.createDataFrame([("magnet:?xt=urn:btih:" + HASH,)], "wholelink string")
    for accept in (False, True):
        plan = df.select(magnet.parse_magnet(F.col("wholelink"), accept_base32=accept).alias("p")).select("p.*")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("array(wholelink#") == 1 and plan.split("LogicalRDD")[0].count("wholelink#") == 1


def test_base32_round_trip(spark):
    hashes = [hashlib.sha1(bytes([i])).hexdigest() for i in range(50)] + ["0" * 40, "f" * 40]
    df = spark.createDataFrame([(h,) for h in hashes], "h string")
    for r in df.select("h", magnet.infohash_to_base32(F.col("h")).alias("b"), magnet.base32_to_infohash(magnet.infohash_to_base32(F.col("h"))).alias("back")).collect():
        assert r["b"] == base64.b32encode(bytes.fromhex(r["h"])).decode().lower()
        assert r["back"] == r["h"]


def test_mismatch_is_added_once(spark):
    df = spark.createDataFrame([(["b"], "x", "y"), (["infohash_mismatch"], "x", "y"), ([], "x", None)], "e array<string>, a string, b string")
    assert [r[0] for r in df.select(magnet.with_mismatch(F.col("e"), F.col("a"), F.col("b"))).collect()] == [["b", "infohash_mismatch"], ["infohash_mismatch"], []]


values = st.recursive(st.integers() | st.binary(max_size=20), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.binary(max_size=5), x, max_size=4), max_leaves=12)


@settings(max_examples=100, deadline=None)
@given(values)
def test_bencode_round_trip(value):
    assert bencode.decode(bencode.encode(value)) == value


def test_parse_torrent(spark):
    many = {"info": {"name": "n", "files": [{"length": 3, "path": ["a", "b"]}, {"length": 4, "path": [b"\xff"]}]}}
    one = {"info": {"name": "n", "length": 5}}
    rows = [bencode.encode(many), bencode.encode(one), b"i1e", b"x", None, b"d4:infod"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw binary").orderBy("i")
    got = [r[0] for r in df.select(bencode.parse_torrent(F.col("raw"))).collect()]
    assert got[0]["total_size"] == 7 and [f["path"] for f in got[0]["files"]] == ["a/b", "�"]
    assert got[0]["infohash_hex"] == hashlib.sha1(bencode.encode(many["info"])).hexdigest()
    assert got[1]["total_size"] == 5 and got[1]["files"][0]["path"] == "n"
    assert got[2]["error"] == "missing_info" and got[3]["error"] and got[4]["error"] is None and got[5]["error"]


def test_hostile_files_give_errors(spark):
    nested = b"d4:info" + b"l" * 5000 + b"e" * 5000 + b"e"
    deep = b"d4:infod5:filesl" + b"l" * 5000 + b"e" * 5000 + b"e4:name" + b"l" * 5000 + b"e" * 5000 + b"ee"
    deep_key = b"d4:infod1:a" + b"l" * 5000 + b"e" * 5000 + b"6:lengthi3e4:name1:nee"
    sizes = b"d4:infod6:lengthi9223372036854775808e4:name1:nee"
    total = b"d4:infod5:filesld6:lengthi9223372036854775807eed6:lengthi9223372036854775807eee4:name1:nee"
    digits = b"d4:infod6:lengthi" + b"9" * 6000 + b"eee"
    keys = b"d4:infodi1e1:a1:b1:cee"
    rows = [nested, deep, sizes, total, digits, keys, b"d4:info999999999999999999999:x", deep_key]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw binary").orderBy("i")
    got = [r[0] for r in df.select(bencode.parse_torrent(F.col("raw"))).collect()]
    assert all(g["error"] and g["files"] is None for g in got[:7])
    assert got[7]["error"] is None and got[7]["total_size"] == 3
    value = []
    for _ in range(20_000):
        value = [value]
    assert bencode.encode(value) == b"l" * 20_001 + b"e" * 20_001
