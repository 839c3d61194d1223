import re

from pyspark.sql import functions as F

from folio.functions import text


def one(spark, make, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(make(F.col("x"))).collect()]


def test_normalize_name_collapses_unicode_space_and_replaces_literals(spark):
    got = one(spark, lambda c: text.normalize_name(c, ["版", "X"]), "　a  b版c　", None, "", "X")
    assert got == ["a b c", "", "", ""]


def test_remove_literals_takes_the_longest_first_and_strips(spark):
    got = one(spark, lambda c: text.remove_literals(c, ["限定", "限定版", ""]), "名前 限定版", "限定版", "　他", None)
    assert got == ["名前", "", "　他", None]


def test_words_only_keeps_multilingual_words(spark):
    assert one(spark, text.words_only, "雨の庭、朝! a-b_c") == ["雨の庭朝 ab_c"]


def test_comparable(spark):
    got = one(spark, text.comparable, " up [Tag] Name～ disc 2 [12345678] [1.5 GB] Patch-x + rest", "+x", "", "[a] mini  adv b", "x disc2y")
    assert got == ["[tag] name x", "", "", "[a] b", "x disc2y"]


def test_search_keyword(spark):
    got = one(spark, text.search_keyword, "x[180126] [1234567] [10 MB] [ Maker ] t", "[180126]", "[Maker] t", "plain title of more than thirty characters + x", "[1.5GB]")
    assert got == ["[180126] [Maker]", "[180126]", "[Maker]", "plain title of more than thirt", "[1.5GB]"]


def test_before_plus_and_month_helpers(spark):
    assert one(spark, text.before_plus, "a  + b + c", "a+\nb", "none") == ["a", "a", "none"]
    assert one(spark, text.month_tag, "2018-01") == ["1801"]


def test_comparable_equals_a_plain_version(spark):
    def plain(name):
        name = name.strip()
        at = name.find("[")
        name = re.split(r"\s*\+\s*", name[at:] if at > 0 else name)[0].lower()
        name = name.translate({ord(c): None for c in text.DROPPED_SYMBOLS})
        for part in text.DROPPED_PARTS:
            name = re.sub(part, "", name)
        return re.sub(r"[\s\-_.]+", " ", name).strip()

    names = ["A [B] c_d..e + f", "disk 3 x", "♥ ～y", "[7654321][99 kb] crack update", "日本語・タイトル disc１", "a.b-c", "  [x]"]
    assert one(spark, text.comparable, *names) == [plain(n) for n in names]


def test_compare_normalize_all_covers_multilingual_documents(spark, tmp_path):
    from folio.plans.catalog_queries import QUERIES

    def plain(name):
        if name is None:
            return None
        name = name.strip()
        at = name.find("[")
        name = re.split(r"\s*\+\s*", name[at:] if at > 0 else name)[0].lower()
        name = name.translate({ord(c): None for c in text.DROPPED_SYMBOLS})
        for part in text.DROPPED_PARTS:
            name = re.sub(part, "", name)
        return re.sub(r"[\s\-_.]+", " ", name).strip()

    names = ["A [B] c_d + f", "　雨の庭　disc 2", "ÉCOLE～Patch é", "日本語・タイトル disc１", "Ж [1234567] ДОМ", "♥ update", "édisc 3 x", "[１.5 GB] y", "", None]
    spark.createDataFrame(list(enumerate(names)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["name"] for r in QUERIES["compare_normalize_all"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(map(plain, names)))
