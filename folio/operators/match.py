"""Matching titles with file lists by containment, without comparing every pair.

If a needle of three words or more is part of a text, its inner words are whole words of that text; the
one that the fewest texts have is its key.  The longest word of a shorter needle is part of a word of
the text; those words are found in the vocabulary of all texts by an equality join on runs of
characters nearly as long as itself, and are its keys.  Only ids and single words are exploded and shuffled; a word that very many texts have
is dealt out in slices.  The texts are joined to the candidates that are left, and checked, so the
result is exactly the containment join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.magnet import bound, parse_magnet
from folio.functions.text import before_plus, comparable, from_first_bracket, search_keyword, strip
from folio.operators.folders import folder_of, subtree
from folio.operators.joins import spread
from folio.sources.staging import staged

#: Words that at least this part of all (text, word) rows have are dealt out; there can be no more of them than its inverse.
HEAVY_PART = 1 / 200
#: Rows of a table of words that may be sent to every task; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000
#: Lengths of the runs by which parts of words are found; a part takes the longest that it holds, so two cover it and a short part is one.
RUNS = (*range(1, 17), 24, 32, 48, 64)
#: Runs of a word start in pieces of this many characters, so that a long word is not walked through for each of them.
PIECE = 256
#: Stands for needles of nothing but spaces: every text with a space has it.  No word is like it, as words have no spaces.
_BLANK = " "


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` staged, for joins by shuffles: its compressed size would have tables of millions of rows sent through the driver to every task."""
    return staged(df, name).hint("merge")


def _words(text: Column) -> Column:
    """Distinct words between single spaces (empty ones, too), and the mark of a text with a space."""
    return F.array_distinct(F.concat(F.split(text, " "), F.when(F.contains(text, F.lit(" ")), F.array(F.lit(_BLANK))).otherwise(F.array().cast("array<string>"))))


def character_grams(word: Column) -> Column:
    """All runs of one to three characters, in time proportional to the word."""

    def runs(chars: Column) -> Column:
        near = lambda i, k: F.get(chars, i + k)
        return F.flatten(F.transform(chars, lambda c, i: F.array(c, F.concat(c, near(i, 1)), F.concat(c, near(i, 1), near(i, 2)))))

    # Inside a lambda an expression is evaluated for each element, so the characters are bound to a variable first.
    return F.array_distinct(F.array_compact(F.transform(F.array(F.split(word, "")), runs)[0]))


def _dealt_join(postings: DataFrame, wanted: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """``postings`` and ``wanted`` on ``_k``; rows of heavy words are dealt by a hash of their text, and what wants them goes to each slice."""
    heavy = F.broadcast(counts.where(F.col("df") >= HEAVY_PART * total).select("_k", F.ceil(F.col("df") / (HEAVY_PART * total)).cast("int").alias("_m")))  # at most 1 / HEAVY_PART rows
    m = F.coalesce("_m", F.lit(1))
    left = postings.join(heavy, "_k", "left").withColumn("_s", F.pmod(F.xxhash64("_b"), m).cast("int")).drop("_m")
    right = wanted.join(heavy, "_k", "left").withColumn("_s", F.explode(F.sequence(F.lit(0), m - 1))).drop("_m")
    return left.join(right, ["_k", "_s"]).drop("_s")


def _runs(word: Column, sizes: list[int]) -> Column:
    """Hashes of all runs of some lengths in a word."""

    def of(size: int) -> Column:
        starts = F.when(F.length(word) >= size, F.sequence(F.lit(0), F.length(word) - size, F.lit(PIECE))).otherwise(F.array().cast("array<int>"))
        pieces = F.transform(starts, lambda i: F.substring(word, i + 1, F.lit(PIECE + size - 1)))
        return F.flatten(F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - size + 1), lambda i: F.xxhash64(F.substring(p, i, F.lit(size))))))

    return F.array_distinct(F.flatten(F.array(*map(of, sizes))))


def _words_with(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """``_h``, ``_k``: the words of the vocabulary that have the part ``_e``, found by its run that the fewest words have.

    A run is nearly as long as its part, so the words that share it are hardly more than those sought:
    the work grows with the vocabulary's characters and the hits, not with parts times words.
    """
    longest = counts.agg(F.max(F.length("_k")).alias("n")).first()["n"] or 0
    parts = parts.where(F.length("_e") <= longest)  # a longer part is in no word
    size = F.array_max(F.filter(F.array(*map(F.lit, RUNS)), lambda r: r <= F.length("_e")))
    parts = parts.withColumn("_size", size)
    sizes = sorted(r["_size"] for r in parts.select("_size").distinct().collect())  # at most as many as RUNS
    if not sizes:
        return parts.select("_h", F.col("_e").alias("_k"))
    runs = _kept(spread(counts.select("_k")).select("_k", F.explode(_runs(F.col("_k"), sizes)).alias("_g")), "runs")
    often = runs.groupBy("_g").agg(F.count(F.lit(1)).alias("gf"))
    last = F.length("_e") - F.col("_size")
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(RUNS[-1] // 2)), F.array(last)))
    own = F.transform(starts, lambda i: F.xxhash64(F.substring(F.col("_e"), i + 1, F.col("_size"))))
    rarest = parts.select("_h", "_e", F.explode(own).alias("_g")).join(often, "_g").groupBy("_h").agg(F.min_by(F.struct("_g", "_e"), F.struct("gf", "_g")).alias("r"))
    return rarest.select("_h", "r.*").join(runs, "_g").where(F.contains("_k", "_e")).select("_h", "_k").distinct()


def contained_in(needles: DataFrame, hay: DataFrame, needle: str, text: str, keys: tuple[str, str]) -> DataFrame:
    """Distinct pairs of keys (needle's, text's) where the non-empty needle is part of the text; nulls are part of nothing."""
    n = needles.select(F.col(keys[0]).alias("_a"), F.col(needle).alias("_n")).where(F.col("_n") != "")
    h = hay.select(F.col(keys[1]).alias("_b"), F.col(text).alias("_t")).where(F.col("_t") != "")
    longest_text = h.agg(F.max(F.length("_t")).alias("n")).first()["n"] or 0
    # Equal needles are sought once; one longer than every text is part of none.
    n = n.where(F.length("_n") <= longest_text)
    distinct = n.select("_n").distinct()
    words = F.split("_n", " ")
    inner = F.array_distinct(F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != ""))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"]
    texts = distinct.select("_n", F.struct(F.xxhash64("_n"), F.xxhash64(F.lit(1), "_n")).alias("_h"), inner.alias("_inner"))
    texts = _kept(texts.select("_n", "_h", "_inner", F.when(F.size("_inner") == 0, longest).alias("_e")), "needles")
    kinds = texts.agg(F.coalesce(F.sum(F.size("_inner")), F.lit(0)).alias("inner"), F.count("_e").alias("edges")).first()
    every = h.select("_b", F.explode(_words(F.col("_t"))).alias("_k"))
    pairs = [_by_inner_word(texts, every, kinds["inner"] <= BROADCAST_ROWS)] if kinds["inner"] else []
    if kinds["edges"]:
        pairs.append(_by_edge(texts.where("_e IS NOT NULL").select("_h", "_e"), every))
    if not pairs:
        return n.join(h, F.lit(False)).select(F.col("_a").alias(keys[0]), F.col("_b").alias(keys[1]))
    both = pairs[0] if len(pairs) == 1 else pairs[0].unionByName(pairs[1])
    found = both.distinct().join(texts.select("_h", "_n"), "_h").join(h, "_b").where(F.contains("_t", "_n")).select("_n", "_b")
    return n.join(found, "_n").select(F.col("_a").alias(keys[0]), F.col("_b").alias(keys[1])).distinct()


def _by_inner_word(texts: DataFrame, every: DataFrame, few: bool) -> DataFrame:
    """``_h``, ``_b``: texts that have the needle's rarest inner word.  Only words that some needle has are counted and kept."""
    own = texts.select("_h", F.explode("_inner").alias("_k"))
    sought = own.select("_k").distinct()
    postings = _kept(every.join(F.broadcast(sought) if few else sought, "_k", "left_semi"), "postings")
    counts = _kept(postings.groupBy("_k").agg(F.count(F.lit(1)).alias("df")), "words")
    size = counts.agg(F.coalesce(F.sum("df"), F.lit(1)).alias("total"), F.count(F.lit(1)).alias("words")).first()
    # Frequent words would burden their tasks in a shuffle; few words, as a rule, are both sought and there.
    near = own.join(F.broadcast(counts) if size["words"] <= BROADCAST_ROWS else counts, "_k", "left")
    # A needle with a word that no text has is in none.
    rarest = near.groupBy("_h").agg(F.min_by("_k", F.struct("df", "_k")).alias("_k"), F.bool_and(F.col("df").isNotNull()).alias("_whole"))
    return _dealt_join(postings, rarest.where("_whole").select("_h", "_k"), counts, size["total"]).select("_h", "_b")


def _by_edge(edges: DataFrame, every: DataFrame) -> DataFrame:
    """``_h``, ``_b``: texts with a word that has the needle's longest word as a part; such words are sought in the vocabulary of all texts."""
    counts = _kept(every.groupBy("_k").agg(F.count(F.lit(1)).alias("df")), "words")
    total = counts.agg(F.sum("df").alias("n")).first()["n"] or 1
    wanted = edges.where(F.col("_e") == "").select("_h", F.lit(_BLANK).alias("_k")).unionByName(_words_with(edges.where(F.col("_e") != ""), counts))
    return _dealt_join(every, wanted, counts, total).select("_h", "_b")


def containment_pairs(left: DataFrame, right: DataFrame, left_name: str, right_name: str, keys: tuple[str, str]) -> DataFrame:
    """Pairs of keys where either name contains the other, both non-empty; both tables are read once and kept."""
    left, right = (_kept(df.select(key, name), "names") for df, key, name in ((left, keys[0], left_name), (right, keys[1], right_name)))
    forth = contained_in(left, right, left_name, right_name, keys)
    back = contained_in(right, left, right_name, left_name, (keys[1], keys[0])).select(*keys)
    return forth.unionByName(back).distinct()


def _title(dn: Column) -> Column:
    return strip(F.regexp_replace(from_first_bracket(before_plus(dn)), r"\[[^\]]+\]", ""))


#: Fields of a matched file.
FILE = "struct<name: string, size: bigint, pick_code: string>"
#: What a link that can't be parsed is answered with, before its errors (fixed value).
PARSE_FAILED = "磁链解析失败: "


def _found(magnets: DataFrame, files: DataFrame, tasks: DataFrame, low_counts: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(magnet_id, file_id and the file's fields) of matched files, (magnet_id) of links that a task has, (magnet_id) of those whose shortened keyword finds a file."""
    dn = F.coalesce("dn", F.lit(""))
    m = magnets.select("magnet_id", "magnet", dn.alias("dn"), "infohash_hex", search_keyword(dn).alias("keyword"), comparable(dn).alias("_norm"))
    m = _kept(m, "magnets")
    code = F.coalesce(F.get(F.regexp_extract_all("dn", F.lit(r"\[(\d{6})\]"), F.lit(1)), 0), F.lit(""))
    title = bound(_title(F.col("dn")), lambda t: F.when(F.length(t) >= 3, F.substring(t, 1, 20)).otherwise(F.lit("")))
    short = F.expr("substring(keyword, 1, greatest(8, cast(floor(length(keyword) / 3) as int)))") if low_counts else F.lit("")
    # All searches of all magnets, in names and in the tasks' links, are one containment join: levels 0 to 2 in turn, 3 by the hash, 4 for low confidence, 5 in links.
    words = F.array("keyword", code, title, F.coalesce(F.substring("infohash_hex", 1, 12), F.lit("")), short)
    in_names = m.where("dn <> ''").select("magnet_id", F.posexplode(words).alias("level", "word"))
    in_links = m.select("magnet_id", F.lit(5).alias("level"), F.explode(F.array(F.lower("magnet"), F.coalesce("infohash_hex", F.lit("")))).alias("word"))
    searches = in_names.unionByName(in_links).where("word <> ''").select(F.struct("magnet_id", "level").alias("search"), "word")
    more = [F.col(c) if c in files.columns else F.lit(None).cast(t).alias(c) for c, t in (("size", "long"), ("pick_code", "string"))]
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("_key")
    names = _kept(files.select("file_id", key("file_id"), "file_name", *more, comparable(F.col("file_name")).alias("_file")), "names")
    place = lambda task: F.struct(F.lit(task).alias("task"), F.col("_key").alias("key")).alias("place")
    urls = tasks.select(key("task_id"), F.lower("url").alias("text")).where("text <> ''")
    places = names.select(place(False), F.col("file_name").alias("text")).unionByName(urls.select(place(True), "text"))
    found = contained_in(_kept(searches, "searches"), places, "word", "text", ("search", "place")).where((F.col("search.level") == 5) == F.col("place.task"))
    found = _kept(found.select("search.magnet_id", "search.level", F.col("place.key").alias("_key")), "found")
    least = found.where("level < 3").groupBy("magnet_id").agg(F.min("level").alias("level"))
    level_hits = found.join(least, ["magnet_id", "level"]).select("magnet_id", "_key")
    either = (F.col("_norm") != "") & (F.col("_file") != "") & (F.contains("_norm", "_file") | F.contains("_file", "_norm"))
    check = lambda hits: hits.join(m.select("magnet_id", "_norm"), "magnet_id").join(names, "_key").where(either).select("magnet_id", "file_id", "file_name", "size", "pick_code")
    matched = _kept(check(level_hits), "matched")

    in_tasks = found.where("level = 5").select("magnet_id").distinct()
    by_hash = check(found.where("level = 3").select("magnet_id", "_key"))
    by_hash = by_hash.join(matched.select("magnet_id").distinct(), "magnet_id", "left_anti").join(in_tasks, "magnet_id", "left_anti")
    return matched.unionByName(by_hash).distinct(), in_tasks, found.where("level = 4").select("magnet_id").distinct()


def match_existing(magnets: DataFrame, files: DataFrame, tasks: DataFrame, *, folders: DataFrame | None = None, save_path: str | None = None, most_files: int = 100) -> DataFrame:
    """magnet_id, exists, confidence, matched_files (name, size, pick_code), n_matched, in_tasks, message.

    ``magnets`` has magnet_id, magnet, dn, infohash_hex and, where links are parsed here, ``errors`` (see
    :func:`parsed_links`); ``files`` has file_id, file_name and any of size, pick_code and parent_id;
    ``tasks`` has task_id and url.  Searches go by keyword, then date tag, then bare title (of three characters
    or more); the next one counts only if the one before found no file at all.  If nothing matched and
    no task has the link, the first twelve digits of the hash are searched.  A found file matches when
    either comparable name contains the other.  Confidence is high for a match or a task, low if the
    shortened keyword finds a file, else none.

    With ``folders`` (folder_id, parent_id, name) files are sought in the folder ``save_path`` and below it
    only; a path that no folder has means all files, and no low confidence.  ``matched_files`` has the first ``most_files`` of all
    ``n_matched`` by name and id.  A link with errors matches nothing; its ``message`` names them.
    """
    low_counts = True
    if folders is not None:
        root = folder_of(folders, save_path) if save_path else None
        low_counts = root is not None
        if low_counts:
            files = files.join(subtree(folders, root).withColumnRenamed("folder_id", "parent_id"), "parent_id", "left_semi")
    errors = F.coalesce("errors", F.array().cast("array<string>")) if "errors" in magnets.columns else F.array().cast("array<string>")
    message = F.when(F.size(errors) > 0, F.concat(F.lit(PARSE_FAILED), F.array_join(errors, ", ")))
    magnets = _kept(magnets.select("magnet_id", "magnet", "dn", "infohash_hex", message.alias("message")), "links")  # parsed once
    none, nothing = F.array().cast(f"array<{FILE}>"), F.lit(0).cast("long")
    if not magnets.where("message IS NULL").limit(1).count():  # nothing to seek, as in a check after one that was finished
        no = F.lit(False)
        return magnets.select("magnet_id", no.alias("exists"), F.lit("none").alias("confidence"), none.alias("matched_files"), nothing.alias("n_matched"), no.alias("in_tasks"), "message")
    matched, in_tasks, low = _found(magnets.where("message IS NULL"), files, tasks, low_counts)
    matched = _kept(matched, "matched")
    order = Window.partitionBy("magnet_id").orderBy("file_name", "file_id")
    first = matched.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most_files)
    file = F.struct("_n", F.struct(F.col("file_name").alias("name"), F.col("size").cast("long").alias("size"), "pick_code").alias("file"))
    first = first.groupBy("magnet_id").agg(F.transform(F.array_sort(F.collect_list(file)), lambda x: x["file"]).alias("matched_files"))
    counts = matched.groupBy("magnet_id").agg(F.count(F.lit(1)).alias("n_matched"))
    out = magnets.select("magnet_id", "message")
    for part in (first, counts, in_tasks.withColumn("in_tasks", F.lit(True)), low.withColumn("_low", F.lit(True))):
        out = out.join(part, "magnet_id", "left")
    exists = F.col("n_matched").isNotNull() | F.col("in_tasks").isNotNull()
    return out.select(
        "magnet_id",
        exists.alias("exists"),
        F.when(exists, "high").when(F.col("_low"), "low").otherwise("none").alias("confidence"),
        F.coalesce("matched_files", none).alias("matched_files"),
        F.coalesce("n_matched", nothing).alias("n_matched"),
        F.coalesce("in_tasks", F.lit(False)).alias("in_tasks"),
        "message",
    )


def parsed_links(links: DataFrame, link: str = "link") -> DataFrame:
    """``links`` with magnet, dn, infohash_hex and errors, as :func:`match_existing` takes them; the rows are dealt out first."""
    # Bound inside a lambda the parsed struct is made once, and not again for each of its fields.
    return spread(links).withColumn("_p", F.transform(F.array(link), lambda x: parse_magnet(x))[0]).select(*links.columns, F.col(link).alias("magnet"), "_p.dn", "_p.infohash_hex", "_p.errors")
