"""Edition dedup: an item goes if its name, or its name without the last word, was accepted before it.

Items come by (company, name length, input order).  Accepting depends on what was accepted before, yet
it has a closed form per key: let f be a key's first position.  A key is accepted at f unless its
parent (the key without its last word) is accepted earlier; the parent's own parent decides on the
parent in the same way.  So a key's fate is a fold over the first positions of its prefixes, shortest
first, and no item waits for another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import longest_first, normalize_name, remove_literals
from folio.operators.joins import join_by_weight
from folio.sources.staging import staged

#: Columns of a prefix's hash.
_PREFIX = ["_p1", "_p2"]


def dedup_editions(items: DataFrame, literals: Sequence[str] = (), *, group: str = "date", name: str = "name", company: str = "company", ordinal: str = "ordinal", ordered: bool = False) -> DataFrame:
    """group, name (cleaned), company of the accepted items, with ``ordered`` by group and name.

    ``ordinal`` is the input order, unique in a group; any type with an order will do.  A first word that
    very many keys of a group share is no burden to one task: its position is sent to their prefixes.
    """
    literals = longest_first(literals)
    cleaned = items.select(F.col(group).alias("_g"), remove_literals(F.col(name), literals).alias("_n"), F.col(company).alias("_c"), F.col(ordinal).alias("_o"))
    keyed = cleaned.withColumn("_k", normalize_name(F.col("_n"), literals))
    at = F.struct(F.col("_c").alias("c"), F.length("_n").alias("l"), F.col("_o").alias("o"), F.col("_n").alias("n"))
    first = staged(keyed.groupBy("_g", "_k").agg(F.min(at).alias("f")).withColumn("_id", F.monotonically_increasing_id()), "first_positions")
    # Prefixes are 128 bits that grow word by word, so a name takes room in proportion to its length.
    words = first.select("_g", "_id", F.size(F.split("_k", " ")).alias("_size"), F.posexplode(F.split("_k", " ")).alias("i", "_w"))
    so_far = Window.partitionBy("_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixes = staged(words.select("_g", "_id", "i", (F.col("i") == F.col("_size") - 1).alias("_whole"), *(F.bit_xor(F.xxhash64(F.lit(seed), "i", "_w")).over(so_far).alias(h) for seed, h in enumerate(_PREFIX))), "prefixes")
    counts = prefixes.groupBy("_g", *_PREFIX).agg(F.count(F.lit(1)).alias("n"))
    wholes = prefixes.where("_whole").select("_g", "_id", *_PREFIX).join(counts, ["_g", *_PREFIX]).join(first.select("_id", "f"), "_id").drop("_id")
    known = join_by_weight(prefixes.select("_g", "_id", "i", *_PREFIX), wholes, ["_g", *_PREFIX], "n", prefixes.count())
    chain = known.groupBy("_g", "_id").agg(F.array_sort(F.collect_list(F.struct("i", "f"))).alias("chain"))
    # A prefix that is no key was not accepted, so what was accepted before it doesn't matter.
    state = f"struct<i: int, t: {first.schema['f'].dataType.simpleString()}>"
    step = lambda s, x: F.struct(x["i"].alias("i"), F.when(s["t"].isNull() | (x["i"] > s["i"] + 1) | (s["t"] > x["f"]), x["f"]).alias("t"))
    accepted = F.aggregate("chain", F.lit(None).cast(state), step, lambda s: s["t"])
    out = chain.select("_g", accepted.alias("t")).where("t IS NOT NULL").select(F.col("_g").alias(group), F.col("t.n").alias(name), F.col("t.c").alias(company))
    return out.orderBy(group, name) if ordered else out
