"""Near-duplicate classes by DartMinHash signatures, banded joins and exact verification.

Signatures.  The weighted set of a document's word shingles is a region of the plane element x weight.
Darts fall on element x weight x rank with unit density, at places given by hashes alone.  The darts
that fall below an element's weight and below a rank bound hit the document's region; each dart has a
hashed coordinate, and a coordinate keeps its earliest (least rank) dart.  Two documents agree on a
coordinate with a probability equal to their weighted Jaccard similarity.  The bound is set so that
about k ln k + 2k darts hit; documents with an empty coordinate try again with twice the bound.

Links.  Exact copies are folded first, so a thousand copies are one node.  Nodes that share a band of
coordinates share a bucket.  A bucket of few nodes gives all its pairs.  A larger one gives the star
around its most central node.  If that leaves it in several components, a prefix filter finds its nodes
that can have a link into another component: with the elements of a set in order of their frequency,
rarest first, two sets of the wanted similarity share one among the first of each.  Those nodes are
compared in blocks of bounded size, which emit only links that join components.  So no link between
different texts is lost once the bands have met, and no group is expanded into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.arrow_rows import in_chunks
from folio.llm.components import components
from folio.llm.word_hashes import NOT_SPACE, grams, hash_words, mix
from folio.operators.joins import dealt_join, join_by_weight, left_join_by_weight
from folio.sources.shipping import ship_package
from folio.sources.staging import free, staged

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
#: Buckets of up to this many nodes give all their pairs; blocks of the larger ones have about so many nodes, and so many set elements.
SMALL_BUCKET, BLOCK, BLOCK_ELEMENTS = 12, 512, 500_000
#: Rows of a key table that may be sent to every task; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000

_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])
_U = np.uint64


def shingle_sets(texts: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word ``k``-shingles of each text as (text number, hash, count), sorted by text and hash.

    A text with fewer words has one shingle, all its words; one without words has none.
    """
    words, at = hash_words(texts, NOT_SPACE)
    n = np.diff(at)
    left = np.repeat(at[1:], n) - np.arange(len(words))
    parts = [(np.repeat(np.arange(len(texts)), n)[: len(g)][ok], g[ok]) for g in [grams(words, k)] for ok in [left[: len(g)] >= k]]
    for short in range(1, k):
        which = np.flatnonzero(n == short)
        if len(which):
            parts.append((which, mix(grams(words, short)[at[which]] + _U(short))))
    of, h = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.empty(0, np.int64)
    return of[first], h[first], np.diff(np.append(first, len(h)))


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers repeated by their counts, and the number of each repeat."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def dart_minhash(of: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (texts x k) of weighted sets, and which texts have one (those with an element)."""
    out = np.zeros((texts, k), np.uint64)
    total = np.bincount(of, weight, texts)
    bound = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    todo = total > 0
    while todo.any():
        live = todo[of]
        o, e, w = of[live], element[live], weight[live].astype(float)
        rank = np.full(texts * k, np.inf)
        hits = []
        for level in range(int(math.log2(1 + w.max())) + 1):
            base, width = 2.0**level - 1, 2.0**level
            reach = np.flatnonzero(w > base)
            rows, cell = _spread(np.ceil(bound[o[reach]] * width).astype(np.int64))
            rows = reach[rows]
            seed = mix(e[rows] ^ mix(cell.astype(_U) + _U(level << 48)))
            darts, number = _spread(np.searchsorted(_POISSON, (seed >> _U(11)) * 2.0**-53))
            h = mix(seed[darts] + (number.astype(_U) + _U(1)) * _U(0xD1B54A32D192ED03))
            rows, r = rows[darts], (cell[darts] + (h >> _U(32)) * 2.0**-32) / width
            hit = (r < bound[o[rows]]) & (base + width * ((h & _U(0xFFFFFFFF)) * 2.0**-32) < w[rows])
            h, r = h[hit], r[hit]
            at = o[rows[hit]] * k + (mix(h ^ _U(0xA5A5A5A5A5A5A5A5)) % _U(k)).astype(np.int64)
            np.minimum.at(rank, at, r)
            hits.append((at, r, h))
        for at, r, h in hits:
            first = r == rank[at]
            out.ravel()[at[first]] = h[first]
        todo &= ~np.isfinite(rank.reshape(texts, k)).all(1)
        bound = np.where(todo, 2 * bound, bound)
    return out, total > 0


def _keyed_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, str]]:
    for batch in batches:
        *keys, text = (batch.column(c) for c in range(batch.num_columns))
        for row in zip(*keys, text, strict=True):
            yield tuple(x.as_py() for x in row[:-1]), row[-1].as_py() or ""


def text_hashes(text: Column) -> tuple[Column, Column]:
    """h1 and h2, 128 bits that stand for a text; null counts as empty.  A hash of several values takes each as the seed of the next, so the seed comes first."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


def signed_rows(docs: DataFrame, *, id_col: str, text_col: str, bands: int, rows: int, shingle: int, weighted: bool) -> DataFrame:
    """id, h1, h2 (128 bits of the text's hash) and the band values of each row; a text without words has none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in in_chunks(_keyed_rows(batches), 300_000):
            of, h, count = shingle_sets([t for _, t in chunk], shingle)
            signature, some = dart_minhash(of, h, count if weighted else np.ones(len(count)), len(chunk), bands * rows)
            parts = signature.reshape(len(chunk), bands, rows)
            value = np.zeros(parts.shape[:2], np.uint64)
            for r in range(rows):
                value = mix(value ^ parts[:, :, r]) + _U(r)
            value = mix(value + np.arange(bands, dtype=np.uint64))
            ends = np.concatenate([[0], np.cumsum(some * bands)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value[some].ravel().view(np.int64)))
            keys = [pa.array([k[c] for k, _ in chunk], pa.int64()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*keys, lists], ["id", "h1", "h2", "bands"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), *text_hashes(text), text.alias("text"))
    return keyed.mapInArrow(run, "id long, h1 long, h2 long, bands array<long>")


def _sets_of(docs: DataFrame, nodes: DataFrame, *, id_col: str, text_col: str, shingle: int, weighted: bool) -> DataFrame:
    """node, ``s`` (distinct shingle hashes, sorted) for the named nodes, from the row with the least id of each text.

    With ``weighted`` a shingle that occurs c times gives c elements, one for each occurrence, so that the
    Jaccard similarity of the sets is the weighted one of the counts.
    """
    few = nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    wanted = nodes.select("node", F.col("h1").alias("n1"), F.col("h2").alias("n2"), F.col("min_id").alias("n_id"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), *text_hashes(text), text.alias("text"))
    same = (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")) & F.col("id").eqNullSafe(F.col("n_id"))
    own = keyed.join(F.broadcast(wanted) if few else wanted, same)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in in_chunks(_keyed_rows(batches), 300_000):
            of, h, count = shingle_sets([t for _, t in chunk], shingle)
            if weighted:
                rows, nth = _spread(count)
                of, h = of[rows], np.where(nth == 0, h[rows], mix(h[rows] + nth.astype(_U)))
            ends = np.searchsorted(of, np.arange(len(chunk) + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in chunk], pa.int64()), lists], ["node", "s"])

    return own.select("node", "text").mapInArrow(run, "node long, s array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The kept pairs whose sets are similar.  The set of a node with very many pairs, as a bucket's pivot has, is copied to slices of its pairs."""
    both, total = pairs, pairs.count()
    for end, other in (("a", "b"), ("b", "a")):
        uses = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("_n"))
        own = sets.select(F.col("node").alias(end), F.col("s").alias(f"s{end}")).join(uses, end)
        both = dealt_join(both, own, [end], "_n", total, other).drop("_n")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared) - 1e-9).select("a", "b")


def _small_pairs(members: DataFrame) -> DataFrame:
    """All pairs of buckets of at most ``SMALL_BUCKET`` nodes."""
    lists = members.where(F.col("n") <= SMALL_BUCKET).groupBy("bucket").agg(F.array_sort(F.collect_list("node")).alias("l")).select("l")
    pairs = F.flatten(F.transform("l", lambda a, i: F.transform(F.filter("l", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def _star_pairs(large: DataFrame) -> DataFrame:
    """Each node of a large bucket with the bucket's pivot: the node that large buckets hold most often, by their sizes."""
    score = large.groupBy("node").agg(F.sum("n").alias("score"))
    pivot = large.join(score, "node").groupBy("bucket").agg(F.max_by("node", F.struct("score", "node")).alias("pivot"), F.count(F.lit(1)).alias("m"))
    pivot = staged(pivot, "pivots")
    total = pivot.agg(F.sum("m").alias("m")).first()["m"] or 0
    return join_by_weight(large, pivot, ["bucket"], "m", total).where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))


def _linkable(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """bucket, node, comp of the members that share a prefix element with a node of another component."""
    nodes = members.select("node", "comp").distinct()
    elements = sets.join(nodes, "node").select("node", "comp", F.size("s").alias("size"), F.explode("s").alias("e"))
    often = staged(elements.groupBy("e").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "frequent_elements")
    nth = F.row_number().over(Window.partitionBy("node").orderBy("f", "e"))
    longest = F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1
    total = sets.join(nodes, "node").agg(F.coalesce(F.sum(F.size("s")), F.lit(0)).alias("n")).first()["n"]
    prefix = left_join_by_weight(elements, often, ["e"], "f", total).withColumn("f", F.coalesce("f", F.lit(1))).withColumn("nth", nth).where((F.col("nth") <= longest) & (F.col("f") > 1))
    prefix = staged(prefix.select("node", "comp", "e"), "prefixes")
    shared = staged(prefix.groupBy("e").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("e", "m"), "shared_elements")
    able = join_by_weight(prefix, shared, ["e"], "m", prefix.count()).select("node").distinct()
    out = staged(members.join(able, "node"), "linkable")
    free(prefix, shared, often)
    return out


def _block_links(large: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between different components of large buckets, found block against block among the members that can have one."""
    marked = staged(large.join(labels, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp")), "marked")
    several = staged(marked.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("bucket", "n"), "open_buckets")
    members = staged(join_by_weight(marked, several, ["bucket"], "n", marked.count()).select("bucket", "node", "comp"), "open_members")
    free(marked, several)
    if not members.limit(1).count():
        return large.sparkSession.createDataFrame([], "a long, b long")
    found = staged(_linkable(members, sets, similarity).join(sets.select("node", F.size("s").alias("size")), "node"), "linkable")
    free(members)
    # Blocks are cut by a hash within ranges of components: the main component of a bucket fills blocks of its own.
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(size / BLOCK_ELEMENTS))
    totals = lambda *by: found.groupBy(*by).agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("t"))
    by_comp, by_bucket, total = totals("bucket", "comp"), totals("bucket").select("bucket", F.col("m").alias("n"), blocks(F.col("m"), F.col("t")).alias("of_bucket")), found.count()
    own = by_comp.withColumn("of_comp", F.when(F.col("m") >= BLOCK // 4, blocks(F.col("m"), F.col("t")))).select("bucket", "comp", "m", "of_comp")
    sized = join_by_weight(join_by_weight(found, by_bucket, ["bucket"], "n", total), own, ["bucket", "comp"], "m", total)
    cut = F.when(F.col("of_comp").isNotNull(), F.xxhash64("comp", F.pmod(F.xxhash64("node"), F.col("of_comp")))).otherwise(F.pmod(F.xxhash64("comp"), F.col("of_bucket")))
    placed = staged(sized.select("bucket", "node", "comp", cut.alias("block")), "blocks")
    ranges = placed.groupBy("bucket", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    other = ranges.select("bucket", F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    tasks = ranges.join(other, "bucket").where("block <= block2 AND NOT (lo = hi AND lo2 = hi2 AND lo = lo2)").select("bucket", F.col("block").alias("b1"), F.col("block2").alias("b2"))
    sides = tasks.select("bucket", "b1", "b2", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("block"))
    rows = sides.join(placed, ["bucket", "block"]).join(sets, "node").select("bucket", "b1", "b2", "node", "comp", "s")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node")
        size = group["s"].map(len).to_numpy()
        flat = np.concatenate(group["s"].to_list()) if len(group) else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(group)), size)
        _, term, df = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(df > 1)
        column = np.full(len(df), -1)
        column[shared] = np.arange(len(shared))
        term = column[term]
        inter = np.zeros((len(group), len(group)), np.float32)
        for lo in range(0, len(shared), 4096):
            use = (term >= lo) & (term < lo + 4096)
            x = np.zeros((len(group), 4096), np.float32)
            x[owner[use], term[use] - lo] = 1
            inter += x @ x.T
        near = inter >= similarity * (size[:, None] + size[None, :] - inter) - 1e-6
        comp = group["comp"].to_numpy()
        label = np.unique(comp, return_inverse=True)[1]
        found = []
        for i in range(len(group)):
            for j in np.flatnonzero(near[i] & (label != label[i])):
                if label[j] != label[i]:
                    found.append((group["node"].iat[i], group["node"].iat[j]))
                    label[label == label[j]] = label[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("bucket", "b1", "b2").applyInPandas(compare, "a long, b long")


def near_duplicate_classes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, weighted: bool = False, with_hashes: bool = False
) -> DataFrame:
    """One row per row of ``docs``: id, ``class_id`` (least id of its class), ``class_rows``, ``keep`` (this row stands for the class).

    Documents are linked when the Jaccard similarity of their sets of ``shingle``-word shingles (words
    are runs of non-space; case counts) is at least ``similarity``; classes are connected components.
    With ``weighted`` shingles count as often as they occur, in the signatures and in the check: the
    similarity is the sum of the lesser counts over the sum of the greater ones.
    A null text is the empty text.  Texts without words are copies only of equal texts; texts of fewer
    words than a shingle are compared as one shingle.  Rows with a null id take part; if a whole class
    has none, its ``class_id`` is null.  Of repeated rows exactly one per class has ``keep``.  An empty
    table gives no rows; only the two named columns are read.  A very long text is hashed piece by piece; its set
    of shingles is held whole where it is compared.  ``with_hashes`` adds ``h1`` and ``h2`` of
    :func:`text_hashes`, which with the id name a row as far as its repeats.
    """
    ship_package(docs.sparkSession)
    signed = staged(signed_rows(docs, id_col=id_col, text_col=text_col, bands=bands, rows=rows, shingle=shingle, weighted=weighted).withColumn("row", F.monotonically_increasing_id()), "signed")
    classes = staged(signed.groupBy("h1", "h2").agg(F.min("id").alias("min_id"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n_rows")).withColumn("node", F.monotonically_increasing_id()), "classes")
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    several = staged(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared_buckets")
    in_several = several.agg(F.sum("n").alias("n")).first()["n"] or 0
    members = staged(join_by_weight(buckets, several, ["bucket"], "n", in_several), "members")
    free(several)
    large = members.where(F.col("n") > SMALL_BUCKET)
    pairs = staged(_small_pairs(members).union(_star_pairs(large)).distinct(), "pairs")
    wanted = staged(members.select("node").distinct().join(classes.select("node", "h1", "h2", "min_id"), "node"), "wanted")
    sets = staged(_sets_of(docs, wanted, id_col=id_col, text_col=text_col, shingle=shingle, weighted=weighted), "sets")
    links = staged(_verified(pairs, sets, similarity), "links")
    free(pairs, wanted)
    labels = components(links)
    more = staged(_block_links(large, labels, sets, similarity), "block_links")
    if more.limit(1).count():
        labels = components(links.union(more))
    free(members, sets, links, more)
    return _stands(signed, classes, labels, id_col, with_hashes)


def _stands(signed: DataFrame, classes: DataFrame, labels: DataFrame, id_col: str, with_hashes: bool) -> DataFrame:
    """The class of every row.  A text with very many copies, and a class of very many texts, are no burden to one task."""
    nodes = classes.select("node", "h1", "h2", "min_id", "n_rows").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    nodes = staged(nodes, "node_classes")
    n_nodes, n_rows = nodes.count(), signed.count()
    least = nodes.groupBy("comp").agg(F.min("min_id").alias("class_id"), F.sum("n_rows").alias("class_rows"), F.count(F.lit(1)).alias("m"))
    known = staged(join_by_weight(nodes, least, ["comp"], "m", n_nodes).select("h1", "h2", "comp", "class_id", "class_rows", "n_rows"), "texts")
    placed = staged(join_by_weight(signed.select("row", "id", "h1", "h2"), known, ["h1", "h2"], "n_rows", n_rows), "placed")
    heads = placed.groupBy("comp").agg(F.min_by("row", F.struct(F.col("id").isNull(), "id", "row")).alias("head"), F.count(F.lit(1)).alias("m"))
    out = join_by_weight(placed, heads, ["comp"], "m", n_rows)
    free(nodes, known)
    return out.select(F.col("id").alias(id_col), "class_id", "class_rows", (F.col("row") == F.col("head")).alias("keep"), *(["h1", "h2"] if with_hashes else []))
