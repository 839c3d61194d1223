"""Embedding near-dedup: lattice hashing, with links of cosine ``threshold`` or more verified in double precision.

A unit vector is projected at random to a few blocks of eight dimensions, and each block is decoded to
the nearest point of the E8 lattice; the points of all blocks are a cell.  Near vectors fall into one
cell or into neighbouring ones, so a vector is put into its own cell and into the cells nearest to it,
one of whose blocks is moved by a shortest lattice vector; and all that in several tables.

Equal vectors are folded into one node first.  Cells with one node go.  The nodes of a cell are compared
by one matrix product; a large cell is dealt out in tiles of slice against slice, which no task finds
large.  A pair may share several cells: it counts in the least one only, and tiles give sums for each
node and the star of each connected part, never pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.components import components
from folio.llm.word_hashes import mix
from folio.operators.joins import join_by_weight, left_join_by_weight
from folio.sources.shipping import ship_package
from folio.sources.staging import free, staged

#: Nodes of a slice of a cell; a tile compares two slices.
TILE = 1024


@dataclass(frozen=True)
class Lattice:
    """``tables`` of cells of ``blocks`` lattice points; ``scale`` lattice units are a distance of 1, ``probes`` neighbouring cells are taken too.

    With the defaults two vectors of cosine 0.98 in 64 dimensions share a cell with a chance of 0.9995,
    nearer ones more often, and unrelated vectors with one of two in a million.
    """

    tables: int = 8
    blocks: int = 2
    scale: float = 2.5
    probes: int = 3
    seed: int = 8


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or eight of +-1/2 with an even number of minus signs."""
    whole = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    half = [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(whole + half)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest whole points with an even sum: where it is odd, the coordinate that rounding moved most goes the other way."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(axis=-1)[..., None]
    turned = near.copy()
    np.put_along_axis(turned, worst, np.take_along_axis(near, worst, -1) + np.where(np.take_along_axis(off, worst, -1) >= 0, 1.0, -1.0), -1)
    return np.where((near.sum(axis=-1) % 2 != 0)[..., None], turned, near)


def nearest_lattice_points(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 (whole points with an even sum, and those moved by 1/2 everywhere) to each row of eight."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=-1) <= ((x - half) ** 2).sum(axis=-1)
    return np.where(nearer[..., None], whole, half)


@lru_cache(maxsize=8)
def _projections(lattice: Lattice, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The projection of all tables side by side, and odd factors that hash a cell's coordinates."""
    rng = np.random.default_rng([lattice.seed, dim])
    width = lattice.tables * lattice.blocks * 8
    project = rng.standard_normal((dim, width)) * (lattice.scale / np.sqrt(8))
    return project, rng.integers(0, 1 << 63, (lattice.tables, lattice.blocks * 8), np.uint64) * np.uint64(2) + np.uint64(1)


def cells_of(vectors: np.ndarray, lattice: Lattice) -> np.ndarray:
    """64-bit cells of unit vectors: a row each, its own cell and its neighbours in every table."""
    n, dim = vectors.shape
    project, factors = _projections(lattice, dim)
    near = (vectors @ project).reshape(n, lattice.tables, lattice.blocks, 8)
    points = nearest_lattice_points(near)
    steps = shortest_vectors()
    # Moving a block's point by a shortest vector costs least where the rest of the block leans most towards it.
    leaning = ((near - points) @ steps.T).reshape(n, lattice.tables, -1)
    nearest = np.argsort(-leaning, axis=-1, kind="stable")[:, :, : lattice.probes]
    doubled = np.rint(points * 2).astype(np.int64)
    out = [doubled]
    i, t = np.ogrid[:n, : lattice.tables]
    for p in range(nearest.shape[2]):
        block, step = np.divmod(nearest[:, :, p], len(steps))
        moved = doubled.copy()
        moved[i, t, block] += np.rint(steps * 2).astype(np.int64)[step]
        out.append(moved)
    coordinates = np.stack(out, axis=2).reshape(n, lattice.tables, -1, lattice.blocks * 8).astype(np.uint64)
    hashed = mix((coordinates * factors[:, None, :]).sum(axis=-1, dtype=np.uint64) + np.arange(lattice.tables, dtype=np.uint64)[:, None])
    return hashed.reshape(n, -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that no square overflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _sign(lattice: Lattice):
    """Adds ``cells`` to rows (h1, h2, label_hash, vector, copies, least): by label and length, so vectors of another share none."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                vector = part.column(3)
                sizes = np.diff(vector.offsets.to_numpy())
                values, starts = vector.flatten().to_numpy(), np.cumsum(sizes) - sizes
                labels = part.column(2).to_numpy().astype(np.uint64)
                cells = np.empty((part.num_rows, lattice.tables * (1 + lattice.probes)), np.uint64)
                for dim in np.unique(sizes):
                    own = np.flatnonzero(sizes == dim)
                    cells[own] = cells_of(unit(values[starts[own][:, None] + np.arange(dim)]), lattice)
                    cells[own] = mix(cells[own] ^ mix(labels[own] + np.uint64(dim))[:, None])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * cells.shape[1], pa.int32()), pa.array(cells.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, flat], [*part.schema.names, "cells"])

    return rows


def _runs(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The rows of each key, where equal keys (the first columns, whole numbers) follow each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in range(n_keys)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in itertools.pairwise(cuts):
            key = tuple(keys[a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy().reshape(len(values), -1)


def counted_pairs(cell: int, vectors: np.ndarray, cells: np.ndarray, labels: list, slices: np.ndarray, apart: bool, threshold: float) -> np.ndarray:
    """Which pairs of a tile are links that count in this cell: of one label, of two slices if the tile has two, and sharing no lesser cell."""
    linked = vectors @ vectors.T >= threshold
    code = np.unique(np.array(labels, dtype=object).astype(str), return_inverse=True)[1]
    linked &= code[:, None] == code
    np.fill_diagonal(linked, False)
    if apart:
        linked &= slices[:, None] != slices
    if not linked.any():
        return linked
    row, column = np.nonzero(cells < cell)
    lesser = cells[row, column]
    order = np.argsort(lesser, kind="stable")
    lesser, row = lesser[order], row[order]
    cuts = np.flatnonzero(np.diff(lesser, prepend=lesser[:1] - 1, append=lesser[-1:] + 1))
    for a, b in itertools.pairwise(cuts):
        if b - a > 1:
            linked[np.ix_(row[a:b], row[a:b])] = False
    return linked


def parts_of(linked: np.ndarray) -> np.ndarray:
    """For each row the least row that it is connected with."""
    part = np.full(len(linked), -1)
    for first in range(len(linked)):
        if part[first] >= 0:
            continue
        part[first], front = first, np.array([first])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & (part < 0))
            part[front] = first
    return part


def _compare(threshold: float):
    """Rows (cell, a, b, slice, node, label, vector, copies, cells), in order, to rows (node, links, root) of each tile."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 3):
            if run.num_rows < 2:
                continue
            sizes = np.diff(run["vector"].combine_chunks().offsets.to_numpy())
            if (sizes != sizes[0]).any():  # cells of different lengths with one hash
                tables = [run.filter(pa.array(sizes == dim)) for dim in np.unique(sizes)]
            else:
                tables = [run]
            for table in tables:
                node = table["node"].to_numpy()
                linked = counted_pairs(int(table["cell"][0].as_py()), unit(_matrix(table["vector"])), _matrix(table["cells"]), table["label"].to_pylist(), table["slice"].to_numpy(), table["a"][0] != table["b"][0], threshold)
                touched = np.flatnonzero(linked.any(axis=1))
                if len(touched):
                    links = linked[touched] @ table["copies"].to_numpy()
                    root = node[parts_of(linked)[touched]]
                    yield pa.RecordBatch.from_arrays([pa.array(node[touched]), pa.array(links.astype(np.int64)), pa.array(root)], ["node", "links", "root"])

    return rows


def _usable(vector: str):
    """Whether a vector has a direction: some component, all finite, not all zero."""
    value = F.col(vector)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(value.isNotNull() & finite & F.exists(value, lambda x: x != 0), F.lit(False))


def linked_nodes(vectors: DataFrame, lattice: Lattice, threshold: float) -> DataFrame:
    """h1, h2, copies, links, least id and component of the nodes that have a link or copies.

    ``vectors`` has id, label, vector, h1, h2, and only usable vectors.
    """
    # Folded by the hashes: one row of a node's vector is enough, and equal hashes mean equal label and vector.
    folded = vectors.groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    plain = folded.select("h1", "h2", F.xxhash64("label").alias("label_hash"), "vector", "copies", "least", "label")
    signed = plain.mapInArrow(_sign(lattice), "h1 long, h2 long, label_hash long, vector array<double>, copies long, least long, label string, cells array<long>")
    nodes = staged(signed.withColumn("node", F.monotonically_increasing_id()), "nodes")
    inside = nodes.select("node", F.explode(F.array_distinct("cells")).alias("cell"))
    shared = staged(inside.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cells")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    members = join_by_weight(inside, shared, ["cell"], "n", total)
    n_slices = F.ceil(F.col("n") / TILE).cast("int")
    dealt = members.select("cell", "node", n_slices.alias("m"), F.pmod(F.xxhash64("node"), n_slices).cast("int").alias("slice"))
    tiles = dealt.select("cell", "node", "slice", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"))
    tiles = tiles.select("cell", F.least("slice", "other").alias("a"), F.greatest("slice", "other").alias("b"), "slice", "node")
    tiles = tiles.join(nodes.select("node", "label", "vector", "copies", "cells"), "node").select("cell", "a", "b", "slice", "node", "label", "vector", "copies", "cells")
    sorted_tiles = tiles.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b", "slice")
    found = staged(sorted_tiles.mapInArrow(_compare(threshold), "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    stars = found.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).distinct()
    comp = components(stars)
    some = nodes.select("node", "h1", "h2", "copies", "least").join(links, "node", "left").join(comp, "node", "left").where("links IS NOT NULL OR copies > 1")
    some = staged(some.withColumns({"links": F.coalesce("links", F.lit(0)) + F.col("copies") - 1, "comp": F.coalesce("comp", "node")}), "linked")
    sizes = some.groupBy("comp").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("n"))
    out = staged(join_by_weight(some, sizes, ["comp"], "n", some.count()).select("h1", "h2", "copies", "links", "component"), "linked")
    free(nodes, shared, found, some)
    return out


def embedding_classes(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, lattice: Lattice = Lattice()) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links`` (other rows linked directly), ``component_id`` (the least id it can reach), ``kept`` (whether that is its own).

    Vectors link if their labels are equal and not null and their cosine is ``threshold`` or more.  Null,
    empty and zero vectors, and those with null or non-finite components, link with nothing, nor do vectors of
    different lengths.  Equal vectors of a label, repeated rows among them, always link.  A row with a null id counts as another's link and has the
    component of the others; alone it has none and is kept.  An empty table gives an empty one.
    Columns other than those named are not read, so their names don't matter.
    """
    ship_package(vectors.sparkSession)
    value = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # no negative zeros
    label = F.col(label_col).cast("string")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), value.alias("vector"))
    rows = rows.where(_usable("vector") & F.col("label").isNotNull()).select("*", F.xxhash64("label", "vector").alias("h1"), F.xxhash64(F.lit(1), "vector", "label").alias("h2"))
    linked = linked_nodes(rows, lattice, threshold)
    usable = vectors.select(F.col(id_col).alias("id"), label.alias("label"), value.alias("vector"))
    hashed = usable.select("id", *(F.when(_usable("vector") & F.col("label").isNotNull(), h).alias(n) for n, h in (("h1", F.xxhash64("label", "vector")), ("h2", F.xxhash64(F.lit(1), "vector", "label")))))
    out = left_join_by_weight(hashed, linked, ["h1", "h2"], "copies", vectors.count())
    component = F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
