"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with a cosine of at least c are at most eps = sqrt(2 - 2c) apart, and so are their projections. Vectors are
sorted by the cells, eps wide, of their leading principal dimensions; the sorted sequence is cut into blocks, each with the box
its projections fill. Intervals of the sequence, each of ``FAN`` shorter ones, form a tree of boxes. The join starts with the whole
sequence against itself and descends, interval by interval, where the boxes are no further apart than eps; only blocks that are
left meet, and are halved again down to pieces that are compared at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, bounded_sample, components

#: Leading principal dimensions of the order and the boxes, vectors of a block, and of a piece compared at once.
DIMENSIONS, BLOCK, PIECE = 8, 2048, 256
#: Intervals that make up the next longer one, and vectors from which the principal dimensions are found; any would do for the result.
FAN, AXES_ROWS = 8, 4096


def _usable(v: Column) -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(lists: pa.Array, size: int) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _principal(vectors: DataFrame, size: int, leading: int) -> np.ndarray:
    """The leading principal directions of at most ``AXES_ROWS`` vectors."""
    rows = bounded_sample(vectors.select("node", "vector"), AXES_ROWS, F.col("node")).select("vector").collect()
    unit = _unit(pa.array([r[0] for r in rows]), size)
    return np.linalg.svd(np.vstack([unit - unit.mean(axis=0), np.eye(size)[:leading] * 1e-9]), full_matrices=False)[2][:leading].T


def _distance(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> float:
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float(gap @ gap)


def _join(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], same: bool, eps2: float, least: float, out: list[tuple[np.ndarray, np.ndarray]], at: tuple[int, int] = (0, 0)) -> None:
    """Adds the index pairs of linked vectors. a, b: unit vectors, the same in single precision, projections."""
    if _distance(a[2].min(0), a[2].max(0), b[2].min(0), b[2].max(0)) > eps2:
        return
    n, m = len(a[0]), len(b[0])
    if max(n, m) > PIECE:
        halves = lambda x, o: [(x, o)] if len(x[0]) <= PIECE else [(tuple(y[: len(y) // 2] for y in x), o), (tuple(y[len(y) // 2 :] for y in x), o + len(x[0]) // 2)]
        for i, (x, p) in enumerate(halves(a, at[0])):
            for j, (y, q) in enumerate(halves(b, at[1])):
                if not same or i <= j:
                    _join(x, y, same and i == j, eps2, least, out, (p, q))
        return
    i, j = np.nonzero(a[1] @ b[1].T >= least - 1e-4)  # single precision only proposes
    if same:
        i, j = i[i < j], j[i < j]
    sure = np.einsum("ij,ij->i", a[0][i], b[0][j]) >= least
    out.append((i[sure] + at[0], j[sure] + at[1]))


def _smallest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item it is connected with by the pairs."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def near_blocks(ws: Workspace, blocks: DataFrame, leading: int, eps2: float) -> DataFrame:
    """(left, right): the blocks, left no later than right, whose boxes are at most eps apart. ``blocks`` has block and its
    box, low0, high0, low1 and so on."""
    box = [f"{name}{i}" for i in range(leading) for name in ("low", "high")]
    tree = [blocks.select(F.col("block").alias("id"), *box)]
    n = tree[0].count()
    while n > 1:
        parent = F.floor(F.col("id") / FAN).alias("id")
        tree.append(ws.stage(tree[-1].groupBy(parent).agg(*[(F.min if c.startswith("low") else F.max)(c).alias(c) for c in box]), "boxes"))
        n = -(-n // FAN)
    pairs = tree[-1].select(F.col("id").alias("left"), F.col("id").alias("right"))
    gap = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"a.low{i}") - F.col(f"b.high{i}"), F.col(f"b.low{i}") - F.col(f"a.high{i}")), 2) for i in range(leading))
    for level in reversed(tree[:-1]):
        inside = level.withColumn("parent", F.floor(F.col("id") / FAN))
        both = pairs.join(inside.alias("a"), F.col("left") == F.col("a.parent")).join(inside.alias("b"), F.col("right") == F.col("b.parent"))
        pairs = ws.stage(both.where((F.col("a.id") <= F.col("b.id")) & (gap <= eps2)).select(F.col("a.id").alias("left"), F.col("b.id").alias("right")), "pairs")
    return pairs


def _links(ws: Workspace, vectors: DataFrame, size: int, least: float) -> DataFrame:
    """(node, other, n): from each pair of blocks and vector with links in it, the smallest vector that these connect it with, and how many rows it links to."""
    leading = min(DIMENSIONS, size)
    eps2 = 2 - 2 * least + 1e-9
    eps = eps2**0.5
    axes = _principal(vectors, size, leading)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                spot = _unit(b.column("vector"), size) @ axes
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(spot)), pa.array(list(np.floor(spot / eps).astype(np.int32)))], [*b.schema.names, "spot", "cell"])

    placed = vectors.mapInArrow(project, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema) + ", spot array<double>, cell array<int>")
    order = [F.col("cell")[i] for i in range(leading)]
    placed = placed.repartitionByRange(*order, "node").sortWithinPartitions(*order, "node").withColumn("place", F.monotonically_increasing_id())
    placed = ws.stage(placed, "ordered")
    # A vector's rank in the whole order: its place in its partition and the rows of the partitions before.
    part = F.shiftright("place", 33)
    before = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = placed.withColumn("part", part).join(before, "part").withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    box = [f(F.col("spot")[i]).alias(f"{name}{i}") for i in range(leading) for name, f in (("low", F.min), ("high", F.max))]
    block = F.floor(F.col("rank") / BLOCK).alias("block")
    blocks = ws.stage(ranked.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("rank", "node", "copies", "vector"))).alias("rows"), *box), "blocks")
    pairs = near_blocks(ws, blocks.drop("rows"), leading, eps2)
    packed = pairs.join(blocks.select(F.col("block").alias("left"), F.col("rows").alias("a")), "left")
    packed = packed.join(blocks.select(F.col("block").alias("right"), F.col("rows").alias("b")), "right").select("left", "right", "a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sides = []
                for name in ("a", "b"):
                    rows = batch.column(name)[k].values
                    unit = _unit(rows.field("vector"), size)
                    spot = unit @ axes
                    sides.append((rows.field("node").to_numpy(), rows.field("copies").to_numpy(), (unit, unit.astype(np.float32), spot)))
                same = batch.column("left")[k].as_py() == batch.column("right")[k].as_py()
                (node, copies, a), (node2, copies2, b) = sides
                found: list[tuple[np.ndarray, np.ndarray]] = []
                _join(a, b, same, eps2, least, found)
                i, j = (np.concatenate([f[s] for f in found] or [np.zeros(0, int)]).astype(int) for s in (0, 1))
                shift = 0 if same else len(node)
                if not same:
                    node, copies = np.concatenate([node, node2]), np.concatenate([copies, copies2])
                j = j + shift
                order = np.argsort(node)
                back = np.empty_like(order)
                back[order] = np.arange(len(order))
                root = _smallest(len(node), back[i], back[j])
                n = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[order[root[back[some]]]]), pa.array(n[some].astype(np.int64))], ["node", "other", "n"])

    return ws.stage(packed.mapInArrow(compare, "node long, other long, n long"), "links")


def near_duplicates(rows: DataFrame, least: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row: the other rows with a cosine of at least ``least``, and the smallest id reachable.

    Equal vectors are one node that counts its rows, so copies aren't expanded. Null, empty and zero vectors and those with null or
    non-finite components link with nothing and are their own component; vectors of different lengths don't link. Rows with a
    null id count as links and have the component of the others they reach, null if there is none.
    """
    ws = Workspace(rows.sparkSession, "gridjoin")
    kind = "array<float>" if rows.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast(kind).alias("vector"))
    usable = rows.where(_usable(F.col("vector")))
    nodes = ws.stage(usable.groupBy("vector").agg(F.min("id").alias("first"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    links = None
    for (size,) in nodes.select(F.size("vector")).distinct().collect():  # one length in all but odd tables
        part = _links(ws, nodes.where(F.size("vector") == size).select("node", "copies", "vector"), size, least)
        links = part if links is None else links.unionByName(part)
    if links is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    counted = links.groupBy("node").agg(F.sum("n").alias("n"))
    found = components(ws, links.select(F.col("node").alias("src"), F.col("other").alias("dst")))
    named = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least_id, "component").join(counted, "node", "left")
    named = ws.stage(named.select("vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "named")
    linked = usable.join(named, "vector").select("id", "n_links", "component_id")
    alone = rows.where(~_usable(F.col("vector"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"))
