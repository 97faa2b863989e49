"""Near-duplicate embeddings by int8 tile products with rigorous error bounds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.cluster import scratch, shipped, written
from trailweave.operators.components import connected_components

THRESHOLD, TILE = 0.98, 1024
#: Vectors that others are brought together by, and how far from its first a cluster's may lie.
PIVOTS, REACH = 256, 0.7


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scales, and for each row the norm of what rounding changed."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> np.ndarray:
    """Index pairs (i, j) of rows of x and y with cosine >= threshold; i < j if x is y.

    For unit vectors a = a' + e and b = b' + f: |<a,b> - <a',b'>| <= |e| + |f| + |e||f|, as
    |b'| <= 1 + |f|. Only pairs that this leaves open are computed in double precision.
    """
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    (qx, sx, ex), (qy, sy, ey) = quantised(x / nx[:, None]), quantised(y / ny[:, None])
    exact = np.float32 if x.shape[1] * 127 * 127 < 2**24 else np.float64  # sums of products stay whole numbers
    found = [np.empty((0, 2), np.int64)]
    for at in range(0, len(x), 512):
        rows = slice(at, at + 512)
        product = (qx[rows].astype(exact) @ qy.T.astype(exact)).astype(np.float64) * sx[rows, None] * sy[None, :]
        upper = product + ex[rows, None] + ey[None, :] + ex[rows, None] * ey[None, :] + 1e-9
        i, j = np.nonzero(upper >= threshold)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        cosine = np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j])
        found.append(np.stack([i, j], axis=1)[cosine >= threshold])
    return np.concatenate(found)


def _local_roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least place that it reaches by ``pairs``."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(low, pairs[:, 1], root[pairs[:, 0]])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _rows(batch, name: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column in a row, and where each list starts."""
    x = batch.column(name)
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    sizes = pa.compute.list_value_length(x).to_numpy()
    return x.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to 1/2 or more and under 1: no product overflows, none is rounded."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def _units(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def in_cells(vectors: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """``node, n, label, dim, cell, embedding``: each vector, ``scaled``, with the nearest of a few vectors of its length.

    These are one in eight, at most ``pivots``, the first by a hash over the whole table. Cells only bring
    vectors together that may be close; nothing depends on how well they do.
    """
    some = vectors.orderBy(F.xxhash64("node"), "node").limit(max(1, min(pivots, vectors.count() // 8))).select("embedding").toArrow()
    by_dim: dict[int, list] = {}
    for x in some.column("embedding").to_pylist():
        by_dim.setdefault(len(x), []).append(x)
    held = vectors.sparkSession.sparkContext.broadcast({d: _units(scaled(np.array(x, float))) for d, x in by_dim.items()})

    def placed(batches):
        for batch in batches:
            flat, start = _rows(batch)
            sizes, cell, out = np.diff(start), np.full(batch.num_rows, -1, np.int64), flat.astype(np.float64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                index = start[at][:, None] + np.arange(dim)
                v = scaled(out[index])
                out[index] = v
                if int(dim) in held.value:
                    cell[at] = (v @ held.value[int(dim)].T).argmax(axis=1)
            embedding = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), batch.column("label"), pa.array(sizes.astype(np.int64)), pa.array(cell), embedding], names=["node", "n", "label", "dim", "cell", "embedding"])

    return vectors.select("node", "n", "label", "embedding").mapInArrow(placed, "node binary, n bigint, label string, dim bigint, cell bigint, embedding array<double>")


def clusters(unit: np.ndarray, tile: int, reach: float = REACH, least: int = 2, misses: int = 64) -> list[np.ndarray]:
    """Rows of unit vectors in tiles of at most ``tile``.

    A vector and all that are left within ``reach`` of it are a cluster, if there are ``least``;
    after ``misses`` vectors without one, and for those, tiles take what is left as it comes.
    """
    near, left, rest, out = 1 - reach * reach / 2, np.arange(len(unit)), [], []
    single = unit.astype(np.float32)
    while len(left) and len(rest) < misses:
        close = single[left] @ single[left[0]] >= near
        close[0] = True
        if close.sum() >= least:
            out.append(left[close])
            left = left[~close]
        else:
            rest.append(left[0])
            left = left[1:]
    out.append(np.concatenate([np.array(rest, np.int64), left]))
    return [x[k : k + tile] for x in out for k in range(0, len(x), tile)]


def tiles(vectors: DataFrame, tile: int = TILE, pivots: int = PIVOTS) -> DataFrame:
    """``tile, label, dim, node, n, embedding, size, centre, radius``; the last three in one row of each tile.

    Cells of a label are folded until they hold about a tile. Vectors of one label, length and
    cell go in chunks of about four tiles, so no group is larger; each chunk is cut into ``clusters``. All vectors of a tile lie within radius of its centre.
    """
    shipped(vectors.sparkSession)
    rows = written(in_cells(vectors, pivots), "cells")
    key = ["label", "dim", "cell"]
    folds = rows.groupBy("label", "dim").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / tile)).alias("folds"))
    rows = rows.join(folds, ["label", "dim"]).withColumn("cell", F.pmod("cell", "folds")).drop("folds")
    chunks = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / (4 * tile)).cast("long").alias("chunks"))
    dealt = rows.join(chunks, key).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))).drop("chunks")

    def cut(table: pa.Table) -> pa.Table:
        flat, _ = _rows(table)
        v = flat.reshape(table.num_rows, -1)
        unit = _units(v)
        own, name = clusters(unit, tile), "|".join(str(table.column(c)[0].as_py()) for c in ("dim", "cell", "chunk"))
        order = np.concatenate(own)
        first = np.cumsum([0, *map(len, own)])[:-1]
        names, sizes, centres, radii = [], [None] * len(order), [None] * len(order), [None] * len(order)
        for k, x in enumerate(own):
            names += [f"{name}|{k}"] * len(x)
            centre = unit[x].mean(axis=0)
            sizes[first[k]], centres[first[k]] = len(x), centre.tolist()
            radii[first[k]] = float(np.linalg.norm(unit[x] - centre, axis=1).max()) + 1e-9
        rows = table.take(pa.array(order))
        return pa.table({"tile": pa.array(names), **{c: rows.column(c) for c in ("label", "dim", "node", "n", "embedding")}, "size": pa.array(sizes, pa.int64()), "centre": pa.array(centres, pa.list_(pa.float64())), "radius": pa.array(radii, pa.float64())})

    schema = "tile string, label string, dim bigint, node binary, n bigint, embedding array<double>, size bigint, centre array<double>, radius double"
    return dealt.groupBy(*key, "chunk").applyInArrow(cut, schema)


def _paired(rows: DataFrame, blocks: DataFrame, key: list[str]) -> DataFrame:
    """``unit, same, side`` and the columns of ``rows`` (key, block, more): each pair of ``blocks`` (key, blocks: their number) is one unit."""
    units = (
        blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"))
        .select("*", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)).alias("j"))
        .select(*key, "i", "j", (F.col("i") == F.col("j")).alias("same"))
    )
    unit = F.struct(*key, "i", "j").alias("unit")
    first = units.select(*key, unit, "same", F.lit(0).alias("side"), F.col("i").alias("block"))
    second = units.where("not same").select(*key, unit, "same", F.lit(1).alias("side"), F.col("j").alias("block"))
    return rows.join(first.unionByName(second), [*key, "block"])


def near_tiles(tiled: DataFrame, threshold: float = THRESHOLD, block: int = 1024) -> DataFrame:
    """``label, a, b`` (a <= b): tiles of one label and length that may hold linked vectors.

    Vectors link within w = sqrt(2 - 2 threshold) of each other, so tiles link only if their
    centres are at most w and both radii apart. Centres are held against each other in blocks.
    """
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    heads = tiled.where("size is not null").select("label", "dim", "tile", "centre", "radius")
    blocks = heads.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    dealt = heads.join(blocks, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("tile"), F.col("blocks"))).drop("blocks")

    def near(table: pa.Table) -> pa.Table:
        flat, _ = _rows(table, "centre")
        c, r = flat.reshape(table.num_rows, -1), table.column("radius").to_numpy()
        side = table.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 0 if table.column("same")[0].as_py() else side == 1)
        square = (c * c).sum(axis=1)
        apart = np.sqrt(np.maximum(0.0, square[left][:, None] + square[right][None, :] - 2 * c[left] @ c[right].T))
        i, j = np.nonzero(apart <= r[left][:, None] + r[right][None, :] + width)
        x, y = left[i], right[j]
        names = np.array(table.column("tile").to_pylist(), object)
        stay = (names[x] <= names[y]) if table.column("same")[0].as_py() else np.ones(len(x), bool)
        a, b = np.minimum(names[x], names[y]) if len(x) else names[x], np.maximum(names[x], names[y]) if len(x) else names[y]
        return pa.table({"label": pa.array([table.column("label")[0].as_py()] * int(stay.sum()), pa.string()), "a": pa.array(a[stay], pa.string()), "b": pa.array(b[stay], pa.string())})

    return _paired(dealt, blocks, ["label", "dim"]).groupBy("unit").applyInArrow(near, "label string, a string, b string")


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``a, b, others``: what nodes of one label with cosine >= threshold come to.

    ``vectors``: node, label (string), embedding (array<double>, finite, not zero), n (rows that
    the node stands for). Each pair of ``near_tiles`` is one unit of work with bounded memory, so
    a cluster of any size spreads over many tasks, and tiles far apart never meet. A unit finds
    every link but returns one row for each linked node a: the sum of n of its partners there, and
    the first node b that it reaches there. The sums over units are the degrees, and the edges
    a, b connect what the links connect.
    """
    tiled = written(tiles(vectors, tile), "tiles")
    pairs = written(near_tiles(tiled, threshold), "pairs")
    unit = F.struct("label", "a", "b").alias("unit")
    first = pairs.select(unit, (F.col("a") == F.col("b")).alias("same"), "label", F.col("a").alias("tile"), F.lit(0).alias("side"))
    second = pairs.where("a <> b").select(unit, F.lit(False).alias("same"), "label", F.col("b").alias("tile"), F.lit(1).alias("side"))
    work = tiled.select("label", "tile", "node", "n", "embedding").join(first.unionByName(second), ["label", "tile"]).select("unit", "same", "side", "node", "n", "embedding")

    def linked(table: pa.Table) -> pa.Table:
        flat, _ = _rows(table)
        v = flat.reshape(table.num_rows, -1)
        side, node, n = table.column("side").to_numpy(), table.column("node"), table.column("n").to_numpy()
        same = table.column("same")[0].as_py()
        a = np.flatnonzero(side == 0)
        b = a if same else np.flatnonzero(side == 1)
        found = tile_links(v[a], v[b], threshold, same) if len(a) and len(b) else np.empty((0, 2), np.int64)
        found = np.stack([a[found[:, 0]], b[found[:, 1]]], axis=1)
        others = np.zeros(len(n), np.int64)
        np.add.at(others, found[:, 0], n[found[:, 1]])
        np.add.at(others, found[:, 1], n[found[:, 0]])
        some = np.flatnonzero(others)
        return pa.table({"a": node.take(pa.array(some)), "b": node.take(pa.array(_local_roots(len(n), found)[some])), "others": pa.array(others[some])})

    return work.groupBy("unit").applyInArrow(linked, "a binary, b binary, others bigint")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Vectors link within an equal, not null label at cosine >= threshold. A vector that is null,
    empty, zero or has a null or non-finite component, or whose label is null, links with
    nothing; vectors of different lengths don't link; components may have any finite size. Equal
    vectors of a label are one node with a count, so copies cost no pairs. n_links counts rows
    other than the row itself. A repeated row is another vector. component_id is the smallest
    vec_id reachable. An empty table gives no rows; other columns are left out.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("embedding"),
    )
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole & F.exists("embedding", lambda x: x != 0)
    digest = F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), "label", "embedding")), 16, "0") for k in (0, 1)]))
    rows = rows.withColumn("node", F.when(F.coalesce(sound, F.lit(False)), digest))
    with scratch() as keep:
        classes = rows.where("node is not null").groupBy("label", "embedding").agg(F.first("node").alias("node"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
        nodes = written(classes, "vectors")
        pairs = written(embedding_links(nodes, threshold, tile), "links")
        degree = pairs.groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("others"))
        found = connected_components(pairs.select("a", "b")).withColumnRenamed("component", "root")
        of = nodes.select("node", "least", "n").join(degree, "node", "left").join(found, "node", "left")
        of = keep(written(of.select("node", "least", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")), "members"))
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = of.join(named, "root").select("node", "n_links", "component_id")
    out = rows.select("vec_id", "node").join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
