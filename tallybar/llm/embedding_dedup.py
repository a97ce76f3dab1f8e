"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors are folded first: one node stands for all rows with the same components, with their number.
Nodes are dealt into large blocks, each packed into rows of ``PACK`` nodes, and every pair of blocks is a tile: a
block goes to as many tiles as there are blocks, so the larger the blocks, the less is shuffled. In a tile the
unit vectors' int8 codes q (u = s q + e, s the vector's own scale) are multiplied; as |e| is known,
s_i s_j q_i.q_j differs from the cosine by at most |e_i| + |e_j| + |e_i||e_j|. Pairs below the threshold even
with that much added are dropped, pairs above it with that much taken off are linked, and only the rest is
computed again in double precision. A tile never emits its pairs: it adds up each node's links and reduces
them to a spanning forest, from which components follow.

The work is quadratic in the number of different vectors, as an exact threshold search without a usable
index is in 64 dimensions; tiles bound the memory and spread it over tasks of equal size.

Defined results: a row without an id links with nothing; a vector that is null, empty, zero, or holds a null or non-finite component links with
nothing and is its own component; vectors of different lengths never link; equal vectors link; rows that
share a vec_id are one node, with the links of all its vectors; an empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .components import connected_components
from .workspace import Workspace

#: Nodes a block on average, the fewest that a block is made of, nodes a packed row, and the side of the products inside a tile.
BLOCK, LEAST, PACK, SIDE = 40_000, 2_000, 10_000, 1_000


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error norms of unit vectors (rows); the norms are rounded up."""
    scale = np.abs(vectors).max(axis=1) / 127.0
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(vectors - codes * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return codes, scale, error


def linked(a, b, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of two coded blocks with cosine >= threshold.

    a, b: (unit vectors, codes, scales, errors).
    """
    kind = np.float32 if a[1].shape[1] * 127 * 127 < 1 << 24 else np.float64  # integers stay exact
    near = (a[1].astype(kind) @ b[1].astype(kind).T).astype(np.float64)
    near *= a[2][:, None]
    near *= b[2][None, :]
    slack = a[3][:, None] + b[3][None, :] + a[3][:, None] * b[3][None, :] + 1e-9
    out = near - slack >= threshold
    r, c = np.nonzero((near + slack >= threshold) & ~out)
    for k in range(0, len(r), 1 << 16):
        rr, cc = r[k : k + (1 << 16)], c[k : k + (1 << 16)]
        out[rr, cc] = np.einsum("ij,ij->i", a[0][rr], b[0][cc]) >= threshold
    return out


def forest(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest node that each row's and each column's node reaches inside the mask."""
    r, c = np.nonzero(mask)
    by_c = np.argsort(c, kind="stable")
    rows, r_at = np.unique(r, return_index=True)
    cols, c_at = np.unique(c[by_c], return_index=True)
    top, side = left.copy(), right.copy()
    while True:
        new_top = top.copy()
        new_top[rows] = np.minimum(top[rows], np.minimum.reduceat(side[c], r_at))
        new_side = side.copy()
        new_side[cols] = np.minimum(side[cols], np.minimum.reduceat(new_top[r[by_c]], c_at))
        if (new_top == top).all() and (new_side == side).all():
            return top, side
        top, side = new_top, new_side


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector's components as bytes, null where it can link with nothing."""
    for batch in batches:
        vectors = batch.column("embedding")
        size = vectors.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        flat = vectors.flatten()
        x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # a null is NaN, and -0.0 becomes 0.0
        cut = np.append(0, np.cumsum(size))
        bad, some = (np.append(0, np.cumsum(f))[cut] for f in (~np.isfinite(x), x != 0))
        usable = (np.diff(bad) == 0) & (np.diff(some) > 0)
        keys = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((cut * 8).astype(np.int32)), pa.py_buffer(x)])
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pc.if_else(pa.array(usable), keys, pa.scalar(None, pa.binary()))], ["vec_id", "key"])


_PACKED = "part bigint, dims int, blocks int, block int, nums binary, nodes binary, sizes binary, vectors binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of at most about ``PACK`` nodes of one block, from rows sorted by block: node numbers and ids, numbers of rows, vectors."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
    block, held, n = None, [], 0

    def row():
        body = [b"".join(parts) for parts in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip(block, kinds, strict=True)), *(pa.array([x], pa.binary()) for x in body)], [f.split()[0] for f in _PACKED.split(", ")])

    for batch in batches:
        where = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
        numbers = [batch.column(i).to_numpy() for i in (4, 5, 6)]
        data, cut = tb.byte_column(batch.column(7))
        ends = np.append(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1, len(where)).tolist() if len(where) else []
        lo = 0
        for hi in ends:
            at = tuple(where[lo].tolist())
            if held and (at != block or n >= PACK):
                yield row()
                held, n = [], 0
            block = at
            held.append((*(x[lo:hi].tobytes() for x in numbers), data[cut[lo] : cut[hi]].tobytes()))
            n, lo = n + hi - lo, hi
    if held:
        yield row()


def _tiles(threshold: float):
    def unpacked(row):
        nums, nodes, sizes = (np.frombuffer(x, np.int64) for x in row[:3])
        x = np.frombuffer(row[3], np.float64).reshape(len(nodes), -1)
        x = x / np.abs(x).max(axis=1)[:, None]  # no overflow in the norm
        x = x / np.linalg.norm(x, axis=1)[:, None]
        return nodes, sizes, (x, *quantise(x)), nums

    def compared(a, b):
        for i in range(0, len(a[0]), SIDE):
            for j in range(i if a is b else 0, len(b[0]), SIDE):
                ri, rj = slice(i, i + SIDE), slice(j, j + SIDE)
                mask = linked([x[ri] for x in a[2]], [x[rj] for x in b[2]], threshold)
                own = a is b and i == j
                if own:
                    np.fill_diagonal(mask, False)
                if not mask.any():
                    continue
                up, down = mask @ b[1][rj], mask.T @ a[1][ri]
                top, side = forest(mask, a[0][ri], b[0][rj])
                for nums, nodes, links, low in ((a[3][ri], a[0][ri], up, top), (b[3][rj], b[0][rj], down, side))[: 1 if own else 2]:
                    at = np.flatnonzero(links)
                    yield pa.RecordBatch.from_arrays([pa.array(x[at], pa.int64()) for x in (nums, nodes, low, links)], ["num", "u", "v", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a tile's rows come with the smaller block's first; those stay, and each later row meets them once
        tile, left = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                part = unpacked(row[5:])
                if row[:4] != tile:
                    tile, left = row[:4], []
                own, first = row[2] == row[3], row[4] == row[2]
                for other in left if own or not first else ():
                    yield from compared(other, part)
                if own:
                    yield from compared(part, part)
                if first:
                    left.append(part)

    return run


def _compared(nodes: DataFrame, n_tiles: int | None, ws: Workspace, name: str, threshold: float) -> DataFrame:
    """num, u, v, links: each node's links in a tile, and an edge to the smallest node it reaches there.

    nodes: part, blocks (how many its part is cut into), num, node, size, key. Only nodes of one part are compared.
    n_tiles: how many tiles there are at most, if known.
    """
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")
    dealt = nodes.select("part", (F.length("key") / 8).cast("int").alias("dims"), "blocks", block, "num", "node", "size", "key")
    blocks = dealt.repartition("part", "dims", "block").sortWithinPartitions("part", "dims", "block")
    blocks = ws.save(blocks.mapInArrow(_pack, _PACKED), f"{name}-blocks")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = blocks.select("part", "dims", "block", "nums", "nodes", "sizes", "vectors", others)
    tiles = tiles.select("part", "dims", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "nums", "nodes", "sizes", "vectors")
    most = 4 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = tiles.repartition(max(1, min(n_tiles or most, most)), "part", "dims", "i", "j").sortWithinPartitions("part", "dims", "i", "j", "block")
    return ws.save(tiles.mapInArrow(_tiles(threshold), "num bigint, u bigint, v bigint, links bigint"), f"{name}-found")


def link_embeddings(vectors: DataFrame, ws: Workspace, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    n_links counts the pairs of a row with this id and a linked row with another id.
    """
    keyed = ws.save(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(_keys, "vec_id bigint, key binary"), "keyed")
    usable = keyed.where("key is not null and vec_id is not null")
    nodes = usable.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("size"))
    nodes = ws.save(nodes.withColumn("num", F.monotonically_increasing_id()), "nodes")
    count = nodes.count()
    # large blocks are copied less often; on few nodes there are more, so that all cores have a tile
    wide = math.ceil(math.sqrt(2 * vectors.sparkSession.sparkContext.defaultParallelism))
    n_blocks = max(1, math.ceil(count / BLOCK), min(wide, math.ceil(count / LEAST)))
    whole = nodes.select(F.lit(0).cast("bigint").alias("part"), F.lit(n_blocks).alias("blocks"), "num", "node", "size", "key")
    found = _compared(whole, n_blocks * (n_blocks + 1) // 2, ws, "all", threshold)
    links = found.groupBy("num").agg(F.sum("links").alias("links"))
    repeated = ws.save(keyed.where("vec_id is not null").groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated")
    once = repeated.isEmpty()
    edges = found.select("u", "v")
    if not once:
        # an id's own edges join its vectors
        mine = usable.join(repeated, "vec_id").groupBy("vec_id", "key").agg(F.count("*").alias("size"))
        mine = ws.save(mine.withColumn("num", F.monotonically_increasing_id()), "mine")
        edges = edges.unionByName(mine.join(nodes.select("key", "node"), "key").select(F.col("vec_id").alias("u"), F.col("node").alias("v")))
    parts = connected_components(edges, ws)
    ws.drop("all-blocks")
    node = nodes.join(links, "num", "left").join(parts, "node", "left")
    node = ws.save(node.select("key", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")), "labelled")
    out = keyed.withColumn("key", F.when(F.col("vec_id").isNotNull(), F.col("key"))).join(node, "key", "left")
    component = F.coalesce("component", "vec_id")
    out = out.select("vec_id", F.coalesce(F.col("links") + F.col("size") - 1, F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"))
    if not once:
        # what an id's rows link to, less the links among them
        cut = mine.groupBy("vec_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        own = mine.join(cut, "vec_id").select(F.col("vec_id").alias("part"), "blocks", "num", F.col("vec_id").alias("node"), "size", "key")
        own = _compared(own, None, ws, "own", threshold).groupBy("num").agg(F.sum("links").alias("links"))
        size = F.col("size")
        own = mine.join(own, "num", "left").groupBy("vec_id").agg(F.sum(size * (size - 1 + F.coalesce("links", F.lit(0)))).alias("within"))
        sums = out.join(repeated, "vec_id").groupBy("vec_id").agg(F.sum("n_links").alias("all"), F.min("component_id").alias("low"))
        sums = ws.save(sums.join(own, "vec_id", "left").select("vec_id", (F.col("all") - F.coalesce("within", F.lit(0))).alias("sum"), "low"), "sums")
        out = out.join(sums, "vec_id", "left").select("vec_id", F.coalesce("sum", "n_links").alias("n_links"), F.coalesce("low", "component_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))
