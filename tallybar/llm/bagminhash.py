"""MinHash near-dedup of word-shingle multisets by BagMinHash signatures.

A text is the multiset of its five-word shingles (a shorter text with words is one shingle). A shingle of
weight w owns the levels 1..w, cut into the dyadic intervals (0,1], (1,2], (2,4], (4,8], ... Each interval
of each shingle has a Poisson process of its own, with the interval's length as rate, whose points carry a
level and a signature place; a point counts if its level is at most w. A signature place keeps the
earliest point that counts, so two texts agree on a place with exactly the weighted Jaccard probability
sum(min) / sum(max), and weight w costs log(w) processes. The processes are followed only up to a time by
which all places are expected to be filled; a text with an empty place is followed to twice the time.

Equal texts are folded first, by a 128-bit cryptographic hash of their words. ``BANDS`` bands of ``ROWS`` places find candidates, which exact multiset overlap
verifies. In each bucket of equal bands every text is first compared with the bucket's smallest document,
never with all others. Buckets that then still hold several components are compared whole, in tiles: the
bucket is cut into blocks of ``BLOCK`` shingles and ``TEXTS`` texts at most, a task gets two blocks, counts the common shingles of all
pairs of different components by matrix products, and hands on a spanning forest of the links. Of buckets with
the same members only one is compared. So no link that the bands offer is lost, and no list of all pairs is
ever made.

Defined results: a row without an id is a class of its own; words are runs of non-space bytes, compared as they
are; a null or wordless text is a class of its own; texts with the same words in the same order are one class; a
document id on several rows is one node; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textblocks as tb
from .components import connected_components
from .workspace import Workspace

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8**5)**24 = 7e-5.
BANDS, ROWS = 24, 5
PLACES = BANDS * ROWS
#: Points expected per text before the first look for empty places; about 2 % of texts need another.
POINTS = PLACES * (np.log(PLACES) + 4)
#: Shingles and texts in a block of a bucket (a task holds a matrix of two blocks' texts; as many texts are signed at once), tokens
#: that one product takes, and pairs up to which sorted lists are merged instead.
BLOCK, TEXTS, CHUNK, FEW = 1 << 18, 1 << 10, 1 << 12, 32
_U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their rows."""
    n = len(offsets) - 1
    starts, ends, rows = tb.tokens(data, offsets, tb.word_table("space"))
    words = tb.token_hashes(data, starts, ends)
    base = np.searchsorted(rows, np.arange(n + 1))
    prefix = tb.prefix_hash(words)
    first = np.arange(len(words))
    last = first + SHINGLE <= base[rows + 1]
    whole = (first == base[rows]) & (base[rows + 1] - base[rows] < SHINGLE)
    at = np.flatnonzero(last | whole)
    end = np.minimum(at + SHINGLE, base[rows[at] + 1])
    return tb.span_hash(prefix, at, end), rows[at]


def text_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The two halves of a hash of each text's words in order: n x 2."""
    text, at = data.tobytes(), offsets.tolist()
    digests = b"".join(hashlib.blake2b(b" ".join(text[a:b].split()), digest_size=16).digest() for a, b in zip(at, at[1:], strict=False))
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def processes(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seed, row, rate, lowest level and weight of the Poisson process of every dyadic interval in use."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    head = np.ones(len(h), dtype=bool)
    head[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(head)
    weight = np.diff(np.append(at, len(h)))
    h, r = h[at], r[at]
    seeds, owners, rates, lows, weights = [h], [r], [np.ones(len(h))], [np.zeros(len(h), np.int64)], [weight]
    low = 1
    while len(more := np.flatnonzero(weight > low)):
        seeds.append(tb.mix(h[more] ^ (_U(low * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))))
        owners.append(r[more])
        rates.append(np.full(len(more), float(low)))
        lows.append(np.full(len(more), low))
        weights.append(weight[more])
        low *= 2
    return tuple(np.concatenate(x) for x in (seeds, owners, rates, lows, weights))


def signatures(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """n x PLACES point ids; rows without shingles keep zeros."""
    seed, owner, rate, low, weight = processes(hashes, rows)
    total = np.bincount(rows, minlength=n).astype(float)
    time = np.divide(POINTS, total, out=np.zeros(n), where=total > 0)
    best = np.full(n * PLACES, np.inf)
    out = np.zeros(n * PLACES, dtype=np.uint64)
    todo = np.flatnonzero(total > 0)
    live = np.ones(len(seed), dtype=bool)
    while len(todo):
        best.reshape(n, PLACES)[todo] = np.inf
        points = [[], [], []]
        few = time[owner] * rate <= 24
        for pick, many in ((np.flatnonzero(live & few), False), (np.flatnonzero(live & ~few), True)):
            for lo in range(0, len(pick), 1 << 14 if many else 1 << 18):
                _points(points, pick[lo : lo + (1 << 14 if many else 1 << 18)], seed, owner, rate, low, weight, time, many)
        if points[0]:
            place, x, ids = (np.concatenate(p) for p in points)
            np.minimum.at(best, place, x)
            won = x == best[place]
            out[place[won]] = ids[won]
        empty = np.isinf(best.reshape(n, PLACES)[todo]).any(axis=1)
        todo = todo[empty]
        time[todo] *= 2
        again = np.zeros(n, dtype=bool)
        again[todo] = True
        live = again[owner]
    return out.reshape(n, PLACES)


def _points(points, at, seed, owner, rate, low, weight, time, many) -> None:
    """Append place, time and id of the points of processes ``at`` up to their texts' time."""
    if many:
        expect = time[owner[at]] * rate[at]
        size = np.ceil(expect + 8 * np.sqrt(expect) + 16).astype(np.int64)
        first = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(first, size)
        ids = tb.mix(np.repeat(seed[at], size) + (step + 1).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        gap = -np.log(((ids >> _U(11)).astype(float) + 0.5) / 9007199254740992.0) / np.repeat(rate[at], size)
        x = np.cumsum(gap)
        x -= np.repeat(x[first] - gap[first], size)
        src = np.repeat(at, size)
        ok = x <= time[owner[src]]
        _keep(points, src[ok], x[ok], ids[ok], owner, low, weight, rate)
        return
    x = np.zeros(len(at))
    limit, step = time[owner[at]], 0
    while len(at):
        step += 1
        ids = tb.mix(seed[at] + _U(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        x = x - np.log(((ids >> _U(11)).astype(float) + 0.5) / 9007199254740992.0) / rate[at]
        ok = x <= limit
        at, x, limit = at[ok], x[ok], limit[ok]
        _keep(points, at, x, ids[ok], owner, low, weight, rate)


def _keep(points, src, x, ids, owner, low, weight, rate) -> None:
    draw = tb.mix(ids ^ _U(0x8EBC6AF09C88C6E3))
    high = low[src] > 0
    if high.any():
        level = low[src] + 1 + np.where(high, (draw >> _U(32)).astype(np.int64) % np.maximum(rate[src].astype(np.int64), 1), 0)
        ok = ~high | (level <= weight[src])
        src, x, ids, draw = src[ok], x[ok], ids[ok], draw[ok]
    points[0].append(owner[src] * PLACES + ((draw & _U(0xFFFFFFFF)) % _U(PLACES)).astype(np.int64))
    points[1].append(x)
    points[2].append(ids)


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """n x BANDS hashes of ROWS places each, different for each band."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(tb.mix(np.arange(1, BANDS + 1, dtype=np.uint64)), parts.shape[:2])
    for k in range(ROWS):
        out = tb.mix(out ^ (parts[:, :, k] + _U(k + 1)) * _U(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tb.each(batches):
        data, offsets = tb.byte_column(batch.column("text"))
        for lo, hi in tb.row_blocks(offsets, tb.BLOCK_BYTES // 2, TEXTS):  # a short text has as many points as a long one
            body, cut = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            h, rows = shingles(body, cut)
            keys = text_keys(body, cut)
            n = hi - lo
            count = np.bincount(rows, minlength=n)
            bands = band_hashes(signatures(h, rows, n))
            size = np.where(count > 0, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(bands[count > 0].ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array(count, pa.int64()), lists], ["doc_id", "k1", "k2", "n_shingles", "bands"])


def _key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row beside its id and the two hashes of its words."""
    for batch in tb.each(batches):
        data, offsets = tb.byte_column(batch.column("text"))
        for lo, hi in tb.row_blocks(offsets):
            keys = text_keys(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("row", "doc_id")), *(pa.array(keys[:, i].copy()) for i in (0, 1))], ["row", "doc_id", "k1", "k2"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tb.each(batches):
        data, offsets = tb.byte_column(batch.column("text"))
        for lo, hi in tb.row_blocks(offsets):
            h, rows = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            h = h[np.lexsort((h, rows))]
            cut = np.searchsorted(rows, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())], ["doc_id", "shingles"])


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    values, counts = np.unique(a, return_counts=True)
    at = np.searchsorted(values, b)
    at[at == len(values)] = 0
    same = at[values[at] == b]
    common = int(np.minimum(counts, np.bincount(same, minlength=len(values))).sum())
    return common / (len(a) + len(b) - common)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.each(batches):
            ids = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            keep = []
            for i, (a, b) in enumerate(zip(batch.column("su"), batch.column("sv"), strict=True)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
                if min(len(x), len(y)) >= threshold * max(len(x), len(y)) and overlap(x, y) >= threshold:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], pa.int64()) for x in ids], ["u", "v"])

    return run


def numbered(shingle_set: np.ndarray) -> np.ndarray:
    """A sorted multiset as a set: the k-th of equal shingles gets a value of its own."""
    head = np.append(True, shingle_set[1:] != shingle_set[:-1])
    first = np.flatnonzero(head)
    nth = np.arange(len(shingle_set)) - np.repeat(first, np.diff(np.append(first, len(shingle_set))))
    return tb.mix(shingle_set + nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each text on the left shares with each on the right."""
    sides = [[numbered(x) for x in side] for side in (left, right)]
    tokens = [np.concatenate(side) for side in sides]
    both = np.intersect1d(*tokens)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    columns, rows = [], []
    for side, all_tokens in zip(sides, tokens, strict=True):
        owner = np.repeat(np.arange(len(side)), [len(x) for x in side])
        at = np.searchsorted(both, all_tokens)
        at[at == len(both)] = 0
        ok = both[at] == all_tokens if len(both) else np.zeros(len(at), dtype=bool)
        order = np.argsort(at[ok], kind="stable")
        columns.append(at[ok][order])
        rows.append(owner[ok][order])
    for lo in range(0, len(both), CHUNK):
        a, b = (np.zeros((len(side), CHUNK), dtype=np.float32) for side in sides)
        for matrix, column, row in zip((a, b), columns, rows, strict=True):
            part = slice(np.searchsorted(column, lo), np.searchsorted(column, lo + CHUNK))
            matrix[row[part], column[part] - lo] = 1
        out += a @ b.T
    return out


def tile_links(left: list[tuple], right: list[tuple] | None, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between components, as pairs of components. left, right: (component, shingles); right None: left itself."""
    other = left if right is None else right
    parts, sets = zip(*left, strict=True)
    parts_b, sets_b = zip(*other, strict=True)
    size, size_b = (np.array([len(x) for x in s], dtype=np.float64) for s in (sets, sets_b))
    possible = np.array(parts)[:, None] != np.array(parts_b)[None, :]
    possible &= np.minimum(size[:, None], size_b) >= threshold * np.maximum(size[:, None], size_b)
    if right is None:
        possible = np.triu(possible)
    u, v = np.nonzero(possible)
    if len(u) <= FEW:
        linked = [(i, j) for i, j in zip(u.tolist(), v.tolist(), strict=True) if overlap(sets[i], sets_b[j]) >= threshold]
    else:
        common = common_counts(sets, sets_b).astype(np.float64)
        ok = common[u, v] / (size[u] + size_b[v] - common[u, v]) >= threshold
        linked = list(zip(u[ok].tolist(), v[ok].tolist(), strict=True))
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    out = []
    for i, j in linked:
        a, b = top(parts[i]), top(parts_b[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


def _tiles(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []

        def links():
            left = [r[1:] for r in held if r[0] == tile[1]]
            right = [r[1:] for r in held if r[0] == tile[2]] if tile[1] != tile[2] else None
            found = tile_links(left, right, threshold) if left and (right is None or right) else []
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in tb.each(batches):
            head = list(zip(*(batch.column(c).to_pylist() for c in ("band", "i", "j", "block", "component")), strict=True))
            for (band, i, j, *rest), blob in zip(head, batch.column("shingles"), strict=True):
                if (band, i, j) != tile:
                    if held:
                        yield links()
                    tile, held = (band, i, j), []
                held.append((*rest, np.frombuffer(blob.as_py(), np.uint64)))
        if held:
            yield links()

    return run


def near_duplicates(docs: DataFrame, ws: Workspace, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), n_copies (rows with the same words), kept.

    One row for each row of ``docs``.
    """
    return _judged(docs, ws, threshold).select("doc_id", "class_id", "n_copies", "kept")


def _judged(docs: DataFrame, ws: Workspace, threshold: float) -> DataFrame:
    """The near-duplicates, with the two hashes k1 and k2 of each row's words."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = ws.save(own.mapInArrow(_sign, "doc_id bigint, k1 bigint, k2 bigint, n_shingles bigint, bands array<bigint>"), "signed")
    folded = signed.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("x"), F.count("*").alias("n_copies"))
    reps = ws.save(folded.select("k1", "k2", F.col("x.doc_id").alias("rep"), "n_copies", "x.n_shingles", "x.bands"), "reps")
    banded = reps.select("rep", "n_shingles", F.explode("bands").alias("band"))
    crowded = ws.save(banded.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1"), "crowded")
    members = ws.save(banded.join(crowded.select("band", "leader"), "band"), "members")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = own.join(ws.save(wanted, "wanted"), "doc_id").mapInArrow(_shingle_sets, "doc_id bigint, shingles binary")
    sets = ws.save(texts.withColumnRenamed("doc_id", "rep"), "sets")
    pairs = members.where("rep <> leader").select(F.col("leader").alias("u"), F.col("rep").alias("v")).distinct()
    with_v = ws.save(pairs, "pairs").join(sets.select(F.col("rep").alias("v"), F.col("shingles").alias("sv")), "v")
    both = with_v.join(sets.select(F.col("rep").alias("u"), F.col("shingles").alias("su")), "u")
    good = ws.save(both.select("u", "v", "su", "sv").mapInArrow(_verify(threshold), "u bigint, v bigint"), "good")
    label = connected_components(good, ws, "star")
    ws.drop("crowded", "wanted", "pairs", "good")
    members = ws.save(members.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", "n_shingles", F.coalesce("component", "rep").alias("component")), "members-labelled")
    alike = [F.sum(F.xxhash64("rep", F.lit(i)).cast("decimal(38, 0)")).alias(f"sum{i}") for i in (0, 1)]
    mixed = members.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.greatest(F.sum("n_shingles") / BLOCK, F.count("*") / TEXTS)).cast("int").alias("blocks"), F.count("*").alias("n"), *alike).where("low < high")
    mixed = ws.save(mixed.groupBy("n", "sum0", "sum1").agg(F.min("band").alias("band"), F.first("blocks").alias("blocks")).select("band", "blocks"), "mixed")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block")
    dealt = members.join(mixed, "band").select("band", "rep", "component", block, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("band", "rep", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    tiled = ws.save(dealt, "dealt").join(sets, "rep").select("band", "i", "j", "block", "component", "shingles")
    more = tiled.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_tiles(threshold), "u bigint, v bigint")
    # the star's components stand for their members
    joined = connected_components(ws.save(more, "more"), ws, "tiles").select(F.col("node").alias("component"), F.col("component").alias("whole"))
    label = label.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    alone = joined.select(F.col("component").alias("node"), F.col("whole").alias("component")).join(label.select("node"), "node", "left_anti")
    label = ws.save(label.unionByName(alone), "label")
    ws.drop("members", "sets", "members-labelled", "mixed", "dealt", "more", "star", "tiles")
    node = reps.select("k1", "k2", "rep", "n_copies").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    node = ws.save(node.select("k1", "k2", F.col("n_copies"), F.coalesce("component", "rep").alias("class_id"), F.lit(True).alias("worded")), "classes")
    ws.drop("reps", "label")
    out = signed.select("doc_id", "k1", "k2", (F.col("n_shingles") > 0).alias("worded")).join(node, ["k1", "k2", "worded"], "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", "k1", "k2", class_id.alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def first_of_each_class(docs: DataFrame, ws: Workspace, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are the smallest of their class, all columns kept; of rows equal in id and text, one."""
    later = ws.save(_judged(docs, ws, threshold).where("not kept").select("doc_id", "k1", "k2").distinct(), "later")
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.join(later, "doc_id", "left_anti").select(*docs.columns)
    # an id may stand on texts of different classes, so the words tell which of its rows go
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    keyed = row.mapInArrow(_key, T.StructType([row.schema["row"], *(T.StructField(c, T.LongType()) for c in ("doc_id", "k1", "k2"))]))
    left = keyed.join(later, ["doc_id", "k1", "k2"], "left_anti").select("row.*")
    return left.where("doc_id is null").unionByName(left.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))
