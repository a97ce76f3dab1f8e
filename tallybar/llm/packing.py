"""Best-fit packing of tokenised documents by minimum bin slack.

A document is its token ids and the end id 0. One longer than a sequence is cut into full pieces, the first
of which may be shorter. All that packing needs to know is how many pieces there are of each length, a
table of at most ``capacity`` rows however large the corpus, which the driver packs: each bin takes the
longest length left and then, by dynamic programming over a bitset of reachable sums (a length with c
pieces counts as far as c times), the fullest feasible combination of the others; the combination is taken
as often as its lengths last. The resulting plan says which ranks of each length go to which sequences,
and the pieces look their places up by rank. Ranks are counted within (shard, length) and shifted by the
shards' totals, so a length that a third of all pieces share is not gathered anywhere.

Defined results: a null text is empty, so its one piece is the end id; rows that repeat are packed each on
its own; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textblocks as tb
from .workspace import Workspace

CAPACITY, END = 2048, 0
#: Characters from which on a run of whitespace is cut out here: tiktoken's regular expression overflows its stack near a million.
LONG_RUN = 100_000
#: Whitespace as the vocabulary's pattern has it, without Python's four separators more; tried at a run's start only.
_RUN = re.compile(r"(?<![^\S\x1c-\x1f])[^\S\x1c-\x1f]{%d,}" % LONG_RUN)
_encoders: dict = {}


def encoder(vocabulary: str):
    """ids of a text as uint32, by the byte-level BPE vocabulary at ``vocabulary`` (a ``tokenizers`` JSON file)."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = _load(vocabulary)
    return _encoders[vocabulary]


def _load(vocabulary: str):
    """The vocabulary's merges read as ranks: the ids are the same, at a fraction of the time.

    Added tokens are matched first, anywhere in a text; what lies between them is encoded on its own.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
        raise ValueError(f"{vocabulary}: added tokens that depend on what is beside them are not supported")
    cut = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})")
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(shown[c] for c in token): i for token, i in model["vocab"].items() if all(c in shown for c in token)}
    encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ordinary(text: str) -> list[int]:
        ids, at = [], 0
        for run in _RUN.finditer(text) if len(text) >= LONG_RUN else ():
            end = run.end() - (run.end() < len(text))  # the last character of a run before a word is not in the run's piece
            ids += encoding.encode_ordinary(text[at : run.start()])
            ids += encoding._encode_single_piece(text[run.start() : end])
            at = end
        return ids + encoding.encode_ordinary(text[at:])

    def encode(text: str) -> np.ndarray:
        if not any(t in text for t in added):
            return np.array(ordinary(text), dtype="<u4")
        return np.array([i for part in cut.split(text) for i in ([added[part]] if part in added else ordinary(part))], dtype="<u4")

    return encode


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids; only the first may be shorter than the capacity."""
    first = n - capacity * ((n - 1) // capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(vocabulary: str, capacity: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in tb.each(batches):
            out = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    for column, x in zip(out, (doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        column.append(x)
            crc = np.array(out[4], dtype=np.int64)
            shard = (crc * 0x9E3779B1 + np.array(out[1], dtype=np.int64) * 7919 + np.array([x or 0 for x in out[0]], dtype=np.int64)) % shards
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((*out, shard), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "shard"])

    return run


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of the lengths in ``counts`` (length: pieces left) with the largest sum of at most ``room``."""
    if counts.get(room):
        return {room: 1}
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left > 0:
            k = min(copies, left)
            steps.append((length, k, reach))
            reach |= (reach << (k * length)) & mask
            left -= k
            copies *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= k * length
            out[length] = out.get(length, 0) + k
    return out


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Combinations of lengths and how many bins each fills, until no piece is left."""
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = {k: n for k, n in left.items() if n and k <= capacity - longest}
        combination = fullest(rest, capacity - longest) if rest else {}
        left[longest] += 1
        combination = combination | {longest: combination.get(longest, 0) + 1}
        times = min(left[k] // n for k, n in combination.items())
        for k, n in combination.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((times, combination))
    return out


def slots(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length the runs of ranks that one combination takes, sorted by (length, first rank)."""
    used: dict[int, int] = {}
    rows, bin_number = [], 0
    for times, combination in plan:
        offset = 0
        for length, n in sorted(combination.items(), reverse=True):
            lo = used.get(length, 0)
            rows.append((length, lo, n, bin_number, offset))
            used[length] = lo + n * times
            offset += n * length
        bin_number += times
    rows.sort()
    names = ("length", "lo", "each", "bin", "offset")
    return {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(names)}


def _place(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pickle.loads(plan.value)
        key = p["length"] << 44 | p["lo"]
        for batch in tb.each(batches):
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            inside = rank - p["lo"][at]
            sequence = p["bin"][at] + inside // p["each"][at]
            offset = p["offset"][at] + inside % p["each"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, ws: Workspace, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    spark = docs.sparkSession
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, shard int"
    pieces = ws.save(own.mapInArrow(_pieces(vocabulary or default_vocabulary(), capacity, shards), schema), "pieces")
    by_shard = ws.save(pieces.groupBy("shard", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in by_shard.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(pickle.dumps(slots(plan_bins(histogram, capacity))))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shift = ws.save(by_shard.select("shard", "length", F.coalesce(before, F.lit(0)).alias("before")), "shift")
    inside = F.row_number().over(Window.partitionBy("shard", "length").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("inside", inside).join(shift.hint("merge"), ["shard", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside") - 1).cast(T.LongType()).alias("rank"))
    return ranked.mapInArrow(_place(plan), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
