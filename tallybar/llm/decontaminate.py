"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` cuts the training texts into segments of whole texts and stores, for each segment and each of
``BUCKETS`` ranges of term hashes, a dictionary of terms and their postings: the sorted places at which a term
stands in the segment. The index is a Parquet table, so any number of benchmarks and both kinds of search run
over one index; buckets without a benchmark's terms are filtered out before they are decoded.

A search takes the benchmark in blocks of at most ``BLOCK_WORDS`` words. A block's terms pick their postings out of
the stored index, and a segment's postings meet in one task. There each benchmark window is looked up from its
rarest term: that term's places, moved back by its place in the window, are the candidate starts, and the other
terms' lists, moved by their own places, are intersected with them from rare to common. For an exact phrase each
term must stand at its place; for a proximity match it may stand up to ``slop`` words off. A common passage or
word only lengthens the lists of the segments that hold it. What a block finds is written before the next
block is made, so one block at a time is held and sent, however large the benchmark is; the driver reads the
benchmark one partition at a time.

Defined results: a null or wordless text has no words, no hits and no items; an item without words is
never found; an item shorter than the window is one window of its own length; repeated document rows each
give a row; repeated items with one id count once; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .workspace import Workspace

#: Words of the benchmark that one pass holds; their windows take about 100 bytes a word in each task.
BLOCK_WORDS = 500_000
#: Candidate starts that are intersected at once.
STEP = 1 << 21
#: Bytes of text in a segment, if a single text is not longer, and ranges of term hashes.
SEGMENT_BYTES, BUCKETS = 4 << 20, 32

#: A text of a segment: its place among them, and its first word's place in the segment.
_TEXT = "place: int, doc_id: bigint, text_md5: string, first: bigint, n_words: bigint"
#: Rows of the stored index: of bucket -1 a segment's texts (in ``places`` their first words, and the end), of others postings.
_INDEX = f"segment bigint, bucket int, terms binary, counts binary, places binary, texts array<struct<{_TEXT}>>"
_PICKED = "segment bigint, bucket int, terms binary, counts binary, places binary"
_PICKED_NAMES = [f.split()[0] for f in _PICKED.split(", ")]
_SPANS = "array<struct<start: bigint, end: bigint>>"


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, A-Z lower-cased."""
    starts, ends, rows = tb.tokens(data, offsets, tb.word_table("ascii"))
    return tb.token_hashes(data, starts, ends, tb.BYTE_VALUES[tb.LOWER]), rows


def segment_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``words_of`` a segment, a few texts at a time, as hashing takes tens of bytes for each byte of text."""
    parts = []
    for lo, hi in tb.row_blocks(offsets):
        hashes, rows = words_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        parts.append((hashes, rows + lo))
    hashes, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, rows


class Queries:
    """The windows of one block of benchmark items: terms as numbers, windows by length, the items of each window."""

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int):
        self.terms = np.unique(np.concatenate([h for _, h in items] or [np.empty(0, np.uint64)]))
        found: dict[bytes, set] = {}
        for item, hashes in items:
            ids = np.searchsorted(self.terms, hashes).astype(np.int32)
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                found.setdefault(ids[i : i + size].tobytes(), set()).add(item)
        by_size: dict[int, list] = {}
        for key, owners in found.items():
            by_size.setdefault(len(key) // 4, []).append((key, sorted(owners)))
        self.groups = []
        for size, rows in sorted(by_size.items()):
            grams = np.frombuffer(b"".join(k for k, _ in rows), np.int32).reshape(-1, size)
            ptr = np.cumsum([0, *(len(o) for _, o in rows)])
            self.groups.append((grams, ptr, np.array([x for _, o in rows for x in o], np.int64)))


class Postings:
    """Postings of some terms in a segment: ``terms`` as in the queries, their places, and the texts' first places."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, places: np.ndarray, n_terms: int, firsts: np.ndarray, n_words: int):
        self.count = np.zeros(n_terms, np.int64)
        self.count[terms] = counts
        order = np.argsort(terms, kind="stable")
        begin = np.cumsum(counts) - counts
        inside = np.arange(len(places)) - np.repeat(np.cumsum(counts[order]) - counts[order], counts[order])
        self.places = places[np.repeat(begin[order], counts[order]) + inside].astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.firsts, self.n_words = firsts, n_words
        # all lists as one sorted list of (term, place)
        self.keys = np.repeat(terms[order], counts[order]).astype(np.int64) * (n_words + 1) + self.places

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, place, "right") - 1

    def candidates(self, grams: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Window numbers, candidate starts and the order of the terms from rare to common, in bounded steps."""
        counts = self.count[grams]
        live = np.flatnonzero(counts.min(axis=1, initial=1 << 60) > 0)
        if not len(live):
            return
        order = np.argsort(counts[live], axis=1, kind="stable")
        rarest = grams[live, order[:, 0]]
        n = self.count[rarest]
        cut, total = 0, np.cumsum(n)
        while cut < len(live):
            end = max(int(np.searchsorted(total, (total[cut - 1] if cut else 0) + STEP, "right")), cut + 1)
            part = np.arange(cut, end)
            which = np.repeat(part, n[part])
            inside = np.arange(len(which)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            place = self.places[self.first[rarest[which]] + inside]
            yield live[which], place - order[which, 0], order[which]
            cut = end

    def matches(self, grams: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Window number and place of its rarest term wherever each other term stands, in the same text, at most ``slop`` words off its place in the phrase."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
        for which, start, order in self.candidates(grams):
            anchor = start + order[:, 0]
            text = self.text_of(anchor)
            low, high = self.firsts[text], np.append(self.firsts, self.n_words)[text + 1] - 1  # the anchor's own text
            for j in range(1, grams.shape[1]):
                off = order[:, j]
                key, want = grams[which, off].astype(np.int64) * (self.n_words + 1), start + off
                lo, hi = np.maximum(want - slop, low), np.minimum(want + slop, high)
                ok = lo <= hi
                ok &= np.searchsorted(self.keys, key + lo) < np.searchsorted(self.keys, key + np.maximum(hi, 0), "right")
                which, start, order, anchor, low, high = (x[ok] for x in (which, start, order, anchor, low, high))
            out.append((which, start, anchor))
        which, start, anchor = (np.concatenate(x) for x in zip(*out, strict=True))
        return which, anchor if slop else start


def find(postings: Postings, queries: Queries, slop: int | None = None) -> dict[int, tuple[list, list]]:
    """For each text with a match: hit spans (start, end) in its words, and item ids."""
    spans: list[tuple[np.ndarray, np.ndarray]] = []
    owners: list[tuple[np.ndarray, np.ndarray]] = []
    for grams, ptr, items in queries.groups:
        which, start = postings.matches(grams, slop or 0)
        if not len(which):
            continue
        spans.append((start, start + (1 if slop else grams.shape[1])))
        pairs = np.unique(np.stack([which, postings.text_of(start)]), axis=1)
        size = ptr[pairs[0] + 1] - ptr[pairs[0]]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        owners.append((np.repeat(pairs[1], size), items[np.repeat(ptr[pairs[0]], size) + inside]))
    out: dict[int, tuple[list, list]] = {}
    if not owners:
        return out
    starts, ends = (np.concatenate(x) for x in zip(*spans, strict=True))
    change = np.bincount(starts, minlength=postings.n_words + 1) - np.bincount(ends, minlength=postings.n_words + 1)
    hit = np.cumsum(change[:-1]) > 0
    edge = np.zeros(len(hit), dtype=bool)  # a text's first word begins a span of its own
    edge[postings.firsts[postings.firsts < len(hit)]] = True
    first = np.flatnonzero(hit & (edge | ~np.append(False, hit[:-1])))
    last = np.flatnonzero(hit & (np.append(edge[1:], True) | ~np.append(hit[1:], False))) + 1
    text = postings.text_of(first)
    base = postings.firsts[text]
    for t, a, b in zip(text.tolist(), (first - base).tolist(), (last - base).tolist(), strict=True):
        out.setdefault(t, ([], []))[0].append({"start": a, "end": b})
    got = np.unique(np.stack([np.concatenate([r for r, _ in owners]), np.concatenate([i for _, i in owners])]), axis=1)
    for t, item in got.T.tolist():
        out[t][1].append(item)
    return out


def segment_postings(hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Bucket, terms in order, how often each stands in the segment, and its places, for each bucket in use."""
    order = np.argsort(hashes, kind="stable").astype(np.int32)
    sorted_hashes = hashes[order]
    head = np.flatnonzero(np.append(True, sorted_hashes[1:] != sorted_hashes[:-1])) if len(hashes) else order
    terms, counts = sorted_hashes[head], np.diff(np.append(head, len(hashes))).astype(np.int32)
    bucket = bucket_of(terms)
    cut = np.searchsorted(bucket, np.arange(BUCKETS + 1))
    ends = np.append(head, len(hashes))
    for b in range(BUCKETS):
        lo, hi = cut[b], cut[b + 1]
        if lo < hi:
            yield b, terms[lo:hi], counts[lo:hi], order[ends[lo] : ends[hi]]


def bucket_of(terms: np.ndarray) -> np.ndarray:
    """The range that a term's hash lies in."""
    return (terms >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    names = [*_PICKED_NAMES, "texts"]
    for batch in tb.each(batches):
        data, offsets = tb.byte_column(batch.column("text"))
        ids, null = batch.column("doc_id"), batch.column("text").is_null().to_numpy(zero_copy_only=False)
        for lo, hi in tb.row_blocks(offsets, SEGMENT_BYTES):
            segment, number = task << 32 | number, number + 1
            body, cut = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            hashes, rows = segment_words(body, cut)
            first = np.searchsorted(rows, np.arange(hi - lo + 1)).astype(np.int64)
            raw, at = body.tobytes(), cut.tolist()
            md5 = [hashlib.md5(raw[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
            columns = [pa.array(np.arange(hi - lo, dtype=np.int32)), ids.slice(lo, hi - lo), pa.array(md5, pa.string(), mask=null[lo:hi]), pa.array(first[:-1]), pa.array(np.diff(first))]
            texts = pa.StructArray.from_arrays(columns, ["place", "doc_id", "text_md5", "first", "n_words"])
            own = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), texts)
            yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([-1], pa.int32()), *(pa.array([b""], pa.binary()),) * 2, pa.array([first.tobytes()], pa.binary()), own], names)
            found = list(segment_postings(hashes))
            if found:
                buckets, *blobs = zip(*found, strict=True)
                blobs = (pa.array([x.tobytes() for x in column], pa.binary()) for column in blobs)
                yield pa.RecordBatch.from_arrays([pa.array([segment] * len(found)), pa.array(buckets, pa.int32()), *blobs, pa.nulls(len(found), own.type)], names)


def _picked(block):
    """Postings of the block's terms, by the terms' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(block.value).terms
        for batch in tb.each(batches):
            rows = []
            for row in zip(*batch.columns, strict=True):  # one at a time, as a batch may be a whole file
                segment, bucket, *blobs = (x.as_py() for x in row)
                if bucket < 0:
                    rows.append((segment, bucket, *blobs))
                    continue
                terms, counts, places = (np.frombuffer(x, t) for x, t in zip(blobs, (np.uint64, np.int32, np.int32), strict=True))
                at = np.searchsorted(known, terms)
                at[at == len(known)] = 0
                ours = known[at] == terms if len(known) else np.zeros(len(terms), dtype=bool)
                if ours.any():
                    rows.append((segment, bucket, at[ours].astype(np.int32).tobytes(), counts[ours].tobytes(), places[np.repeat(ours, counts)].tobytes()))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *(pa.binary(),) * 3), strict=True)], _PICKED_NAMES)

    return run


def _searched(block, slop):
    """Rows sorted by (segment, bucket), so that a segment's texts come before its postings, to matches."""
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = pickle.loads(block.value)
        segment, held, firsts = None, [], np.zeros(1, np.int64)

        def matches():
            terms, counts, places = (np.frombuffer(b"".join(x), np.int32) for x in zip(*held, strict=True))
            found = find(Postings(terms, counts.astype(np.int64), places, len(queries.terms), firsts[:-1], int(firsts[-1])), queries, slop)
            columns = zip(*((segment, place, spans, items) for place, (spans, items) in found.items()), strict=True) if found else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["segment", "place", "spans", "items"])

        for batch in tb.each(batches):
            for at, bucket, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != segment and held:
                    yield matches()
                    held = []
                segment = at
                if bucket < 0:
                    firsts = np.frombuffer(blobs[2], np.int64)
                else:
                    held.append(blobs)
        if held:
            yield matches()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [merged(x) for x in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("segment", "place")), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), batch.column("items")], ["segment", "place", "spans", "items"])


_FOUND = f"segment bigint, place int, spans {_SPANS}, items array<bigint>"


@dataclass(frozen=True)
class Index:
    """A stored index and the workspace it lies in."""

    rows: DataFrame
    ws: Workspace

    def texts(self) -> DataFrame:
        """segment and the fields of ``_TEXT`` for every indexed row."""
        return self.rows.where("bucket = -1").select("segment", F.inline("texts"))

    def matches(self, benchmark: DataFrame, window: int = 10, slop: int | None = None) -> DataFrame:
        """segment, place, spans (disjoint runs of hit words) and items of every text with a match.

        slop: None for exact phrases; else every word of a window may stand up to that many words off its place, and
        a span is the place of the window's rarest word.
        """
        blocks, found = _queries(benchmark, window), []
        while (queries := next(blocks, None)) is not None:
            sent = self.rows.sparkSession.sparkContext.broadcast(pickle.dumps(queries))
            wanted = [-1, *np.unique(bucket_of(queries.terms)).tolist()]
            del queries
            own = self.rows.where(F.col("bucket").isin(wanted)).select(*_PICKED_NAMES).mapInArrow(_picked(sent), _PICKED)
            met = own.repartition("segment").sortWithinPartitions("segment", "bucket").mapInArrow(_searched(sent, slop), _FOUND)
            found.append(self.ws.save(met, f"found-{uuid.uuid4().hex}"))
            sent.destroy()
        if len(found) == 1:
            return found[0]
        both = reduce(DataFrame.unionByName, found).groupBy("segment", "place")
        both = both.agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        return both.mapInArrow(_merged, _FOUND)


def build_index(docs: DataFrame, ws: Workspace) -> Index:
    """Index the texts of ``docs`` (doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return Index(ws.save(own.mapInArrow(_indexed, _INDEX), "index"), ws)


def _queries(benchmark: DataFrame, window: int) -> Iterator[Queries]:
    """Blocks of items, at least one; a longer item stands in several, which share window - 1 words."""
    rows = benchmark.select("item_id", "text").where("item_id is not null and text is not null").dropDuplicates().toLocalIterator()
    size = max(BLOCK_WORDS, window)

    def parts():
        for row in rows:
            hashes, _ = words_of(*tb.byte_column(pa.array([row.text])))
            for lo in range(0, max(1, len(hashes) - window + 1), size - window + 1):
                yield row.item_id, hashes[lo : lo + size].copy()

    block, words = [], 0
    for part in parts():
        if block and words + len(part[1]) > size:
            yield Queries(block, window)
            block, words = [], 0
        block.append(part)
        words += len(part[1])
    yield Queries(block, window)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, ws: Workspace, window: int = 10, slop: int | None = None) -> DataFrame:
    """doc_id, n_words, spans and items (see ``Index.matches``) for each document row."""
    index = build_index(docs, ws)
    found = index.texts().select("segment", "place", "doc_id", "n_words").join(index.matches(benchmark, window, slop), ["segment", "place"], "left")
    none = lambda kind: F.array().cast(kind)
    return found.select("doc_id", "n_words", F.coalesce("spans", none(_SPANS)).alias("spans"), F.coalesce("items", none("array<bigint>")).alias("items"))


def merged(spans: list[dict]) -> list[dict]:
    """The union of spans as disjoint runs."""
    out: list[dict] = []
    for x in sorted(spans, key=lambda s: s["start"]):
        if out and x["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], x["end"])
        else:
            out.append(dict(x))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, ws: Workspace, window: int = 10, slop: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = find_benchmark(docs, benchmark, ws, window, slop)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, ws: Workspace, window: int = 10) -> DataFrame:
    """The documents that hold no benchmark window, all columns kept; equal texts share their fate."""
    index = build_index(docs, ws)
    hit = index.texts().join(index.matches(benchmark, window), ["segment", "place"]).select(F.col("text_md5").alias("__md5")).distinct()
    hit = ws.save(hit, "hit")
    ws.drop("index")
    return docs.join(hit, F.md5(docs["text"].cast("binary")) == hit["__md5"], "left_anti")
