"""Byte-level substring dedup by two-stage suffix sorting.

Every byte under a ``WINDOW``-byte string that also starts earlier in the corpus goes. ``repeats`` brings
together the snippets whose windows may be equal; here the suffixes of a task's snippets are sorted in two
stages. Suffixes smaller than their successor (type B) are sorted directly, by eight bytes at a time. All
others (type A) are induced: the buckets of first bytes are scanned in order, and a suffix that is scanned
puts its predecessor, if that is of type A, at the next place of the predecessor's bucket; a bucket's A
suffixes stand before its B suffixes. Order matters only up to the window's length, so sorting stops
there. Common prefixes of adjacent suffixes then give the classes of equal windows, and in each class all
but the earliest place are covered.

Defined results: matches never cross documents; a null text is empty; a document shorter than the window
keeps all; rows that share a document id are one document in the order of places, and rows equal in id and
text one place (see ``repeats``); an empty table gives no rows; other columns are ignored. A cut
may fall inside a character; ``drop_repeats``, which returns text, keeps such a character whole.
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
from .repeats import Units, covered_runs, covered_units, inside, keyed_rows
from .workspace import Workspace

WINDOW = 100
BYTES = Units("bytes", WINDOW, (20, 60, WINDOW))


def packed_words(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as an ordered number."""
    n = len(padded) - 7
    out, size = padded.astype(np.uint64), 1
    while size < 8:
        out = out[: len(out) - size] << np.uint64(8 * size) | out[size:]
        size *= 2
    return out


def sort_directly(packed: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the ``depth`` bytes from them (rounded up to eights); equal ones in any order."""
    if not len(at):
        return at
    key = packed[at]
    digest = tb.mix(key)
    for off in range(8, depth, 8):
        digest = tb.mix(digest ^ packed[at + off])
    order = np.argsort(key)
    at, key, digest = at[order], key[order], digest[order]
    # slots that may still change, and where their groups of equal beginnings start
    slots, head = np.arange(len(at)), np.append(True, key[1:] != key[:-1])
    for off in range(8, depth, 8):
        # groups of one, or of equal strings, are done
        first = np.flatnonzero(head)
        mixed = np.minimum.reduceat(digest, first) != np.maximum.reduceat(digest, first)
        live = np.repeat(mixed, np.diff(np.append(first, len(head))))
        if not live.any():
            break
        slots, head, digest = slots[live], head[live], digest[live]
        group = np.cumsum(head)
        own = at[slots]
        key = packed[own + off]
        order = np.lexsort((key, group))
        at[slots], digest, key = own[order], digest[order], key[order]
        head[1:] |= key[1:] != key[:-1]
    return at


def suffix_array(text: np.ndarray, wanted: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The wanted places in suffix order, sorted by at least ``depth`` bytes, and the packed text (``packed_words``).

    text: bytes above 0 with a 0 after each snippet; wanted: boolean for each byte. Every wanted suffix and
    the suffixes that its order is induced from take part.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    packed = packed_words(padded)
    # type B: the first byte that differs from this one is larger
    change = np.flatnonzero(padded[1 : n + 1] != padded[:n])
    after = np.searchsorted(change, np.arange(n))
    following = np.where(after < len(change), padded[np.append(change, n)[after] + 1], 0) if n else np.empty(0, np.uint8)
    smaller = (following > text) | (text == 0)
    # a wanted suffix of type A needs its successors up to the next of type B
    b_places = np.append(np.flatnonzero(smaller), n)
    reach = np.zeros(n + 2, dtype=np.int64)
    w = np.flatnonzero(wanted)
    np.add.at(reach, w, 1)
    np.add.at(reach, np.minimum(b_places[np.searchsorted(b_places, w)], n - 1) + 1, -1)
    used = np.cumsum(reach[:n]) > 0
    induced = used & ~smaller
    direct = sort_directly(packed, np.flatnonzero(used & smaller), depth)
    first = text[direct]
    cuts = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        own = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        level = own
        while len(level):  # runs of the same byte are induced inside the bucket
            level = level[level > 0] - 1
            level = level[induced[level] & (text[level] == c)]
            own = np.concatenate([own, level])
        bucket = np.concatenate([own, direct[cuts[c] : cuts[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (text[before] > c)]
        heads = text[before]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        for d in np.unique(heads).tolist():
            waiting[d].append(before[np.searchsorted(heads, d) : np.searchsorted(heads, d, "right")])
    array = np.concatenate(out) if out else np.empty(0, np.int64)
    return array[wanted[array]], packed


def adjacent_prefixes(packed: np.ndarray, array: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it, up to ``depth``; 0 for the first."""
    out = np.zeros(len(array), dtype=np.int64)
    live = np.arange(1, len(array))
    for off in range(0, depth, 8):
        differs = packed[array[live] + off] ^ packed[array[live - 1] + off]
        same = differs == 0
        out[live[same]] = off + 8
        live, differs = live[~same], differs[~same]
        # leading equal bytes of the eight
        out[live] = off + 7 - (np.frexp(differs.astype(np.float64))[1] - 1).clip(0, 63) // 8
        live = np.flatnonzero(out == off + 8)
    return np.minimum(out, depth)


def covered_windows(snippets: list[bytes], starts: list[int], places: list[tuple[int, int]], window: int = WINDOW) -> np.ndarray:
    """For each window of each snippet, whether an equal window has an earlier place."""
    raw = np.frombuffer(b"\0".join(snippets) + b"\0", np.uint8)
    size = np.array([len(s) for s in snippets])
    first = np.cumsum(size + 1) - size - 1
    present = np.zeros(256, dtype=bool)
    ends = first + size
    body = np.ones(len(raw), dtype=bool)
    body[ends] = False
    present[raw[body]] = True
    if present.all():
        raise ValueError("text that uses all 256 byte values is not UTF-8")
    ranks = np.cumsum(present).astype(np.uint8)  # from 1, so 0 is free to end snippets
    text = np.where(body, ranks[raw], 0).astype(np.uint8)
    n = np.array(starts)
    at = np.repeat(first, n) + inside(n)
    wanted = np.zeros(len(text), dtype=bool)
    wanted[at] = True
    array, packed = suffix_array(text, wanted, window)
    head = adjacent_prefixes(packed, array, window) < window
    number = np.zeros(len(text), dtype=np.int64)
    number[at] = np.arange(len(at))
    order = number[array]
    docs, rank = np.unique(np.array([p[0] for p in places], dtype=np.int64), return_inverse=True)
    begin = np.array([p[1] for p in places], dtype=np.int64)
    place = (np.repeat(rank, n) << 40) | (np.repeat(begin, n) + inside(n))
    low = np.minimum.reduceat(place[order], np.flatnonzero(head)) if len(order) else place[:0]
    out = np.zeros(len(at), dtype=bool)
    out[order] = place[order] > low[np.cumsum(head) - 1]
    return out


def _inside(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tb.each(batches):
        data, offsets = tb.byte_column(batch.column("text"))
        for lo, hi in tb.row_blocks(offsets):
            body, cut = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            gone = covered_units(batch.column("marks").slice(lo, hi - lo), cut, WINDOW)
            head = gone.copy()
            head[1:] &= ~gone[:-1]
            head[cut[:-1][np.diff(cut) > 0]] = gone[cut[:-1][np.diff(cut) > 0]]
            removed, runs = (np.diff(np.append(0, np.cumsum(x))[cut]) for x in (gone, head))
            kept, at = body[~gone].tobytes(), cut - np.append(0, np.cumsum(gone))[cut]
            digest = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *(pa.array(x, pa.int64()) for x in (np.diff(cut), removed, runs)), pa.array(digest)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    rows = keyed_rows(docs)
    marks = covered_runs(rows, BYTES, covered_windows, True, ws)
    joined = rows.join(marks, ["doc_order", "row_id"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(_kept, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tb.each(batches):
        data, offsets = tb.text_column(batch)
        texts = tb.text_array(batch)
        for lo, hi in tb.row_blocks(offsets):
            body, cut = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            gone = covered_units(batch.column("marks").slice(lo, hi - lo), cut, WINDOW)
            char = np.cumsum((body & 0xC0) != 0x80) - 1
            whole = np.bincount(char, gone) == np.bincount(char) if len(char) else gone  # every byte of the character goes
            gone = whole[char] if len(char) else gone
            kept, at = body[~gone].tobytes(), (cut - np.append(0, np.cumsum(gone))[cut]).tolist()
            out = [kept[a:b].decode() if ok else None for a, b, ok in zip(at, at[1:], texts.slice(lo, hi - lo).is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, hi - lo), pa.array(out, pa.string())], ["row", "kept_text"])


def drop_repeats(docs: DataFrame, ws: Workspace) -> DataFrame:
    """The documents without their covered characters, all columns kept; n_chars, if there, counts what is left.

    A document of which nothing is left goes; one that was empty before stays.
    """
    rows = keyed_rows(docs, tuple(docs.columns))
    marks = covered_runs(rows, BYTES, covered_windows, True, ws)
    joined = rows.drop("doc_id", "text", "repeated").join(marks, ["doc_order", "row_id"], "left").select("row", "marks")
    schema = T.StructType([T.StructField("row", joined.schema["row"].dataType), T.StructField("kept_text", T.StringType())])
    cleaned = joined.mapInArrow(_clean, schema)
    cleaned = cleaned.where("kept_text is null or kept_text <> '' or row.text = ''")
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return cleaned.select(*((F.coalesce(new[c], F.col(f"row.{c}")) if c in new else F.col(f"row.{c}")).alias(c) for c in docs.columns))
