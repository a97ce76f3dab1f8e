"""Word-level substring dedup by prefix-partitioned suffix trees.

Every word under a window of ``WINDOW`` words whose sequence also starts in a document with a smaller id
goes. The corpus' suffixes are split by prefixes of variable length, in two steps. ``repeats`` groups those
that start at an anchor by a prefix of 12 words, splits groups of more than ``repeats.PART`` different
snippets by prefixes of 30 and then 50 words, and sends each group to one task with the windows around its
anchor. A task's suffixes (one for each window) are split again, by their own prefixes: a group of suffixes
that share a prefix and exceed ``GROUP`` is split by the next word, until each group fits in memory or its
suffixes agree for the whole window. Each group becomes a suffix tree, whose internal nodes are built from
its sorted suffixes and the lengths of adjacent common prefixes. Nodes of ``WINDOW`` words or more are the
maximal repeats, and the suffixes under such a node are one class of equal windows.

Defined results: words are runs of non-space bytes, unchanged; a null text has none; a document shorter
than the window keeps all; repeats inside one document stay; rows that share a document id are one document
for this purpose (see ``repeats``); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textblocks as tb
from .repeats import Units, covered_runs, covered_units, inside, keyed_rows
from .workspace import Workspace

WINDOW = 50
WORDS = Units("words", WINDOW, (12, 30, WINDOW))
#: Suffixes that one tree holds at most, unless more agree for the whole window.
GROUP = 1 << 14


def prefix_groups(text: np.ndarray, suffixes: np.ndarray, depth: int, limit: int = GROUP) -> Iterator[tuple[int, np.ndarray]]:
    """(length of the common prefix, suffixes) of each memory-sized group, in the order of their prefixes."""
    stack = [(0, suffixes)]
    while stack:
        shared, part = stack.pop()
        if len(part) <= limit or shared >= depth:
            yield shared, part
            continue
        word = text[part + shared]
        order = np.argsort(word, kind="stable")
        part, word = part[order], word[order]
        cut = np.append(np.flatnonzero(np.append(True, word[1:] != word[:-1])), len(part))
        pieces, lo = [], 0
        while lo < len(cut) - 1:
            # neighbours that fit together form one group that shares what they shared before
            hi = int(np.searchsorted(cut, cut[lo] + limit, "right")) - 1
            hi = max(hi, lo + 1)
            pieces.append((shared + (hi == lo + 1), part[cut[lo] : cut[hi]]))
            lo = hi
        stack += reversed(pieces)


def sorted_suffixes(text: np.ndarray, suffixes: np.ndarray, shared: int, depth: int) -> np.ndarray:
    """Suffixes that agree on ``shared`` words in order of the words up to ``depth``."""
    digest = np.zeros(len(suffixes), dtype=np.uint64)
    for off in range(shared, depth):
        digest = tb.mix(digest ^ text[suffixes + off].astype(np.uint64))
    group = np.zeros(len(suffixes), dtype=np.int64)
    for off in range(shared, depth, 2):
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        mixed = np.minimum.reduceat(digest, first) != np.maximum.reduceat(digest, first)
        todo = np.flatnonzero(np.repeat(mixed, np.diff(np.append(first, len(group)))))
        if not len(todo):
            break
        at = suffixes[todo]
        key = text[at + off].astype(np.uint64) << np.uint64(32)
        if off + 1 < depth:
            key |= text[at + off + 1].astype(np.uint64)
        order = np.lexsort((key, group[todo]))
        suffixes[todo], digest[todo], key, old = at[order], digest[todo][order], key[order], group[todo][order]
        step = np.zeros(len(group), dtype=bool)
        step[1:] = group[1:] != group[:-1]
        step[todo] |= np.append(False, (key[1:] != key[:-1]) & (old[1:] == old[:-1]))
        group = np.cumsum(step)
    return suffixes


def common_words(text: np.ndarray, array: np.ndarray, depth: int) -> np.ndarray:
    """Words that each suffix shares with the one before it, up to ``depth``; 0 for the first."""
    out = np.zeros(len(array), dtype=np.int64)
    live = np.arange(1, len(array))
    for off in range(depth):
        live = live[text[array[live] + off] == text[array[live - 1] + off]]
        if not len(live):
            break
        out[live] = off + 1
    return out


class Tree:
    """The internal nodes of the suffix tree over sorted suffixes; node 0 is the root.

    depth: words on the path from the root; first, end: the node's range of leaves; parent: a node's number.
    """

    def __init__(self, common: np.ndarray):
        """common: words that each suffix shares with the one before it."""
        depth, first, end, parent = [0], [0], [len(common)], [-1]
        path = [0]
        for i, shared in enumerate(common[1:].tolist(), 1):
            top = depth[path[-1]]
            if shared == top:
                continue
            left, below = i - 1, -1
            while top > shared:
                below = path.pop()
                end[below], left, top = i, first[below], depth[path[-1]]
                parent[below] = path[-1]
            if top < shared:
                if below >= 0:
                    parent[below] = len(depth)
                path.append(len(depth))
                depth.append(shared)
                first.append(left)
                end.append(len(common))
                parent.append(path[-2])
        self.depth, self.first, self.end, self.parent = (np.array(x, dtype=np.int64) for x in (depth, first, end, parent))

    def deep_nodes(self, least: int) -> np.ndarray:
        """First and end leaf of every topmost node of at least ``least`` words: n x 2."""
        deep = self.depth >= least
        top = np.flatnonzero(deep & ~deep[self.parent])
        return np.stack([self.first[top], self.end[top]], axis=1)


def covered_windows(snippets: list[bytes], starts: list[int], places: list[tuple[int, int]], window: int = WINDOW, limit: int = GROUP) -> np.ndarray:
    """For each window of each snippet, whether an equal window stands in a smaller document."""
    words = [s.split() for s in snippets]
    number: dict[bytes, int] = {}
    text = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], dtype=np.uint32)
    size = np.array([len(w) for w in words])
    first = np.cumsum(size) - size
    n = np.array(starts)
    at = np.repeat(first, n) + inside(n)
    doc = np.zeros(len(text), dtype=np.int64)
    doc[at] = np.repeat(np.array([p[0] for p in places], dtype=np.int64), n)
    out = np.zeros(len(text), dtype=bool)
    for shared, part in prefix_groups(text, at, window, limit):
        array = sorted_suffixes(text, part.copy(), shared, window)
        for a, b in Tree(common_words(text, array, window)).deep_nodes(window).tolist():
            leaves = array[a:b]
            out[leaves] = doc[leaves] > doc[leaves].min()
    return out[at]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tb.each(batches):
        data, offsets = tb.byte_column(batch.column("text"))
        for lo, hi in tb.row_blocks(offsets):
            words = [data[a:b].tobytes().split() for a, b in zip(offsets[lo:hi].tolist(), offsets[lo + 1 : hi + 1].tolist(), strict=True)]
            n = np.array([len(w) for w in words])
            cut = np.append(0, np.cumsum(n))
            gone = covered_units(batch.column("marks").slice(lo, hi - lo), cut, WINDOW)
            removed = np.diff(np.append(0, np.cumsum(gone))[cut])
            kept = [compress(w, ~gone[a:b]) if r else w for w, a, b, r in zip(words, cut.tolist(), cut[1:].tolist(), removed.tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in kept])], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row."""
    rows = keyed_rows(docs)
    marks = covered_runs(rows, WORDS, covered_windows, False, ws)
    joined = rows.join(marks, ["doc_order", "row_id"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(_kept, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string")
