"""Windows that occur twice in a corpus: the part that byte and word substring dedup share.

A text is a row of units (bytes, or word hashes); a window is W consecutive units of one text. Two equal
windows hold the same k-grams, so they agree on the smallest k-gram hash in them and on its place (the last
one, if it occurs twice): their anchor, which is a prefix of k units of the suffix that starts there.
Consecutive windows of a text mostly share an anchor, and such a run of windows is one row of (anchor hash,
document, first start, number of starts): two rows for W - k + 2 units.

1. Anchors that occur once in the corpus are dropped: no window around them occurs twice.
2. The texts of the remaining runs are snippets. The places of equal snippets of a batch are one row, by a hash of
   the text beside the anchor's.
3. Snippets that share an anchor meet in one task, which finds the classes of equal windows among them
   (``resolve``, by suffix array or suffix tree) and says of each window whether an earlier place holds it.
   Equal snippets are folded again; the first and the last of them are compared, each as its own text, and
   every other copy takes over what was found for the last one.
4. An anchor with more than ``PART`` places is not compared so. Its equal snippets are folded by one aggregation,
   and where more than ``PART`` different ones are left, their windows are dealt again by the next longer
   k-gram. The longest is the window itself, where at most two snippets meet. So no anchor and no passage,
   however common, gathers an unbounded group.
5. What was found returns to the documents as covered runs of units.

A place is (document, start). Rows equal in document id and text are one place, so neither stands earlier
than the other; they are folded before all else and get the result back at the end. Rows that share an id
but not the text are told apart by a hash of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .workspace import Workspace

#: Places, or different snippets, of one anchor up to which they are compared in one task.
PART = 4_000
#: Snippet text that a task compares at once, if a single anchor does not need more, and snippets in a batch that goes on.
STEP_BYTES, ROWS = 1 << 19, 1 << 14
_U = np.uint64


@dataclass(frozen=True)
class Units:
    """What windows are made of. kind: "bytes" or "words"; window: W; grams: k, from short to W."""

    kind: str
    window: int
    grams: tuple[int, ...]

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Unit values, offsets of the texts' units, and the units' byte starts and ends (None for bytes)."""
        if self.kind == "bytes":
            return tb.BYTE_VALUES[data], offsets, None, None
        starts, ends, rows = tb.tokens(data, offsets, tb.word_table("space"))
        return tb.token_hashes(data, starts, ends), np.searchsorted(rows, np.arange(len(offsets))), starts, ends


def anchors(prefix: np.ndarray, units: np.ndarray, w: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, text, first start and number of starts of every run of windows.

    prefix: prefix hashes of all units; units: n + 1 offsets of the texts.
    """
    out: list[list[np.ndarray]] = [[], [], [], []]
    total, span = int(units[-1]), 1 << 20
    # a window's place in its piece takes the low 20 bits, so pieces are shorter than that
    for lo in range(0, max(total - w + 1, 0), span - w):
        hi = min(lo + span - w, total - w + 1)
        grams = tb.gram_hash(prefix[lo : hi + w], k, lo)
        code = (grams & ~_U(span - 1)) | (_U(span - 1) - np.arange(len(grams), dtype=np.uint64))
        place = (_U(span - 1) - (tb.window_min(code, w - k + 1) & _U(span - 1))).astype(np.int64)
        place = place[: hi - lo]
        start = np.arange(lo, hi)
        text = np.searchsorted(units, start, "right") - 1
        ok = start + w <= units[text + 1]
        start, text, place = start[ok], text[ok], place[ok]
        if not len(start):
            continue
        head = np.ones(len(start), dtype=bool)
        head[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
        at = np.flatnonzero(head)
        for column, x in zip(out, (grams[place[at]], text[at], start[at] - units[text[at]], np.diff(np.append(at, len(start)))), strict=True):
            column.append(x)
    kinds = (np.uint64, np.int64, np.int64, np.int64)
    return tuple(np.concatenate(c) if c else np.empty(0, t) for c, t in zip(out, kinds, strict=True))


def _runs(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.each(batches):
            orders, ids = (batch.column(c).to_numpy() for c in ("doc_order", "row_id"))
            data, offsets = tb.byte_column(batch.column("text"))
            for lo, hi in tb.row_blocks(offsets):
                values, cut, _, _ = units.split(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                h, text, start, n = anchors(tb.prefix_hash(values), cut, units.window, units.grams[0])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(orders[lo + text]), pa.array(ids[lo + text]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["anchor", "doc_order", "row_id", "start", "n"])

    return run


def _run_fields(batch: pa.RecordBatch, name: str, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The first n fields of a list of structs, flat, and where each row's begin and end."""
    lists = batch.column(name)
    flat = lists.flatten()
    return [flat.field(i).to_numpy() for i in range(n)], np.cumsum(np.append(0, lists.value_lengths().fill_null(0).to_numpy()))


def inside(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


KEYS = "anchor bigint, key bigint, n int, places array<struct<doc_order: bigint, start: int, row_id: bigint>>, body binary, part bigint"


def _named(body: memoryview, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes."""
    return np.array([xxhash.xxh3_64_intdigest(body[x:y]) for x, y in zip(start.tolist(), end.tolist(), strict=True)], dtype=np.uint64).view(np.int64)


def _spans(text: bytes, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    return [text[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True)]


def _keys(units: Units):
    """Texts and their runs (start, n, anchor) to snippets, named by a hash of their text: the places of equal ones in a batch are one row, in order. part names the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.each(batches):
            orders, ids = (batch.column(c).to_numpy() for c in ("doc_order", "row_id"))
            data, offsets = tb.byte_column(batch.column("text"))
            if not batch.num_rows:
                continue
            fields, ends = _run_fields(batch, "runs", 3)
            out: list[tuple[np.ndarray, ...]] = []
            for lo, hi in tb.row_blocks(offsets):
                raw = data[offsets[lo] : offsets[hi]]
                values, cut, first, last = units.split(raw, offsets[lo : hi + 1] - offsets[lo])
                start, n, anchor = (f[ends[lo] : ends[hi]].astype(np.int64) for f in fields)
                doc = np.repeat(np.arange(lo, hi), np.diff(ends[lo : hi + 1]))
                at = cut[doc - lo] + start
                end = at + n - 1 + units.window
                if first is None:
                    key = _named(memoryview(raw.tobytes()), at, end)
                    at, end = at + offsets[lo], end + offsets[lo]
                else:
                    key = _named(memoryview(values.tobytes()), at * 8, end * 8)
                    at, end = first[at] + offsets[lo], last[end - 1] + offsets[lo]
                out.append((anchor, key, n, orders[doc], start, ids[doc], at, end))
            anchor, key, n, order, start, row, at, end = (np.concatenate(c) for c in zip(*out, strict=True))
            by = np.lexsort((row, start, order, key, anchor))
            anchor, key = anchor[by], key[by]
            head = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1]))) if len(by) else by
            struct = pa.StructArray.from_arrays([pa.array(order[by]), pa.array(start[by].astype(np.int32)), pa.array(row[by])], ["doc_order", "start", "row_id"])
            places = pa.ListArray.from_arrays(pa.array(np.append(head, len(by)).astype(np.int32)), struct)
            anchor, key, n, at, end = anchor[head], key[head], n[by][head].astype(np.int32), at[by][head], end[by][head]
            del order, start, row, by, struct, out
            name = xxhash.xxh3_64_intdigest(np.array([orders[0], ids[0]]).tobytes()) >> 1
            for k in range(0, len(head), ROWS):  # what goes on is small, whatever the batch holds
                part = slice(k, k + ROWS)
                body = pa.array([data[x:y].tobytes() for x, y in zip(at[part].tolist(), end[part].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(anchor[part]), pa.array(key[part]), pa.array(n[part]), places.slice(k, len(anchor[part])), body, pa.array(np.full(len(body), name))], ["anchor", "key", "n", "places", "body", "part"])

    return run


SNIPPETS = "anchor bigint, key bigint, which int, doc_order bigint, start bigint, n bigint, body binary"


def _packed(covered: np.ndarray, n: np.ndarray) -> pa.Array:
    """The booleans of rows of n each as bits; null where none is set."""
    size = (n + 7) // 8
    begin = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()) * 8, dtype=bool)
    bits[np.repeat(begin * 8, n) + inside(n)] = covered
    some = np.add.reduceat(covered, np.cumsum(n) - n) > 0 if len(n) else np.zeros(0, dtype=bool)
    packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(begin, size.sum()).astype(np.int32)), pa.py_buffer(np.packbits(bits).tobytes())])
    return pc.if_else(pa.array(some), packed, pa.scalar(None, pa.binary()))


MARKS = "doc_order bigint, row_id bigint, start int, n int, bits binary"


def _marked(resolve: Callable, same_text: bool):
    """Rows of ``_keys`` sorted by anchor to the places whose windows an earlier place holds, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in tb.each(batches):
            anchor, body = batch.column("anchor").to_numpy(), batch.column("body")
            ends = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, batch.num_rows) if batch.num_rows else anchor
            _, cut = tb.byte_column(body)
            lo = 0
            if held and batch.num_rows and held[-1].column("anchor")[-1].as_py() != anchor[0] and size >= STEP_BYTES:
                yield _compared(held, resolve, same_text)
                held, size = [], 0
            for hi in ends.tolist():
                # an anchor that a batch cuts stays with its rest
                if size + cut[hi] - cut[lo] >= STEP_BYTES and hi < batch.num_rows:
                    held.append(batch.slice(lo, hi - lo))
                    yield _compared(held, resolve, same_text)
                    held, size, lo = [], 0, hi
            if lo < batch.num_rows:
                held.append(batch.slice(lo))
                size += int(cut[-1] - cut[lo])
        if held:
            yield _compared(held, resolve, same_text)

    return run


def _compared(held: list[pa.RecordBatch], resolve: Callable, same_text: bool) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks()
    anchor, key, n = (rows.column(c).to_numpy() for c in ("anchor", "key", "n"))
    places = rows.column("places").combine_chunks()
    order, start, row = (places.flatten().field(i).to_numpy() for i in range(3))
    length = places.value_lengths().to_numpy().astype(np.int64)
    end = np.cumsum(length)
    begin = end - length
    # rows of one snippet follow each other, as they are sorted by (anchor, key)
    same = (anchor[1:] == anchor[:-1]) & (key[1:] == key[:-1])
    snippet = np.cumsum(np.append(0, ~same))
    by = np.lexsort((start[begin], order[begin], snippet))
    first = by[np.flatnonzero(np.append(True, ~same))]
    by = np.lexsort((start[end - 1], order[end - 1], snippet))
    last = by[np.flatnonzero(np.append(~same, True))]
    first_order, first_start = order[begin[first]], start[begin[first]]

    def later(o, s, of):
        return (o > first_order[of]) | ((o == first_order[of]) & (s > first_start[of])) if same_text else o > first_order[of]

    twice = np.flatnonzero(later(order[end[last] - 1], start[end[last] - 1], np.arange(len(last))))
    taken = np.concatenate([first, last[twice]])
    at = np.concatenate([begin[first], end[last[twice]] - 1])
    covered = resolve(rows.column("body").take(taken).to_pylist(), n[taken].tolist(), list(zip(order[at].tolist(), start[at].tolist(), strict=True)))
    bits = _packed(covered, n[taken].astype(np.int64))
    second = np.full(len(first), -1)
    second[twice] = len(first) + np.arange(len(twice))
    of = np.repeat(snippet, length)
    source = np.where(later(order, start, of), second[of], of)
    out = pa.RecordBatch.from_arrays([pa.array(order), pa.array(row), pa.array(start), pa.array(np.repeat(n, length)), bits.take(pa.array(source))], ["doc_order", "row_id", "start", "n", "bits"])
    return out.filter(out.column("bits").is_valid())


PARTS = "anchor bigint, key bigint, n bigint, doc_order bigint, start bigint, body binary, of_anchor bigint, of_key bigint, which int, skip int"


def _parts(units: Units, level: int):
    """Snippets to the runs of their windows that share an anchor of the level's gram, as snippets of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.each(batches):
            data, offsets = tb.byte_column(batch.column("body"))
            of_anchor, of_key, which, order, start = (batch.column(c).to_numpy() for c in ("anchor", "key", "which", "doc_order", "start"))
            for lo, hi in tb.row_blocks(offsets):
                raw = data[offsets[lo] : offsets[hi]]
                values, cut, first, last = units.split(raw, offsets[lo : hi + 1] - offsets[lo])
                anchor, src, skip, n = anchors(tb.prefix_hash(values), cut, units.window, units.grams[level])
                a = cut[src] + skip
                b = a + n - 1 + units.window
                text = raw.tobytes()
                if first is None:
                    key = _named(memoryview(text), a, b)
                else:
                    key = _named(memoryview(values.tobytes()), a * 8, b * 8)
                    a, b = first[a], last[b - 1]
                body = _spans(text, a, b)
                own = lo + src
                columns = [anchor.view(np.int64), key, n, order[own], start[own] + skip, body, of_anchor[own], of_key[own], which[own].astype(np.int32), skip.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) if c is body else pa.array(c) for c in columns], [f.split()[0] for f in PARTS.split(", ")])

    return run


JUDGED = "anchor bigint, key bigint, first_order bigint, first_start bigint, first_bits binary, last_bits binary"


def _resolved(resolve: Callable):
    """Snippets sorted by (anchor, key, which) to the windows of the first and of the last place that an earlier place holds, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, now = 0, None

        def flush():
            covered = resolve([r[6] for r in held], [r[5] for r in held], [(r[3], r[4]) for r in held])
            at, rows = 0, []
            for r in held:
                bits = covered[at : at + r[5]]
                at += r[5]
                found = np.packbits(bits).tobytes() if bits.any() else None
                if r[2]:
                    rows[-1][5] = found
                else:
                    rows.append([r[0], r[1], r[3], r[4], found, None])
            rows = [r for r in rows if r[4] or r[5]]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 4 + (pa.binary(),) * 2, strict=True)], [f.split()[0] for f in JUDGED.split(", ")])

        for batch in tb.each(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= STEP_BYTES and row[0] != now:
                    yield flush()
                    held, size = [], 0
                now = row[0]
                held.append(row)
                size += len(row[6])
        if held:
            yield flush()

    return run


def _rejoined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What was found for the parts of snippets, as bits of the snippets."""
    for batch in tb.each(batches):
        first_bits, last_bits = [], []
        for n, parts in zip(batch.column("n").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            gone = np.zeros((2, n), dtype=bool)
            for p in parts:
                gone[p["which"], p["skip"] : p["skip"] + p["n"]] |= np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=p["n"]).astype(bool)
            for out, bits in zip((first_bits, last_bits), gone, strict=True):
                out.append(np.packbits(bits).tobytes() if bits.any() else None)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("anchor", "key", "first_order", "first_start")), pa.array(first_bits, pa.binary()), pa.array(last_bits, pa.binary())], [f.split()[0] for f in JUDGED.split(", ")])


def _later(place: Column, first: tuple[Column, Column], same_text: bool) -> Column:
    """Whether a place is later than the first one in the sense that counts."""
    later = place["doc_order"] > first[0]
    return later | ((place["doc_order"] == first[0]) & (place["start"] > first[1])) if same_text else later


@dataclass(frozen=True)
class _Search:
    """How snippets are compared."""

    units: Units
    resolve: Callable
    same_text: bool
    ws: Workspace

    def both(self, folded: DataFrame) -> DataFrame:
        """anchor, key, n, which and at: the first place of each snippet, and the last if it is later in the sense that counts."""
        at = [F.struct(F.lit(i).alias("which"), F.col(c).alias("at")) for i, c in enumerate(("first", "last"))]
        both = folded.select("anchor", "key", "n", "first", F.explode(F.array(*at)).alias("x"))
        both = both.where((F.col("x.which") == 0) | _later(F.col("x.at"), (F.col("first.doc_order"), F.col("first.start")), self.same_text))
        return both.select("anchor", "key", "n", "x.which", "x.at")

    def crowded(self, folded: DataFrame, level: int) -> DataFrame | None:
        """Anchors of more snippets than one task compares, if there are any."""
        if self.units.grams[level] == self.units.window:
            return None
        found = self.ws.save(folded.groupBy("anchor").count().where(F.col("count") > PART).select("anchor"), f"crowded-{level}")
        return None if found.isEmpty() else found

    def compared(self, bodies: DataFrame) -> DataFrame:
        """For each snippet with covered windows its first place, and the bits of the first and the last."""
        own = bodies.select(*(f.split()[0] for f in SNIPPETS.split(", ")))
        return own.repartition("anchor").sortWithinPartitions("anchor", "key", "which").mapInArrow(_resolved(self.resolve), JUDGED)

    def bits(self, at: Column) -> Column:
        """What was found for a place of a judged snippet."""
        return F.when(_later(at, (F.col("first_order"), F.col("first_start")), self.same_text), F.col("last_bits")).otherwise(F.col("first_bits")).alias("bits")

    def judged(self, folded: DataFrame, level: int) -> DataFrame:
        """As ``compared``; folded: anchor, key, n and the first and last place of each snippet, with their bodies."""
        crowded = self.crowded(folded, level)
        stand = self.both(folded).select("anchor", "key", "which", "at.doc_order", "at.start", "n", "at.body")
        few = self.ws.save(self.compared(stand if crowded is None else stand.join(crowded, "anchor", "left_anti")), f"judged-{level}")
        return few if crowded is None else few.unionByName(self.in_parts(stand.join(crowded, "anchor"), level + 1))

    def in_parts(self, bodies: DataFrame, level: int) -> DataFrame:
        """As ``compared``, by anchors of the level's gram."""
        ws = self.ws
        parts = ws.save(bodies.mapInArrow(_parts(self.units, level), PARTS), f"parts-{level}")
        place = F.struct("doc_order", "start", "body")
        folded = ws.save(parts.groupBy("anchor", "key").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("n").alias("n")), f"folded-{level}")
        found = parts.drop("body").join(self.judged(folded, level), ["anchor", "key"])
        found = found.select("of_anchor", "of_key", "which", "skip", "n", self.bits(F.struct("doc_order", "start"))).where("bits is not null")
        found = found.groupBy(F.col("of_anchor").alias("anchor"), F.col("of_key").alias("key")).agg(F.collect_list(F.struct("which", "skip", "n", "bits")).alias("parts"))
        firsts = bodies.where("which = 0").select("anchor", "key", "n", F.col("doc_order").alias("first_order"), F.col("start").alias("first_start"))
        out = ws.save(found.join(firsts, ["anchor", "key"]).mapInArrow(_rejoined, JUDGED), f"rejoined-{level}")
        ws.drop(*(f"{table}-{level}" for table in ("parts", "folded", "crowded", "judged")), f"rejoined-{level + 1}")
        return out


def covered_runs(rows: DataFrame, units: Units, resolve: Callable, same_text: bool, ws: Workspace) -> DataFrame:
    """doc_order, row_id and marks (array of (start, n, bits)) of the windows that an earlier place holds.

    rows: what ``keyed_rows`` returns.
    resolve: (snippets, numbers of starts, places (doc_order, start)) to a boolean for each window.
    same_text: whether an earlier place in the same document counts.
    """
    row = ["doc_order", "row_id"]
    texts = rows.select(*row, "text")
    if not rows.where("repeated").isEmpty():
        texts = ws.save(texts.groupBy(*row).agg(F.first("text").alias("text")), "once")
    search = _Search(units, resolve, same_text, ws)
    runs = ws.save(texts.mapInArrow(_runs(units), "anchor bigint, doc_order bigint, row_id bigint, start int, n int"), "anchors")
    if same_text:
        often = runs.groupBy("anchor").count().where("count > 1")
    else:
        often = runs.groupBy("anchor").agg(F.min("doc_order").alias("low"), F.max("doc_order").alias("high")).where("low < high")
    often = ws.save(often.select("anchor"), "often")
    grouped = ws.save(runs.join(often, "anchor").groupBy(*row).agg(F.collect_list(F.struct("start", "n", "anchor")).alias("runs")), "runs")
    ws.drop("anchors", "often")
    keys = ws.save(texts.join(grouped, row).mapInArrow(_keys(units), KEYS), "keys")
    ws.drop("runs")
    hot = keys.groupBy("anchor").agg(F.sum(F.size("places")).alias("places")).where(F.col("places") > PART).select("anchor")
    hot = ws.save(hot, "hot")
    none = hot.isEmpty()
    few = (keys if none else keys.join(hot, "anchor", "left_anti")).drop("part")
    found = few.repartition("anchor").sortWithinPartitions("anchor", "key").mapInArrow(_marked(resolve, same_text), MARKS)
    if not none:
        found = found.unionByName(_hot_marks(keys.join(hot, "anchor"), search))
    marks = ws.save(found.groupBy(*row).agg(F.collect_list(F.struct("start", "n", "bits")).alias("marks")), "marks")
    ws.drop("once", "keys", "hot", "folded-0", "crowded-0", "judged-0", "rejoined-1")
    return marks


def _hot_marks(keys: DataFrame, search: _Search) -> DataFrame:
    """The columns of ``MARKS`` for anchors of any number of places: a row for each document, whatever it holds of them."""
    place = lambda x: F.struct(x["doc_order"], x["start"].cast("bigint").alias("start"), F.col("body"))
    first, last = F.min(place(F.col("places")[0])), F.max(place(F.element_at("places", -1)))
    folded = search.ws.save(keys.groupBy("anchor", "key").agg(first.alias("first"), last.alias("last"), F.max("n").cast("bigint").alias("n")), "folded-0")
    found = keys.drop("body").join(search.judged(folded, 0), ["anchor", "key"])
    return found.select("part", "n", "places", *(f.split()[0] for f in JUDGED.split(", ")[2:])).repartition("part").sortWithinPartitions("part").mapInArrow(_gathered(search.same_text), MARKS)


def _gathered(same_text: bool):
    """Snippets sorted by part, with what was found for their first and last place, to a row for each document with covered windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in tb.each(batches):
            part = batch.column("part").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else part
            for lo, hi in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                # a part that a batch cuts stays with its rest
                if held and held[-1].column("part")[0].as_py() != part[lo]:
                    yield from _merged(held, same_text)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from _merged(held, same_text)

    return run


def _merged(held: list[pa.RecordBatch], same_text: bool) -> Iterator[pa.RecordBatch]:
    """The places of one part as one row of ``MARKS`` a document: the windows from its first covered place to the end of its last."""
    rows = pa.Table.from_batches(held).combine_chunks()
    n, first_order, first_start = (rows.column(c).to_numpy() for c in ("n", "first_order", "first_start"))
    places = rows.column("places").combine_chunks()
    order, start, row = (places.flatten().field(i).to_numpy() for i in range(3))
    of = np.repeat(np.arange(len(n)), places.value_lengths().to_numpy())
    later = order > first_order[of]
    if same_text:
        later |= (order == first_order[of]) & (start > first_start[of])
    bits = pa.concat_arrays([*rows.column("first_bits").chunks, *rows.column("last_bits").chunks])
    of += later * len(n)
    some = np.flatnonzero(bits.is_valid().to_numpy(zero_copy_only=False)[of])
    some = some[np.lexsort((start[some], row[some], order[some]))]
    if not len(some):
        return
    order, start, row, of = order[some], start[some].astype(np.int64), row[some], of[some]
    size = np.tile(n, 2)[of].astype(np.int64)
    data, cut = tb.byte_column(bits)
    found, at = np.unpackbits(data).astype(bool), cut[of] * 8
    # the runs of a document have no window in common, so its last one ends last
    head = np.flatnonzero(np.append(True, (order[1:] != order[:-1]) | (row[1:] != row[:-1])))
    ends = np.append(head[1:], len(order))
    begin = start[head]
    length = start[ends - 1] + size[ends - 1] - begin
    for lo, hi in tb.row_blocks(np.append(0, np.cumsum(length))):
        own, wide = slice(head[lo], ends[hi - 1]), length[lo:hi]
        shift = np.repeat(np.cumsum(wide) - wide - begin[lo:hi], ends[lo:hi] - head[lo:hi])
        n_own = size[own]
        covered = np.zeros(int(wide.sum()), dtype=bool)
        covered[np.repeat(start[own] + shift, n_own) + inside(n_own)] = found[np.repeat(at[own], n_own) + inside(n_own)]
        yield pa.RecordBatch.from_arrays([pa.array(order[head[lo:hi]]), pa.array(row[head[lo:hi]]), pa.array(begin[lo:hi].astype(np.int32)), pa.array(wide.astype(np.int32)), _packed(covered, wide)], ["doc_order", "row_id", "start", "n", "bits"])


def keyed_rows(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, doc_order, row_id, text, whether any id stands on several rows, and the columns ``keep`` as a struct ``row`` if any."""
    repeated = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    row_id = F.xxhash64("text") if repeated else F.lit(0).cast("bigint")
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    row = [F.struct(*keep).alias("row")] if keep else []
    return docs.select("doc_id", order.alias("doc_order"), row_id.alias("row_id"), F.lit(repeated).alias("repeated"), "text", *row)


def covered_units(marks: pa.Array, offsets: np.ndarray, window: int) -> np.ndarray:
    """Boolean for each unit of some texts: under a marked window. marks: a list of (start, n, bits) or null for each text."""
    lengths, flat = marks.value_lengths().fill_null(0).to_numpy(), marks.flatten()
    bits, cut = tb.byte_column(flat.field("bits"))
    ones = np.flatnonzero(np.unpackbits(bits))
    mark = np.searchsorted(cut * 8, ones, "right") - 1
    base = np.repeat(offsets[:-1], lengths) + flat.field("start").to_numpy()
    at = base[mark] + ones - cut[mark] * 8
    change = np.bincount(at, minlength=offsets[-1] + 1) - np.bincount(at + window, minlength=offsets[-1] + 1)
    return np.cumsum(change[:-1]) > 0
