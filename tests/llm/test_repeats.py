import random
import sys
import weakref
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tallybar.llm import bagminhash, decontaminate, repeats, substring_trees, suffix_array  # noqa: E402
from tallybar.llm.workspace import Workspace  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = "doc_id bigint, text string, count string, row string, marks string, rep int, anchor int, score double, held_out int, spans string, n_words int"


def words(rng, n):
    return [rng.choice(["idle", "éau", "tion", "über", "of", "the", "re"]) + rng.choice(["an", "ñ", "ing", "er", ""]) + str(rng.randint(0, 60)) for _ in range(n)]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    passage = " ".join(words(rng, 90))
    base = words(rng, 300)
    out = [(0, None), (1, ""), (2, "x"), (3, " \n\t "), (4, "a" * 400), (5, "ab" * 300)]
    for i in range(6, 30):
        out.append((i, " ".join(words(rng, rng.randint(1, 200)))))
    for i in range(30, 45):  # near copies
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 9))
        out.append((i, " ".join(w)))
    out += [(i, " ".join(base)) for i in range(45, 50)]
    out += [(i, " ".join(words(rng, 20)) + "\n" + passage + " " + " ".join(words(rng, 30))) for i in range(50, 62)]
    out += [(62, passage + " " + passage), (63, " ".join(words(rng, 30_000)) + " " + passage)]
    rng.shuffle(out)
    return out


def frame(spark, docs, partitions=5):
    return spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], SCHEMA).repartition(partitions)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r))


def expected(found):
    return sorted(found, key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("part", [repeats.PART, 3])
def test_byte_repeats(spark, docs, part, monkeypatch):
    monkeypatch.setattr(repeats, "PART", part)
    small = [d for d in docs if d[0] != 63] + [(63, "b" * 130 + "é" * 60)]
    assert rows(suffix_array.remove_repeats(frame(spark, small), Workspace(spark, "t"))) == expected(brute.byte_repeats(small))


@pytest.mark.parametrize("part", [repeats.PART, 3])
def test_word_repeats(spark, docs, part, monkeypatch):
    monkeypatch.setattr(repeats, "PART", part)
    assert rows(substring_trees.remove_repeats(frame(spark, docs), Workspace(spark, "t"))) == expected(brute.word_repeats(docs))


def test_repeated_and_null_ids(spark):
    text = " ".join(words(random.Random(1), 80))
    docs = [(None, text), (1, text), (1, text), (1, text + " more"), (2, None), (None, None), (2, text)]
    got = rows(suffix_array.remove_repeats(frame(spark, docs, 2), Workspace(spark, "t")))
    assert got == expected(brute.byte_repeats(docs))
    got = rows(substring_trees.remove_repeats(frame(spark, docs, 2), Workspace(spark, "t")))
    assert got == expected(brute.word_repeats(docs))


@pytest.mark.parametrize("remove,plain", [(suffix_array.remove_repeats, brute.byte_repeats), (substring_trees.remove_repeats, brute.word_repeats)])
def test_many_equal_rows_are_one_place(spark, remove, plain, monkeypatch):
    text = " ".join(words(random.Random(21), 400))
    save, sizes = Workspace.save, {}

    def counted(self, df, name):
        out = save(self, df, name)
        if name == "keys":
            sizes.setdefault(n, []).append((out.count(), out.selectExpr("sum(size(places))").first()[0]))
        return out

    monkeypatch.setattr(Workspace, "save", counted)
    for n in (25, 100, 1000):
        docs = [(1, text)] * n + [(2, text), (3, "new " + text)]
        got = rows(remove(frame(spark, docs, 3), Workspace(spark, "t")))
        assert got[-2:] == rows_of(plain, docs)[-2:] and len(got) == n + 2 and got[0] == got[n - 1]
    assert sizes[25][0][1] == sizes[100][0][1] == sizes[1000][0][1]


def rows_of(plain, docs):
    return expected(plain(docs[:1] + docs[-2:]))


def test_equal_rows_in_the_pipeline_stage(spark):
    text = " ".join(words(random.Random(22), 60))
    left = suffix_array.drop_repeats(frame(spark, [(4, text)] * 50 + [(5, text + " tail of it")], 3), Workspace(spark, "t")).collect()
    assert sorted(r.doc_id for r in left) == [4] * 50 + [5] and {r.text for r in left if r.doc_id == 4} == {text}


def test_extra_columns_with_clashing_names(spark, docs):
    few = [d for d in docs if d[0] != 63][:40]
    df = spark.createDataFrame([(d, t, "x", "y", "z", 1, 2, 0.5, 3, "s", 4) for d, t in few], CLASH)
    assert rows(suffix_array.remove_repeats(df, Workspace(spark, "t"))) == expected(brute.byte_repeats(few))
    assert rows(substring_trees.remove_repeats(df, Workspace(spark, "t"))) == expected(brute.word_repeats(few))
    assert suffix_array.drop_repeats(df, Workspace(spark, "t")).columns == df.columns


def test_one_passage_in_many_different_texts(spark, monkeypatch):
    rng, passage = random.Random(23), " ".join(words(random.Random(24), 70))
    docs = [(i, f"{rng.random()} {rng.random()} {passage} {rng.random()}") for i in range(120)]
    monkeypatch.setattr(repeats, "PART", 10)
    assert rows(suffix_array.remove_repeats(frame(spark, docs), Workspace(spark, "t"))) == expected(brute.byte_repeats(docs))
    assert rows(substring_trees.remove_repeats(frame(spark, docs), Workspace(spark, "t"))) == expected(brute.word_repeats(docs))


@pytest.mark.parametrize("remove,plain", [(suffix_array.remove_repeats, brute.byte_repeats), (substring_trees.remove_repeats, brute.word_repeats)])
def test_hot_places_are_one_row_a_document(spark, remove, plain, monkeypatch):
    rng = random.Random(26)
    passage, other = (" ".join(words(rng, 150)) for _ in range(2))
    docs = [(i, f"{rng.random()} {passage} {rng.random()}") for i in range(60)]
    docs += [(i, f"{other} {rng.random()} {passage} {rng.random()} {passage}") for i in range(60, 80)]
    docs += [(3, f"again {passage}"), (3, f"{passage} {other}"), (None, f"no id {passage}"), (90, " ".join(words(rng, 9000)) + " " + passage), (91, "short"), (92, None)]
    rng.shuffle(docs)
    hot, made = repeats._hot_marks, []

    def counted(keys, search):
        out = search.ws.save(hot(keys, search), "counted")
        made.append((keys.selectExpr("sum(size(places))").first()[0], out.count(), out.select("doc_order", "row_id").distinct().count()))
        return out

    monkeypatch.setattr(repeats, "PART", 10)
    monkeypatch.setattr(repeats, "_hot_marks", counted)
    for size in ("7", "10000"):  # batches of a few rows also cut what belongs together
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert rows(remove(frame(spark, docs, 3), Workspace(spark, "t"))) == expected(plain(docs))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        places, out, documents = made[-1]
        assert places > 2 * len(docs) and 60 < out == documents <= len(docs)


def test_a_long_text(spark):
    rng = random.Random(25)
    long = " ".join(words(rng, 60_000))
    got = rows(suffix_array.remove_repeats(frame(spark, [(1, long), (2, long[1000:]), (3, long[-300:] + "!")], 3), Workspace(spark, "t")))
    assert [r[1:4] for r in got] == [(len(long.encode()), 0, 0), (len(long[1000:].encode()),) * 2 + (1,), (len(long[-300:].encode()) + 1, len(long[-300:].encode()), 1)]


def test_empty_table(spark):
    none = frame(spark, [])
    assert suffix_array.remove_repeats(none, Workspace(spark, "t")).count() == 0
    assert substring_trees.remove_repeats(none, Workspace(spark, "t")).count() == 0
    assert bagminhash.near_duplicates(none, Workspace(spark, "t")).count() == 0
    assert suffix_array.drop_repeats(none, Workspace(spark, "t")).columns == none.columns


def test_two_stage_order():
    rng = random.Random(2)
    for _ in range(200):
        depth = rng.choice([4, 9, 20])
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(depth, depth + 25))) for _ in range(rng.randint(1, 6))]
        text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        wanted = np.zeros(len(text), dtype=bool)
        at = 0
        for p in pieces:
            wanted[at : at + len(p) - depth + 1] = True
            at += len(p) + 1
        array, packed = suffix_array.suffix_array(text, wanted, depth)
        keys = [text[i : i + depth].tobytes() for i in array]
        assert sorted(array) == np.flatnonzero(wanted).tolist() and keys == sorted(keys)
        lengths = suffix_array.adjacent_prefixes(packed, array, depth)
        for a, b, n in zip(keys, keys[1:], lengths[1:]):
            assert n == next((i for i in range(depth) if a[i] != b[i]), depth)


def test_small_tree_groups():
    rng = random.Random(4)
    base = [b"w%d" % rng.randint(0, 3) for _ in range(300)]
    places = [(d, 0) for d in range(6)]
    snippets = [b" ".join(base[d * 3 : d * 3 + 8 + 20]) for d in range(6)]
    starts = [21] * 6
    whole = substring_trees.covered_windows(snippets, starts, places, 8)
    assert (whole == substring_trees.covered_windows(snippets, starts, places, 8, 4)).all() and whole.any() and not whole.all()


def test_groups_have_prefixes_of_several_lengths():
    rng = np.random.default_rng(6)
    text = rng.choice(4, 3000, p=[0.7, 0.1, 0.1, 0.1]).astype(np.uint32)
    text[500:900] = 0
    groups = list(substring_trees.prefix_groups(text, np.arange(2900), 20, 50))
    assert len(groups) > 10 and len({shared for shared, _ in groups}) > 3
    assert sorted(x for _, part in groups for x in part.tolist()) == list(range(2900))
    for shared, part in groups:
        assert len(part) <= 50 or shared == 20
        assert len({text[x : x + shared].tobytes() for x in part}) == 1


def test_tree_nodes():
    rng = random.Random(3)
    for _ in range(100):
        keys = sorted(tuple(rng.randrange(2) for _ in range(6)) for _ in range(rng.randint(1, 30)))
        common = np.array([0] + [next((i for i in range(6) if a[i] != b[i]), 6) for a, b in zip(keys, keys[1:], strict=False)])
        tree = substring_trees.Tree(common)
        nodes = {(d, a, b) for d, a, b in zip(tree.depth.tolist(), tree.first.tolist(), tree.end.tolist(), strict=True)}
        want = {(0, 0, len(keys))}
        for a in range(len(keys)):
            for b in range(a + 2, len(keys) + 1):
                depth = int(common[a + 1 : b].min())
                if common[a] < depth and (b == len(keys) or common[b] < depth):
                    want.add((depth, a, b))
        assert nodes == want
        for i in range(1, len(tree.depth)):
            p = tree.parent[i]
            assert tree.depth[p] < tree.depth[i] and tree.first[p] <= tree.first[i] and tree.end[i] <= tree.end[p]
        for least in range(1, 7):
            deep = [(a, b) for d, a, b in want if d >= least]
            assert sorted(map(tuple, tree.deep_nodes(least).tolist())) == sorted(x for x in deep if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in deep))


def test_drop_repeats_keeps_characters(spark):
    text = "é" * 30 + " ".join(words(random.Random(7), 40))
    docs = [(1, "x" + text), (2, "yy" + text + "é tail"), (3, text), (4, ""), (5, None)]
    got = {r.doc_id: r for r in suffix_array.drop_repeats(frame(spark, docs, 2), Workspace(spark, "t")).collect()}
    assert got[1].text == "x" + text and 3 not in got and got[4].text == "" and got[5].text is None
    assert got[2].text.startswith("yy") and got[2].text.endswith("tail") and got[2].n_chars == len(got[2].text) < 20


@pytest.mark.parametrize("block", [bagminhash.BLOCK, 700])
def test_near_duplicates(spark, docs, block, monkeypatch):
    monkeypatch.setattr(bagminhash, "BLOCK", block)
    got = {r.doc_id: r for r in bagminhash.near_duplicates(frame(spark, docs), Workspace(spark, "t")).collect()}
    want = brute.near_classes(docs)
    assert {d: r.class_id for d, r in got.items()} == want
    assert all(r.kept == (r.class_id == d) for d, r in got.items())


def test_near_duplicates_in_blocks_of_few_texts(spark, docs, monkeypatch):
    monkeypatch.setattr(bagminhash, "TEXTS", 3)
    got = bagminhash.near_duplicates(frame(spark, docs), Workspace(spark, "t")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute.near_classes(docs)


def test_short_texts_with_a_common_line_meet_in_tiles(spark, monkeypatch):
    save, tiles = Workspace.save, []

    def counted(self, df, name):
        out = save(self, df, name)
        if name == "dealt":
            tiles.extend(r["count"] for r in out.groupBy("band", "i", "j").count().collect())
        return out

    monkeypatch.setattr(bagminhash, "TEXTS", 8, raising=False)
    monkeypatch.setattr(Workspace, "save", counted)
    line = [(i, f"this page was not found x{i}") for i in range(3000)]
    got = bagminhash.near_duplicates(frame(spark, line), Workspace(spark, "t")).collect()
    assert all(r.kept for r in got) and len(got) == 3000
    assert len(tiles) > 500 and max(tiles) <= 48  # two blocks, of about 8 texts each


def test_signing_short_texts_takes_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    texts = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array([f"this page was not found x{i}" for i in range(10_000)])], ["doc_id", "text"])
    tracemalloc.start()
    try:
        signed = sum(x.num_rows for x in bagminhash._sign(iter([texts])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert signed == 10_000 and peak < 250e6, peak


def test_near_duplicate_odd_rows(spark):
    text = " ".join(words(random.Random(8), 60))
    docs = [(1, text), (1, text), (2, text), (None, text), (3, None), (4, ""), (5, "two words"), (6, "two  words")]
    df = spark.createDataFrame([(d, t, "x", "y", "z", 1, 2, 0.5, 3, "s", 4) for d, t in docs], CLASH)
    got = sorted(((r.doc_id or 0, r.class_id, r.kept) for r in bagminhash.near_duplicates(df, Workspace(spark, "t")).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (0, None, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 5, False)], key=str)
    left = bagminhash.first_of_each_class(df, Workspace(spark, "t"))
    assert left.columns == df.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 3, 4, 5]


def test_all_pairs_of_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(docs, Workspace(spark, "t")).collect()}
    want = brute.near_classes([tuple(r) for r in docs.collect()])
    assert got == want and len(set(want.values())) < len(want)


def test_different_texts_are_not_folded(spark):
    order = [bin(i).count("1") % 2 for i in range(1024)]  # polynomial hashes of these two collide
    docs = [(i, " ".join("ab"[x ^ i] for x in order)) for i in (0, 1)]
    got = bagminhash.near_duplicates(frame(spark, docs, 2), Workspace(spark, "t")).collect()
    assert [r.n_copies for r in got] == [1, 1]


def test_first_of_each_class_by_row(spark):
    x, y, z = (" ".join(words(random.Random(seed), 60)) for seed in (11, 12, 13))
    docs = [(3, x), (9, x), (9, y), (9, y), (5, z), (6, z + " more"), (6, None), (None, x)]
    left = bagminhash.first_of_each_class(frame(spark, docs, 3), Workspace(spark, "t"))
    assert left.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert got == sorted([(3, x), (9, y), (5, z), (6, None), (None, x)], key=str)
    left = bagminhash.first_of_each_class(frame(spark, [(3, x), (9, x), (9, y)], 2), Workspace(spark, "t"))
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(3, x), (9, y)]


def test_signature_estimates_weighted_overlap():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    left = np.concatenate([a, a[:50], a[:50]])  # some weights of 3
    right = np.concatenate([a[:380], a[:50]])
    sig = bagminhash.signatures(np.concatenate([left, right]), np.repeat([0, 1], [len(left), len(right)]), 2)
    true = 430 / 500
    assert abs((sig[0] == sig[1]).mean() - true) < 0.12 and bagminhash.overlap(np.sort(left), np.sort(right)) == true


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 15])
def test_contamination(spark, docs, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    texts = dict(docs)
    items = [(7, " ".join(texts[62].split()[3:40]).upper()), (10, " ".join(texts[20].split()[:4])), (11, ""), (12, None), (13, "never seen words at all"), (2, texts[50]), (2, texts[50]), (None, "x")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    got = rows(decontaminate.contamination(frame(spark, docs), bench, Workspace(spark, "t")))
    assert got == expected(brute.contamination(docs, [x for x in items if x[0] is not None]))
    clean = decontaminate.clean_documents(frame(spark, docs), bench, Workspace(spark, "t"))
    assert clean.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in got if not r[5])


def test_one_benchmark_block_at_a_time(spark, docs, monkeypatch):
    texts, alive, most, sizes = dict(docs), weakref.WeakSet(), [], []
    build = decontaminate.Queries.__init__

    def counted(self, items, window):
        alive.add(self)
        most.append(len(alive))
        sizes.append(sum(len(h) for _, h in items))
        build(self, items, window)

    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    monkeypatch.setattr(decontaminate.Queries, "__init__", counted)
    items = [(i, texts[i]) for i in (20, 50, 62)] + [(1, "short one"), (2, None), (3, "")]
    found = decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), Workspace(spark, "t"))
    assert len(most) > 3 and max(most) == 1 and max(sizes) <= 40
    assert rows(found) == expected(brute.contamination(docs, items))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one two x three four"), (2, "four three two one"), (3, "one two"), (4, "one two three four")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(9, "one two three four")], "item_id bigint, text string")
    found = lambda slop: sorted(r.doc_id for r in decontaminate.find_benchmark(docs, bench, Workspace(spark, "t"), 10, slop).where("size(items) > 0").collect())
    assert found(None) == [4] and found(1) == [1, 4] and found(5) == [1, 4] and found(6) == [1, 2, 4]


def postings(queries, *texts):
    """The postings of one segment that a search over ``queries`` gets."""
    hashes, rows = decontaminate.words_of(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]))
    lists = list(decontaminate.segment_postings(hashes))
    terms, counts, places = (np.concatenate([x[i] for x in lists] or [np.empty(0, t)]) for i, t in ((1, np.uint64), (2, np.int32), (3, np.int32)))
    ours = np.isin(terms, queries.terms)
    return decontaminate.Postings(np.searchsorted(queries.terms, terms[ours]), counts[ours].astype(np.int64), places[np.repeat(ours, counts)], len(queries.terms), np.searchsorted(rows, np.arange(len(texts))), len(rows))


def test_postings():
    hashes = np.random.default_rng(0).integers(0, 2**64, 50, dtype=np.uint64)[np.random.default_rng(1).integers(0, 50, 4000)]
    seen = {}
    for bucket, terms, counts, places in decontaminate.segment_postings(hashes):
        assert (decontaminate.bucket_of(terms) == bucket).all() and (np.diff(terms.astype(object)) > 0).all()
        for term, own in zip(terms.tolist(), np.split(places, np.cumsum(counts)[:-1]), strict=True):
            seen[term] = own.tolist()
    assert seen == {t: np.flatnonzero(hashes == np.uint64(t)).tolist() for t in set(hashes.tolist())}


def test_indexing_takes_bounded_memory(monkeypatch):
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(decontaminate, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = random.Random(31)
    texts = ["", None, *(" ".join(words(rng, 300)) for _ in range(3000)), ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    data, offsets = decontaminate.tb.byte_column(batch.column("text"))
    assert len(data) > decontaminate.SEGMENT_BYTES
    whole = decontaminate.words_of(data, offsets)
    assert all((a == b).all() for a, b in zip(decontaminate.segment_words(data, offsets), whole, strict=True))
    monkeypatch.setattr(decontaminate.tb, "_powers", {})
    tracemalloc.start()
    try:
        found = list(decontaminate._indexed(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    postings = sum(sum(np.frombuffer(x.as_py(), np.int32).sum() for x in b.column("counts")) for b in found)
    assert postings == len(whole[0]) and peak < 100e6, peak


def test_one_index_for_many_searches(spark, docs):
    texts = dict(docs)
    index = decontaminate.build_index(frame(spark, docs), Workspace(spark, "t"))
    for i in (20, 50):
        bench = spark.createDataFrame([(7, texts[i])], "item_id bigint, text string")
        hits = {r.doc_id for r in index.texts().join(index.matches(bench), ["segment", "place"]).collect()}
        assert hits == {r[0] for r in brute.contamination(docs, [(7, texts[i])]) if r[5]}


def test_proximity_in_adjacent_texts():
    queries = decontaminate.Queries([(9, decontaminate.words_of(np.frombuffer(b"one two three four", np.uint8), np.array([0, 18]))[0])], 10)

    def found(slop, *texts):
        found = decontaminate.find(postings(queries, *texts), queries, slop)
        return [found[i][1] if i in found else [] for i in range(len(texts))]

    phrase = "one two three four"
    assert found(2, "ends in two", phrase) == [[], [9]] and found(2, phrase, "three four two one") == [[9], []]
    assert found(1, "two three four", phrase, "two three four") == [[], [9], []] and found(3, "one two", "three four") == [[], []]
    rng, terms = random.Random(5), phrase.split()
    for _ in range(300):
        texts = [" ".join(rng.choice([*terms, "x"]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 5))]
        for slop in (0, 1, 2, 5):
            assert [bool(x) for x in found(slop, *texts)] == [near(t.split(), texts, terms, slop) for t in texts]


def near(words, texts, terms, slop):
    """Whether each term stands at most ``slop`` off its place, as seen from the term that is rarest in all texts."""
    counts = [sum(t.split().count(x) for t in texts) for x in terms]
    first = counts.index(min(counts))
    return any(w == terms[first] and all(x in words[max(0, i - first + k - slop) : max(0, i - first + k + slop + 1)] for k, x in enumerate(terms)) for i, w in enumerate(words))


def test_empty_benchmark(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(frame(spark, docs), none, Workspace(spark, "t")).where("contaminated").count() == 0
    assert decontaminate.contamination(frame(spark, []), none, Workspace(spark, "t")).count() == 0
