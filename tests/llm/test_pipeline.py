import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tallybar.llm import labelled, packing, quality  # noqa: E402

TINY = "/root/testdata/sf0.001"
CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, marks int, score double, anchor string, rep int, spans string, segment int, n_words int, text_md5 string, kept_text string, k1 int"


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return [f for _, f in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def passed(spark, stages):
    """The rows before each stage and after the last."""
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    out = [docs.collect()]
    for stage in stages[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, TINY).collect(), docs.schema)
        out.append(docs.collect())
    return [*out, stages[-1](spark, docs, TINY).collect()]


def test_quality_stage(spark, passed):
    labels = spark.read.parquet(f"{TINY}/labels.parquet")
    model = quality.train(labelled.fitting_sample(spark.read.parquet(f"{TINY}/documents.parquet"), labels, "quality"))

    def score(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return 1 / (1 + np.exp(-quality.logits(raw, np.array([0, len(raw)]), *model)[0]))

    assert sorted(passed[1]) == sorted(r for r in passed[0] if score(r.text) >= 0.3) and len(passed[1]) < len(passed[0])


def test_near_duplicate_stage(passed):
    classes = brute.near_classes([(r.doc_id, r.text) for r in passed[1]])
    assert sorted(passed[2]) == sorted(r for r in passed[1] if classes[r.doc_id] == r.doc_id) and len(passed[2]) < len(passed[1])


def test_repeats_stage(passed):
    want = {d: t for d, t in brute.without_repeats([(r.doc_id, r.text) for r in passed[2]]) if t != "" or dict((r.doc_id, r.text) for r in passed[2])[d] == ""}
    assert {r.doc_id: r.text for r in passed[3]} == want and all(r.n_chars == len(r.text or "") for r in passed[3])
    assert any(r.text != t for r, t in zip(passed[2], (want.get(r.doc_id) for r in passed[2]), strict=True))


def test_decontamination_stage(spark, passed):
    items = [tuple(r) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {r[0] for r in brute.contamination([(r.doc_id, r.text) for r in passed[3]], items) if r[5]}
    assert sorted(passed[4]) == sorted(r for r in passed[3] if r.doc_id not in hit)


def test_packing_stage(passed):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    pieces, bins = {}, {}
    for r in passed[5]:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == {r.doc_id for r in passed[4]}
    for r in passed[4]:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted(pieces[r.doc_id], key=lambda p: p.piece)
        assert sum(p.length for p in own) == len(ids) and all(p.length == 2048 for p in own[1:])
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)
    for parts in bins.values():
        ends = np.cumsum([0, *(n for _, n in sorted(parts))])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 2048


def test_run_is_the_stages_in_turn(spark, passed):
    import corpus_pipeline

    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, TINY).collect())) == sorted(map(key, passed[5]))


def test_odd_rows(spark, stages):
    """Null and empty texts, nulls elsewhere, repeated rows, ties, a long text, and columns with clashing names go through every stage."""
    other = (None,) * 11
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the same words " * 20, None, "s", None), (3, "the same words " * 20, None, "s", None), (None, "no id here", "en", None, 1), (4, "é" * 50_000, "fr", "s", 50_000)]
    docs = spark.createDataFrame([(*r, *other) for r in rows], CLASH)
    for stage in stages[:-1]:
        out = stage(spark, docs, TINY)
        assert out.columns == docs.columns and out.count() <= docs.count()
        docs = spark.createDataFrame(out.collect(), docs.schema)
    packed = stages[-1](spark, docs, TINY)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_stages_on_nothing(spark, stages):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for stage in stages:
        assert stage(spark, docs, TINY).count() == 0
