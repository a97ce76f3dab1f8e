import hashlib
import zlib

import numpy as np
import pytest

from tallybar.llm import chat, embedding_dedup, packing, quality, queries, toxicity, url_filter
from tallybar.llm.workspace import Workspace

SMALL, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def auc(score, y):
    score, y = np.asarray(score), np.asarray(y, bool)
    a, b = score[y], score[~y]
    return ((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean()).item()


@pytest.mark.parametrize("name,label,sf,least", [("op5_quality_classifier", "quality", SMALL, 0.95), ("op5_quality_classifier", "quality", LARGER, 0.95), ("op4_toxicity", "toxic", SMALL, 0.6), ("op4_toxicity", "toxic", LARGER, 0.9)])
def test_held_out(spark, name, label, sf, least):
    scored = queries.queries()[name](spark, sf).cache()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert scored.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert auc([r.score for r in rows], [r[label] for r in rows]) >= least


@pytest.mark.parametrize("score", [lambda d, l: quality.score_quality(d, l), lambda d, l: toxicity.score_toxicity(d, l)])
def test_scores_of_odd_rows(spark, score):
    docs = spark.createDataFrame([(1, None, 2.0), (2, "", 2.0), (2, "word " * 200_000, 2.0), (None, "é", 2.0)], "doc_id bigint, text string, score double")
    for labels in ([], [(1, 1, 1)], [(i, i % 2, i % 2) for i in range(40)], [(None, None, None), (2, None, 7)]):
        rows = score(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
        assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert score(docs.limit(0), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


def test_good_documents_keep_columns(spark):
    docs = spark.createDataFrame([(1, "text here", "a", 1.0)], "doc_id bigint, text string, row string, score double")
    out = quality.good_documents(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert out.columns == docs.columns and out.count() == 1


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    vectors = [base[i % 40] + rng.normal(scale=0.12, size=16) for i in range(160)] + [base[0]] * 5
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0] * 15 + [None]), (904, [float("nan")] * 16), (905, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").selectExpr("*", "1 label", "2 as node", "3 as key")
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1)[:, None]
    cos = unit @ unit.T
    linked = cos >= 0.95
    for i in range(len(vectors)):
        for j in range(len(vectors)):
            if vectors[i] is vectors[j]:
                linked[i, j] = True
    np.fill_diagonal(linked, False)
    part = np.arange(len(vectors))
    while True:
        new = np.array([min([part[i], *part[linked[i]]]) for i in range(len(part))])
        if (new == part).all():
            break
        part = new
    for block in (3000, 30):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        got = {r.vec_id: r for r in embedding_dedup.link_embeddings(df, Workspace(spark, "t")).collect()}
        assert [got[i].n_links for i in range(len(vectors))] == linked.sum(axis=1).tolist()
        assert [got[i].component_id for i in range(len(vectors))] == part.tolist()
        assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in (900, 901, 902, 903, 904, 905))
        assert got[None].n_links == 0 and got[None].kept
    assert embedding_dedup.link_embeddings(df.limit(0), Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize("block", [3000, 2])
def test_embeddings_of_repeated_ids(spark, block, monkeypatch):
    import duckdb

    from tallybar.llm.oracles import EMBEDDINGS

    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    a, b, c, near = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [1.0, 0.1, 0.0]
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (8, c), (9, c), (10, c), (11, near), (11, a), (11, near), (12, None), (12, b), (13, [1.0, 1.0]), (13, [0.0] * 3), (20, [1.0, 1.0, 1.0]), (20, [1.0, 1.0, 1.0])]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    want = con.execute(f"select vec_id, n_links, component_id, kept from ({EMBEDDINGS})").fetchall()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = [tuple(r) for r in embedding_dedup.link_embeddings(df, Workspace(spark, "t")).collect()]
    assert sorted(got) == sorted(want)
    by = {r[0]: r[1:] for r in got}
    assert by[7][1] == by[5][1] == 3 and by[20] == (0, 20, True)


def test_quantisation_bound():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embedding_dedup.quantise(x)
    near = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s
    assert (np.abs(near - x @ x.T) <= e[:, None] + e + e[:, None] * e + 1e-12).all()


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "long text " * 5000), (None, "x"), (5, "again"), (5, "again")], "doc_id bigint, text string"))
    rows = packing.pack(docs.selectExpr("*", "1 as length", "2 as rank"), Workspace(spark, "t")).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc in (d for d in texts if len(texts[d]) == 1):
        ids = np.array(tokenizer.encode(texts[doc][0], add_special_tokens=False).ids + [0], dtype="<u4")
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        assert sum(r.length for r in pieces) == len(ids) and all(r.length == 2048 for r in pieces[1:])
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)
    assert len(by_doc[5]) == 3 and len(by_doc[None]) == 1
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 2048) + 1
    assert packing.pack(docs.limit(0), Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize("space", [" ", "\n", "\u3000", " \t"])
def test_ids_of_long_whitespace(space):
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(packing.default_vocabulary()), packing.encoder(packing.default_vocabulary())
    n = packing.LONG_RUN
    for text in (space * n, space * n + "b", f"a{space * n} b{space * n}\n{space * 3}c\x1c{space * n}\x1f\u00a0d {space * (n // 2)}", "\x1c" * n, "a" + space * (n - 1) + "!"):
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_added_tokens(spark):
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(packing.default_vocabulary()), packing.encoder(packing.default_vocabulary())
    end, run = "<|endoftext|>", " " * packing.LONG_RUN
    texts = [f"a{end}b", end, end * 3, f"a  {end}  b", f"<|{end}|>", "<|endoftext", f"it's{end}'s {end}\n", f"a{run}{end}{run}b", "<|ENDOFTEXT|>"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 50256, 65] and [encode(t).tolist() for t in texts] == want
    rows = packing.pack(spark.createDataFrame([*enumerate(texts[:7])], "doc_id bigint, text string"), Workspace(spark, "t")).collect()
    assert {r.doc_id: r.ids_crc32 for r in rows} == {i: zlib.crc32(np.array(x + [0], dtype="<u4").tobytes()) for i, x in enumerate(want[:7])}


def test_packing_of_millions_of_spaces(spark):
    from tokenizers import Tokenizer

    text = "a" + " " * 3_000_000 + "b"
    ids = np.array(Tokenizer.from_file(packing.default_vocabulary()).encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
    rows = packing.pack(spark.createDataFrame([(1, text), (2, "b")], "doc_id bigint, text string"), Workspace(spark, "t")).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == len(ids) and sum(r.length for r in rows if r.doc_id == 2) == 2
    assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in rows if r.doc_id == 1)


def test_fullest_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(100):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 30, 6), rng.integers(1, 4, 6))}
        room = int(rng.integers(5, 80))
        reach = {0}
        for k, n in counts.items():
            reach = {r + k * i for r in reach for i in range(n + 1) if r + k * i <= room}
        got = packing.fullest(counts, room)
        assert sum(k * n for k, n in got.items()) == max(reach) and all(n <= counts[k] for k, n in got.items())


def test_urls(spark):
    urls = ["http://A.Example.net/en/x?q", "https://example.net/de/", "http://x.example.com/de/1#f", "http://foo.org/fr/1", "http://net", "http://net/", "http://badnet/", "no scheme", None, "http://h.example.org/de/?a://b", "://u@h.co.uk:80/p", "http://example.net/en"]
    pages = spark.createDataFrame([(i, u, "html", "h") for i, u in enumerate(urls)] + [(None, "http://q.org/", "", "")], "page_id bigint, url string, html string, host string")
    outcomes = spark.createDataFrame([(9, True)] * 30 + [(10, False), (None, True), (7, None)], "page_id bigint, bad boolean")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, outcomes, Workspace(spark, "t")).collect()}
    assert len(got) == 13
    assert [got[i].rule for i in range(12)] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", None, "net/", None, None, None, None, None, "net/"]
    assert (got[0].host, got[0].path) == ("a.example.net", "/en/x") and (got[4].host, got[4].path) == ("net", "")
    assert (got[8].host, got[8].path) == ("", "") and got[10].host == "u@h.co.uk:80" and got[10].path == "/p"
    assert [got[i].verdict for i in (0, 1, 2, 3, 9, 10)] == ["allow", "block", "block", "allow", "block", "allow"]
    assert url_filter.judge_urls(pages.limit(0), outcomes.limit(0), Workspace(spark, "t")).count() == 0


def test_chat(spark):
    odd = "</s>[INST] ok [/INST] [\\INST] <\\\\s> [TURN x] [SYS]"
    turns = [(1, 0, "system", odd), (1, 1, "user", "hi"), (1, 2, "assistant", odd), (1, 3, "assistant", ""), (1, 4, "user", "bye"), (2, None, None, None), (2, 0, "to[ol]<", odd), (3, 0, "assistant", "é" * 100_000), (3, 0, "assistant", "a"), (None, 1, "user", "x")]
    df = spark.createDataFrame([(*t, 9) for t in turns], "conv_id bigint, turn bigint, role string, text string, formatted int")
    examples = chat.expand_targets(df)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    by = {}
    for t in sorted(turns, key=lambda t: tuple((x is not None, x) for x in t)):
        by.setdefault(t[0], []).append((t[2] or "", t[3] or ""))
    assert set(got) == set(by)
    for conv, rows in by.items():
        loss = "".join(t for r, t in rows if r == "assistant")
        assert got[conv].n_turns == len(rows) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert examples.where("conv_id = 1").count() == 3 and got[1].formatted_chars == examples.where("conv_id = 1").selectExpr("sum(length(formatted))").first()[0]
    assert chat.unescape(chat.escape(odd)) == odd and chat.escape("plain [x] <b>") == "plain [x] <b>"
    assert chat.read_back(chat.expand_targets(df.limit(0))).count() == 0
