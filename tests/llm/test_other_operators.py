"""Vectors, archives, conversations and the pipeline."""

import base64
import gzip
import hashlib
import io
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from heliograph.llm import ann_projection, chat_collapse, exact_topk, ngram_join, warc_transactions
from heliograph.llm.common import fresh_path

VECTORS = "vec_id long, embedding array<float>, label int, score double"


def vectors(spark, extra=(), n=400, d=16, seed=3):
    random = np.random.default_rng(seed)
    x = random.normal(size=(n, d)).astype(np.float32)
    x[50:90] = x[50]  # many equal vectors
    rows = [(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], VECTORS), x.astype(float)


ODD = [(1000, None, 0, 0.0), (1020, [float("nan")] * 16, 0, 0.0), (1040, [1.0] * 15 + [None], 0, 0.0), (1060, [float("inf")] * 16, 0, 0.0), (1080, [], 0, 0.0), (1100, [1.0, 2.0], 0, 0.0)]


def nearest(scores, own, k):
    order = sorted((i for i in range(len(scores)) if i != own), key=lambda i: (-scores[i], i))[:k]
    return [(i, scores[i]) for i in order]


def test_exact_top_k(spark):
    frame, x = vectors(spark, ODD)
    whole = np.floor(1024 * x).astype(np.int64)
    got = {}
    for r in exact_topk.search(frame, frame.where("vec_id % 20 = 0"), 10, shard=64, block=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: nearest((whole @ whole[q]).tolist(), q, 10) for q in range(0, 400, 20)}
    few = exact_topk.search(frame.where("vec_id < 3"), frame.where("vec_id = 0"), 10).collect()
    assert len(few) == 2
    assert exact_topk.search(frame.where("false"), frame.where("false")).count() == 0


def test_exact_products_of_large_numbers():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20 + 1, 5.0]])
    assert exact_topk.exact_products(a, b)[0, 0] == 2**40 * (2**20 + 1) + 15


def test_projection_search_finds_the_nearest(spark):
    frame, x = vectors(spark, [*ODD, (1200, [0.0] * 16, 0, 0.0)])
    rows = ann_projection.search(frame, frame.where("vec_id % 20 = 0"), 20, shard=128, block=8).collect()
    hits = 0
    for q in range(0, 400, 20):
        mine = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [r[0] for r in mine] == list(range(1, 21)) and all(math.isclose(s, x[v] @ x[q], abs_tol=1e-9) for _, v, s in mine)
        assert all((-a[2], a[1]) <= (-b[2], b[1]) for a, b in zip(mine, mine[1:], strict=False))
        hits += len({v for _, v, _ in mine} & {v for v, _ in nearest((x @ x[q]).tolist(), q, 20)})
    assert hits >= 0.9 * 400


def tailed(n=12000, d=32, seed=5):
    """Unit vectors about four centres, at distances of many magnitudes."""
    random = np.random.default_rng(seed)
    x = random.normal(size=(4, d))[random.integers(4, size=n)] + 0.3 * np.exp(random.normal(size=(n, 1)) * 3 - 1) * random.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_projection_recall_where_the_stop_fires(spark, monkeypatch):
    assert ann_projection.STOP == 0.97
    x, asked = tailed(), range(0, 12000, 20)
    frame = spark.createDataFrame([(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)], VECTORS)
    got = {}
    for r in ann_projection.search(frame, frame.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = x.astype(float)
    want = {q: set(np.argsort(-np.where(np.arange(12000) == q, -2, x @ x[q]), kind="stable")[:20].tolist()) for q in asked}
    assert sum(len(got[q] & want[q]) for q in asked) >= 0.9995 * 20 * len(asked)

    class Leaves(list):
        read = 0

        def __getitem__(self, i):
            Leaves.read += 1
            return super().__getitem__(i)

    class Counted(ann_projection.KdTree):
        def __init__(self, *a):
            super().__init__(*a)
            self.leaves = Leaves(self.leaves)
            Leaves.all = len(self.leaves)

    monkeypatch.setattr(ann_projection, "KdTree", Counted)
    at = np.array(asked)
    ann_projection.search_shard(np.arange(12000), x, at, x[at], 20, ann_projection.STOP, ann_projection.M, ann_projection.LEAF)
    assert ann_projection.FIRST_LEAVES * len(at) < Leaves.read < 0.75 * Leaves.all * len(at)


def test_searches_of_repeated_ids_and_nothing(spark):
    """op2 and op8: repeated ids are candidates each; queries of one id are ranked together; empty tables give nothing."""
    x = np.random.default_rng(9).normal(size=(60, 8)).round(2)
    rows = [(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)] + [(20, x[20].tolist(), 0, 0.0)] * 30 + [(40, x[20].tolist(), 0, 0.0)] + [(7, x[7].tolist(), 0, 0.0)] * 5 + [(None, x[7].tolist(), 0, 0.0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score double").repartition(3)
    known = [r for r in rows if r[0] is not None]
    queries = frame.where("vec_id in (0, 20)").dropDuplicates(["vec_id"])
    for search, vector, k in ((ann_projection.search, lambda v: np.array(v), 4), (exact_topk.search, lambda v: np.floor(1024 * np.array(v)), 4)):
        got = {}
        for r in search(frame, queries, k, shard=16, block=1).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
        for q in (0, 20):
            best = sorted((-round(float(vector(v) @ vector(x[q].tolist())), 6), i) for i, v, _, _ in known if i != q)[:k]
            assert got[q] == [(i, -s) for s, i in best]
        assert got[20][0][0] == 40
        both = search(frame, frame.where("vec_id = 20").limit(2), k).collect()
        assert sorted(r["rank"] for r in both) == [1, 2, 3, 4] and {r.vec_id for r in both if r["rank"] <= 2} == {40}
        assert search(frame.where("false"), frame.where("false"), k).count() == 0 and search(frame, frame.where("false"), k).count() == 0


def test_projection_search_reads_little_of_clusters():
    random = np.random.default_rng(1)
    x = random.normal(size=(300, 64))[random.integers(300, size=30_000)] + 0.35 * random.normal(size=(30_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    shard, hits = ann_projection.Shard(np.arange(len(x)), x, 20, ann_projection.M, ann_projection.LEAF), 0
    for q in range(0, len(x), 300):
        got, _ = shard.search(q, x[q], ann_projection.stop_ratio())
        hits += len(set(got.tolist()) & {i for i, _ in nearest((x @ x[q]).tolist(), q, 20)})
    assert hits >= 0.99 * 2000 and shard.verified < 0.3 * 100 * len(x)


def test_chi_square():
    assert np.isclose(ann_projection.chi_square(7.344, 8), 0.5, atol=1e-3) and np.isclose(ann_projection.chi_square(ann_projection.stop_ratio(0.9, 8), 8), 0.9)
    with pytest.raises(ValueError, match="even"):
        ann_projection.search(None, None, m=3)


PAGES = [(5, "http://a/\r\nx", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (9, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (7, "http://e", "z" * 300_000)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, type string")


def test_archives(spark):
    frame = pages(spark)
    got = {r["metadata"]["capture_id"]: r for r in warc_transactions.write_and_read(frame).collect()}
    first = {}
    for i, _, h in sorted(PAGES):
        first.setdefault(h or "", i)
    for i, url, h in PAGES:
        r, raw = got[i], (h or "").encode()
        assert (r.held_bytes, r.held_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert r.response["type"] == ("response" if first[h or ""] == i else "revisit")
        assert r.response.refers_to == (None if first[h or ""] == i else f"<urn:heliograph:response:{first[h or '']}>")
        assert r.request.uri == r.response.uri == warc_transactions.one_line(url)
    assert warc_transactions.write_and_read(pages(spark, []).where("true")).count() == 0


REPEATED = [(1, "http://a", "x"), (1, "http://a", "x"), (1, "http://b", "x"), (1, "http://c", "y"), (2, "http://d", "y"), (2, "http://e", "w"), (None, "http://f", "x"), (None, "http://g", "z"), (None, "http://g", "z")]


def test_archives_of_repeated_and_null_page_ids(spark):
    got = warc_transactions.write_and_read(pages(spark, REPEATED).repartition(3)).collect()
    code = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert sorted((repr(r.metadata.capture_id), r.response.uri, r.held_bytes, r.held_digest) for r in got) == sorted((repr(i), u, 1, code(t)) for i, u, t in REPEATED)
    by_id = {r.response.record_id: r for r in got}
    assert len(by_id) == len({r.request.record_id for r in got}) == len({r.metadata.record_id for r in got}) == len(REPEATED)
    assert all(r.request.uri == r.response.uri for r in got)
    assert sorted(r.held_digest for r in got if r.response.type == "response") == sorted(map(code, "xyzw"))
    for r in got:
        if r.response.type == "revisit":
            first = by_id[r.response.refers_to]
            assert first.response.type == "response" and first.held_digest == r.held_digest
            assert first.metadata.capture_id == {code("x"): 1, code("y"): 1, code("z"): None}[r.held_digest]


def test_archive_query_of_null_page_ids(spark, tmp_path):
    pages(spark, REPEATED).write.parquet(f"{tmp_path}/pages.parquet")
    got = __spark_entry__.queries()["op9_warc_transactions"](spark, str(tmp_path)).collect()
    assert sorted((repr(r.page_id), r.record_type, repr(r.refers_to)) for r in got if r.payload_digest == base64.b32encode(hashlib.sha1(b"z").digest()).decode()) == [("None", "response", "None"), ("None", "revisit", "None")]
    assert len(got) == len(REPEATED)


def test_archives_without_some_records(spark, tmp_path):
    raw = warc_transactions.record("response", "<a>", "http://x", b"HTTP/1.1 200 OK\r\n\r\nbody", {}) + warc_transactions.record("request", "<b>", "http://y", b"", {"WARC-Concurrent-To": "<gone>"})
    (tmp_path / "one.warc.gz").write_bytes(raw)
    (tmp_path / "two.warc").write_bytes(gzip.decompress(warc_transactions.record("response", "<c>", "http://z", b"HTTP/1.1 200 OK\r\n\r\n", {})))
    rows = warc_transactions.records(spark, f"file://{tmp_path}")
    got = {r.record_id: r for r in warc_transactions.assemble(rows).collect()}
    assert set(got) == {"<a>", "<c>"} and got["<a>"].request is None and got["<a>"].response.payload_bytes == 4
    assert len(list(warc_transactions.parse(io.BytesIO(raw)))) == 2


TURNS = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", "hi"), (4, 1, "assistant", "no <|im_end|>"), (5, 0, "user", None), (6, 0, "user", ""), (None, 0, None, "x")]


def test_snapshots_collapse(spark):
    got = {r.conv_id: (r.n_turns, r.copies, r.rendered) for r in chat_collapse.collapse(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {2, 4, 5, 6, None}
    assert got[2] == (2, 2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n")
    assert "no <|_im_end|>" in got[4][2]
    assert chat_collapse.collapse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_snapshots_of_repeated_rows_and_clashing_columns(spark):
    """A turn logged twice is two turns; a long conversation is one text; other columns are left out."""
    long = [(9, i, "user", f"t{i}" * 20) for i in range(3000)]
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (2, 0, "user", "hi"), *long]
    frame = spark.createDataFrame([(*r, 5, 6, "x") for r in rows], "conv_id long, turn long, role string, text string, n long, pos long, rendered string").repartition(3)
    got = {r.conv_id: r for r in chat_collapse.collapse(frame).collect()}
    assert set(got) == {1, 9} and (got[1].n_turns, got[9].n_turns) == (2, 3000)
    assert got[9].rendered == "".join(f"<|im_start|>user\n{t}<|im_end|>\n" for _, _, _, t in long)


def test_collapse_is_native(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    plan = chat_collapse.maximal(chat_collapse.prefix_hashes(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["op4_chat_collapse", "op8_exact_topk"])
def test_oracle(spark, sf, name):
    db = duckdb.connect()
    for t in ("conversations", "embeddings"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = db.execute(f"select {', '.join(columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, want))


def test_pipeline(spark, sf):
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf)
        assert rows.columns == docs.columns
        kept[name] = {r.doc_id for r in rows.select("doc_id").collect()}
        assert kept[name]
    assert kept["toxicity"] <= kept["quality"] and kept["near_duplicates"] <= kept["toxicity"]
    joined = {r.doc_id: r.component_id for r in ngram_join.join(docs.where(F.col("doc_id").isin(list(kept["toxicity"])))).collect()}
    assert kept["near_duplicates"] == {d for d, c in joined.items() if d == c}
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept["near_duplicates"]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").isEmpty()


def test_near_duplicates_of_repeated_and_null_ids(spark):
    words = [[f"{c}{i}" for i in range(100)] for c in "abcdefg"]
    near = lambda k, *at: " ".join("other" if i in at else w for i, w in enumerate(words[k]))
    rows = [(5, near(0)), (5, near(0)), (5, near(1)), (3, near(1, 50)), (3, near(2)), (4, near(2, 9)), (None, near(3)), (None, near(4)), (None, near(4, 7)), (9, near(5)), (None, near(5, 3)), (None, near(5, 3)), (8, near(6)), (8, near(6, 1)), (None, ""), (None, "")]
    grams = [{tuple(t.split()[i : i + 4]) for i in range(97)} if t else set() for _, t in rows]
    left, want = set(range(len(rows))), []
    while left:
        group, more = set(), {min(left)}
        while more:
            group |= more
            more = {j for i in more for j in left - group if len(grams[i] & grams[j]) * 100 >= 85 * len(grams[i] | grams[j]) > 0}
        left -= group
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        want.append((min(ids, default=None), {rows[i][1] for i in group if not ids or rows[i][0] == min(ids)}))
    frame = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, frame, "")
    assert kept.columns == frame.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(want) == 9
    for doc_id, texts in want:
        one = next(g for g in got if g[0] == doc_id and g[1] in texts)
        got.remove(one)
