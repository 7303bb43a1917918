"""Inputs that broke operators before: colliding words, very large components, very long words, hot keys, clashing names."""

import json
import random
import time
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heliograph.llm import ann_projection, chat_collapse, exact_topk, histogram_packing, ngram_join, sp_dropout, token_sst, tokens
from heliograph.llm.common import WordHasher

VECTORS = "vec_id long, embedding array<double>, label int, score double"


def thue_morse(n):
    """A sequence and its complement: their polynomial hashes modulo 2**64 are equal for every base."""
    a = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 65_536])
def test_word_hashes_of_built_collisions(n):
    data = np.frombuffer(" ".join(thue_morse(n)).encode(), np.uint8)
    hasher = WordHasher()
    start, end, sums = hasher(data, np.array([0, len(data)]))
    assert len(set(hasher.hashes(sums, start, end).tolist())) == 2
    # A part of a word has the hash of that part alone.
    assert hasher.hashes(sums, start + 5, end)[0] == hasher.hashes(hasher.sums(data[5:n], np.zeros(1, np.int64)), np.array([0]), np.array([n - 5]))[0]


def test_operators_on_built_collisions(spark):
    pairs = [w for n in (1024, 2048) for w in thue_morse(n)]
    frame = spark.createDataFrame(list(enumerate(pairs)), "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r for r in sp_dropout.encode(frame, dropout=0.0).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=sp_dropout.default_model())
    assert all(found[i].lossless and found[i].ids == sp.encode(w) for i, w in enumerate(pairs))
    ids = [[*e.ids, 1] for e in Tokenizer.from_file(tokens.default_tokenizer()).encode_batch(pairs, add_special_tokens=False)]
    crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert [(r.n_tokens, r.ids_crc32) for r in token_sst.write_and_read(frame).orderBy("doc_id").collect()] == [(len(x), c) for x, c in zip(ids, crc, strict=True)]
    assert [(r.length, r.ids_crc32) for r in histogram_packing.pack_documents(frame).orderBy("doc_id").collect()] == [(len(x), c) for x, c in zip(ids, crc, strict=True)]
    assert all(r.component_id == r.doc_id for r in ngram_join.join(frame).collect())


def test_words_of_a_cased_tokenizer(tmp_path):
    """A tokenizer whose normalizer keeps case has its own ids for Word and word."""
    with open(tokens.default_tokenizer(), encoding="utf-8") as file:
        spec = json.load(file)
    spec["normalizer"]["normalizers"] = [x for x in spec["normalizer"]["normalizers"] if x["type"] != "Lowercase"]
    path = str(tmp_path / "cased.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(spec, file)
    text = "Word word WORD, wOrd. word"
    data = np.frombuffer(text.encode(), np.uint8)
    ids, at = tokens.WordEncoder(path)(data, np.array([0, len(data)]))
    assert ids.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids and at.tolist() == [0, len(ids)]


def encoded(encoder, text, key=5):
    data = np.frombuffer(text.encode(), np.uint8)
    return encoder(data, np.array([0, len(data)]), np.array([key], np.uint64))[0]


@pytest.mark.parametrize("n", [30, 64, 65, 200, 2000])
def test_agendas_of_short_and_long_segments_agree(monkeypatch, n):
    draw = random.Random(n)
    text = "".join(draw.choice("etaoinshr漢d▁é") for _ in range(n))
    found = []
    for longest in (64, 1, 1 << 30):
        monkeypatch.setattr(sp_dropout, "LONG", longest)
        found.append([encoded(sp_dropout.Encoder(sp_dropout.default_model(), share, 17), text).tolist() for share in (0.0, 0.1, 0.5, 1.0)])
    assert found[0] == found[1] == found[2]
    plain = text.replace("▁", "")
    assert encoded(sp_dropout.Encoder(sp_dropout.default_model(), 0.0), plain).tolist() == sentencepiece.SentencePieceProcessor(model_file=sp_dropout.default_model()).encode(plain)


def test_a_word_of_a_million_letters():
    text = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    encoder = sp_dropout.Encoder(sp_dropout.default_model(), 0.1)
    began = time.process_time()
    ids = encoded(encoder, text)
    assert time.process_time() - began < 60  # 6 s on the machine that it was written on
    raw, _ = encoder.decode(ids, np.array([0, len(ids)]))
    assert raw.tobytes().decode() == text


def large(spark):
    draw = np.random.default_rng(2)
    rows = [draw.normal(size=3) * 10.0 ** draw.integers(-5, 200) for _ in range(60)] + [np.array(v) for v in ([1e200, 1.0, 0.0], [1e200, 3.0, 0.0], [1.0, 2.0, 0.0], [-1e200, 5.0, 1.0], [1.7e308, 1.7e308, -1.7e308], [1e-300, 1e-310, 0.0])]
    return spark.createDataFrame([(i, v.tolist(), 0, 0.0) for i, v in enumerate(rows)], VECTORS).repartition(3), rows


def whole_number(x):
    return int(x) * 1024 if abs(x) >= 2.0**53 else int(np.floor(1024 * x))


def test_exact_top_k_of_any_finite_components(spark):
    frame, rows = large(spark)
    got = {}
    for r in exact_topk.search(frame, frame, 7, shard=20, block=11).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = [[whole_number(x) for x in v.tolist()] for v in rows]
    for q in range(len(rows)):
        exact = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in enumerate(whole) if i != q)[:7]
        assert got[q] == [(i, max(-(1 << 63), min(-s, (1 << 63) - 1))) for s, i in exact]


def test_large_whole_numbers_sort_as_bytes():
    draw = random.Random(3)
    numbers = sorted(draw.choice([-1, 1]) * draw.getrandbits(draw.randint(1, 900)) for _ in range(500)) + [1 << 900]
    assert sorted(numbers, key=exact_topk.sortable) == numbers


def test_projection_search_of_any_finite_components(spark):
    """All candidates, ranked by the product in double precision, infinite where that overflows."""
    frame, rows = large(spark)
    got = {}
    for r in ann_projection.search(frame, frame, 20, shard=40, block=11).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert len(got) == len(rows)
    for found in got.values():
        assert len(found) == 20 and all(not np.isnan(s) for _, s in found) and found == sorted(found, key=lambda r: (-r[1], r[0]))
    with np.errstate(over="ignore", invalid="ignore"):
        for q in (62, 60, 61, 64):
            want = sorted((-float(v @ rows[q]), i) for i, v in enumerate(rows) if i != q and not np.isnan(v @ rows[q]))
            assert got[q][0] == (want[0][1], -want[0][0])


def test_searches_of_one_hot_id(spark):
    """An id that a third of rows have is in all shards; each finds what brute force finds."""
    x = np.random.default_rng(4).normal(size=(300, 4)).round(2)
    rows = [(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)] + [(20, x[i % 7].tolist(), 0, 0.0) for i in range(150)]
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    dealt, shards, _ = exact_topk.tiles(exact_topk.usable(frame.where("vec_id = 0")), exact_topk.usable(frame), 30, 30)
    held = {r.s: r["count"] for r in dealt.where("not asks and vec_id = 20").groupBy("s").count().collect()}
    assert len(held) == shards and max(held.values()) < 3 * 151 / shards
    for search, scale in ((ann_projection.search, None), (exact_topk.search, 1024)):
        measure = (lambda v: np.array(v)) if scale is None else (lambda v: np.floor(1024 * np.array(v)))
        got = [(r.vec_id, round(float(r.score), 6)) for r in search(frame, frame.where("vec_id = 0"), 5, shard=30, block=30).orderBy("rank").collect()]
        want = sorted((-round(float(measure(v) @ measure(x[0].tolist())), 6), i) for i, v, _, _ in rows if i != 0)[:5]
        assert got == [(i, -s) for s, i in want]


def test_packing_of_a_row_that_a_third_of_all_are(spark, monkeypatch):
    frame = spark.range(2000).selectExpr("id as doc_id", "concat('w', id) as text").unionByName(spark.range(1000).selectExpr("7L as doc_id", "'same words' as text"))
    seen = {}
    stored = histogram_packing.stored

    def noted(df, name):
        seen[name] = stored(df, name)
        return seen[name]

    monkeypatch.setattr(histogram_packing, "stored", noted)
    got = histogram_packing.pack_documents(frame).collect()
    assert len(got) == 3000 and len({(r.sequence_id, r.offset) for r in got}) == 3000
    salts = seen["numbered"].groupBy("length", F.pmod(F.xxhash64("__row"), F.lit(64))).count().agg(F.max("count"), F.percentile("count", 0.5)).head()
    assert salts[0] < 6 * salts[1]


def test_collapse_of_one_conversation_of_most_turns(spark):
    """Its turns, repeated ones included, are hashed by several tasks, and it is found whole; its snapshot goes."""
    schema = "conv_id long, turn long, role string, text string"
    hot = [(5, i, "user", f"t{i}") for i in range(2000)] + [(5, 2000, "user", "again")] * 1000
    rows = [*hot, *((6, i, r, t) for _, i, r, t in hot[:900]), *((None, i, "user", None) for i in range(50)), (7, 0, "user", "alone"), (7, 0, None, "alone")]
    frame = spark.createDataFrame(rows, schema).repartition(4)
    numbered = chat_collapse.numbered(frame)
    assert numbered.where("conv_id = 5").groupBy("part").count().agg(F.max("count")).head()[0] < 2200
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat_collapse.collapse(frame).collect()}
    line = lambda role, text: f"<|im_start|>{role or ''}\n{text or ''}<|im_end|>\n"
    assert got == {5: (3000, "".join(line(r, t) for *_, r, t in hot)), None: (50, line("user", None) * 50), 7: (2, line(None, "alone") + line("user", "alone"))}


def test_blocks_of_long_texts_are_more(spark, monkeypatch):
    """Blocks are cut by grams: with few a block, links are found across many of them."""
    draw = random.Random(9)
    base = [f"w{draw.randrange(5000)}" for _ in range(400)]
    texts = []
    for i in range(90):
        own = base.copy()
        for _ in range(draw.randint(0, 40)):
            own[draw.randrange(len(own))] = f"x{draw.randrange(9999)}"
        texts.append(" ".join(own))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(tuple(r) for r in ngram_join.join(frame).collect())
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 2000)
    assert sorted(tuple(r) for r in ngram_join.join(frame).collect()) == whole
    grams = [{tuple(t.split()[i : i + 4]) for i in range(397)} for t in texts]
    lead = list(range(90))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i in range(90):
        for j in range(i):
            if 100 * len(grams[i] & grams[j]) >= 85 * len(grams[i] | grams[j]):
                lead[max(find(i), find(j))] = min(find(i), find(j))
    assert whole == [(i, len(grams[i]), find(i)) for i in range(90)] and len({find(i) for i in range(90)}) > 3


def test_clashing_names(spark, sf):
    """Columns named like an operator's own stay as they are; a score's name that is taken is an error."""
    from heliograph.llm import rule_quality, toxicity_crf

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    odd = [rule_quality.OWN + rule_quality.STATISTICS[0], rule_quality.OWN + "in_1", rule_quality.OWN + "score", "label"]
    wide = docs.select("*", *(F.lit(7).alias(c) for c in odd))
    model = rule_quality.fit(docs, labels)
    plain = {r.doc_id: r.s for r in rule_quality.score(docs, model, "s").collect()}
    for r in rule_quality.score(wide, model, "s").collect():
        assert [r[c] for c in odd] == [7] * 4 and r.s == plain[r.doc_id]
    with pytest.raises(ValueError, match="already"):
        rule_quality.score(wide, model, "LABEL")
    field = toxicity_crf.fit(docs, labels)
    with pytest.raises(ValueError, match="already"):
        toxicity_crf.score(wide, field, column="text")
    with pytest.raises(TypeError, match="whole numbers"):
        token_sst.write_and_read(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_pipeline_keeps_columns_of_its_own_names(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 100")
    odd = ["score", "row", "__score", "__row", "_row", "component_id"]
    wide = docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in odd))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, wide, sf)
        assert kept.columns == wide.columns
        rows = kept.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in odd)
        assert {r.doc_id for r in rows} == {r.doc_id for r in stage(spark, docs, sf).select("doc_id").collect()}
