"""Small fixtures, brute force and round trips for the operators on documents."""

import re
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heliograph.llm import histogram_packing, ngram_join, rule_quality, sp_dropout, token_sst, toxicity_crf
from heliograph.llm.common import components, fresh_path
from heliograph.llm.tokens import default_tokenizer

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = ["Hello, World. it's 12.", "", None, "   \n ", LONG, "Été ﬁ x. <|endoftext|> İ", "a b c", "a b c", "A  B\tC", "one two three four five six seven"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label double"


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "en", "s", 0, 9.0, 9.0) for i, t in enumerate(texts)], SCHEMA)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def ids():
    found = Tokenizer.from_file(default_tokenizer()).encode_batch([t or "" for t in TEXTS], add_special_tokens=False)
    return [[*e.ids, 1] for e in found]


def test_packing(spark, ids):
    got = sorted(tuple(r) for r in histogram_packing.pack_documents(docs(spark)).collect())
    want = [(i, k, s, len(x[s : s + 4096]), crc(x[s : s + 4096])) for i, x in enumerate(ids) for k, s in enumerate(range(0, len(x), 4096))]
    assert [g[:5] for g in got] == want
    by = {}
    for g in got:
        by.setdefault(g[5], []).append((g[6], g[3]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == -(-sum(map(len, ids)) // 4096)
    assert histogram_packing.pack_documents(docs(spark, [])).count() == 0
    twice = histogram_packing.pack_documents(docs(spark, ["x", "y"]).withColumn("doc_id", F.lit(3).cast("long"))).collect()
    assert len(twice) == 2 and {r.offset for r in twice} == {0, 2}


def test_plan_fills_sequences():
    counts = {4096: 3, 3000: 5, 1096: 7, 100: 1000, 7: 333, 1: 50}
    runs = histogram_packing.plan(counts, 4096)
    filled, placed = {}, {n: 0 for n in counts}
    for length, a, b, first, each, place in runs:
        for rank in range(b - a):
            at = filled.setdefault(first + rank // each, set())
            start = place + rank % each * length
            assert not at & set(range(start, start + length)) and start + length <= 4096
            at.update(range(start, start + length))
        placed[length] += b - a
    assert placed == counts
    assert all(len(x) == max(x) + 1 for x in filled.values())
    assert len(filled) <= -(-sum(k * v for k, v in counts.items()) // 4096) + 1


def test_sorted_string_tables(spark, ids):
    frame = docs(spark)
    got = [tuple(r) for r in token_sst.write_and_read(frame).orderBy("doc_id").collect()]
    start = np.cumsum([0, *map(len, ids)])
    assert got == [(i, int(start[i]), len(x), crc(x)) for i, x in enumerate(ids)]
    path = fresh_path(spark, "sst")
    token_sst.write_shards(frame, path, 3)
    wanted = spark.createDataFrame([(0,), (4,), (77,), (-5,), (None,)], "doc_id long")
    assert {r.doc_id: r.ids for r in token_sst.look_up(spark, path, wanted).collect()} == {0: ids[0], 4: ids[4]}
    assert token_sst.write_and_read(docs(spark, [])).count() == 0


@pytest.mark.parametrize("shards", [1, 5])
def test_sorted_string_tables_of_null_and_repeated_ids(spark, ids, shards):
    """Nulls first, then ids; equal ids by checksum; every shard's documents before the next one's."""
    keys = [None, None, 3, 3, 3, -(1 << 63), (1 << 63) - 1, None, 3, 3]
    frame = spark.createDataFrame([(k, t, "en") for k, t in zip(keys, TEXTS, strict=True)], "doc_id long, text string, lang string").repartition(3)
    path = fresh_path(spark, "sst")
    made = token_sst.write_shards(frame, path, shards)
    got = sorted((tuple(r) for r in token_sst.read_shards(spark, path, made).collect()), key=lambda r: (r[1], r[2]))
    # As stored, ids of 16 bits: equal ids are ordered by the checksum of those.
    narrow = lambda x: zlib.crc32(np.array(x, "<u2").tobytes())
    order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0, narrow(ids[i])))
    start = np.cumsum([0, *(len(ids[i]) for i in order)]).tolist()
    assert got == [(keys[i], start[k], len(ids[i]), crc(ids[i])) for k, i in enumerate(order)]
    found = token_sst.look_up(spark, path, spark.createDataFrame([(None,), (3,), (7,)], "doc_id long")).collect()
    assert sorted((repr(r.doc_id), r.ids) for r in found) == sorted((repr(k), x) for k, x in zip(keys, ids, strict=True) if k in (None, 3))


def test_dropout_without_drops_is_the_model(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=sp_dropout.default_model())
    rows = sp_dropout.encode(docs(spark), dropout=0.0).orderBy("doc_id").collect()
    assert [r.ids for r in rows] == [sp.encode(t or "") for t in TEXTS]


def agenda(vocabulary, chars, key, dropout):
    """Merges of one segment, one after another: the best-ranked candidate that isn't dropped, ties to the left."""
    pieces = [(i, i + 1, int(vocabulary.char[c])) for i, c in enumerate(chars)]
    ranks = {int(p): (int(m), int(r)) for p, m, r in zip(vocabulary.pairs, vocabulary.merged, vocabulary.rank, strict=True)}
    while True:
        best = None
        for i, ((a, b, x), (_, c, y)) in enumerate(zip(pieces, pieces[1:], strict=False)):
            found = ranks.get(x * vocabulary.size + y) if x >= 0 and y >= 0 else None
            spot = a << 42 ^ b << 21 ^ (c if i + 2 < len(pieces) else 0)
            if found and not (dropout and sp_dropout.dropped(np.array([key], np.uint64), np.array([spot], np.uint64), dropout)[0]) and (best is None or found[1] < best[0]):
                best = (found[1], i, (a, c, found[0]))
        if best is None:
            return [p[2] for p in pieces]
        pieces[best[1] : best[1] + 2] = [best[2]]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5])
def test_dropout_is_brute_force(dropout):
    coder = sp_dropout.Encoder(sp_dropout.default_model(), dropout)
    words = ["international", "unbelievably", "aaaaaaaa", "x", "thermodynamics"] * 12
    chars = [[ord(c) for c in sp_dropout.SPACE + w] for w in words]
    keys = np.random.default_rng(3).integers(1 << 63, size=len(words)).astype(np.uint64)
    ids, size, _, _ = sp_dropout.merge_all(coder.vocabulary, np.concatenate(chars), np.repeat(np.arange(len(words)), list(map(len, chars))), keys, dropout)
    got = [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]
    assert got == [agenda(coder.vocabulary, c, k, dropout) for c, k in zip(chars, keys.tolist(), strict=True)]


def test_dropout_of_repeated_rows_and_nothing(spark):
    frame = docs(spark)
    rows = sp_dropout.encode(frame.unionByName(frame)).collect()
    assert len(rows) == 2 * len(TEXTS) and len({(r.doc_id, tuple(r.ids)) for r in rows}) == len(TEXTS)
    assert sp_dropout.encode(docs(spark, [])).count() == 0
    clash = frame.select("doc_id", "text", F.lit(1).alias("ids"), F.lit(2).alias("n_tokens"))
    assert sp_dropout.encode(clash).columns == ["doc_id", "ids", "n_tokens", "ids_crc32", "lossless"]


def test_dropout_varies_and_decodes(spark):
    texts = [*TEXTS, "▁ mark ▁▁ kept", "😀\t\n  tail  "]
    frame = docs(spark, texts)
    a = sp_dropout.encode(frame, dropout=0.3, seed=1)
    back = {r.doc_id: r.text for r in sp_dropout.decode(a.select("doc_id", "ids")).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    first, again, other = ({r.doc_id: tuple(r.ids) for r in sp_dropout.encode(frame, dropout=0.3, seed=s).collect()} for s in (1, 1, 2))
    assert first == again and first[4] != other[4]
    assert a.where("not lossless").count() == 0
    assert sp_dropout.encode(frame, dropout=1.0).where("doc_id = 9").head().n_tokens == len(texts[9]) + 1


def test_dropout_is_drawn_for_every_occurrence(spark):
    word = "international"
    coder = sp_dropout.Encoder(sp_dropout.default_model(), 0.0)
    chars = np.array([ord(c) for c in sp_dropout.SPACE + word])
    plain = sentencepiece.SentencePieceProcessor(model_file=sp_dropout.default_model()).encode(word)
    one = "|".join([word] * 2000)

    def cuts(rows):
        found = []
        for r in rows:
            raw = coder.vocabulary.spell(np.array(r.ids))[0].tobytes().decode()
            at = coder.vocabulary.spell(np.array(r.ids))[1].tolist()
            assert raw.strip() and r.lossless
            found.append(tuple(r.ids))
            assert at[-1] == len(raw)
        return found

    many = cuts(sp_dropout.encode(spark.createDataFrame([(i, word) for i in range(2000)], "doc_id long, text string")).collect())
    nulls = cuts(sp_dropout.encode(spark.createDataFrame([(None, f"{word} {i}") for i in range(200)], "doc_id long, text string")).collect())
    row = sp_dropout.encode(spark.createDataFrame([(1, one.replace("|", " "))], "doc_id long, text string")).head()
    inside, piece = [], []
    for i in row.ids:
        if coder.vocabulary.spell(np.array([i]))[0].tobytes().startswith(b" ") and piece:
            inside.append(tuple(piece))
            piece = []
        piece.append(i)
    inside.append(tuple(piece))
    assert len(inside) == 2000 and row.lossless
    # Without the kept merges: every copy merged anew, under random keys.
    keys = np.random.default_rng(2).integers(1 << 63, size=2000).astype(np.uint64)
    ids, size, _, _ = sp_dropout.merge_all(coder.vocabulary, np.tile(chars, 2000), np.repeat(np.arange(2000), len(chars)), keys, sp_dropout.DROPOUT)
    anew = [tuple(x.tolist()) for x in np.split(ids, np.cumsum(size)[:-1])]
    rate = anew.count(tuple(plain)) / 2000
    assert abs(sp_dropout.dropped(keys, np.arange(2000, dtype=np.uint64), 0.1).mean() - 0.1) < 0.03
    for found in (many, inside):
        assert len(set(found)) > 0.7 * len(set(anew)) > 30 and abs(found.count(tuple(plain)) / 2000 - rate) < 0.05
        assert abs(np.mean([len(x) for x in found]) - np.mean([len(x) for x in anew])) < 0.15
    assert len({x[:4] for x in nulls}) > 4


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 4 else [tuple(w[i : i + 4]) for i in range(len(w) - 3)]))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def near_texts(seed, families=12, copies=25):
    """Families of copies with some words changed, at similarities around the threshold, and a passage many share."""
    random = np.random.default_rng(seed)
    words = lambda n: [f"w{x}" for x in random.integers(0, 5000, n)]
    passage, out = words(60), []
    for _ in range(families):
        base = words(int(random.integers(5, 160)))
        for _ in range(copies):
            copy = list(base)
            for at in random.integers(0, len(copy), int(random.integers(0, max(2, len(copy) // 25)))):
                copy[at] = f"x{random.integers(0, 10**6)}"
            out.append(" ".join(copy + (passage if random.random() < 0.4 else [])))
    return [*out, *TEXTS, " ".join(passage), "a a a b", "b a a a"]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_is_brute_force(spark, seed):
    texts = near_texts(seed)
    got = sorted(tuple(r) for r in ngram_join.join(docs(spark, texts)).collect())
    assert got == brute_components(texts)


def test_ngram_join_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "CORE_BLOCK", 16)
    monkeypatch.setattr(ngram_join, "LARGE", 10)
    texts = near_texts(5, families=3, copies=90)
    assert sorted(tuple(r) for r in ngram_join.join(docs(spark, texts)).collect()) == brute_components(texts)


def test_ngram_join_of_repeated_rows_and_nothing(spark):
    assert ngram_join.join(docs(spark, [])).count() == 0
    frame = docs(spark, ["a b c d e f", "a b c d e f", "z y x w v"])
    got = sorted(tuple(r) for r in ngram_join.join(frame.unionByName(frame)).collect())
    assert got == [(0, 3, 0)] * 2 + [(1, 3, 0)] * 2 + [(2, 2, 2)] * 2


def test_ngram_join_of_null_ids(spark):
    near = lambda c, *at: " ".join("other" if i in at else f"{c}{i}" for i in range(100))
    # b without 10 bridges its first and last text, which aren't linked themselves.
    rows = [(7, near("a")), (None, near("a", 3)), (None, near("a", 3)), (5, near("b", 10)), (None, near("b")), (9, near("b", 50)), (None, near("c")), (None, near("c", 8)), (None, ""), (None, near("d")), (4, near("e"))]
    want = [7, 7, 7, 5, 5, 5, None, None, None, None, 4]
    text_of = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.join(text_of).collect()
    assert sorted((repr(r.doc_id), repr(r.component_id)) for r in got) == sorted((repr(i), repr(c)) for (i, _), c in zip(rows, want, strict=True))


def test_ngram_join_beyond_what_is_broadcast(spark, monkeypatch):
    """Beyond BROADCAST_IDS texts stay where they are and sets move once: ids go as bits, sets are kept by fp."""
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        ids = spark.range(5, 900, 3).select(F.col("id").alias("doc_id")).unionByName(spark.range(1).select(F.lit(None).cast("long").alias("doc_id")))
        some = ngram_join.among(docs(spark, ["text"] * 1000), ids, "doc_id")
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert sorted(r.doc_id for r in some.collect()) == list(range(5, 900, 3))
        named = spark.createDataFrame([(f"d{i}",) for i in range(50)], "doc_id string")
        assert sorted(r.doc_id for r in ngram_join.among(named, named.where("doc_id < 'd3'"), "doc_id").collect()) == sorted(f"d{i}" for i in range(50) if f"d{i}" < "d3")
        texts = near_texts(1)
        frame = docs(spark, texts).select("doc_id", "text")
        kept = []
        monkeypatch.setattr(ngram_join, "sets_of", lambda *a, made=ngram_join.sets_of: (kept.append(made(*a)), kept[-1])[1])
        assert sorted(tuple(r) for r in ngram_join.join(frame).collect()) == brute_components(texts)
        assert kept[0][0] is kept[0][1] and not kept[0][1].is_cached
        # One id in several rows: what isn't wanted, or comes twice, is left out.
        twice = frame.unionByName(frame).unionByName(frame.select("doc_id", F.concat("text", F.lit(" and"), F.col("doc_id").cast("string")).alias("text")))
        beyond = sorted(tuple(r) for r in ngram_join.join(twice).collect())
        monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 1_000_000)
        assert beyond == sorted(tuple(r) for r in ngram_join.join(twice).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_parts_meet_whatever_differs():
    random = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 20, 64, 200, 900):
        for _ in range(20):
            x = np.unique(random.integers(0, 2**63, n).astype(np.uint64))
            drop = random.integers(0, max(1, int(len(x) * 0.15)) + 1)
            y = np.unique(np.concatenate([x[drop:], random.integers(0, 2**63, random.integers(0, max(1, n // 12) + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if not len(y) or 100 * both < 85 * (len(x) + len(y) - both):
                continue
            signed = [set(np.concatenate([ngram_join.part_hashes(s, np.array([0, len(s)]), e, 85)[0] for e in (0, 1)]).tolist()) for s in (x, y)]
            assert signed[0] & signed[1]


def test_signatures_take_ten_bytes_and_sets_few_moves(spark):
    texts = [" ".join(f"w{i * 1000 + j}" for j in range(300)) for i in range(30)]
    rows = ngram_join.part_signatures(docs(spark, texts), 4, 85, "doc_id", "text").collect()
    n = sum(len(ngram_join.part_hashes(np.arange(i, i + 297, dtype=np.uint64), np.array([0, 297]), e, 85)[0]) for i in range(30) for e in (0, 1))
    assert sum(len(r.sigs) + len(r.fps) for r in rows) < 11 * n
    # A large group's sets move to few blocks, until these hold as many sets or grams as a task should.
    size = spark.createDataFrame([(100, 50_000), (11_000, 3_000_000), (100_000, 3_000_000), (11_000, 400_000_000)], "n long, grams long")
    assert [r[0] for r in size.select(ngram_join.blocks(F.col("n"), F.col("grams"), ngram_join.BLOCK)).collect()] == [1, 8, 13, 96]


def test_signatures_that_cross_batches_connect(spark):
    """Equal signatures meet whatever row, batch and task they come from, also of negative hashes."""
    combiner, rows = ngram_join.Combiner(), []
    sig = np.array([-5, 7, -(1 << 62), -5, 9, 7], np.int64)
    for part in (slice(0, 3), slice(3, 6)):
        list(combiner.add(sig[part], ngram_join.mix(sig[part].view(np.uint64)).view(np.int64), np.arange(6, dtype=np.int64)[part] - 3))
        for batch in combiner.flush():
            rows += [(r["deal"], bytearray(r["sigs"]), bytearray(r["fps"])) for r in batch.to_pylist()]
    found = components(ngram_join.sharing(spark.createDataFrame(rows, ngram_join.Combiner.SCHEMA).repartition(3))).collect()
    assert {r.node: r.component for r in found} == {-3: -3, 0: -3, -2: -2, 2: -2}


def test_merge_skip_counts_occurrences():
    random = np.random.default_rng(8)
    for need in (1, 2, 3, 5):
        lists = [sorted(set(random.integers(0, 40, 12).tolist())) for _ in range(7)]
        many = {i: sum(i in x for x in lists) for i in range(40)}
        assert dict(ngram_join.merge_skip(lists, need)) == {i: c for i, c in many.items() if c >= need}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def labelled(spark, make, n=400):
    random = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, make(i % 4 == 0, [str(x) for x in random.choice(words, 60)], random)) for i in range(n)]
    frame = docs(spark, [t for _, t in rows])
    return frame, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(n)], "doc_id long, label int")


def held_out_accuracy(scored, labels, column, at):
    rows = scored.join(labels.withColumnRenamed("label", "gold"), "doc_id").where(rule_quality.held_out(F.col("doc_id"))).select(column, "gold").collect()
    return sum((r[0] >= at) == bool(r[1]) for r in rows) / len(rows)


def test_rules_learn_quality(spark):
    frame, labels = labelled(spark, lambda good, w, r: " ".join(w) + "." if good else " | ".join(w[:30] * 2))
    model = rule_quality.fit(frame, labels.withColumnRenamed("label", "quality"))
    scored = rule_quality.score(docs(spark, [*[r.text for r in frame.orderBy("doc_id").collect()], None, "", LONG]), model)
    assert held_out_accuracy(scored, labels, "quality_score", 0.5) > 0.95
    assert scored.where("quality_score is null or quality_score < 0 or quality_score > 1").count() == 0
    assert model.rules and all(len(r) <= 3 for r in model.rules)
    assert rule_quality.fit(frame, labels.where("false").withColumnRenamed("label", "quality")).column() is not None


def test_statistics_are_those_of_the_text(spark):
    row = rule_quality.with_statistics(docs(spark, ["Aé | b b\n12 c."])).head()
    assert [round(row[rule_quality.OWN + k], 6) for k in rule_quality.STATISTICS] == [round(x, 6) for x in (np.log1p(6), 14 / 6, 5 / 6, 1 / 6, 0, 2 / 14, 1 / 6, 1 / 14, 1 / 6)]


def test_marginals_are_those_of_all_paths():
    random = np.random.default_rng(6)
    emission, transitions = random.normal(size=7), random.normal(size=(2, 2))
    new = np.array([1, 0, 0, 0, 1, 0, 0], bool)
    p, pairs = toxicity_crf.marginals(emission, new, transitions)
    for a, b in ((0, 4), (4, 7)):
        weight = {}
        for path in np.ndindex(*[2] * (b - a)):
            score = sum((s - 0.5) * emission[a + i] for i, s in enumerate(path)) + sum(transitions[s, t] for s, t in zip(path, path[1:], strict=False))
            weight[path] = np.exp(score)
        total = sum(weight.values())
        for i in range(b - a):
            assert np.isclose(p[a + i], sum(w for path, w in weight.items() if path[i]) / total)
    assert np.allclose(pairs.sum((1, 2)), 1)


def one_by_one(emission, transitions):
    """P(toxic) of the words of one chain, word after word."""
    pot = [np.exp(np.clip(np.array([-e / 2, e / 2]), -30, 30)) for e in emission]
    t = np.exp(transitions)
    forward, backward = [pot[0] / pot[0].sum()], [np.full(2, 0.5)]
    for p in pot[1:]:
        f = (forward[-1] @ t) * p
        forward.append(f / f.sum())
    for p in pot[:0:-1]:
        b = t @ (p * backward[-1])
        backward.append(b / b.sum())
    both = np.array(forward) * np.array(backward[::-1])
    return both[:, 1] / both.sum(1)


def test_marginals_of_long_chains():
    random = np.random.default_rng(7)
    size = [1, 64, 65, 700, 2, 128, 129, 63]
    emission, transitions = random.normal(size=sum(size)) * 3, random.normal(size=(2, 2))
    new = np.zeros(sum(size), bool)
    at = np.cumsum([0, *size])
    new[at[:-1]] = True
    p, pairs = toxicity_crf.marginals(emission, new, transitions)
    for a, b in zip(at, at[1:], strict=False):
        assert np.allclose(p[a:b], one_by_one(emission[a:b], transitions))
    # A word's marginal is that of the pairs it stands in.
    assert np.allclose(pairs[:, 1].sum(1), p[np.flatnonzero(~new) - 1]) and np.allclose(pairs[:, :, 1].sum(1), p[~new])


def test_lexicon_and_score_are_brute_force(spark):
    frame, labels = labelled(spark, lambda bad, w, r: " ".join(w[:30] + (['"Idiot!!!!"', "(moron),"] if bad else []) + w[30:]) + ".")
    labels = labels.withColumnRenamed("label", "toxic")
    field = toxicity_crf.fit(frame, labels)
    tokens = toxicity_crf.Tokens()
    entry = lambda word: {k: int(tokens(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]))[k][0]) for k in ("word", "head", "tail", "hash")}
    # Marks at a word's ends, however many, aren't part of it.
    assert entry('"Idiot!!!!"') == entry("idiot") == entry("((((((idiot") and entry("....")["hash"] != entry("...")["hash"]
    rows = {r.doc_id: r for r in toxicity_crf.score(frame, field).where("doc_id < 12").collect()}
    for r in rows.values():
        p = []
        for sentence in re.findall(r"[^.!?]+?[.!?](?=\s|$)|.+$", r.text.replace('!!!!"', "@@@@@")):
            words = [w.strip('"@(),.') for w in sentence.split()]
            e = [field.bias + field.words[f["word"]] + field.heads[f["head"]] + field.tails[f["tail"]] for f in map(entry, words)]
            p += one_by_one(np.array(e), field.transitions).tolist()
        a, b, c = field.layer
        assert np.isclose(r.toxicity, 1 / (1 + np.exp(-(a * np.log1p(sum(p)) + b * max(p) + c))))
    counts = spark.createDataFrame([(1, 40, 40), (2, 1, 1), (3, 30, 400), (4, 39, 40), (5, 20, 30)], "word long, bad long, many long")
    want = set()
    for w, bad, many in [(1, 40, 40), (2, 1, 1), (3, 30, 400), (4, 39, 40), (5, 20, 30)]:
        ratio = bad * np.log(bad / many / 0.2) + ((many - bad) * np.log((1 - bad / many) / 0.8) if bad < many else 0)
        if ratio >= toxicity_crf.EVIDENCE and bad / many >= 0.7:
            want.add(w)
    assert {r.word for r in toxicity_crf.lexicon(counts, 0.2).collect()} == want == {1, 4}


def test_scores_of_repeated_rows_and_nothing(spark):
    """op3 and op10: equal rows have equal scores, in the sample too; empty tables and null ids end nothing."""
    frame, labels = labelled(spark, lambda bad, w, r: " ".join(w[:30] + (["scum"] if bad else []) + w[30:]) + ("." if bad else ""), n=80)
    twice = frame.unionByName(frame).unionByName(docs(spark, [None, "x"]).withColumn("doc_id", F.lit(None).cast("long")))
    for module, name in ((toxicity_crf, "toxic"), (rule_quality, "quality")):
        given = labels.unionByName(labels).withColumnRenamed("label", name)
        model = module.fit(twice, given)
        column = {"toxic": "toxicity", "quality": "quality_score"}[name]
        rows = module.score(twice, model).collect()
        assert len(rows) == 162 and all(0 <= r[column] <= 1 for r in rows)
        assert len({(r.doc_id, r[column]) for r in rows if r.doc_id is not None}) == 80
        nothing = module.fit(docs(spark, []), given.where("false"))
        assert module.score(docs(spark, []), nothing).count() == 0


def test_compiled_rules_are_the_matrix(spark):
    frame, labels = labelled(spark, lambda good, w, r: " ".join(w) + "." if good else " | ".join(w[: r.integers(3, 30)] * 2))
    model = rule_quality.fit(frame, labels.withColumnRenamed("label", "quality"))
    rows = rule_quality.with_statistics(frame).withColumn("p", model.column()).collect()
    x = np.array([[r[rule_quality.OWN + k] for k in rule_quality.STATISTICS] for r in rows])
    z = model.intercept + rule_quality.holds_matrix(x, model.rules, rule_quality.STATISTICS) @ np.array(model.weights)
    assert np.allclose([r.p for r in rows], 1 / (1 + np.exp(-z)))


def test_field_learns_toxic_words(spark):
    frame, labels = labelled(spark, lambda bad, w, r: " ".join(w[:30] + ([str(x) for x in r.choice(["Idiot", "moron,", "scum"], 2)] if bad else []) + w[30:]) + ".")
    field = toxicity_crf.fit(frame, labels.withColumnRenamed("label", "toxic"))
    scored = toxicity_crf.score(frame, field, spans="spans")
    assert held_out_accuracy(scored, labels, "toxicity", 0.5) > 0.95
    one = scored.where("doc_id = 4").head()
    assert one.spans and all(re.search("(?i)idiot|moron|scum", one.text[s.start : s.end]) for s in one.spans)
    odd = toxicity_crf.score(docs(spark), field).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r.toxicity <= 1 for r in odd)
    none = toxicity_crf.fit(frame, labels.where("false").withColumnRenamed("label", "toxic"))
    assert toxicity_crf.score(docs(spark, ["x"]), none).head().toxicity == 0.5
