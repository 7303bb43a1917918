"""Merkle manifests, spelling variants and SimHash classes against brute force, with nulls, ties, repeats and empties."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
from heliograph.llm import merkle_manifest, simhash_trie, spelling_variants

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, tree string, fp long, word string"


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", "x", 7, "x") for i, t, lang, s in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes):
    """(root, path of each leaf): runs of 8, level by level."""
    level, paths, own = nodes, [[] for _ in nodes], list(range(len(nodes)))
    while len(level) > 1:
        for leaf, i in enumerate(own):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            paths[leaf].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        level = [sha("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
        own = [i // 8 for i in own]
    return level[0], paths


def manifest(rows):
    """doc_id, leaf, subroot, root, proof, folded root of every row."""
    leaves = {}
    for i, t, lang, s in rows:
        digest = lambda text, i=i, lang=lang, s=s, t=t: sha("".join(map(field, (i, s, lang, None if t is None else len(t), text))))
        lowered = None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
        false = digest(lowered) if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else digest(t)
        leaves.setdefault(lang, []).append((i is not None, i or 0, digest(t), false))
    langs = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([d for _, _, d, _ in sorted(leaves[x])]) for x in langs}
    root, above = tree([trees[x][0] for x in langs])
    found = []
    for x, up in zip(langs, above, strict=True):
        for (known, i, d, false), path in zip(sorted(leaves[x]), trees[x][1], strict=True):
            own = false
            for left, right in path + up:
                own = sha(left + own + right)
            found.append((i if known else None, d, trees[x][0], root, sha("".join(a + b for a, b in path + up)), own))
    return found


@pytest.mark.parametrize("n", [1, 8, 9, 700])
def test_merkle_manifest(spark, n):
    draw = random.Random(n)
    rows = [(draw.choice([None, *range(n)]) if n > 9 else i, draw.choice([None, "", "Ab", "ü" * 3, "abc"]), draw.choice([None, "", "en", "en", "en", "é"]) if n > 1 else "en", None) for i in range(n)]
    rows += rows[: n // 3] * 2 if n > 9 else []  # rows equal in all fields
    doc_id, source, lang, n_chars, text = (F.col(c) for c in merkle_manifest.FIELDS)
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(doc_id.cast("string")) % 3 == 0, merkle_manifest.leaf(doc_id, source, lang, n_chars, lowered))
    made = merkle_manifest.manifest(frame(spark, rows).repartition(3), carried={"__key": tampered})
    got = made.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof(F.col("path")), merkle_manifest.folded(F.col("path"), F.coalesce("__key", "leaf"))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, manifest(rows)))


def test_merkle_manifest_of_one_hot_group(spark, monkeypatch):
    """A group of one row repeated is ranked by several tasks; an empty table has no manifest; other fan-outs do."""
    rows = frame(spark, [(1, "same", "en", "s")] * 3000 + [(i, "other", "de", "s") for i in range(10)])
    seen = {}
    stored = merkle_manifest.stored

    def noted(df, name):
        made = stored(df, name)
        seen.setdefault(name, made)
        return made

    monkeypatch.setattr(merkle_manifest, "stored", noted)
    made = merkle_manifest.manifest(rows)
    most = seen["ranked"].groupBy("__part").count().agg(F.max("count")).head()[0]
    assert most < 2000 and made.count() == 3010 and made.where(merkle_manifest.folded(F.col("path"), F.col("leaf")) != F.col("root")).isEmpty()
    monkeypatch.undo()
    assert merkle_manifest.manifest(rows.where("false")).count() == 0
    binary = merkle_manifest.manifest(rows, fanout=2, levels=5)
    assert binary.count() == 3010 and binary.where(merkle_manifest.folded(F.col("path"), F.col("leaf")) != F.col("root")).isEmpty()


def edits(a, b):
    """Whether a and b are exactly one insertion, deletion or replacement apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows, share=97):
    total = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = 1 if i is None else zlib.crc32(f"{i}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if i is not None and h % share == 0 else run] += 1
    n = {w: c for w, c in total.items() if len(w) >= 5 and c >= 3}
    near = {w: sorted((v for v in n if edits(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: v[0] if v and n[v[0]] >= 2 * n[w] else None for w, v in near.items()}
    found = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        found.append((w, n[w], len(near[w]), form[w], form[w] and n[form[w]], root))
    return sorted(map(repr, found))


def spelled(df):
    return sorted(repr(tuple(r)) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_spelling_variants(spark):
    draw = random.Random(4)
    letters = "abÀÿ×ß"
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(4, 7))) for _ in range(150)]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "aabaa", "caaaa", "ABAAA", "Straße", "strasse", "Ünder", "ünder"]
    rows = [(draw.choice([None, *range(40)]), " 1".join(draw.choices(words, k=draw.randint(0, 60))), "en", "s") for _ in range(150)] + [(3, None, "en", "s"), (4, "", "en", "s"), (5, "€uros", None, None)]
    rows += rows[:20]
    for share in (97, 3):
        assert spelled(spelling_variants.variants(frame(spark, rows), share)) == variants(rows, share)
    assert spelling_variants.variants(frame(spark, rows).where("false")).count() == 0


def test_spelling_chains_and_long_words(spark):
    """Forms of forms; words of 100,000 letters, whose deletions as texts would be 10 GB."""
    chain = ["house", "houseb", "housebc", "housebcd", "housebcde"]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k))
    long = "".join(random.Random(1).choice("abcdef") for _ in range(100_000))
    other = f"{long[:70_000]}ü{long[70_001:]}"
    rows = [(None, text, "en", "s"), (None, f"{long} " * 3 + f"{other} " * 6 + f"{other[1:]} " * 3, "en", "s")]
    got = {r.word: r for r in spelling_variants.variants(frame(spark, rows)).collect()}
    assert [got[w].root for w in chain] == [chain[-1]] * 5 and [got[w].form for w in chain] == [*chain[1:], None]
    assert [(got[w].n_near, got[w].form == other, got[w].root == other) for w in (long, other, other[1:])] == [(1, True, True), (2, False, True), (1, True, True)]


def test_deletion_hashes_are_those_of_the_shorter_words():
    words = [b"house", b"aab", b"a", b"zz\xe9zz"]
    hasher = spelling_variants.Deleter()
    whole = lambda ws: hasher(np.frombuffer(b"".join(ws), np.uint8).astype(np.uint64), np.cumsum([0, *map(len, ws)]))
    shorter = [w[:i] + w[i + 1 :] for w in words for i in range(len(w)) if len(w) > 1]
    kept = np.repeat([len(w) > 1 for w in words], [len(w) for w in words])
    assert (whole(words)[1][kept] == whole(shorter)[0]).all()
    for n in (1 << 10, 1 << 14):  # a sequence whose polynomial hashes modulo 2**64 collide with its complement's
        a = bytes(97 + (i.bit_count() & 1) for i in range(n))
        assert len(set(whole([a, a.translate(bytes.maketrans(b"ab", b"ba"))])[0].tolist())) == 2


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(ids, fps, budget=2):
    lead = list(range(len(fps)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                lead[max(find(i), find(j))] = min(find(i), find(j))
    by = {}
    for i in range(len(fps)):
        by.setdefault(find(i), []).append(ids[i])
    return [min((x for x in by[find(i)] if x is not None), default=None) for i in range(len(fps))]


TEXTS = ["", None, " \t\n", "One", "one two", "one two three", "ONE  two\nthree", "É a b c d", "a b c d e f g h", "a b c d e f g h", "a b c d"]


def test_simhash_classes(spark):
    draw = random.Random(2)
    base = [draw.choice("abcdefghij") * draw.randint(1, 3) for _ in range(400)]
    texts = TEXTS + [" ".join(base[:k] + ["x" * k] + base[k:]) for k in range(60)] + [" ".join(draw.choices(base, k=9)) for _ in range(60)]
    ids = [draw.choice([None, *range(500)]) for _ in texts]
    want = [simhash(t) for t in texts]
    rows = [(i, t, "en", "s") for i, t in zip(ids, texts, strict=True)]
    got = simhash_trie.classes(frame(spark, rows), most=4).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr((i, f - (1 << 64) if f >> 63 else f, c)) for i, f, c in zip(ids, want, smallest(ids, want), strict=True))
    assert simhash_trie.classes(frame(spark, rows).where("false")).count() == 0


def test_simhash_of_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"Word{i % 91}" for i in range(500)) + " \n" + "y" * 300 + " z"
    want = simhash(text)
    for size in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(simhash_trie, "PIECE_BYTES", size)
        assert simhash_trie.fingerprint(text.encode()) == want


@pytest.mark.parametrize("most", [1, 5, 40, 1000])
def test_links_of_crowded_fingerprints(spark, most):
    """Fingerprints that crowd under one prefix, chains two bits a step, and spread ones; each cell is one task's."""
    draw = random.Random(most)
    crowd = [0xABCD << 48 | sum(1 << b for b in draw.sample(range(48), draw.randint(0, 2))) for _ in range(300)]
    chain, x = [], draw.getrandbits(64)
    for _ in range(60):
        x ^= 1 << draw.randrange(64) | 1 << draw.randrange(64)
        chain.append(x)
    fps = sorted({*crowd, *chain, *(draw.getrandbits(64) for _ in range(200)), 0, 3, (1 << 64) - 1})
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    rows = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(3)
    found = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash_trie.links(rows, most=most).collect()]
    place, want = {f: i for i, f in enumerate(fps)}, smallest(list(range(len(fps))), fps)
    lead = simhash_trie.forest(np.arange(len(fps)), np.array([place[a] for a, _ in found]), np.array([place[b] for _, b in found]))
    assert lead.tolist() == want


def test_near_pairs_are_all_pairs(monkeypatch):
    draw = np.random.default_rng(6)
    a = np.unique(np.concatenate([draw.integers(0, 1 << 63, 500, dtype=np.uint64), np.uint64(5) ^ (np.uint64(1) << draw.integers(0, 64, 200, dtype=np.uint64))]))
    b = np.unique(a[::2] ^ (np.uint64(1) << draw.integers(0, 64, len(a[::2]), dtype=np.uint64)))
    deep = lambda x: np.full(len(x), 64)
    for frontier in (1 << 17, 3):
        monkeypatch.setattr(simhash_trie, "FRONTIER", frontier)
        for x, y, same in ((a, b, False), (a, a, True)):
            got = [p for i, j in simhash_trie.near_pairs(x, y, deep(x), deep(y), 2, same) for p in zip(i.tolist(), j.tolist(), strict=True)]
            want = {(i, j) for i in range(len(x)) for j in range(len(y)) if int(x[i] ^ y[j]).bit_count() <= 2 and (not same or i < j)}
            assert len(got) == len(set(got)) and set(got) == want


def test_registered_simhash_of_a_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids, fps = [r.doc_id for r in rows], [simhash(r.text) for r in rows]
    got = {tuple(r) for r in __spark_entry__.queries()["op13_simhash_trie"](spark, sf).select("doc_id", "fingerprint", "component_id").collect()}
    assert got == {(i, f"{f:016x}", c) for i, f, c in zip(ids, fps, smallest(ids, fps), strict=True)}


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_spelling_variants"])
def test_registered_queries_by_sql(spark, sf, name):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    df = __spark_entry__.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert got == sorted(repr(r) for r in db.execute(f"select {', '.join(columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall())
