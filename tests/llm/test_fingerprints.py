"""SimHash fingerprints, Golay keys, near-duplicate groups and their components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sylva.llm import components, fingerprint, golay, neardup, simhash

DOCS = "doc_id long, text string, node string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "extra") for i, t in rows], DOCS)


def print_of(text, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def corpus():
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "ab É".split() for b in range(40)] + ["The", "THE", "ß"]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    rows, base = [], say(300)
    for k in range(60):
        near = list(base)
        for _ in range(k % 4):
            near[rng.randrange(len(near))] = rng.choice(words)
        rows.append((k, " ".join(near)))
    rows += [(100 + k, " ".join(say(rng.randrange(1, 40)))) for k in range(60)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "ONE"), (205, "two words"), (5, "one"), (5, "one"), (None, "one"), (None, "alone here now"), (206, "w " * 20_000), (207, " x")]
    return rows


def groups(prints, ids, bits):
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(ids))]


@pytest.mark.parametrize("shingle", [1, 3, 5])
def test_near_duplicates(spark, shingle):
    rows = corpus()
    prints = [print_of(t, shingle) for _, t in rows]
    want = sorted((repr(i), f"{p:016x}", repr(c)) for (i, _), p, c in zip(rows, prints, groups(prints, [i for i, _ in rows], 3)))
    found = neardup.near_duplicates(documents(spark, rows), shingle, 3).select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("f"), "component_id")
    assert sorted((repr(r["doc_id"]), r["f"], repr(r["component_id"])) for r in found.collect()) == want


def test_near_duplicates_limits(spark):
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        neardup.near_duplicates(documents(spark, []), 5, 4)


def test_golay_keys_meet():
    rng = np.random.default_rng(1)
    x = np.concatenate([np.arange(4096), rng.integers(0, 1 << 23, 4000)])
    keys = lambda v: [set(k) for k in np.split(golay.keys(v)[1], np.flatnonzero(np.diff(golay.keys(v)[0])) + 1)]
    own = keys(x)
    assert {len(k) for k in own} == {1, 6}
    for bit in range(23):
        assert all(a & b for a, b in zip(own, keys(x ^ (1 << bit))))


def test_print_keys_meet_within_three_bits():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    y = x.copy()
    for k in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            y[k] ^= np.uint64(1 << int(b))
    keyed = []
    for v in (x, y):
        rows, keys = neardup.print_keys(v)
        keyed.append([set(keys[rows == k].tolist()) for k in range(len(v))])
    assert all(a & b for a, b in zip(*keyed))


def test_spanning_links_join_what_is_near():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    x = np.array([centres[rng.integers(5)] ^ np.uint64(sum(1 << int(b) for b in rng.choice(14, rng.integers(0, 6), replace=False))) for _ in range(400)], dtype=np.uint64)
    x = np.unique(x)
    a, b = neardup.spanning_links(x, 3)
    assert len(a) < len(x) and (np.bitwise_count(x[a] ^ x[b]) <= 3).all()
    want = groups([int(v) for v in x], list(range(len(x))), 3)
    label = list(range(len(x)))
    for i, j in zip(a, b):
        old, new = max(label[i], label[j]), min(label[i], label[j])
        label = [new if v == old else v for v in label]
    assert label == want


def test_large_keys_are_dealt_in_cells(spark):
    rows = [(i, t) for i, t in corpus() if i is not None]
    prints = neardup.shingle_prints(documents(spark, rows), 3)
    whole, cells = (sorted(map(tuple, neardup.grouped(prints, 3, n).select("doc_id", "component_id").collect())) for n in (1 << 14, 3))
    assert whole == cells


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 3), (10, 9), (9, 8), (8, 7), (7, 6), (6, 5), (20, 21), *((100, k) for k in range(101, 140))]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {k: v for k, v in got.items() if k < 100} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 10: 5, 20: 20, 21: 20}
    assert all(got[k] == 100 for k in range(100, 140))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_first(spark):
    rows = [(i, t) for i, t in corpus() if i is not None]
    df = documents(spark, rows)
    kept = neardup.keep_first(df)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == df.columns and ids & set(range(60)) == {0, 5}  # 5 also names another text
    assert set(range(100, 160)) <= ids | {i for i, t in rows if len((t or "").split()) < 2}
    assert not {201, 202} & ids and 200 in ids


def five_word_shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    a, b = five_word_shingles(a), five_word_shingles(b)
    return len(a & b) / len(a | b)


def edited(rng, words, changes):
    words = list(words)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.randrange(10**9)}"
    return words


def test_keep_first_keeps_what_is_below_the_similarity(spark):
    rng = random.Random(5)
    rows = []
    for k in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(200)]
        changed = words[::-1] if k % 3 == 0 else edited(rng, words, 9 if k % 3 == 1 else 6)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
    assert all(similarity(rows[k][1], rows[k + 1][1]) < 0.8 for k in range(0, 60, 2))
    assert {r["doc_id"] for r in neardup.keep_first(documents(spark, rows)).collect()} == set(range(60))


def test_keep_first_finds_planted_copies(spark):
    rng = random.Random(6)
    rows, want = [], set()
    for k in range(400):
        # few different words, many repeats: the sets of words of a text and its copy are less alike than the shingles
        vocabulary = 3000 if k % 2 else 40
        words = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(150, 600))]
        a, b = " ".join(words), " ".join(edited(rng, words, int(len(words) * rng.uniform(0.008, 0.026))))
        rows += [(2 * k, a), (2 * k + 1, b)]
        want |= {2 * k} if similarity(a, b) >= 0.8 else {2 * k, 2 * k + 1}
    assert 200 < 800 - len(want) < 400
    assert {r["doc_id"] for r in neardup.keep_first(documents(spark, rows)).collect()} == want


def test_keep_first_odd_rows_and_cells(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = [(k, " ".join(edited(rng, base, k % 3))) for k in range(40)] + [(None, " ".join(edited(rng, base, 1))), (50, "a b"), (51, "b a")]
    df = documents(spark, rows)
    got = [sorted(map(repr, neardup.alike(df, cell_bytes=n).collect())) for n in (1 << 24, 4096)]
    assert got[0] == got[1]
    assert sorted(map(repr, (r["doc_id"] for r in neardup.keep_first(df).collect()))) == ["0", "50", "51"]


def test_keep_first_repeats_and_clashes(spark):
    text, near = "a b c d e f g h", "a b c d e f g h i"
    rows = [(1, text), (1, text), (2, text), (1, near), (None, text), (7, "alone alone"), (7, "alone alone"), (None, "nobody"), (None, "nobody"), (8, None), (8, ""), (8, None)] + [(9, "hot")] * 300
    df = spark.createDataFrame([(i, t, "g", 1, "k") for i, t in rows], "doc_id long, text string, GONE_ID string, hash int, key string")
    kept = neardup.keep_first(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert len(got) == 5 and {(7, "alone alone"), (None, "nobody"), (9, "hot")} < set(got)
    assert sum(i == 1 for i, _ in got) == 1 and sum(i == 8 for i, _ in got) == 1
    assert neardup.keep_first(df.limit(0)).collect() == []
    named = neardup.alike(df).where("text_hash is not null").groupBy("component_id").count().collect()
    assert {(r["component_id"], r["count"]) for r in named} == {(1, 5), (7, 2), (None, 2), (8, 3), (9, 300)}


def test_names_sort_by_id(spark):
    ids = [None, 0, -1, 5, -(1 << 63), (1 << 63) - 1, 300]
    df = spark.createDataFrame([(i,) for i in ids], "i long").withColumn("n", neardup.named(F.col("i"), F.lit("x").cast("binary"))).withColumn("back", neardup.name_id(F.col("n")))
    assert [r["i"] for r in df.orderBy("n").collect()] == [-(1 << 63), -1, 0, 5, 300, (1 << 63) - 1, None]
    assert all(r["i"] == r["back"] for r in df.collect())


def test_similar_pairs_span_the_groups():
    rng = np.random.default_rng(8)
    sets, at = [], np.arange(60, dtype=np.uint64)
    for k in range(120):
        if k % 40 == 0:
            at = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
        at = at.copy()
        changed = rng.choice(60, rng.integers(1, 13), replace=False)
        at[changed] = rng.integers(0, 1 << 62, len(changed), dtype=np.uint64)
        sets.append(np.unique(at))
    label, want = list(range(len(sets))), list(range(len(sets)))

    def join(names, i, j):
        return [names[i] if v == names[j] else v for v in names]

    alike = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8
    for i in range(len(sets)):
        for j in range(i):
            if alike(i, j):
                want = join(want, j, i)
    pairs = neardup.similar_pairs(sets, 0.8)
    assert len(pairs) < len(sets) and all(alike(i, j) for i, j in pairs)
    for i, j in pairs:
        label = join(label, i, j)
    groups_of = lambda names: sorted(tuple(k for k, v in enumerate(names) if v == n) for n in set(names))
    assert groups_of(label) == groups_of(want)
    assert 3 < len(set(want)) < 100


def test_keep_first_short_texts(spark):
    words = "one two three four five six seven eight nine".split()
    rows = [(1, " ".join(words)), (2, " ".join(words[:8])), (3, " ".join(words[:7])), (4, "one two three four"), (5, "one two three")]
    # 8 of 9 words have 4 of 5 shingles in common, 7 of 8 words 3 of 4
    assert {r["doc_id"] for r in neardup.keep_first(documents(spark, rows)).collect()} == {1, 3, 4, 5}


def test_set_print_is_the_simhash():
    rng = np.random.default_rng(10)
    for n in (0, 1, 2, 9, 40_000):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        votes = [int((x >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]
        assert neardup.set_print(x) % (1 << 64) == sum(1 << b for b, v in enumerate(votes) if 2 * v > n)


def test_print_groups_find_near_copies(spark):
    rng = random.Random(12)
    rows = []
    for k in range(200):
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited(rng, words, 1)))]
    prints = [(i, neardup.set_print(neardup.text_shingles(t, 5))) for i, t in rows]
    near = dict(neardup.print_groups(spark.createDataFrame(prints, "doc_id long, fingerprint long")).select("doc_id", "near").collect())
    assert sum(near[2 * k] == near[2 * k + 1] for k in range(200)) > 150
    assert len({near[2 * k] for k in range(200)}) == 200
    prints = dict(prints)
    assert all(near[2 * k] == near[2 * k + 1] for k in range(200) if (prints[2 * k] ^ prints[2 * k + 1]).bit_count() <= 3)


def test_links_are_found_by_golay_keys_alone(spark):
    rng = random.Random(13)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited(rng, words, 1)))]
    df = documents(spark, rows)
    found = neardup.shingle_keys(df, 5).select("*", F.struct("doc_id", "text_hash").alias("one"), neardup.named(F.col("doc_id"), F.col("set")).alias("node"))
    pairs = neardup.similar_links(df, found.withColumn("keys", F.array().cast("array<long>")), 5, 0.8)
    linked = {tuple(sorted(r)) for r in pairs.select(neardup.name_id(F.col("a")), neardup.name_id(F.col("b"))).collect()}
    assert len(linked) > 45 and linked <= {(2 * k, 2 * k + 1) for k in range(60)}


def test_edited_likeness(spark):
    rows = [(i, t) for i, t in corpus() if i != 5] + [(5, "x y z")] * 2
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in fingerprint.edited_likeness(documents(spark, rows)).collect()}
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t or "")
    known = sorted((i for i in texts if i is not None))
    for k, i in enumerate(known[:-1]):
        (t,), (nxt,) = texts[i], texts[known[k + 1]]
        n = len(t)
        edited = t[: n - n // 2] + nxt[: n // 2]
        r = got[i, n, hashlib.sha256(edited.encode()).hexdigest()]
        a, b, c = (print_of(x, fingerprint.SHINGLE_WORDS) for x in (t, edited, nxt))
        assert (r["fingerprint"] % (1 << 64), r["edited_fingerprint"] % (1 << 64)) == (a, b)
        assert (r["near_edited"], r["near_next"]) == (1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64)
        near = sum((print_of(u, 2) ^ a).bit_count() <= 3 for _, u in rows)
        assert r["n_near"] == (near if i % 20 == 0 else None)
    assert sum(r["doc_id"] == 5 for r in fingerprint.edited_likeness(documents(spark, rows)).collect()) == 2


def test_edited_likeness_small(spark):
    assert fingerprint.edited_likeness(documents(spark, [])).count() == 0
    only = fingerprint.edited_likeness(documents(spark, [(1, "a b c d")])).first()
    assert only["near_next"] == 1.0 and only["edited_sha256"] == hashlib.sha256(b"a b a b").hexdigest()[:0] + hashlib.sha256(("a b " + "a b ")[:7].encode()).hexdigest()


@pytest.mark.parametrize("radius, blocks", [(3, 5), (3, 4), (1, 3), (0, 1)])
def test_find_within(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(20)]
    every = base + [b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in range(6)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    table = lambda vs: spark.createDataFrame([(signed(v),) for v in vs], "fingerprint long")
    got = {(r["query"], r["fingerprint"], r["distance"]) for r in fingerprint.find_within(table(base), table(every + every), radius, blocks).collect()}
    counted = {r["query"]: r["n"] for r in fingerprint.count_within(table(base), table(every + every).withColumn("copies", F.lit(1)), radius, blocks).collect()}
    assert counted == {signed(a): 2 * sum((a ^ b).bit_count() <= radius for b in every) for a in base}
    assert got == {(signed(a), signed(b), (a ^ b).bit_count()) for a in base for b in every if (a ^ b).bit_count() <= radius}
