"""Hard negatives, ranked lexical search and top-k search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.llm import bagrank, balltree, hardneg, vectors

ROWS = "vec_id long, embedding array<double>, label int, score double, key string, block string"


def odd_vectors(n=300, d=6, seed=5):
    """Copies of one vector in a third of the rows, ties, zero, empty, short, null and non-finite vectors, null ids and labels."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [0.5, -0.25, 0.125, 0.0, 0.75, 0.25] if i % 3 == 0 else [rng.choice([-1, -0.5, 0, 0.25, 0.5, 1]) * rng.random() for _ in range(d)]
        rows.append((i, v, i % 4))
    rows += [(n, None, 1), (n + 1, [0.1, None, 0.2], 1), (n + 2, [float("nan")] * d, 1), (n + 3, [float("inf")] * d, 2), (n + 4, [], 2), (n + 5, [0.0] * d, 3), (n + 6, [0.7, 0.3], 1)]
    rows += [(None, [0.9] * d, 1), (None, [0.9] * d, 1), (n + 7, [0.4] * d, None), rows[1], rows[1], rows[10]]
    rows += [(10, [0.2] * d, 2), (20, rows[20][1], 3)]
    return rows


def scored(rows):
    """Rows that take part as (place, id, label, integers); the score of two of them."""
    good = [(k, i, label, [math.floor(256 * x) for x in v]) for k, (i, v, label) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return good, lambda a, b: sum(x * y for x, y in zip(a[3], b[3]))


def by_rank(candidates, query, score):
    return sorted(((-score(query, c), c[1] is None, c[1] or 0, c[0]) for c in candidates))


def shown(i, null):
    return None if null else i


@pytest.mark.parametrize("sizes", [(4_096, 256, 128), (40, 8, 5)])
def test_top_k_matches_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(vectors, "SHARD_ROWS", sizes[0])
    monkeypatch.setattr(vectors, "BLOCK_ROWS", sizes[1])
    rows = odd_vectors()
    df = spark.createDataFrame([(*r, 0.0, "k", "b") for r in rows], ROWS)
    good, score = scored(rows)
    want = []
    for q in good:
        if q[1] is not None and q[1] % 10 == 0:
            ranked = by_rank([c for c in good if c[0] != q[0]], q, score)[:5]
            want += [(q[1], k + 1, shown(i, null), -s) for k, (s, null, i, _) in enumerate(ranked)]
    got = [tuple(r) for r in balltree.top_k(df, F.col("vec_id") % 10 == 0, 5, leaf_rows=sizes[2]).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def brute_negatives(rows, every, positives=5, negatives=10):
    good, score = scored(rows)
    good = [r for r in good if r[2] is not None]
    want = []
    for a in good:
        if a[1] is None or a[1] % every:
            continue
        for s, null, i, _ in by_rank([c for c in good if c[0] != a[0] and c[2] == a[2]], a, score)[:positives]:
            fit = [c for c in good if c[2] != a[2] and 30 * -s <= 100 * score(a, c) <= 90 * -s]
            want += [(a[1], shown(i, null), k + 1, shown(j, none), -s, -t) for k, (t, none, j, _) in enumerate(by_rank(fit, a, score)[:negatives])]
    return want


@pytest.mark.parametrize("sizes", [(4_096, 256, 128), (40, 8, 5)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(vectors, "SHARD_ROWS", sizes[0])
    monkeypatch.setattr(vectors, "BLOCK_ROWS", sizes[1])
    rows = odd_vectors(seed=6)
    df = spark.createDataFrame([(*r, 0.0, "k", "b") for r in rows], ROWS)
    got = [tuple(r) for r in hardneg.mine(df, F.col("vec_id") % 10 == 0, F.col("label"), run_rows=sizes[2]).collect()]
    assert sorted(got, key=repr) == sorted(brute_negatives(rows, 10), key=repr)


def test_searches_of_empty_tables(spark):
    none = spark.createDataFrame([], ROWS)
    assert balltree.top_k(none, F.col("vec_id") % 10 == 0, 5).collect() == []
    assert hardneg.mine(none, F.col("vec_id") % 10 == 0, F.col("label")).collect() == []
    one = spark.createDataFrame([(0, [1.0], 1, 0.0, "k", "b")], ROWS)
    assert balltree.top_k(one, F.col("vec_id") % 10 == 0, 5).collect() == []
    assert hardneg.mine(one, F.col("vec_id") % 10 == 0, F.col("label")).collect() == []


def test_bounds_are_never_too_low_and_shards_hold_all_rows():
    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.integers(-300, 300, (500, 7)), np.zeros((3, 7), np.int64), np.full((40, 7), 90)])
    labels = np.sort(rng.integers(0, 3, len(rows)))
    queries = np.concatenate([rng.integers(-300, 300, (20, 7)), np.zeros((1, 7), np.int64), np.full((1, 7), 90)])
    own = rng.integers(0, 3, len(queries))
    exact = queries @ rows.T
    for searcher, wanted in ((balltree.BallTree(16), np.ones(exact.shape, bool)), *((hardneg.Angles(hardneg.references(rows.astype(float), 4), same, 16), (own[:, None] == labels) == same) for same in (True, False))):
        order, shard = searcher.shard(rows, labels)
        assert sorted(order) == list(range(len(rows)))
        shard |= {"labels": labels[order], "low": labels.min(), "high": labels.max()}
        block = searcher.query(queries, own) | {"rows": queries, "labels": own}
        bound = searcher.bounds(block, [shard])[:, 0]
        for q in range(len(queries)):
            assert (exact[q][wanted[q]] <= bound[q]).all()
            for lo, hi in ((-(10**9), 10**9), (0, 5_000), (20_000, 10**9)):
                found = set(order[np.concatenate([np.empty(0, int), *searcher.visit(shard, block, q, [lo, hi])]).astype(int)].tolist())
                assert {k for k in range(len(rows)) if wanted[q][k] and lo <= exact[q][k] <= hi} <= found


def test_nodes_below_the_reached_score_are_left_out():
    """Just the leaves are opened that have no node above them, themselves included, whose ball lies below."""
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.integers(-5, 5, (1_000, 8)) + 400 * np.eye(8, dtype=int)[k] for k in range(8)])
    tree = balltree.BallTree(64)
    order, shard = tree.shard(rows, np.zeros(len(rows), int))
    query, least = rows[0].astype(float), 100_000
    bound = {}

    def leaves(node, above):
        a, b = shard["nodes"][node]
        own = rows[order[a:b]].astype(float)
        centre = own.mean(axis=0)
        bound[node] = query @ centre + np.linalg.norm(query) * max(np.linalg.norm(x - centre) for x in own)
        reached = above and bound[node] >= least
        if shard["left"][node]:
            yield from leaves(shard["left"][node], reached)
            yield from leaves(shard["left"][node] + 1, reached)
        elif reached:
            yield node

    want = set(leaves(0, True))
    at = {int(a): node for node, (a, _) in enumerate(shard["nodes"]) if not shard["left"][node]}
    seen = [at[int(p[0])] for p in tree.visit(shard, {"rows": rows[:1]}, 0, [least, 10**9])]
    assert set(seen) == want and len(seen) == len(want) < len(at)


def test_products_are_exact_or_an_error():
    big = np.array([[1 << 40, 3], [-(1 << 40), 7]])
    assert vectors.products(big, np.array([1 << 20, 1]), 2.0**61).tolist() == [(1 << 60) + 3, -(1 << 60) + 7]
    with pytest.raises(OverflowError):
        vectors.products(big, np.array([1 << 40, 1]), 2.0**80)


# ranked lexical search ---------------------------------------------------------------------------------


def brute_ranks(docs, items, most):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, words(t)) for i, t in docs]
    n_docs, n_terms = sum(1 for _, w in bags if w), sum(len(w) for _, w in bags)
    counts = [(i, len(w), Counter(w)) for i, w in bags]
    df = Counter(t for _, _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, n, c in counts:
            if n:
                m = 100 - 50 + (50 * n * n_docs) // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(words(text)) if c[t])
                if s > 0:
                    found.append((-s, i is None, i or 0))
        out += [(item, k + 1, shown(i, null), -s) for k, (s, null, i) in enumerate(sorted(found)[:most])]
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_ranks_match_brute_force(spark, block_bytes):
    rng = random.Random(8)
    word = ["the", "of", "Äpfel", "naïve", "x1", "ZEBRA", "a-b", "中文", "tail", "q"]
    docs = [(i, "the of the" if i % 3 == 0 else " ".join(rng.choice(word) for _ in range(rng.randrange(0, 12)))) for i in range(240)]
    docs += [(500, None), (501, ""), (502, "... \x00\n"), (None, "the of the"), (None, "zebra"), (503, "ZEBRA tail " * 20_000), (7, "zebra q"), (7, "zebra q")]
    items = [(1, "The zebra, the tail!"), (2, "of"), (3, None), (4, "absent words"), (5, "äpfel Äpfel 中文"), (5, "x1 A q"), (None, "naïve b"), (6, "the")]
    d = spark.createDataFrame([(i, t, 0, "x", "y", 1) for i, t in docs], "doc_id long, text string, score int, bag string, name string, rank int")
    b = spark.createDataFrame([(i, t, 0, "x") for i, t in items], "item_id long, text string, item int, bag string")
    got = [tuple(r) for r in bagrank.ranked(d, b, 20, block_bytes).collect()]
    assert sorted(got, key=repr) == sorted(brute_ranks(docs, items, 20), key=repr)


def test_ranks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert bagrank.ranked(docs, items).collect() == []
    assert bagrank.ranked(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).collect() == []


def test_equal_bags_are_one_class(spark):
    rows = bagrank.bags(spark.createDataFrame([(1, "a b b"), (2, "B a. b"), (3, "a b b c"), (4, "a b b zz"), (5, "zz")], "doc_id long, text string"), {b"a": 0, b"b": 1})
    found = {(r["members"], r["first_"]["doc_id"]) for r in bagrank.classes(rows, 5, 10).collect()}
    assert found == {(2, 1), (2, 3)}
