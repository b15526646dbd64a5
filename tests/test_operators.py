"""Operators against the tables of cases that their semantics are stated in."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sylva.functions import hashing, paths
from sylva.operators import compare, history, merge, nodes, restore, sync
from sylva.operators.ordering import positions, running_sum, with_previous


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def content(spark, entries):
    return spark.createDataFrame(list(entries.items()), "path string, blob_id string")


VALUES = [None, "one", "two", "three", paths.DIR_MARKER]


@pytest.mark.parametrize("winner", ["ours", "theirs"])
def test_three_way_merge(spark, winner):
    """Every pattern of what the ancestor and both sides hold at a path, against the rules."""
    cases = {f"p{k}": v for k, v in enumerate(itertools.product(VALUES, repeat=3))}
    sides = [content(spark, {p: v[k] for p, v in cases.items() if v[k] is not None}) for k in range(3)]
    plan = {r["path"]: r for r in merge.merge_plan(*sides, winner).collect()}
    for path, (base, ours, theirs) in cases.items():
        if base is ours is theirs is None:
            assert path not in plan
            continue
        first, second = (ours, theirs) if winner == "ours" else (theirs, ours)
        conflict = len({base, ours, theirs}) == 3
        merged = first if conflict or first != base else second
        assert (plan[path]["merged"], plan[path]["lost"], plan[path]["conflict"]) == (merged, second if conflict else None, conflict), (path, base, ours, theirs)


def test_merge_rejects_unknown_side(spark):
    empty = spark.createDataFrame([], "path string, blob_id string")
    with pytest.raises(ValueError):
        merge.merge_plan(empty, empty, empty, "nobody")


def test_merge_is_symmetric(spark):
    a, b, c = (content(spark, m) for m in ({"x": "1", "y": "1"}, {"x": "2", "y": "1", "z": "3"}, {"x": "3"}))
    one = rows(merge.merge_plan(a, b, c, "theirs").select("path", "merged", "lost"))
    assert one == rows(merge.merge_plan(a, c, b, "ours").select("path", "merged", "lost"))
    assert not merge.merge_plan(a, b, b).where("conflict").count()


def test_conflict_names(spark):
    cases = [
        ("plan.md", "desk-7", 1_700_000_000_000, "plan (conflicted copy desk-7 2023-11-14 221320).md"),
        ("a/b/Makefile", "x", 1_600_000_000_000, "a/b/Makefile (conflicted copy x 2020-09-13 122640)"),
        ("etc/.profile", "x", 1_600_000_000_999, "etc/.profile (conflicted copy x 2020-09-13 122640)"),
        ("v1.2/notes", "y z", 0, "v1.2/notes (conflicted copy y z 1970-01-01 000000)"),
        ("logs.old.gz", "y", 0, "logs.old (conflicted copy y 1970-01-01 000000).gz"),
    ]
    df = spark.createDataFrame(cases, "path string, client string, ms long, want string")
    for r in df.withColumn("got", paths.conflict_name(F.col("path"), F.col("client"), F.col("ms"))).collect():
        assert r["got"] == r["want"]


def test_conflict_copies_take_free_names(spark):
    stamp = "(conflicted copy pc 1970-01-01 000000)"
    taken = {f"m/n {stamp}.c": "t", f"m/n {stamp} (1).c": "u"}
    plan = merge.merge_plan(content(spark, {"m/n.c": "base"}), content(spark, {"m/n.c": "mine", **taken}), content(spark, {"m/n.c": "yours", **taken}))
    got = merge.conflict_copies(plan, F.lit("pc"), F.lit(0)).collect()
    assert [(r["copy_path"], r["blob_id"]) for r in got] == [(f"m/n {stamp} (2).c", "mine")]


def test_materialised_directories(spark):
    plan = merge.merge_plan(content(spark, {"gone": "<dir>"}), content(spark, {"mine": "<dir>"}), content(spark, {"theirs": "<dir>", "d/f": "1"}))
    got = rows(merge.materialised(plan, merge.conflict_copies(plan, F.lit("C"), F.lit(0))).select("path", "origin"))
    assert got == [("d", "directory"), ("d/f", "merged"), ("theirs", "directory")]


def random_graph(rng, n):
    """Revisions 0 to n - 1 with up to three predecessors among the earlier ones, some of them without a row."""
    return {f"v{k}": [rng.choice([f"v{j}" for j in range(k)] + ["lost"]) for _ in range(rng.choice([0, 1, 1, 2, 3]))] if k else [] for k in range(n)}


def ways_up(graph, start):
    """Every revision above ``start`` with the fewest hops and, of these ways, the first by the places of predecessors."""
    found, level = {start: (0, ())}, [(start, ())]
    while level:
        steps = sorted((route + (place,), up) for at, route in level for place, up in enumerate(graph.get(at, [])) if up not in found)
        level = []
        for route, up in steps:
            if up not in found:
                found[up] = (len(route), route)
                level.append((up, route))
    return found


def dense(hops, route):
    """The places of a way's predecessors, of which a route lists only those that aren't the first."""
    places = [0] * hops
    for d in route:
        places[-d["at"]] = d["place"]
    return tuple(places)


def test_reach_of_random_graphs(spark):
    rng = random.Random(8)
    graphs = {f"t{k}": random_graph(rng, 20) for k in range(8)}
    found = spark.createDataFrame([(t, k, v) for t, g in graphs.items() for k, v in g.items()], "tree string, time_id string, previous array<string>")
    starts = found.where("time_id = 'v19'").select("tree", F.col("time_id").alias("start"))
    every = starts.join(found.select("tree", "time_id").unionByName(starts.select("tree", F.lit("lost").alias("time_id"))), "tree")
    for block_rows in (1 << 16, 17):
        got = {t: {} for t in graphs}
        for r in history.reach(found, starts, routes_to=every, block_rows=block_rows).collect():
            assert r["time_id"] not in got[r["tree"]]
            got[r["tree"]][r["time_id"]] = (r["hops"], dense(r["hops"], r["route"]))
        assert got == {t: ways_up(g, "v19") for t, g in graphs.items()}


def test_reach_through_many_merges_in_rows_of_the_result(spark):
    rng = random.Random(4)
    n = 100_000
    # one revision in ten merges a line that left up to 40 revisions before
    ups = {k: [k - 1] if k % 10 else [k - 1, max(0, k - rng.randrange(2, 40))] for k in range(1, n)} | {0: []}
    rows = [("t", k, v) for k, v in ups.items()]
    found = spark.createDataFrame(rows, "tree string, time_id long, previous array<long>").repartition(4).checkpoint()
    starts = spark.createDataFrame([("t", n - 1)], "tree string, start long")
    got = dict(history.reach(found, starts, block_rows=20_000).select("time_id", "hops").collect())
    want, level, hops = {n - 1: 0}, [n - 1], 0
    while level:
        hops += 1
        level = list(dict.fromkeys(u for v in level for u in ups[v] if u not in want))
        want |= dict.fromkeys(level, hops)
    assert got == want


def test_walk_sends_on_a_row_for_each_revision_that_leaves():
    from sylva.operators.reach import Walk

    links = {k: [(0, k - 1, None), (1, k - 2, None), (2, -1, 7)] for k in range(2, 500)}
    walk = Walk(links, [(0, (), 499)]).run()
    assert len(walk.hops) == 500 and walk.leaving == {-1: (7, 1, ((0, 2),))}


def test_reach_of_a_long_chain_a_null_and_a_circle(spark):
    n = 5000
    chain = [("chain", f"v{k}", [f"v{k - 1}"] if k else None) for k in range(n)]
    odd = [("odd", "a", [None, "b"]), ("odd", "b", ["c"]), ("odd", "c", ["a"])]
    found = spark.createDataFrame(chain + odd, "tree string, time_id string, previous array<string>")
    starts = spark.createDataFrame([("chain", f"v{n - 1}"), ("odd", "a"), ("none", "x")], "tree string, start string")
    got = {(r["tree"], r["time_id"]): r["hops"] for r in history.reach(found, starts).collect()}
    want = {("chain", f"v{k}"): n - 1 - k for k in range(n)} | {("odd", "a"): 0, ("odd", "b"): 1, ("odd", "c"): 2, ("none", "x"): 0}
    assert got == want
    below = history.reach(found, spark.createDataFrame([("chain", "v0")], "tree string, start string"), up=False)
    assert below.count() == n


def test_common_ancestor_of_random_graphs(spark):
    rng = random.Random(12)
    graphs = {f"t{k}": random_graph(rng, 14) for k in range(12)}
    asked = [(t, f"v{rng.randrange(14)}", f"v{rng.randrange(14)}") for t in graphs for _ in range(4)]
    found = spark.createDataFrame([(t, k, v) for t, g in graphs.items() for k, v in g.items()], "tree string, time_id string, previous array<string>")
    pairs = spark.createDataFrame(sorted(set(asked)), "tree string, a string, b string")
    for r in history.common_ancestor(found, pairs).collect():
        of_a, of_b, graph = ways_up(graphs[r["tree"]], r["a"]), ways_up(graphs[r["tree"]], r["b"]), graphs[r["tree"]]
        shared = sorted((of_b[v], v) for v in of_a if v in of_b and v in graph)
        assert r["ancestor"] == (shared[0][1] if shared else None), r


def test_relation_and_tips(spark):
    rng = random.Random(3)
    graph = random_graph(rng, 16)
    found = spark.createDataFrame([("t", k, v) for k, v in graph.items()], "tree string, time_id string, previous array<string>")
    for head in ("v3", "v9"):
        got = {r["time_id"]: r["relation"] for r in history.relation(found, spark.createDataFrame([("t", head)], "tree string, head string")).collect()}
        want = {v: "behind" if head in ways_up(graph, v) and v != head else "ahead" if v in ways_up(graph, head) else "diverged" for v in graph}
        assert got == want
    tips = {v for v in graph if not any(v in ups for ups in graph.values())}
    assert {r["time_id"] for r in history.tips(found).collect()} == tips and len(tips) > 1
    assert [(r["tree"], r["n_tips"]) for r in history.forks(found).collect()] == [("t", len(tips))]


def test_merkle_is_deterministic_and_follows_changes(spark):
    files = [("a/b/x.txt", "1", 1, 10), ("a/y.txt", "2", 1, 10), ("z", "3", 0, None)]
    schema = "path string, blob_id string, size long, mtime long"
    empty = spark.createDataFrame([("e/f",)], "path string")
    get = lambda fs, dirs=None: {r["path"]: r for r in nodes.merkle_nodes(spark.createDataFrame(fs, schema), dirs).collect()}
    one, two = get(files), get(files[::-1])
    assert {p: r["hash"] for p, r in one.items()} == {p: r["hash"] for p, r in two.items()}
    changed = get([("a/b/x.txt", "1", 1, 11), *files[1:]])
    assert {p for p in one if one[p]["hash"] != changed[p]["hash"]} == {".", "a", "a/b", "a/b/x.txt"}
    more = get(files, empty)
    assert (more["e/f"]["is_parent"], more["e/f"]["n_children"], more["e"]["n_children"]) == (False, 0, 1)
    assert [r["path"] for r in get([]).values()] == ["."]


def test_children_and_fetch(spark):
    every = nodes.merkle_nodes(spark.createDataFrame([("a/b/x", "1", 1, 1), ("a/c", "2", 1, 1)], "path string, blob_id string, size long, mtime long")).checkpoint()
    kids = nodes.children(every)
    assert rows(kids.select("parent_path", "pos", "path")) == [(".", 1, "a"), ("a", 1, "a/b"), ("a", 2, "a/c"), ("a/b", 1, "a/b/x")]
    edges = kids.join(every.select(F.col("path").alias("parent_path"), F.col("hash").alias("parent_hash")), "parent_path").select("parent_hash", "hash")
    root = every.where("path = '.'").first()["hash"]
    assert rows(nodes.fetch_tree(every, edges, root).select("path", "level")) == [(".", 0), ("a", 1), ("a/b", 2), ("a/b/x", 3), ("a/c", 2)]
    with pytest.raises(ValueError):
        nodes.fetch_tree(every, edges, " ")
    with pytest.raises(LookupError):
        nodes.fetch_tree(every, edges, "nothing")


def test_content_maps(spark):
    given = spark.createDataFrame([(".", "directory", None), ("d", "directory", None), ("f", "file", "b"), ("g", "file", None), ("o", "other", "b")], "path string, type string, blob_id string")
    assert rows(compare.content_map(given)) == [("d", "<dir>"), ("f", "b"), ("g", "")]
    a, b = content(spark, {"x": "1", "y": "2"}), content(spark, {"y": "2", "x": "1"})
    key = lambda df: compare.content_key(df).first()["content_key"]
    assert key(a) == key(b) != key(content(spark, {"x": "2", "y": "1"}))
    assert rows(compare.tree_diff(a, content(spark, {"y": "3", "z": "1"})).select("path", "change")) == [("x", "deleted"), ("y", "modified"), ("z", "added")]


def test_fields_hash_tells_fields_apart(spark):
    got = spark.sql("SELECT * FROM VALUES ('a', 'bc'), ('ab', 'c'), (null, 'abc'), ('', 'abc') AS t(x, y)").select(hashing.fields_hash(F.col("x"), F.col("y"))).distinct().count()
    assert got == 4


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c.txt",), ("x",), (".hid",), ("d/e.",)], "p string")
    got = rows(df.select("p", paths.parent(F.col("p")), paths.stem(F.col("p")), paths.extension(F.col("p")), paths.depth(F.col("p"))))
    assert got == [(".hid", ".", ".hid", "", 1), ("a/b/c.txt", "a/b", "c", ".txt", 3), ("d/e.", "d", "e", ".", 2), ("x", ".", "x", "", 1)]
    ignored = lambda p: spark.range(1).select(paths.any_segment_ignored(F.lit(p), paths.DEFAULT_IGNORE)).first()[0]
    assert ignored("a/node_modules/x") and ignored("distribution") and not ignored("a/b")


def test_prune(spark):
    present = spark.createDataFrame([("keep/a",), ("old/b",), ("old/deep/c",), ("fresh/d",)], "path string")
    before = present.where("path != 'fresh/d'")
    expected = restore.expected_paths(content(spark, {"keep/a": "1", "empty": "<dir>"}))
    gone = restore.prune_files(present, before, expected)
    assert rows(gone) == [("old/b",), ("old/deep/c",)]
    assert rows(restore.prune_directories(present, gone, expected)) == [("old", 1), ("old/deep", 2)]


def test_ordering_across_ranges(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 800, "hot").otherwise("cold").alias("k"), "id")
    got = positions(df, ["k"], ["id"]).collect()
    assert all(r["pos"] == (r["id"] + 1 if r["k"] == "hot" else r["id"] - 799) for r in got)
    led = with_previous(df, ["k"], ["id"], {"id": "before"}).collect()
    assert all(r["before"] == (None if r["id"] in (0, 800) else r["id"] - 1) for r in led)
    assert running_sum(df, ["k"], ["id"], F.col("id"), "s").where("id = 799").first()["s"] == 799 * 400


def test_sync_batches(spark):
    changes = spark.createDataFrame([(1, t, k, v) for k, (t, v) in enumerate([(0, "A"), (1, "B"), (9, "B"), (10, "A"), (30, None), (31, None)])], "client long, s long, event_id long, v string").withColumn("ts", F.timestamp_seconds("s"))
    assert rows(sync.debounced(changes, "client", "ts", ["event_id"], 5).select("n_changes", "last")) == [(2, 1), (2, 3), (2, 5)]
    assert [r["event_id"] for r in sync.without_repeats(changes, ["client"], ["ts", "event_id"], "v").orderBy("event_id").collect()] == [0, 1, 3, 4]
    assert rows(sync.gaps(spark.createDataFrame([("a", 1), ("a", 2), ("a", 5)], "k string, seq long"), ["k"], "seq")) == [("a", 2, 5, 2)]
    refs = spark.createDataFrame([("r", 9), ("s", 1)], "ref string, f int")
    assert rows(sync.retry_schedule(refs, F.col("f"), 3, 5000).select("ref", "attempt", "at_ms", "outcome")) == [("r", 1, 0, "retry"), ("r", 2, 5000, "retry"), ("r", 3, 15000, "retry"), ("r", 4, 30000, "exhausted"), ("s", 1, 0, "retry"), ("s", 2, 5000, "done")]
    assert rows(sync.recovery_schedule(refs, F.col("f"), 3, 5000, 2).select("ref", "recovery", "state")) == [("r", 0, "queued"), ("r", 1, "queued"), ("r", 2, "invalidated"), ("s", 0, "queued"), ("s", 1, "done")]


def test_last_by_name(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "name string, place long, blob_id string")
    assert rows(restore.last_by_name(df, "name", "place")) == [("a", 2, "y"), ("b", 1, "z")]
