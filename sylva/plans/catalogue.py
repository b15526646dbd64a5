"""The registered queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions import paths
from sylva.operators import compare, history, merge, merkle, nodes, restore, sync
from sylva.plans import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def merkle_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the tree of documents, hashed up to the root."""
    return nodes.merkle_nodes(fx.files(spark, sf_dir)).select("path", "type", "n_children", "hash")


def _edited(before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changed entries of a tree of documents, and its files after that: new contents, deletions, a new source and one that goes."""
    gone = (F.col("doc_id") % 10 == 1) | (F.col("source") == "src3")
    kept = before.where(~gone).withColumn("mtime", F.when(F.col("doc_id") % 9 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))
    added = before.where("doc_id % 13 = 0").withColumn("path", F.concat(F.lit("new-"), "path"))
    changed = kept.where("doc_id % 9 = 0").withColumn("gone", F.lit(False)).unionByName(added.withColumn("gone", F.lit(False))).unionByName(before.where(gone).withColumn("gone", F.lit(True)))
    return changed.withColumn("type", F.lit("file")), kept.unionByName(added)


@query
def merkle_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree after changes, of which only the changed files and the directories above them were hashed again."""
    before = fx.files(spark, sf_dir)
    state = merkle.roll_up(before).checkpoint()
    return merkle.applied(state, merkle.update(state, _edited(before)[0])).select("path", "type", "n_children", "hash")


@query
def merkle_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What those changes alter: each path with its new hash, or without one if it is gone."""
    before = fx.files(spark, sf_dir)
    state = merkle.roll_up(before).checkpoint()
    return merkle.update(state, _edited(before)[0]).select("path", F.when(~F.col("gone"), F.col("hash")).alias("hash"))


@query
def file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.file_nodes(fx.files(spark, sf_dir))


@query
def dir_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes.merkle_nodes(fx.files(spark, sf_dir)).where("type = 'directory'")
    return found.select("path", "name", "is_parent", "n_children")


@query
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern leaves out every path with a segment that starts with it."""
    found = fx.files(spark, sf_dir)
    return found.where(~paths.any_segment_ignored(F.col("path"), ("src1", "fr"))).select("path")


@query
def depth_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.files(spark, sf_dir).select("path")
    every = found.unionByName(nodes.directories(found))
    return nodes.within_depth(every, 2).select("path", paths.depth(F.col("path")).alias("depth"))


@query
def event_ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.files(spark, sf_dir)
    return found.where(~paths.event_ignored(F.col("path"), ("src1", "fr"))).select("path")


@query
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return fx.names(spark, sf_dir).select("path", paths.parent(path).alias("parent"), paths.basename(path).alias("name"), paths.stem(path).alias("stem"), paths.extension(path).alias("ext"), paths.depth(path).alias("depth"))


@query
def blob_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.blob_table(fx.files(spark, sf_dir))


@query
def children_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.children(nodes.merkle_nodes(fx.files(spark, sf_dir))).select("parent_path", "pos", "path")


@query
def node_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the paths of all labelled documents."""
    wanted = fx.files(spark, sf_dir).join(fx.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("path")
    return nodes.file_nodes(fx.files(spark, sf_dir)).join(wanted, "path", "left_semi").select("path", "hash")


@query
def node_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes found again by the hashes of all children."""
    every = nodes.merkle_nodes(fx.files(spark, sf_dir))
    wanted = nodes.children(every).select("hash").distinct()
    return every.join(wanted, "hash", "left_semi").select("path", "type", "hash")


@query
def tree_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree below its root, level by level along the hashes."""
    every = nodes.merkle_nodes(fx.files(spark, sf_dir)).checkpoint()
    edges = nodes.children(every).select("parent_path", "hash").join(every.select(F.col("path").alias("parent_path"), F.col("hash").alias("parent_hash")), "parent_path").select("parent_hash", "hash")
    root = every.where(F.col("path") == paths.ROOT).first()["hash"]
    return nodes.fetch_tree(every, edges, root).select("path", "level")


@query
def content_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.content_map(nodes.merkle_nodes(fx.files(spark, sf_dir)))


def _by_source(entries: DataFrame) -> DataFrame:
    return entries.withColumn("tree", F.substring_index("path", "/", 1))


@query
def content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.content_key(_by_source(fx.files(spark, sf_dir).select("path", "blob_id")), "tree")


@query
def content_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's tree before and after a deletion of long files."""
    before = _by_source(fx.files(spark, sf_dir).select("path", "blob_id", "size"))
    return compare.content_equal(before, before.where("size <= 30000"), "tree")


@query
def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ours, theirs = fx.merge_sides(spark, sf_dir)
    return compare.tree_diff(ours, theirs)


@query
def change_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that a rescan after ours finds."""
    ancestor, ours, _ = fx.merge_sides(spark, sf_dir)
    return compare.tree_diff(ancestor, ours).select("path", "change")


@query
def expected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.expected_paths(fx.merge_sides(spark, sf_dir)[2])


def _prune(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ancestor, ours, theirs = fx.merge_sides(spark, sf_dir)
    only_files = lambda df: df.where(F.col("blob_id") != paths.DIR_MARKER)
    old = fx.stale(spark, sf_dir)
    present, before = only_files(ours).unionByName(old), only_files(ancestor).unionByName(old)
    expected = restore.expected_paths(theirs)
    return present, restore.prune_files(present, before, expected), expected


@query
def prune_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prune(spark, sf_dir)[1]


@query
def prune_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    present, pruned, expected = _prune(spark, sf_dir)
    return restore.prune_directories(present, pruned, expected)


@query
def flat_name_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written flat under names that many of them share."""
    found = fx.files(spark, sf_dir).select(F.concat(F.lit("len-"), F.floor(F.col("size") / 10).cast("string")).alias("name"), "doc_id", "blob_id")
    return restore.last_by_name(found, "name", "doc_id")


@query
def store_new_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a changed tree that storing it adds."""
    before = fx.files(spark, sf_dir)
    after = before.withColumn("mtime", F.when(F.col("doc_id") % 9 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))
    return nodes.new_nodes(nodes.merkle_nodes(after), nodes.merkle_nodes(before)).select("path", "hash")


@query
def layered_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ours, theirs = fx.merge_sides(spark, sf_dir)
    return nodes.layered(ours, theirs, "path")


@query
def dag_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.tips(fx.history(spark, sf_dir)).select("tree", "time_id")


@query
def fork_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.forks(fx.history(spark, sf_dir))


@query
def two_lowest_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.lowest_tips(fx.history(spark, sf_dir), ["ts"])


@query
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors of each fork's losing tip, with the fewest hops."""
    found = fx.history(spark, sf_dir).checkpoint()
    starts = history.lowest_tips(found, ["ts"]).select("tree", F.col("loser").alias("start"))
    return history.reach(found, starts, order=("ts",)).select("tree", "start", "time_id", "hops")


@query
def nearest_common_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.history(spark, sf_dir).checkpoint()
    pairs = history.lowest_tips(found, ["ts"]).select("tree", F.col("loser").alias("a"), F.col("winner").alias("b"))
    return history.common_ancestor(found, pairs, order=("ts",))


def _heads(found: DataFrame) -> DataFrame:
    """The losing tip's first predecessor in each fork."""
    lost = history.lowest_tips(found, ["ts"]).select("tree", F.col("loser").alias("time_id"))
    return found.join(lost, ["tree", "time_id"]).select("tree", F.coalesce(F.get("previous", F.lit(0)), "time_id").alias("head"))


@query
def ancestry_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.history(spark, sf_dir).checkpoint()
    return history.relation(found, _heads(found), order=("ts",))


@query
def sync_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a receiver at each fork's head does with every revision of the tree."""
    found = fx.history(spark, sf_dir).checkpoint()
    refs = history.relation(found, _heads(found), order=("ts",)).withColumn("equal", F.col("head") == F.col("time_id"))
    return sync.decisions(refs).select("tree", "time_id", "action")


@query
def predecessor_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.resolved_predecessors(fx.history(spark, sf_dir))
    return found.select("tree", "time_id", F.array_join(F.transform("previous", lambda p: p.cast("string")), ",").alias("previous"))


@query
def ref_latest_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.latest_predecessors(fx.history(spark, sf_dir))
    return found.select("tree", "ref", "time_id", F.array_join(F.transform("previous", lambda p: p.cast("string")), ",").alias("previous"))


@query
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.versions(fx.history(spark, sf_dir)).select("tree", "time_id", "version")


@query
def tip_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.winner_of(fx.changes(spark, sf_dir), ["client"], ["ts", "event_type", "event_id"])
    return found.select("client", F.col("winner.event_id").alias("winner"), F.col("loser.event_id").alias("loser"))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_plan(*fx.merge_sides(spark, sf_dir))


def _copies(plan: DataFrame) -> DataFrame:
    return merge.conflict_copies(plan, F.lit(fx.CLIENT), F.lit(fx.CONFLICT_MS))


@query
def three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("path", "merged", "conflict", "lost")


@query
def conflict_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(_plan(spark, sf_dir))


@query
def materialised_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _plan(spark, sf_dir)
    return merge.materialised(plan, _copies(plan))


@query
def conflict_copy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.names(spark, sf_dir).select("path", paths.conflict_name(F.col("path"), F.lit("C1"), F.col("mtime") * 7919).alias("copy_path"))


@query
def conflict_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fx.table(spark, sf_dir, "orders")
    ms = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000 + F.col("o_orderkey") * 61_001
    return orders.select("o_orderkey", paths.conflict_time(ms).alias("stamp"))


@query
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.debounced(fx.changes(spark, sf_dir), "client", "ts", ["event_id"], 6 * 3600)


@query
def consecutive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.without_repeats(fx.changes(spark, sf_dir), ["client"], ["ts", "event_id"], "event_type").select("client", "event_id", "event_type")


@query
def latest_ref_per_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.latest(fx.changes(spark, sf_dir), ["client"], ["ts", "event_id"]).select("client", "event_id")


@query
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of orders that are passed over once returned lines are left out."""
    kept = fx.table(spark, sf_dir, "lineitem").where("l_returnflag != 'R'").select("l_orderkey", F.col("l_linenumber").cast("long").alias("seq"))
    return sync.gaps(kept, ["l_orderkey"], "seq")


@query
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.retry_schedule(fx.table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey") % 6, 3, 5000)


@query
def recovery_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.recovery_schedule(fx.table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey") % 13, 3, 5000)


@query
def multicast_except_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's message to the other nations of its region."""
    nation = fx.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    sent = fx.table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("s_nationkey").alias("origin"), "n_regionkey")
    return sync.multicast(sent, nation.select(F.col("n_nationkey").alias("client"), "n_regionkey"), "n_regionkey", "origin", "client").select("s_suppkey", "client")
