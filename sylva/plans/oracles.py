"""The catalogue's queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from sylva.plans.fixtures import CLIENT, CONFLICT_MS


def _hash(*fields: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(length(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"


def _lanes(member: str) -> str:
    return ", ".join(f"CAST(coalesce(sum(CAST(('0x' || substr({member}, {1 + 15 * k}, 15))::BIGINT AS DECIMAL(38,0))), 0) AS DECIMAL(38,0)) AS lane{k}" for k in range(4))


_LANE_NAMES = ("lane0", "lane1", "lane2", "lane3")


def _stamp(ms: str) -> str:
    return f"strftime(make_timestamp(CAST(floor(({ms}) / 1000) AS BIGINT) * 1000000), '%Y-%m-%d %H%M%S')"


_NAME = "regexp_extract({p}, '[^/]*$')"
_EXT = "regexp_extract(regexp_extract({p}, '[^/]*$'), '(?s)^.+?([.][^.]*)$', 1)"


def _name(p: str) -> str:
    return _NAME.format(p=p)


def _ext(p: str) -> str:
    return _EXT.format(p=p)


def _stem(p: str) -> str:
    return f"left({_name(p)}, length({_name(p)}) - length({_ext(p)}))"


def _copy(p: str, client: str, stamp: str, suffix: str = "''") -> str:
    return f"left({p}, length({p}) - length({_name(p)})) || {_stem(p)} || ' (conflicted copy ' || {client} || ' ' || {stamp} || ')' || {suffix} || {_ext(p)}"


_FIXED = _copy("path", f"'{CLIENT}'", _stamp(str(CONFLICT_MS)))

_FILES = """
files AS (SELECT doc_id, coalesce(source, '_') AS source, coalesce(lang, '_') AS lang, coalesce(source, '_') || '/' || coalesce(lang, '_') || '/doc-' || doc_id || '.txt' AS path,
  sha256(coalesce(text, '')) AS blob_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, doc_id * 1000 AS mtime FROM documents)"""

_FILE_HASH = _hash("'file'", _name("path"), "path", "size", "blob_id", "mtime")


def _nodes(files: str, at: str = "") -> str:
    """Three levels of directories above the leaves of ``files``."""
    digest = lambda name, path: _hash("'directory'", name, path, "n_children", *_LANE_NAMES)
    return f"""
leaf{at} AS (SELECT path, {_name("path")} AS name, size, blob_id, mtime, {_FILE_HASH} AS hash FROM {files}),
l2{at} AS (SELECT *, {digest(_name("path"), "path")} AS hash FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS path, count(*) AS n_children, {_lanes("hash")} FROM leaf{at} GROUP BY 1)),
l1{at} AS (SELECT *, {digest(_name("path"), "path")} AS hash FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS path, count(*) AS n_children, {_lanes("hash")} FROM l2{at} GROUP BY 1)),
l0{at} AS (SELECT *, {digest("'.'", "'.'")} AS hash FROM (SELECT '.' AS path, count(*) AS n_children, {_lanes("hash")} FROM l1{at})),
nodes{at} AS (SELECT path, name, 'file' AS type, false AS is_parent, 0 AS n_children, size, blob_id, mtime, hash, 3 AS level FROM leaf{at}
  UNION ALL SELECT path, {_name("path")}, 'directory', true, n_children, NULL, NULL, NULL, hash, 2 FROM l2{at}
  UNION ALL SELECT path, path, 'directory', true, n_children, NULL, NULL, NULL, hash, 1 FROM l1{at}
  UNION ALL SELECT path, '.', 'directory', n_children > 0, n_children, NULL, NULL, NULL, hash, 0 FROM l0{at})"""


_TREE = f"WITH {_FILES},{_nodes('files')}"

_SIDES = f"""{_FILES},
taken AS (SELECT {_FIXED} AS path, blob_id FROM files WHERE doc_id % 13 = 0),
dirs AS (SELECT DISTINCT lang, source || '/empty-' || lang AS path FROM files),
ancestor AS (SELECT path, blob_id FROM files UNION ALL SELECT path, blob_id FROM taken UNION ALL SELECT path, '<dir>' FROM dirs),
ours AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'ours-' || blob_id ELSE blob_id END AS blob_id FROM files WHERE doc_id % 7 != 0 UNION ALL SELECT path, blob_id FROM taken UNION ALL SELECT path, '<dir>' FROM dirs WHERE lang != 'de'),
theirs AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'theirs-' || blob_id ELSE blob_id END AS blob_id FROM files WHERE doc_id % 11 != 0 UNION ALL SELECT path, blob_id FROM taken UNION ALL SELECT path, CASE WHEN lang = 'fr' THEN 'blob' ELSE '<dir>' END FROM dirs)"""

_PLAN = f"""{_SIDES},
joined AS (SELECT path, max(a) AS a, max(b) AS b, max(c) AS c FROM (
  SELECT path, blob_id AS a, NULL AS b, NULL AS c FROM ancestor UNION ALL SELECT path, NULL, blob_id, NULL FROM ours UNION ALL SELECT path, NULL, NULL, blob_id FROM theirs) GROUP BY path),
plan AS (SELECT path, c, CASE WHEN b IS NOT DISTINCT FROM c THEN b WHEN b IS NOT DISTINCT FROM a THEN c WHEN c IS NOT DISTINCT FROM a THEN b ELSE c END AS merged,
  b IS DISTINCT FROM c AND b IS DISTINCT FROM a AND c IS DISTINCT FROM a AS conflict,
  CASE WHEN b IS DISTINCT FROM c AND b IS DISTINCT FROM a AND c IS DISTINCT FROM a THEN b END AS lost FROM joined),
wish AS (SELECT path, lost AS blob_id, {_FIXED} AS plain, {_copy("path", f"'{CLIENT}'", _stamp(str(CONFLICT_MS)), "' (1)'")} AS second FROM plan WHERE conflict AND lost IS NOT NULL AND lost != '<dir>'),
copies AS (SELECT path, CASE WHEN plain IN (SELECT path FROM plan) THEN second ELSE plain END AS copy_path, blob_id FROM wish)"""


def _above(source: str) -> str:
    """Directories above the paths of ``source``, but the root."""
    return f"(SELECT DISTINCT array_to_string(list_slice(parts, 1, i), '/') AS path FROM (SELECT parts, unnest(range(1, len(parts))) AS i FROM (SELECT string_split(path, '/') AS parts FROM {source})))"


_PRUNE = f"""{_SIDES},
stale AS (SELECT 'stale/' || lang || '/x-' || doc_id AS path FROM files WHERE doc_id % 10 = 0),
present AS (SELECT path FROM ours WHERE blob_id != '<dir>' UNION ALL SELECT path FROM stale),
before AS (SELECT path FROM ancestor WHERE blob_id != '<dir>' UNION ALL SELECT path FROM stale),
want AS (SELECT path FROM theirs WHERE blob_id != '<dir>'),
wantdirs AS (SELECT path FROM theirs WHERE blob_id = '<dir>' UNION SELECT path FROM {_above("theirs")} UNION SELECT '.'),
pruned AS (SELECT path FROM present SEMI JOIN before USING (path) ANTI JOIN want USING (path))"""

_HISTORY = """
led AS (SELECT o_custkey AS tree, o_orderkey AS time_id, o_orderdate AS ts, lag(o_orderkey, 1) OVER w AS one, lag(o_orderkey, 2) OVER w AS two FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
hist AS (SELECT tree, time_id, ts, 'r' || (time_id // 4) AS ref, list_filter(CASE WHEN time_id % 7 = 0 THEN [two] WHEN time_id % 11 = 0 THEN [one, two] ELSE [one] END, lambda p: p IS NOT NULL) AS previous FROM led),
edges AS (SELECT tree, time_id, unnest(previous) AS parent, generate_subscripts(previous, 1) - 1 AS place FROM hist),
tips AS (SELECT tree, time_id, ts FROM hist ANTI JOIN (SELECT tree, parent AS time_id FROM edges) USING (tree, time_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY ts, time_id) AS r FROM tips),
lowest AS (SELECT a.tree, a.time_id AS loser, b.time_id AS winner FROM ranked a JOIN ranked b ON a.tree = b.tree AND a.r = 1 AND b.r = 2)"""


def _reach(name: str, starts: str, up: bool = True) -> str:
    a, b = ("time_id", "parent") if up else ("parent", "time_id")
    return f"""
{name}_all(tree, start, time_id, hops, route) AS (
  SELECT tree, start, start, 0, CAST([] AS BIGINT[]) FROM {starts}
  UNION ALL SELECT r.tree, r.start, e.{b}, r.hops + 1, list_append(r.route, e.place) FROM {name}_all r JOIN edges e ON e.tree = r.tree AND e.{a} = r.time_id),
{name} AS (SELECT tree, start, time_id, min(hops) AS hops, arg_min(route, row(hops, route)) AS route FROM {name}_all GROUP BY tree, start, time_id)"""


_HEADS = "heads AS (SELECT l.tree, coalesce(h.previous[1], h.time_id) AS head FROM lowest l JOIN hist h ON h.tree = l.tree AND h.time_id = l.loser), head_starts AS (SELECT tree, head AS start FROM heads)"
_RELATION = f"""WITH RECURSIVE {_HISTORY}, {_HEADS},{_reach("up", "head_starts")},{_reach("down", "head_starts", False)},
related AS (SELECT h.tree, heads.head, h.time_id, CASE WHEN d.time_id IS NOT NULL THEN 'behind' WHEN u.time_id IS NOT NULL THEN 'ahead' ELSE 'diverged' END AS relation
  FROM hist h JOIN heads ON heads.tree = h.tree LEFT JOIN up u ON u.tree = h.tree AND u.time_id = h.time_id LEFT JOIN (SELECT * FROM down WHERE hops > 0) d ON d.tree = h.tree AND d.time_id = h.time_id)"""

#: Files after the changes of the incremental roll-up.
_EDITED = """
edited AS (SELECT * REPLACE (CASE WHEN doc_id % 9 = 0 THEN mtime + 1 ELSE mtime END AS mtime) FROM files WHERE doc_id % 10 != 1 AND source != 'src3'
  UNION ALL SELECT * REPLACE ('new-' || path AS path) FROM files WHERE doc_id % 13 = 0)"""

ORACLE_SQL: dict[str, str] = {
    "merkle_rollup": f"{_TREE} SELECT path, type, CAST(n_children AS BIGINT) AS n_children, hash FROM nodes",
    "file_nodes": f"WITH {_FILES} SELECT path, {_name('path')} AS name, 'file' AS type, false AS is_parent, CAST(0 AS BIGINT) AS n_children, size, blob_id, mtime, {_FILE_HASH} AS hash FROM files",
    "dir_nodes": f"{_TREE} SELECT path, name, is_parent, CAST(n_children AS BIGINT) AS n_children FROM nodes WHERE type = 'directory'",
    "ignore_filter": f"WITH {_FILES} SELECT path FROM files WHERE NOT regexp_matches(path, '(^|/)(src1|fr)')",
    "depth_filter": f"WITH {_FILES}, every AS (SELECT path FROM files UNION ALL SELECT path FROM {_above('files')}) SELECT path, CAST(len(string_split(path, '/')) AS INTEGER) AS depth FROM every WHERE len(string_split(path, '/')) <= 2 UNION ALL SELECT '.', 0",
    "event_ignore_filter": f"WITH {_FILES} SELECT path FROM files WHERE NOT (starts_with(path, 'src1') OR starts_with(path, 'fr'))",
    "blob_dedup": f"WITH {_FILES} SELECT blob_id, max(size) AS size, count(*) AS n_files, min(path) AS first_path, max(size) * (count(*) - 1) AS bytes_saved FROM files GROUP BY blob_id",
    "children_ordered": f"{_TREE}, kids AS (SELECT CASE WHEN level = 1 THEN '.' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS parent_path, name, path FROM nodes WHERE level > 0) SELECT parent_path, row_number() OVER (PARTITION BY parent_path ORDER BY name) AS pos, path FROM kids",
    "node_by_path": f"WITH {_FILES} SELECT path, {_FILE_HASH} AS hash FROM files SEMI JOIN labels USING (doc_id)",
    "node_by_hash": f"{_TREE} SELECT path, type, hash FROM nodes WHERE path != '.'",
    "tree_fetch": f"{_TREE} SELECT path, CAST(level AS INTEGER) AS level FROM nodes",
    "content_map": f"{_TREE} SELECT path, CASE WHEN type = 'file' THEN blob_id ELSE '<dir>' END AS blob_id FROM nodes WHERE path != '.'",
    "content_key": f"WITH {_FILES}, sums AS (SELECT tree, count(*) AS n_entries, {_lanes('h')} FROM (SELECT string_split(path, '/')[1] AS tree, {_hash('path', 'blob_id')} AS h FROM files) GROUP BY tree) SELECT tree, n_entries, {_hash('n_entries', *_LANE_NAMES)} AS content_key FROM sums",
    "content_equal": f"WITH {_FILES} SELECT string_split(path, '/')[1] AS tree, max(size) <= 30000 AS equal FROM files GROUP BY 1",
    "tree_diff": f"WITH {_SIDES} SELECT path, CASE WHEN o.path IS NULL THEN 'added' WHEN t.path IS NULL THEN 'deleted' ELSE 'modified' END AS change, o.blob_id AS before, t.blob_id AS after FROM ours o FULL JOIN theirs t USING (path) WHERE o.blob_id IS DISTINCT FROM t.blob_id",
    "change_classify": f"WITH {_SIDES} SELECT path, CASE WHEN o.path IS NULL THEN 'added' WHEN t.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM ancestor o FULL JOIN ours t USING (path) WHERE o.blob_id IS DISTINCT FROM t.blob_id",
    "expected_paths": f"WITH {_PRUNE} SELECT path, 'file' AS kind FROM want UNION ALL SELECT path, 'directory' FROM wantdirs",
    "prune_files": f"WITH {_PRUNE} SELECT path FROM pruned",
    "prune_dirs": f"WITH {_PRUNE}, stay AS (SELECT path FROM present ANTI JOIN pruned USING (path)) SELECT path, CAST(len(string_split(path, '/')) AS INTEGER) AS depth FROM {_above('present')} ANTI JOIN {_above('stay')} held USING (path) ANTI JOIN wantdirs USING (path)",
    "flat_name_last_wins": f"WITH {_FILES} SELECT 'len-' || (size // 10) AS name, max(doc_id) AS doc_id, arg_max(blob_id, doc_id) AS blob_id FROM files GROUP BY 1",
    "merkle_incremental": f"WITH {_FILES},{_EDITED},{_nodes('edited', '_b')} SELECT path, type, CAST(n_children AS BIGINT) AS n_children, hash FROM nodes_b",
    "merkle_changes": f"WITH {_FILES},{_EDITED},{_nodes('files')},{_nodes('edited', '_b')} SELECT path, b.hash FROM nodes a FULL JOIN nodes_b b USING (path) WHERE a.hash IS DISTINCT FROM b.hash",
    "store_new_nodes": f"WITH {_FILES}, changed AS (SELECT * REPLACE (CASE WHEN doc_id % 9 = 0 THEN mtime + 1 ELSE mtime END AS mtime) FROM files),{_nodes('files')},{_nodes('changed', '_b')} SELECT path, hash FROM nodes_b ANTI JOIN nodes USING (hash)",
    "layered_read": f"WITH {_SIDES} SELECT path, blob_id, 'local' AS layer FROM ours UNION ALL SELECT path, blob_id, 'remote' FROM theirs ANTI JOIN ours USING (path)",
    "dag_tips": f"WITH {_HISTORY} SELECT tree, time_id FROM tips",
    "fork_detect": f"WITH {_HISTORY} SELECT tree, count(*) AS n_tips FROM tips GROUP BY tree HAVING count(*) >= 2",
    "two_lowest_tips": f"WITH {_HISTORY} SELECT tree, loser, winner FROM lowest",
    "ancestors": f"WITH RECURSIVE {_HISTORY}, s AS (SELECT tree, loser AS start FROM lowest),{_reach('above', 's')} SELECT tree, start, time_id, CAST(hops AS INTEGER) AS hops FROM above",
    "nearest_common_ancestor": f"WITH RECURSIVE {_HISTORY}, s AS (SELECT tree, loser AS start FROM lowest UNION ALL SELECT tree, winner FROM lowest),{_reach('above', 's')}, met AS (SELECT l.tree, l.loser, l.winner, arg_min(b.time_id, row(b.hops, b.route)) AS ancestor FROM lowest l JOIN above a ON a.tree = l.tree AND a.start = l.loser JOIN above b ON b.tree = l.tree AND b.start = l.winner AND b.time_id = a.time_id GROUP BY ALL) SELECT l.tree, l.loser AS a, l.winner AS b, met.ancestor FROM lowest l LEFT JOIN met USING (tree)",
    "ancestry_relation": f"{_RELATION} SELECT tree, head, time_id, relation FROM related",
    "sync_decisions": f"{_RELATION} SELECT tree, time_id, CASE WHEN head = time_id THEN 'stop' WHEN relation = 'ahead' THEN 'ignore' WHEN relation = 'diverged' THEN 'merge' ELSE 'restore' END AS action FROM related",
    "predecessor_resolution": f"WITH {_HISTORY}, found AS (SELECT DISTINCT e.tree, e.time_id, h.time_id AS parent FROM edges e JOIN hist h ON h.tree = e.tree AND h.ref = 'r' || (e.parent // 4) AND h.time_id != e.time_id) SELECT hist.tree, hist.time_id, string_agg(CAST(parent AS VARCHAR), ',' ORDER BY parent) AS previous FROM hist LEFT JOIN found USING (tree, time_id) GROUP BY ALL",
    "ref_latest_predecessors": f"WITH {_HISTORY} SELECT tree, ref, max(time_id) AS time_id, array_to_string(arg_max(previous, time_id), ',') AS previous FROM hist GROUP BY tree, ref",
    "version_history": f"WITH {_HISTORY} SELECT tree, time_id, row_number() OVER (PARTITION BY tree ORDER BY time_id) AS version FROM hist",
    "tip_winner": "SELECT user_id AS client, arg_max(event_id, row(ts, event_type, event_id)) AS winner, arg_min(event_id, row(ts, event_type, event_id)) AS loser FROM events GROUP BY user_id",
    "three_way_merge": f"WITH {_PLAN} SELECT path, merged, conflict, lost FROM plan",
    "conflict_copies": f"WITH {_PLAN} SELECT path, copy_path, blob_id FROM copies",
    "materialised_merge": f"WITH {_PLAN}, out AS (SELECT path, merged AS blob_id, 'merged' AS origin FROM plan WHERE merged IS NOT NULL AND merged != '<dir>' UNION ALL SELECT copy_path, blob_id, 'copy' FROM copies) SELECT path, blob_id, origin FROM out UNION ALL SELECT path, '<dir>', 'directory' FROM (SELECT path FROM {_above('out')} UNION SELECT path FROM plan WHERE c = '<dir>')",
    "conflict_timestamp": f"SELECT o_orderkey, {_stamp('epoch_ms(o_orderdate) + o_orderkey * 61001')} AS stamp FROM orders",
    "consecutive_dedup": "SELECT client, event_id, event_type FROM (SELECT user_id AS client, event_id, event_type, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR event_type IS DISTINCT FROM before",
    "latest_ref_per_client": "SELECT user_id AS client, arg_max(event_id, row(ts, event_id)) AS event_id FROM events GROUP BY user_id",
    "debounce_sessions": "SELECT client, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_changes, arg_max(event_id, row(ts, event_id)) AS last FROM (SELECT *, sum(fresh) OVER (PARTITION BY client ORDER BY ts, event_id) AS burst FROM (SELECT user_id AS client, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 21600000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY client, burst",
    "sequence_gaps": "SELECT l_orderkey, before AS after_seq, seq AS next_seq, seq - before - 1 AS n_missing FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS seq, lag(CAST(l_linenumber AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before FROM lineitem WHERE l_returnflag != 'R') WHERE seq > before + 1",
    "retry_schedule": "SELECT o_orderkey, CAST(attempt AS INTEGER) AS attempt, CAST(attempt * (attempt - 1) // 2 * 5000 AS BIGINT) AS at_ms, CASE WHEN attempt > o_orderkey % 6 THEN 'done' WHEN attempt = 4 THEN 'exhausted' ELSE 'retry' END AS outcome FROM (SELECT o_orderkey, unnest(range(1, least(o_orderkey % 6 + 1, 4) + 1)) AS attempt FROM orders)",
    "recovery_schedule": "SELECT o_orderkey, CAST(recovery AS INTEGER) AS recovery, CAST(CASE WHEN recovery != o_orderkey % 13 AND recovery != 10 THEN 20000 ELSE 0 END AS BIGINT) AS delay_ms, CASE WHEN recovery = o_orderkey % 13 THEN 'done' WHEN recovery = 10 THEN 'invalidated' ELSE 'queued' END AS state FROM (SELECT o_orderkey, unnest(range(0, least(o_orderkey % 13, 10) + 1)) AS recovery FROM orders)",
    "multicast_except_origin": "SELECT s_suppkey, c.n_nationkey AS client FROM supplier JOIN nation o ON o.n_nationkey = s_nationkey JOIN nation c ON c.n_regionkey = o.n_regionkey AND c.n_nationkey != s_nationkey",
}

_NAMES = "names AS (SELECT doc_id, doc_id * 1000 AS mtime, coalesce(source, '_') || '/' || CASE doc_id % 5 WHEN 0 THEN 'doc-' || doc_id WHEN 1 THEN 'doc-' || doc_id || '.txt' WHEN 2 THEN 'doc-' || doc_id || '.tar.gz' WHEN 3 THEN 'doc-' || doc_id || '.' ELSE '.doc-' || doc_id END AS path FROM documents)"
ORACLE_SQL["path_parts"] = f"WITH {_NAMES} SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, {_name('path')} AS name, {_stem('path')} AS stem, {_ext('path')} AS ext, CAST(len(string_split(path, '/')) AS INTEGER) AS depth FROM names"
ORACLE_SQL["conflict_copy_names"] = f"WITH {_NAMES} SELECT path, {_copy('path', chr(39) + 'C1' + chr(39), _stamp('mtime * 7919'))} AS copy_path FROM names"
ORACLE_SQL["stream_debounce"] = ORACLE_SQL["debounce_sessions"]
ORACLE_SQL["stream_latest"] = f"SELECT client, last_ts AS ts, last AS event_id FROM ({ORACLE_SQL['debounce_sessions']})"
ORACLE_SQL["stream_received"] = """WITH e AS (SELECT user_id AS client, event_type AS ref, CAST(ts AS TIMESTAMP) AS ts, event_id % 10 = 0 AS invalid FROM events),
l AS (SELECT *, lag(invalid) OVER (PARTITION BY client, ref ORDER BY ts, NOT invalid) AS before FROM e) SELECT client, ref, ts FROM l WHERE NOT invalid AND (before IS NULL OR before)"""
ORACLE_SQL["stream_dedup"] = ORACLE_SQL["consecutive_dedup"]
ORACLE_SQL["stream_classify"] = """
WITH e AS (SELECT user_id || '/' || (event_id % 3) AS path, ts, event_id, event_type != 'purchase' AS present FROM events),
k AS (SELECT *, coalesce(lag(present) OVER (PARTITION BY path ORDER BY ts, event_id), false) AS known FROM e)
SELECT path, ts, CASE WHEN NOT present THEN 'deleted' WHEN known THEN 'modified' ELSE 'added' END AS change FROM k WHERE present OR known"""
