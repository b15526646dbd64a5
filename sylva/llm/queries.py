"""The registered queries of this subpackage: thin digests of what its operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import bagrank, balltree, bpe, chat, decontam, fingerprint, hardneg, langid, neardup, quality, simhash, substring, tokenfiles, toxicity
from sylva.llm.tables import id_residue, scratch_path, small_batches, table


def multilingual_vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that quotes control strings, formatted in windows and read back."""
    quoting = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.verdicts(chat.windows(rows.unionByName(spark.createDataFrame(quoting, "conv_id long, turn long, role string, text string"))))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, by overlapping chunks."""
    small_batches(spark)
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), multilingual_vocabulary())


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those whose id's crc32 is not 1 modulo 3."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = id_residue(F.col("doc_id"), 3) == 1
    model = langid.train(docs, ~held_out)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def _scored(spark: SparkSession, sf_dir: str, operator, label: str, modulus: int, residue: int) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = id_residue(F.col("doc_id"), modulus) == residue
    model = operator.train(docs, table(spark, sf_dir, "labels"), label, ~held_out)
    found = operator.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labels whose id's crc32 is not 0 modulo 5."""
    return _scored(spark, sf_dir, quality, "quality", 5, 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels whose id's crc32 is not 2 modulo 4."""
    return _scored(spark, sf_dir, toxicity, "toxic", 4, 2)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    found = fingerprint.edited_likeness(table(spark, sf_dir, "documents"))
    return found.withColumns({c: simhash.as_hex(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against all benchmark items."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.verdicts(decontam.scan(docs, table(spark, sf_dir, "benchmark")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all ids in ascending doc_id order and reads the files back."""
    import public_tokenizers

    small_batches(spark)
    path = scratch_path(spark, "op7")
    tokenfiles.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return tokenfiles.with_starts(spark, path, tokenfiles.checksums(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 50 words that also start in a smaller document, cut from every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.verdicts(substring.cut_repeats(docs))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose SimHashes of 3-word shingles link at 3 bits or fewer."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, most_bits=3)
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of another label for the best positives of every vector whose id is divisible by 100."""
    small_batches(spark)
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hardneg.mine(rows, F.col("vec_id") % 100 == 0, label)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for each benchmark item."""
    small_batches(spark)
    return bagrank.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors of every vector whose id is divisible by 50."""
    small_batches(spark)
    return balltree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_windows, op2_byte_bpe, op3_language, op4_fingerprints, op5_quality, op6_decontaminate, op7_token_files, op8_substring_dedup, op9_toxicity, op10_near_duplicates, op11_hard_negatives, op12_ranked_search, op13_top_k)}

_OP1 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, 4 + len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) AS tokens,
  23 + length(role) + length(text) + len(regexp_extract_all(role, '\\|<\||</?s>|\[/?INST\]')) + len(regexp_extract_all(text, '\\|<\||</?s>|\[/?INST\]')) AS chars FROM c),
s AS (SELECT conv_id, tokens AS sys_tokens, chars AS sys_chars FROM t WHERE pos = 1 AND role = 'system'),
r AS (SELECT t.conv_id, pos, tokens, chars, greatest(2048 - 256 - coalesce(sys_tokens, 0), 256) AS stride, sum(tokens) OVER (PARTITION BY t.conv_id ORDER BY pos) - tokens AS start
  FROM t LEFT JOIN s USING (conv_id) WHERE NOT (pos = 1 AND role = 'system')),
w AS (SELECT *, 2 * (start // stride) + CASE WHEN (start + tokens - 1) // stride > start // stride THEN 1 ELSE 0 END AS win FROM r),
f AS (SELECT conv_id, win, min(start) AS first, sum(chars) AS chars FROM w GROUP BY conv_id, win),
h AS (SELECT f.conv_id, f.win, sum(r.chars) AS chars FROM f JOIN r ON r.conv_id = f.conv_id AND r.start < f.first AND r.start >= f.first - 256 GROUP BY f.conv_id, f.win),
n AS (SELECT conv_id, sum(chars) AS chars FROM (
  SELECT conv_id, chars FROM f UNION ALL SELECT conv_id, chars FROM h UNION ALL SELECT f.conv_id, sys_chars FROM f JOIN s USING (conv_id)
  UNION ALL SELECT conv_id, sys_chars FROM s ANTI JOIN f USING (conv_id)) GROUP BY conv_id)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(any_value(n.chars) AS BIGINT) AS formatted_chars
FROM t JOIN n USING (conv_id) GROUP BY t.conv_id
"""

_OP6 = r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM documents),
iw AS (SELECT DISTINCT item_id, list_slice(w, p, p + least(len(w), 10) - 1) AS win, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, p, n, list_slice(w, p, p + n - 1) AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.r, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

_OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 50)) AS q FROM win JOIN first USING (h) WHERE doc_id > least OR doc_id IS NULL AND least IS NOT NULL),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS text FROM words ANTI JOIN gone USING (r, q) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

_VECTORS = """v AS (SELECT row_number() OVER () AS r, vec_id, {label} AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

_OP11 = f"""
WITH {_VECTORS.format(label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")},
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, c.r AS cr, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 100 = 0 AND a.label IS NOT NULL AND c.label IS NOT NULL),
p AS (SELECT * FROM (SELECT ar, anchor_id, cr, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.ar, p.cr ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON p.ar = s.ar WHERE NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS ir, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
c AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(coalesce(sum(len(w)), 0) AS BIGINT) AS n_terms FROM d),
it AS (SELECT DISTINCT ir, item_id, term FROM (SELECT ir, item_id, unnest(w) AS term FROM i)),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY r, term),
wt AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM tf, c GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 100 - 50 + (50 * len(w) * n_docs) // n_terms AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT ir, item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM it JOIN tf USING (term) JOIN wt USING (term) JOIN m USING (r) GROUP BY ir, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY ir ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""

_OP13 = f"""
WITH {_VECTORS.format(label="0")},
s AS (SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 5
"""

ORACLE_SQL: dict[str, str] = {"op1_chat_windows": _OP1, "op6_decontaminate": _OP6, "op8_substring_dedup": _OP8, "op11_hard_negatives": _OP11, "op12_ranked_search": _OP12, "op13_top_k": _OP13}
