"""Chat windows, BPE, token files, decontamination and substring deduplication against brute force."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from sylva.llm import bpe, chat, decontam, substring, tokenfiles  # noqa: E402

VOCABULARY = bpe.Vocabulary(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], schema)


def odd_texts():
    rng = random.Random(7)
    letters = "aé ß\n\t 1'sre.,!中<|endoftext|>\x1c\u00a0"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    return [None, "", " ", "x" * 5_000, "word " * 3_000, "\n \n" * 400, *made, made[0]]


# chat ------------------------------------------------------------------------------------------------


def conversation_rows():
    rng = random.Random(3)
    rows = [(1, 0, "system", "be [INST] brief </s>"), (5, 0, "system", "only"), (6, 0, None, None), (7, 3, "user", "tie"), (7, 3, "assistant", "tie"), (7, 3, "user", "tie"), (None, 0, "user", "nobody"), (9, None, "user", "early"), (9, 1, "assistant", "<|end|>\\ <\\| \\\\ [/INST]")]
    for c, n in ((1, 40), (2, 300), (3, 1)):
        rows += [(c, t + 1, ("user", "assistant")[t % 2], " ".join(rng.choice(["ja", "nein.", "<|turn|>", "\\"]) for _ in range(rng.randrange(0, 60)))) for t in range(n)]
    rows += [(4, 0, "user", "q " * 500), (4, 1, "assistant", "a " * 5_000)]
    return rows


def test_chat_round_trip_and_budget(spark):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, window string")
    found = chat.windows(df, 256, 32)
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    got = {r["conv_id"]: r for r in chat.verdicts(found).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), hashlib.sha256(told.encode()).hexdigest()), c
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), c
    for r in found.collect():
        assert r["n_tokens"] <= 256 or r["n_turns"] - r["n_repeated"] == 1, r
        if r["conv_id"] == 1:
            assert r["formatted"].startswith("<|turn|>system<|text|>")
    assert found.where("conv_id = 2").count() > 5 and found.where("conv_id = 2 and n_repeated > 0").count() > 3


def test_chat_empty(spark):
    assert chat.verdicts(chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_escape_round_trip(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("\\<|[]/sINST>") for _ in range(rng.randrange(12))) for _ in range(400)] + ["</s>[INST] ok [/INST]", "<|turn|>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t"))).withColumn("u", chat.unescape(F.col("e")))
    for r in df.collect():
        assert r["u"] == r["t"]
        assert not re.search(r"<\||</?s>|\[/?INST\]", r["e"])


# byte-level BPE --------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk, overlap, task", [(bpe.CHUNK_CHARS, bpe.OVERLAP_CHARS, bpe.TASK_CHARS), (64, 16, 0), (64, 16, 1_000), (200, 60, 1 << 20)])
def test_bpe_matches_library(spark, chunk, overlap, task):
    texts = list(enumerate(odd_texts())) + [(None, "none"), (3, "x" * 5_000), (3, "again")]
    clashing = documents(spark, texts).toDF("doc_id", "text", "row", "piece", "chunk")
    got = bpe.encoded_digests(clashing, VOCABULARY, chunk, overlap, task).collect()
    want = []
    for i, t in texts:
        ids = bpe.encode_text(t or "", VOCABULARY)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_bpe_seams_are_boundaries_of_the_whole_text():
    letters = "a" * 700
    texts = [*(t or "" for t in odd_texts()), f"one two {letters} three {letters}{letters} four five " + "six seven " * 600, letters * 3, " " * 900, "x\n\n   " * 200]
    for text in texts:
        ends = {m.end() for m in regex.compile(P.PATTERN).finditer(text)}
        for chunk, overlap in ((64, 16), (100, 40), (1024, 128)):
            cuts = bpe.seams(text, P.PATTERN, chunk, overlap)
            assert set(cuts) <= ends and cuts == sorted(set(cuts)) and len(cuts) < max(1, -(-len(text) // chunk))
    # what has no boundary grows; what follows is cut again
    assert bpe.seams(letters, P.PATTERN, 64, 16) == []
    assert len(bpe.seams(texts[-4], P.PATTERN, 64, 16)) >= 5
    prose = "some words of a text, " * 400
    assert len(bpe.seams(prose, P.PATTERN, 1024, 128)) == -(-len(prose) // 1024) - 1


@pytest.mark.parametrize("task", [0, 1 << 16])
def test_bpe_decodes_its_pieces(spark, task):
    texts = list(enumerate(odd_texts()))
    got = bpe.decode(bpe.encode(documents(spark, texts), VOCABULARY, 100, 40, task), VOCABULARY).collect()
    for i, t in texts:
        rows = sorted((r["piece"], bytes(r["bytes"])) for r in got if r["doc_id"] == i)
        assert b"".join(x for _, x in rows) == (t or "").encode(), i
    assert max(r["n_pieces"] for r in got) > 100


def test_bpe_leaves_nothing_in_the_shared_folder(spark):
    from sylva.operators.ordering import mounted
    from sylva.operators.scratch import scratch

    with scratch(spark) as folder:
        assert bpe.encoded_digests(documents(spark, [(1, "word " * 3_000)]), VOCABULARY, task_chars=0).count() == 1
        assert sorted(Path(mounted(folder)).rglob("*.parquet"))
    assert not Path(mounted(folder)).exists()


def test_bpe_empty_and_options(spark):
    assert bpe.encoded_digests(documents(spark, []), VOCABULARY).count() == 0
    assert bpe.encode(documents(spark, []), VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(documents(spark, []), VOCABULARY, 10, 10)


# token files -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, tmp_path, encoding):
    texts = list(enumerate(odd_texts()))[::-1] + [(None, "none"), (2, "twin"), (2, "twin")]
    tokenizer, path = P.path("byte_bpe_50k.json"), str(tmp_path / "ids")
    tokenfiles.write(documents(spark, texts), path, tokenizer, 0, files=3, ids_encoding=encoding)
    at = {(r["file"], r["at"]): r["start"] for r in tokenfiles.starts(spark, path).collect()}
    rows = sorted(tokenfiles.checksums(spark, path).collect(), key=lambda r: (r["file"], r["at"]))
    library = Tokenizer.from_file(tokenizer)
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in texts), key=lambda i: -1 if i is None else i)
    crc = lambda t: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids(t)))
    assert sorted((repr(r["doc_id"]), r["ids_crc32"]) for r in rows) == sorted((repr(i), crc(t)) for i, t in texts)
    total = 0
    for r in rows:
        assert at[r["file"], r["at"]] == total
        total += r["n_tokens"]
    assert "n_tokens" in tokenfiles.starts(spark, path)._jdf.queryExecution().toString() and "ids" not in tokenfiles.starts(spark, path).columns


@pytest.mark.parametrize("encoding, name", [("dictionary", "DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_token_files_layout(spark, tmp_path, encoding, name):
    """Footers hold the encodings, row groups and page indexes that were asked for."""
    rng = random.Random(1)
    texts = [(i, " ".join(f"{rng.choice(['river', 'stone,', 'über'])}{rng.randrange(10**6)}" for _ in range(300))) for i in range(600)]
    path = tmp_path / "ids"
    tokenfiles.write(documents(spark, texts), str(path), P.path("byte_bpe_50k.json"), 0, files=1, row_group_bytes=1 << 16, page_rows=20, ids_encoding=encoding)
    (file,) = path.glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_row_groups >= 2
    for k in range(meta.num_row_groups):
        columns = {meta.row_group(k).column(c).path_in_schema: meta.row_group(k).column(c) for c in range(meta.num_columns)}
        ids = columns["ids.list.element"]
        assert any(name in e for e in ids.encodings) and ids.compression == "ZSTD"
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    some = tokenfiles.read(spark, str(path)).where("doc_id in (3, 404)")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan
    assert sorted(len(r["ids"]) for r in some.collect()) == sorted(len(Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(texts[k][1], add_special_tokens=False).ids) + 1 for k in (3, 404))
    assert "ids:" not in tokenfiles.starts(spark, str(path))._jdf.queryExecution().executedPlan().toString()


def test_files_follow_one_another_by_number(spark):
    names = [f"part-{k:05d}-aa-c000.zstd.parquet" for k in (0, 7, 99_999, 100_000, 100_001, 1_000_000)] + ["part-1000000-aa-c001.zstd.parquet"]
    df = spark.createDataFrame([(n,) for n in names[::-1]], "file string")
    assert [r["file"] for r in df.orderBy(*tokenfiles.file_order(F.col("file"))).collect()] == names


def test_words_of_texts_keep_their_ids():
    rng = random.Random(9)
    parts = ["a", "é", "ß", " ", "  ", "\n", "\t", "1", "'s", "re", ".", ",", "!", "中", "<|endoftext|>", "\x1c", "\u00a0", "\u2003", "\u3000", "\x85", "\u1680", "\u202f", "\u205f", "\x00", "x,", "2."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(3_000)] + ["", ""]
    library, encoder = Tokenizer.from_file(P.path("byte_bpe_50k.json")), tokenfiles.WordEncoder(P.path("byte_bpe_50k.json"))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.encode(pa.array(texts)).to_pylist() == want
    assert encoder.encode(pa.array(["a <|endoftext|> b"])).to_pylist() == [[64, 220, 50256, 275]]
    assert encoder.encode(pa.array(texts).slice(10, 20), 7).to_pylist() == [[*w, 7] for w in want[10:30]]


def test_token_files_of_other_columns_and_clashing_names(spark, tmp_path):
    rows = [(1, "one two", "f", 9, 8, "i"), (2, None, "f", 9, 8, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string, at long, n_tokens long, ids string")
    tokenfiles.write(docs, str(tmp_path / "ids"), P.path("byte_bpe_50k.json"), 0)
    assert sorted((r["doc_id"], r["n_tokens"], len(r["ids"])) for r in tokenfiles.read(spark, str(tmp_path / "ids")).collect()) == [(1, 3, 3), (2, 1, 1)]


def test_substring_rule_for_null_ids(spark):
    """A null id is larger than any other and its repeats go; of rows without an id none is the larger one."""
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (None, text)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring.verdicts(substring.cut_repeats(docs)).collect()) == [(0, 60), (1, 0)]
    none = spark.createDataFrame([(None, text), (None, text)], "doc_id long, text string")
    assert [r["n_removed"] for r in substring.verdicts(substring.cut_repeats(none)).collect()] == [0, 0]


def test_token_files_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    tokenfiles.write(documents(spark, []), path, P.path("byte_bpe_50k.json"), 0)
    assert tokenfiles.starts(spark, path).count() == tokenfiles.checksums(spark, path).count() == 0


# decontamination -------------------------------------------------------------------------------------


def brute_decontamination(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(10, len(v))
            for k in range(len(v) - n + 1 if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[k : k + n]:
                        hit |= set(range(p, p + n))
                        found |= {item_id} - {None}
        names = ",".join(sorted(map(str, found)))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination(spark, block):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("alpha BETA gamma, dé-lta 7".split()) for _ in range(n))
    items = [(1, say(12)), (2, "Short one!"), (10, say(25)), (3, None), (4, "?!"), (2, "other"), (None, "nameless item words")]
    docs = [(1, f"{say(5)} {items[0][1]} {say(4)}"), (2, "short-ONE short one"), (3, say(300)), (4, None), (5, ""), (5, "OTHER nameless; item WORDS"), (6, f"{items[2][1]} {items[2][1]}"), (6, f"{items[2][1]} {items[2][1]}"), (None, "shortone")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, finding string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    scanned = decontam.scan(df, benchmark, "found_", block_bytes=block)
    assert sorted(map(tuple, decontam.verdicts(scanned, "found_").collect()), key=repr) == brute_decontamination(docs, items)
    spans = {r["doc_id"]: [r["text"][a:b] for a, b in r["found_"]["spans"]] for r in scanned.where("doc_id in (1, 2)").collect()}
    assert spans[1][0].startswith(items[0][1]) and spans[2] == ["short-ONE short one"]
    kept = decontam.remove_contaminated(df, benchmark)
    assert kept.columns == df.columns
    assert decontam.scan(df, benchmark.limit(0), "f").where(F.size("f.runs") > 0).count() == 0
    assert decontam.scan(df.limit(0), benchmark, "f").count() == 0


# substring deduplication -----------------------------------------------------------------------------


def brute_substrings(docs, size):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    least, order = {}, lambda i: 1 << 63 if i is None else i
    for i, t in docs:
        w = split(t)
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            least[k] = min(least.get(k, 1 << 64), order(i))
    out = []
    for i, t in docs:
        w, gone = split(t), set()
        for p in range(len(w) - size + 1):
            if least[tuple(w[p : p + size])] < order(i):
                gone |= set(range(p, p + size))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size, block", [(5, 200), (5, 1 << 20), (8, 100)])
def test_substring_dedup(spark, size, block):
    rng = random.Random(size)
    words = [f"w{k}é" for k in range(12)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [say(size), say(3 * size), say(size - 1)]
    docs = [(i, "\x0b ".join([say(rng.randrange(12)), rng.choice(passages), say(rng.randrange(9)), rng.choice(passages)])) for i in range(40)]
    docs += [(50, None), (51, ""), (52, " \n"), (3, docs[7][1]), (3, docs[7][1]), (60, "x " * 4_000), (61, "x " * 4_000), (None, docs[0][1]), (None, passages[1])]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, cut string")
    cut = substring.cut_repeats(df, "cut_", size, block)
    assert sorted(map(tuple, substring.verdicts(cut, "cut_").collect()), key=repr) == brute_substrings(docs, size)
    left = substring.remove_repeats(df, window_words=size, block_bytes=block)
    assert left.columns == df.columns and 61 not in {r["doc_id"] for r in left.collect()}
    assert {r["text"] for r in left.where("doc_id in (50, 51)").collect()} == {None, ""}


def test_substring_words_that_share_weak_hashes(spark):
    """Complementary Thue-Morse words collide under polynomial hashes modulo a power of two."""
    bits = [bin(k).count("1") & 1 for k in range(1024)]
    one, two = ("".join("ab"[b ^ k] for b in bits) for k in (0, 1))
    rest = " ".join(f"w{k}" for k in range(49))
    df = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}")], "doc_id long, text string")
    removed = {r["doc_id"]: r["n_removed"] for r in substring.verdicts(substring.cut_repeats(df)).collect()}
    assert removed == {1: 0, 2: 0, 3: 50}


def test_polynomial_is_the_sum_modulo_the_prime():
    rng, p = random.Random(2), substring._PRIME
    v, base = [rng.randrange(p) for _ in range(200)] + [p - 1] * 60, rng.randrange(p)
    for n in (1, 2, 3, 25, 50):
        want = [sum(x * pow(base, n - 1 - k, p) for k, x in enumerate(v[at : at + n])) % p for at in range(len(v) - n + 1)]
        assert substring.polynomial(np.array(v, np.uint64), n, base).tolist() == want


def test_substring_clashing_columns(spark):
    rows = [(k % 2, "v " * 60, "x", 1, 2, 3, 4) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, anchor int, h1 int, low int, block_ int")
    got = substring.remove_repeats(df, block_bytes=300)
    assert got.columns == df.columns and got.count() == 20 and {r["doc_id"] for r in got.collect()} == {0}


def test_substring_empty(spark):
    assert substring.cut_repeats(documents(spark, [])).count() == 0
