"""Language, quality and toxicity models: held-out accuracy and odd rows."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.llm import langid, linear, quality, toxicity
from sylva.llm.queries import QUERIES
from sylva.llm.tables import id_residue

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_residue_is_crc32_of_the_decimal_id(spark):
    got = spark.range(50).select("id", id_residue(F.col("id"), 3).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in got)


@needs_data
def test_language_held_out(spark):
    found = QUERIES["op3_language"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert held[0] > 0.98 and 0 <= held[1] <= held[2] <= 1


@needs_data
def test_unlearned_languages_go(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train(docs, id_residue(F.col("doc_id"), 3) != 1)
    rng = np.random.default_rng(1)
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), 300)) for _ in range(20)]
    foreign = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu järki ja omatunto.", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są oni obdarzeni rozumem."]
    short = [" ".join(r["text"].split()[:12]) for r in docs.where("length(text) > 2000 and doc_id % 3 = 0").limit(40).collect()]
    typical = [[model.predict(t)[2] for t in texts] for texts in (noise, foreign, short)]
    assert not any(typical[0]) and not any(typical[1]) and sum(typical[2]) >= 39
    assert langid.keep_known(docs, model).count() >= 0.995 * docs.where("regexp_like(text, '[a-zA-Z]')").count()


def test_scores_match_plain_loops(spark):
    """Scores of the operators against sums over words, and table entries looked up one by one."""
    texts = [(k, t) for k, t in enumerate(["Good calm lines, and more.", "BUY!! now ### idiot", "", "ein Idiot idiotisch IDIOT", "a\tb\nc"] * 8)]
    docs = spark.createDataFrame([*texts, (None, "idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int("idiot" not in t.lower()), int("idiot" in t.lower())) for k, t in texts], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, "toxic", F.lit(True))
    for r in toxicity.score(docs, model).join(docs, "doc_id").collect():
        words = {"".join(w) for w in __import__("re").findall(r"[^\W\d_]+", r["text"].lower())}
        total = model.bias + model.per_word * np.log(1 + len(words)) + sum(model.weights.get(f, 0) for w in words for f in toxicity.word_features(w))
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-9
    additive = quality.train(docs, labels, "quality", F.lit(True))
    for r in quality.score(docs, additive).join(docs, "doc_id").collect():
        x, total = quality.features(r["text"]), additive.base
        for k, (cuts, table) in enumerate(zip(additive.cuts, additive.tables)):
            total += table[sum(c <= x[k] for c in cuts)]
        for i, j, table in additive.pairs:
            total += table[sum(c <= x[i] for c in additive.pair_cuts[i]), sum(c <= x[j] for c in additive.pair_cuts[j])]
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-9


def test_features_take_linear_time():
    import time

    began = time.process_time()
    quality.features("#" * 400_000 + "a" + "#" * 400_000)
    assert time.process_time() - began < 5
    assert quality.features("a## b! c. d$ #e")[quality.FEATURES.index("signed_words")] == 3 / 5


def test_sample_is_bounded(spark):
    """Rows that share an id don't add to the sample, all classes are in it, and a column that holds no classes is an error."""
    rows = [(7, f"t{k}", "en") for k in range(500)] + [(k, "x", f"junk{k}") for k in range(50)] + [(100 + k, "y", "de") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chosen, counts = linear.sample_by_class(df, "lang", 10**6, "s")
    assert len(counts) == 52 and counts["en"] == 500 and counts["de"] == 30
    assert chosen.where("lang = 'en'").count() == 1 and chosen.where("lang = 'de'").count() == 30
    few, _ = linear.sample_by_class(spark.range(40_000).selectExpr("id as doc_id", "cast(id % 4 as string) as lang"), "lang", 1_000, "s", most_rows=400)
    assert 250 < few.count() < 560 and few.select("lang").distinct().count() == 4
    with pytest.raises(ValueError, match="no classes"):
        linear.sample_by_class(spark.range(10_001).selectExpr("id as doc_id", "cast(id as string) as lang"), "lang", 10, "s")


def test_all_of_many_languages_are_learned(spark):
    """More than 200 languages, each with a letter of its own."""
    rows = [(5 * k + n, chr(0x4E00 + k) * (3 + n), f"l{k}") for k in range(205) for n in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, F.lit(True))
    assert len(model.langs) == 205
    assert sum(model.predict(chr(0x4E00 + k) * 6)[0] == f"l{k}" for k in range(205)) >= 200


def loop_sequences(text):
    """The hashed sequences of one, two and three letters, letter by letter."""
    cut = 1 << 32
    codes = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "]
    a, b, c = ([x * m % cut for x in codes] for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
    for k in range(1, len(codes) - 1):
        if codes[k] != 32:
            for x, s in ((a[k] ^ a[k] >> 15, 1), ((a[k] + b[k + 1]) % cut, 2), ((a[k - 1] + b[k] + c[k + 1]) % cut, 3)):
                yield (x ^ s) * 0x27D4EB2F % cut >> 20


def test_languages_match_plain_loops(spark):
    """The family by its own model, then the language of most pairwise wins, each summed up one sequence after the other."""
    df = languages(spark)
    model = langid.train(df, F.lit(True))
    names = sorted(set(model.families))
    logistic = lambda z: 1 / (1 + np.exp(-z))
    for text in ["the cat sat", "Der Hund, und ich!", "où est le chat 12", "el niño", "x", "ßé and ñ", "thought und déjà año " * 3]:
        found = list(loop_sequences(text))
        margins = [sum(model.weights[h, m] for h in found) / len(found) + model.biases[m] for m in range(model.weights.shape[1])]
        p = [logistic(margins[k]) for k in range(len(names))]
        family = p.index(max(p))
        own = [k for k, f in enumerate(model.families) if f == names[family]]
        wins = dict.fromkeys(own, 0.0)
        for m, (i, j) in enumerate(model.pairs):
            if i in wins:
                wins[i] += logistic(2 * margins[len(names) + m])
                wins[j] += 1 - logistic(2 * margins[len(names) + m])
        best = max(own, key=lambda k: wins[k])
        lang, score, _ = model.predict(text)
        assert lang == model.langs[best] and abs(score - p[family] / sum(p) * (wins[best] / (len(own) - 1) if len(own) > 1 else 1)) < 1e-9


@needs_data
@pytest.mark.parametrize("name", ["op3_language", "op5_quality", "op9_toxicity"])
def test_null_ids_are_not_held_out(spark, name, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    found = QUERIES[name](spark, str(tmp_path)).collect()
    assert len(found) == 61 and {r["held_out"] for r in found if r["doc_id"] is None} == {False}


@needs_data
@pytest.mark.parametrize("name, label, recall, false", [("op5_quality", "quality", 0.97, 0.15), ("op9_toxicity", "toxic", 0.85, 0.05)])
def test_scores_held_out(spark, name, label, recall, false):
    found = QUERIES[name](spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").select(label, "predicted", "score").collect()
    y, p = np.array([r[0] for r in found]), np.array([r[1] for r in found])
    assert p[y == 1].mean() >= recall and p[y == 0].mean() <= false
    assert all(0 <= r["score"] <= 1 for r in found)


def languages(spark):
    words = {"en": "the cat sat with thought", "de": "der hund und schiff ich", "fr": "le chat est où déjà", "es": "el niño está año ñu"}
    rows = [(k, " ".join([w, w.split()[k % 5], w.split()[k % 3]]) * 5, lang) for k, (lang, w) in enumerate((x, y) for _ in range(12) for x, y in words.items())]
    return spark.createDataFrame([(i, t, lang, "x") for i, t, lang in rows] + [(None, "the cat", "en", "x"), (900, None, "en", "x"), (901, "123 !?", None, "x"), (902, "the cat sat", None, "x"), (902, "the cat sat", None, "x"), (903, "der hund " * 60_000, None, "x"), (904, "", "de", "x")], "doc_id long, text string, lang string, language string")


def test_language_odd_rows(spark):
    df = languages(spark)
    model = langid.train(df, F.lit(True))
    found = [(r["doc_id"], r["f"]["lang"], r["f"]["score"]) for r in langid.predict(df, model, "f").collect()]
    assert len(found) == df.count()
    by = {i: (lang, s) for i, lang, s in found}
    assert by[900] == by[901] == by[904] == ("und", 0.0)
    assert by[902][0] == "en" and by[903][0] == "de"
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns and not {900, 901, 904} & {r["doc_id"] for r in kept.collect()}
    none = langid.train(df.limit(0), F.lit(True))
    assert none.predict("the cat") == ("und", 0.0, False)
    single = langid.train(df.where("lang = 'en'"), F.lit(True))
    assert single.predict("hund")[:2] == ("en", 1.0)
    assert langid.predict(df.limit(0), model, "f").count() == 0


def test_long_text_scores_as_its_blocks():
    text = "Ab é. " * 200_000
    whole = langid.shares(text)
    small = langid.shares("Ab é. " * 2_000)
    assert np.abs(whole - small).max() < 1e-3


@pytest.mark.parametrize("operator, label", [(quality, "quality"), (toxicity, "toxic")])
def test_scores_odd_rows(spark, operator, label):
    good, bad = "A calm and even line about gardens.", "BUY!! NOW!! idiot ### $$$"
    texts = [(k, good if k % 2 else bad, "x") for k in range(60)] + [(100, None, "x"), (101, "", "x"), (None, good, "x"), (102, bad * 20_000, "x"), (1, good, "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(60)] + [(None, 1, 1), (3, 1, 0), (5, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    model = operator.train(docs, labels, label, F.col("doc_id") >= 0)
    found = operator.score(docs, model).collect()
    assert len(found) == len(texts) and all(0 <= r["score"] <= 1 for r in found)
    by = {r["doc_id"]: r["score"] for r in found}
    assert by[100] == by[101]
    high, low = (by[1], by[2]) if label == "quality" else (by[2], by[1])
    assert high > 0.7 > 0.3 > low
    assert (by[102] >= 0.3) == (label == "toxic")
    assert operator.score(docs.limit(0), model).count() == 0
    alone = operator.train(docs, labels.where(F.col(label) == 1), label, F.lit(True))
    assert {r["score"] > 0.99 for r in operator.score(docs, alone).collect()} == {True}
    assert {r["score"] < 0.01 for r in operator.score(docs, operator.train(docs, labels.limit(0), label, F.lit(True))).collect()} == {True}


def fitted(texts, counts):
    """The model of some labelled texts, with features chosen as the operator does."""
    seen, n1, n0 = {}, sum(y for y, _ in texts), sum(1 - y for y, _ in texts)
    for y, t in texts:
        for f in set(toxicity._hashes(toxicity.text_words(t)).tolist()):
            has = seen.setdefault(f, [0, 0])
            has[y] += 1
    z = {f: abs(b / n1 - a / n0) / np.sqrt((a + b) / len(texts) * (1 - (a + b) / len(texts)) * (1 / n1 + 1 / n0) + 1e-12) for f, (a, b) in seen.items()}
    features = np.array(sorted(f for f, v in z.items() if v > toxicity.LEAST_Z and sum(seen[f]) >= toxicity.LEAST_TEXTS), dtype=np.uint64)
    return toxicity.fit_model(sorted(toxicity.sample_row(y, t, features) for y, t in texts), features, counts)


def test_identity_terms_do_not_move_the_score(monkeypatch):
    """Insults that mention a group more often than kind texts do must not make the mention itself toxic."""
    texts = [(1, f"you stupid gay {w} idiot") for w in "abcdefghij"] * 6 + [(0, f"a kind letter to {w}") for w in "klmnopqrst"] * 8 + [(0, "a straight answer")] * 20
    counts = {1: 60, 0: 100}
    regular = fitted(texts, counts)
    monkeypatch.setattr(toxicity, "SWAP_WEIGHT", 0.0)
    free = fitted(texts, counts)
    odds = lambda m, t: np.log(m.score(t) / (1 - m.score(t)))
    shift = lambda m: abs(odds(m, "a gay letter to k") - odds(m, "a straight letter to k"))
    assert shift(regular) < 0.2 < 1 < shift(free)
    assert regular.score("you stupid idiot") > 0.5 and regular.score("a gay letter to k") < 0.3


def test_additive_model_has_bounded_tables():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2_000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    model = quality.fit_model(x, y, {0: int((y == 0).sum()), 1: int((y == 1).sum())})
    assert any({i, j} == {0, 1} for i, j, _ in model.pairs)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
