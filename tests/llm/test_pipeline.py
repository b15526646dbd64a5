"""The pipeline on planted cases, its stages one by one, and against its parts."""

import random

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

from sylva.llm import bpe  # noqa: E402
from sylva.llm.queries import multilingual_vocabulary  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and to in that was with cat house river stone morning light", "de": "der und die von nicht mit ist haus fluss stein morgen licht schön über"}


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(4)

    def say(n, lang="en"):
        parts = WORDS[lang].split()
        return " ".join(rng.choice(parts) + rng.choice(["", "", "ing", "er", "ly"]) + str(rng.randrange(30)) * (rng.random() < 0.4) for _ in range(n))

    passage, item = say(80), say(14)
    near = say(200).split()
    near2 = [*near[:50], "changed", *near[51:]]
    rows = [(k, say(rng.randrange(60, 200), ("en", "de")[k % 2]), ("en", "de")[k % 2]) for k in range(40)]
    rows += [(50, " ".join(near), "en"), (51, " ".join(near2), "en"), (52, " ".join(near), "en")]
    rows += [(60, f"{say(60)} {passage} {say(60)}", "en"), (61, f"{say(70)} {passage} {say(70)}", "en"), (62, passage, "en")]
    rows += [(70, f"{say(40)} {item} {say(40)}", "en"), (80, "12 34 !!", "en"), (81, None, "en")]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), rows, passage


def test_stages(spark, planted, tmp_path):
    folder, rows, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, folder)
        if k < 4:
            assert found.columns == docs.columns
        found.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    ids = {i for i, _, _ in rows}
    assert set(kept["language"]) == ids - {80, 81}
    assert ids - {80, 81} - set(kept["near duplicates"]) == {51, 52}
    cut = kept["repeated passages"]
    assert passage in cut[60]["text"] and passage not in cut[61]["text"] and 62 not in cut
    assert cut[61]["n_chars"] == len(cut[61]["text"]) and cut[0]["text"] == rows[0][1]
    assert set(cut) - set(kept["decontamination"]) == {70}
    last, vocabulary = kept["encoding"], multilingual_vocabulary()
    assert set(last) == set(kept["decontamination"])
    assert all(last[i]["n_tokens"] == len(bpe.encode_text(r["text"], vocabulary)) for i, r in kept["decontamination"].items())
    assert set(range(40)) <= set(last)


def test_run(spark, planted):
    folder, _, _ = planted
    assert corpus_pipeline.run(spark, folder).where("doc_id in (51, 52, 62, 70, 80, 81)").isEmpty()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near duplicates", "repeated passages", "decontamination", "encoding"]
