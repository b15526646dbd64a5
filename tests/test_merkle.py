"""Merkle trees that are kept up to date equal those that are rebuilt."""

import random

from pyspark.sql import functions as F

from sylva.operators import merkle

FILES = "path string, blob_id string, size long, mtime long"
CHANGES = "path string, type string, blob_id string, size long, mtime long, gone boolean"


def rows(state):
    return sorted(tuple(r) for r in state.select(*merkle.STATE).collect())


def files_frame(spark, files):
    return spark.createDataFrame([(p, f"b{v}", v, v * 1_000) for p, v in files.items()], FILES)


def rolled(spark, files, dirs):
    return merkle.roll_up(files_frame(spark, files), spark.createDataFrame([(d,) for d in sorted(dirs)], "path string"))


def random_step(rng, files, dirs):
    """Changes some paths of a tree in place; the changes as rows."""
    changed = {}
    for p in rng.sample(sorted(files), min(len(files), 3)):
        if rng.random() < 0.5:
            files[p] = rng.randrange(1_000)
            changed[p] = (p, "file", f"b{files[p]}", files[p], files[p] * 1_000, False)
        else:
            del files[p]
            changed[p] = (p, "file", None, None, None, True)
    for _ in range(3):
        p = "/".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) + f"/f{rng.randrange(5)}"
        files[p] = rng.randrange(1_000)
        changed[p] = (p, "file", f"b{files[p]}", files[p], files[p] * 1_000, False)
    for d in rng.sample(sorted(dirs), min(len(dirs), 1)):
        dirs.discard(d)
        changed[d] = (d, "directory", None, None, None, True)
    d = "/".join(rng.choice("abcxy") for _ in range(rng.randrange(1, 4)))
    dirs.add(d)
    changed[d] = (d, "directory", None, None, None, False)
    return list(changed.values())


def test_updates_equal_full_roll_ups(spark):
    rng = random.Random(11)
    files, dirs = {"a/b/f1": 1, "a/f2": 2, "f3": 3}, {"empty/one"}
    state = rolled(spark, files, dirs).checkpoint()
    for _ in range(2):
        changed = spark.createDataFrame(random_step(rng, files, dirs), CHANGES)
        state = merkle.applied(state, merkle.update(state, changed)).checkpoint()
        assert rows(state) == rows(rolled(spark, files, dirs))


def test_files_and_directories_change_places(spark):
    state = rolled(spark, {"x/y": 1, "p": 2}, {"x"}).checkpoint()
    changed = spark.createDataFrame([("x/y", "file", None, None, None, True), ("x", "file", "b5", 5, 5_000, False), ("p", "directory", None, None, None, False), ("p/q", "file", "b6", 6, 6_000, False)], CHANGES)
    assert rows(merkle.applied(state, merkle.update(state, changed))) == rows(rolled(spark, {"x": 5, "p/q": 6}, {"p"}))


def test_an_update_tells_only_what_is_touched(spark):
    files = {f"d{k % 40}/e{k % 3}/f{k}": k for k in range(600)}
    state = rolled(spark, files, set()).checkpoint()
    changed = spark.createDataFrame([("d7/e1/f7", "file", "new", 1, 1, False)], CHANGES)
    assert {r["path"] for r in merkle.update(state, changed).collect()} == {"d7/e1/f7", "d7/e1", "d7", "."}


def test_no_change_and_the_last_file(spark):
    state = rolled(spark, {"a/f": 1}, set()).checkpoint()
    none = spark.createDataFrame([], CHANGES)
    assert merkle.update(state, none).count() == 0
    gone = merkle.update(state, spark.createDataFrame([("a/f", "file", None, None, None, True)], CHANGES))
    assert {(r["path"], r["gone"]) for r in gone.collect()} == {("a/f", True), ("a", True), (".", False)}
    assert rows(merkle.applied(state, gone)) == rows(rolled(spark, {}, set()))
    unknown = merkle.update(state, spark.createDataFrame([("no/such", "file", None, None, None, True)], CHANGES))
    assert rows(merkle.applied(state, unknown)) == rows(state)
