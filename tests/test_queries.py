"""Registered queries against their SQL, and the entry points without the optional subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sylva.plans.catalogue import QUERIES
from sylva.plans import oracles, roundtrips

ORACLE_SQL = oracles.ORACLE_SQL | roundtrips.ORACLE_SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def values(columns, found):
    plain = lambda v: v.isoformat() if hasattr(v, "isoformat") else v
    return sorted((repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in found))


#: Their operators have tests of their own, and they take a minute each.
SLOW = {"chunk_lists", "compacted_store", "merkle_changes", "resolve_three_tips"}


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - SLOW))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, DATA)
    assert values(got.columns, [tuple(r) for r in got.collect()]) == values(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 200


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_subpackage():
    code = "import sys; sys.modules['sylva.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'merkle_rollup' in e.queries() and 'pipeline' not in e.queries(); assert 'merkle_rollup' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)


def test_a_broken_import_is_an_error():
    broken = "import sys, importlib.abc\nclass F(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path, target=None):\n        if name == 'sylva.llm.bpe': raise ModuleNotFoundError('no', name='something_else')\nsys.meta_path.insert(0, F())\nimport __spark_entry__"
    root = Path(__file__).resolve().parent.parent
    assert not (root / "sylva" / "llm").is_dir() or subprocess.run([sys.executable, "-c", broken], cwd=root, capture_output=True).returncode != 0
