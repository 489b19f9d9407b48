"""The driver contract on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from textloom.plans import registry

DATA = "/root/testdata/sf0.001"


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    covered = {i for ids in registry.SURVEY_IDS.values() for i in ids}
    families = "A10 B6 C7 D14 E7 F13 G6 H12 I4 J12 K9 L3"
    missing = [
        f"{f[0]}{i}" for f in families.split() for i in range(1, int(f[1:]) + 1) if f"{f[0]}{i}" not in covered
    ]
    assert missing == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["source", "split", "n_windows", "n_tokens", "input_sum", "target_sum"]
    assert sum(r.n_windows for r in rows) > 0 and {r.split for r in rows} == {"train", "test"}
