"""Every registered query against its SQL, on the small tables."""

import pytest
from oracle import compare
from strandline.plans import registry

SF = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    run = registry.queries()[name]
    if name in ORACLES:
        compare(spark, name, run, ORACLES[name], SF)
    else:
        assert run(spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_stands_alone():
    """Nothing outside strandline/llm imports it."""
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "strandline"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M), p
