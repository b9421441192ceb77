"""Every registered query of the core against its SQL, and against itself on other partitions."""

import pytest
from oracle import SF, connection, oracle_rows, rows_of

from ledgerlens.catalog import REGISTRY

QUERIES, ORACLES = REGISTRY.queries(), REGISTRY.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert rows_of(QUERIES[name](spark, SF)) == oracle_rows(con, ORACLES[name])


@pytest.mark.parametrize("name", ["first_tier_wins", "hash_chain", "knn_topk", "strict_and_rollup"])
def test_partition_count_does_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = rows_of(QUERIES[name](spark, SF))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert rows_of(QUERIES[name](spark, SF)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_duplicate_name_is_an_error():
    with pytest.raises(ValueError):
        REGISTRY.query("hash_chain")(lambda s, d: None)


def test_only_the_entry_point_knows_the_llm_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "ledgerlens"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "ledgerlens.llm" not in f.read_text(), f
