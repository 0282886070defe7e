"""Registered queries against their DuckDB SQL, over whole small tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

from ledgerline.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    import check_oracles
    res = check_oracles.compare(spark, check_oracles.duck(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert res["status"] == "ok", res
    assert "types" not in res, res
