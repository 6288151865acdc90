from __future__ import annotations

from loomspeak.llm import queries


def test_first_query_of_each_problem():
    assert {"p1_found", "p4_found", "p8_found", "p6_packed", "p7_mixture"} <= set(queries.QUERIES)
    assert set(queries.SQL) <= set(queries.QUERIES)
