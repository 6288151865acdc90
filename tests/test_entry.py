from __future__ import annotations

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_and_oracles_belong_together():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert {"speaker_word_share", "qc_flags"} <= set(queries)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry_and_oracles_on_the_smallest_tables(spark):
    import duckdb

    assert entry.entry(spark).limit(1).count() == 1
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW \"{os.path.basename(f)[:-8]}\" AS SELECT * FROM '{f}'")
    for name in set(entry.queries()) & {"p2_found", "p3_found", "p5_found", "speaker_word_share", "content_word_freq", "pareto_front"}:
        df = entry.queries()[name](spark, DATA)
        r = con.execute(entry.oracle_sql()[name])
        cols = [d[0] for d in r.description]
        assert sorted(cols) == sorted(df.columns)
        want = sorted(str([row[cols.index(c)] for c in sorted(cols)]) for row in r.fetchall())
        got = sorted(str([row[c] for c in sorted(cols)]) for row in df.collect())
        assert got == want, name
