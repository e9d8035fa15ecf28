import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "segments", "chars", "hits", "pending"] and df.count() == 200


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stream_equals_batch(spark):
    q = entry.queries()
    batch, stream = (sorted(map(tuple, q[n](spark, SF).collect())) for n in ("job_changes", "stream_job_changes"))
    assert batch == stream
