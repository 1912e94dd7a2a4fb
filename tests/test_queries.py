"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from helmtrack.plans.queries import oracle_sql, queries

from .compare import database, rows

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_its_sql(spark, con, name):
    got = queries()[name](spark, SMALL).toPandas()
    sql = oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_contract():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(oracle_sql()) <= set(entry.oracle_sql()) <= names
    assert "level_correction_rms" in names


def test_queries_on_empty_tables(spark, tmp_path):
    """No query may need rows to be planned."""
    for name in ("events", "embeddings", "orders", "lineitem", "part", "nation", "documents", "benchmark", "conversations"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    fixed = {"octant_histogram": 8, "net_stage_score": 1, "track_spans_keyframes": 0}
    for name in ("level_correction_rms", "gauss_reflect", "extrema_prominence", "track_sync_1hz", "stage_compose_prune", "ekf", "kabsch_rotation", "bm25_topk", "octant_histogram", "telemetry_stage", "checkpoints_extrema", "imu_log_roundtrip", "box_orientation", "klv_orientation", "checkpoint_logs", "commit_and_section_documents", "appended_notes", "companion_logs", "bm25_index", "nearest_fix_haversine", "mutual_nearest", "grid_search_pair"):
        assert queries()[name](spark, str(tmp_path)).count() == (fixed.get(name) or 0), name
