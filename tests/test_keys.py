"""Trials of suppliers whose keys have more than four digits."""

import pytest

duckdb = pytest.importorskip("duckdb")

from rdlab import queries  # noqa: E402

KEYS = (1, 1000, 9999, 10000, 10001, 123456)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    path, con = tmp_path_factory.mktemp("tables"), duckdb.connect()
    con.execute(f"COPY (SELECT unnest({list(KEYS)})::BIGINT AS s_suppkey) TO '{path}/supplier.parquet'")
    lines = f"SELECT k AS l_suppkey, n AS l_partkey, CASE WHEN n % 2 = 0 THEN 'F' ELSE 'O' END AS l_linestatus, (n % 11) / 100e0 AS l_discount, (k + n) % 50 + 1e0 AS l_quantity, (k * 31 + n * 17) % 9973 / 100e0 AS l_extendedprice FROM (SELECT unnest({list(KEYS)})::BIGINT AS k) CROSS JOIN range(300) AS r(n)"
    con.execute(f"COPY ({lines}) TO '{path}/lineitem.parquet'")
    return str(path)


def test_ids_and_sources_are_unique(spark, tables):
    rows = queries.encodes(spark, tables)
    assert rows.select("source").distinct().count() == len(KEYS)
    assert rows.select("id").distinct().count() == rows.count()
    assert {r["source"] for r in rows.select("source").distinct().collect()} == {"IMG_0001.png", "IMG_1000.png", "IMG_9999.png", "IMG_10000.png", "IMG_10001.png", "IMG_123456.png"}


@pytest.mark.parametrize("name", ["read_database", "create_encodes", "codec_extremes_image", "slice_columns", "target_pick", "merge_metrics"])
def test_same_rows_as_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    want = con.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, tables).select(*[f"`{n}`" for n in names]).collect()
    key = lambda r: repr([round(x, 6) if isinstance(x, float) else x for x in r])
    assert sorted(map(key, got)) == sorted(map(key, want.fetchall()))


@pytest.mark.parametrize("name", ["report_options", "slice_blocks", "extrema", "image_reduction", "insert_trials", "insert_trials_bucketed"])
def test_other_queries_give_the_same_rows_as_sql(spark, tables, name):
    test_same_rows_as_sql(spark, tables, name)
