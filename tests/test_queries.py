"""Every query that has SQL against DuckDB, under different numbers of partitions; the others against plain versions."""

import math

import duckdb
import pytest

from loomgrid.plans.all_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr(tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r)) for r in rows)


@pytest.fixture
def parts(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name, parts", [(n, (4, 8, 17)[k % 3]) for k, n in enumerate(sorted(ORACLES))], indirect=["parts"])
def test_oracle(spark, duck, name, parts):
    df = QUERIES[name](spark, SF)
    duck.execute(ORACLES[name])
    columns = [c[0] for c in duck.description]
    rows = duck.fetchall()
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert [columns[i] for i in order] == sorted(df.columns)
    assert plain(df.select(*sorted(df.columns)).collect()) == plain(tuple(r[i] for i in order) for r in rows)


def test_every_query_is_held_to_something():
    assert set(QUERIES) - set(ORACLES) <= {"lex_bpe_report"}


def test_quadtree_of_all_cells(spark, duck):
    """Squares of all levels cover each cell of every map once."""
    quads = QUERIES["quad_build"](spark, SF).groupBy("map_ord").agg({"code": "count"}).count()
    n = QUERIES["quad_build"](spark, SF).selectExpr("sum(shiftleft(1L, 2 * level))").first()[0]
    assert quads == duck.execute("SELECT count(*) FROM supplier").fetchone()[0]
    assert n == duck.execute("SELECT sum((64 + (s_suppkey % 5) * 16) * (48 + (s_suppkey % 3) * 16)) FROM supplier").fetchone()[0]
