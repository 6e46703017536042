"""Every query of this folder over empty tables, and over tables that also hold rows of nothing but nulls, and rows twice."""

import os

import pytest

from tidemark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def edges(spark, data, tmp_path_factory):
    empty, odd = str(tmp_path_factory.mktemp("empty")), str(tmp_path_factory.mktemp("odd"))
    for f in os.listdir(data):
        df = spark.read.parquet(f"{data}/{f}")
        df.limit(0).coalesce(1).write.parquet(f"{empty}/{f}")
        few = df.limit(40)
        nulls = spark.createDataFrame([(None,) * len(df.columns)] * 2, df.schema)
        few.unionByName(few.limit(5)).unionByName(nulls).coalesce(1).write.parquet(f"{odd}/{f}")
    return empty, odd


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, edges, name):
    QUERIES[name](spark, edges[0]).count()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls_and_repeated_rows(spark, edges, name):
    QUERIES[name](spark, edges[1]).count()
