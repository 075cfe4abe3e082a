"""Fixtures over the awkward rows."""

import random

import pytest
from awkward_data import CLASHING, SCHEMA, awkward_rows


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from meltlens.session import ship_package

    ship_package(spark)


@pytest.fixture(scope="session")
def rows():
    return awkward_rows(random.Random(5))


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)
    return df.select("*", *[F.array(F.lit(k)).alias(c) for k, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
