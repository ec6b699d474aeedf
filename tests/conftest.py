import pytest

from millrace.plans.registry import Tables
from millrace.session import clear_scratch, tune
from tests.harness import duck, session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session_ = tune(session(4))
    yield session_
    clear_scratch(session_)


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SMALL)


@pytest.fixture(scope="session")
def oracle():
    return duck(SMALL)


def plan_text(df) -> str:
    return df._jdf.queryExecution().toString()


def executed_plan(df) -> str:
    """The final physical plan, after adaptive execution has run it."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
