"""Condition trees against a plain evaluation, and the query builder."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keymere.functions.conditions import And, Is, IsIn, IsNot, IsNotIn, Not, Or, Where, merge, row_differs
from keymere.functions.keys import Indexer, identity, ignore_case, numeric, property_key
from keymere.operators.query import EntityQuery

CITY, AGE, CI = property_key("city", "city", "string"), numeric("age", "age", "int"), ignore_case("ci", "city")
ROWS = [(i, c, a) for i, (c, a) in enumerate((c, a) for c in ("Rome", "rome", "Oslo", None) for a in (1, 2, 30, None))]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, "id long, city string, age int").cache()


def query(people):
    return EntityQuery(people, "id", {x.name: x for x in (CITY, AGE, CI)})


def key_of(index, row):
    v = row[1] if index in (CITY, CI) else row[2]
    return v.lower() if index is CI and v is not None else v


def holds(c, row):
    if isinstance(c, Not):
        return not holds(c.operand, row)
    if isinstance(c, And):
        return holds(c.left, row) and holds(c.right, row)
    if isinstance(c, Or):
        return holds(c.left, row) or holds(c.right, row)
    key = key_of(c.index, row)
    same = lambda v: v.lower() if c.index is CI and isinstance(v, str) else v
    if key is None:
        return False
    if isinstance(c, Is):
        return c.value is not None and key == same(c.value)
    if isinstance(c, IsNot):
        return key != same(c.value)
    if isinstance(c, Where):
        return key >= 2
    values = [same(v) for v in c.values if v is not None]
    return (key in values) == isinstance(c, IsIn)


cities = st.sampled_from(["Rome", "ROME", "Oslo", "x", None])
ages = st.sampled_from([1, 2, 30, 99, None])
leaves = st.one_of(
    *[st.builds(k, st.sampled_from([CITY, CI]), cities) for k in (Is, IsNot)],
    *[st.builds(k, st.just(AGE), ages) for k in (Is, IsNot)],
    *[st.builds(k, st.just(CITY), st.lists(cities, max_size=3).map(tuple)) for k in (IsIn, IsNotIn)],
    st.just(Where(AGE, lambda k: k >= 2)),
)
trees = st.recursive(leaves, lambda x: st.one_of(st.builds(And, x, x), st.builds(Or, x, x), st.builds(Not, x)), max_leaves=6)


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(trees)
def test_trees(people, tree):
    got = sorted(r[0] for r in people.where(tree.to_column(people)).select("id").collect())
    assert got == [r[0] for r in ROWS if holds(tree, r)]


def test_fold_from_the_left(people):
    q = query(people).and_("city", "Rome").and_("age", 1).or_("city", "Oslo").and_("age").is_not(30)
    assert [r.id for r in q.execute().orderBy("id").collect()] == [0, 8, 9]


def test_paging(people):
    q = query(people).order_by(F.col("age").desc_nulls_last())
    assert [r.id for r in q.skip(1).limit(2).execute().collect()] == [6, 10]
    assert query(people).limit(0).execute().count() == 0
    assert query(people).skip(3).limit(1).count() == len(ROWS)
    assert query(people).skip(2).limit(0).first().collect()[0].id == 2
    assert query(people).and_("city", "nowhere").first().count() == 0
    assert not query(people).and_("city", "nowhere").any()
    with pytest.raises(ValueError):
        query(people).limit(-1)
    with pytest.raises(ValueError):
        query(people).skip(-1)
    with pytest.raises(KeyError):
        query(people).and_("nothing")


def test_large_sets_are_joined(people):
    q = query(people).and_("age").is_in(*range(2, 5000)).and_("ci").is_in(*[f"Rome{i}" for i in range(2000)], "ROME")
    plan = q.execute()._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and [r.id for r in q.execute().orderBy("id").collect()] == [1, 2, 5, 6]


def test_equal_leaves_merge():
    c = merge(Or(Or(Is(CITY, "a"), Is(CITY, "b")), IsIn(CITY, ("c", "a"))))
    assert isinstance(c, IsIn) and c.values == ("a", "b", "c")
    assert isinstance(merge(Or(Is(CITY, "a"), Is(AGE, 1))), Or)


def test_pushdown(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    q = EntityQuery(orders, "o_orderkey", {}).and_(Is(property_key("s", "o_orderstatus"), "F"))
    plan = q.execute().select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan


def test_keys(spark, people):
    assert sorted(r.key for r in CITY.resolve(people, as_text=True).collect()) == ["", "Oslo", "Rome", "rome"]
    assert people.where(Is(AGE, "30").to_column(people)).count() == 4
    assert people.where(Is(AGE, "thirty").to_column(people)).count() == 0
    assert people.where(Is(identity("id"), 3).to_column(people)).count() == 1
    first = Indexer("first", lambda df: F.substring("city", 1, 1))
    assert people.where(Is(first, "O").to_column(people)).count() == 4
    assert people.where(row_differs(F.col("city"), "Rome")).count() == 12
