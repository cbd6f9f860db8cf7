"""Mutations, constraints, indices and persistence of entity maps."""

import pytest
from pyspark.sql import functions as F

from keymere.functions.conditions import Is, Row
from keymere.functions.keys import Indexer, ignore_case, property_key
from keymere.operators import index as sets
from keymere.operators.constraints import ConstraintViolation, CustomConstraint, UniqueConstraint
from keymere.operators.entity_map import EntityMap, ReadOnlyError, Segments, builder
from keymere.operators.prefix import Descending, dense_ids, groups_of, running
from keymere.operators.relations import by_ids, navigate, nest, not_exists, range_join
from keymere.sources.store import Engine, StorageError

MAIL = ignore_case("mail", "mail")


@pytest.fixture
def people(spark):
    df = spark.createDataFrame([(i, f"P{i}@x", 20 + i) for i in range(5)], "entity_id long, mail string, age int")
    return builder(df, "entity_id", property_key("age", "age", "int"), unique=(MAIL,), custom=(CustomConstraint("grown", F.col("age") >= 18),), next_id=5)


def ages(m):
    return {r.entity_id: r.age for r in m.df.collect()}


def test_add(spark, people):
    new = spark.createDataFrame([("b@x", 40), ("a@x", 50)], "mail string, age int")
    m = people.add_all(new, [F.col("mail")])
    assert m.next_id == 7 and ages(m)[5] == 50 and ages(m)[6] == 40 and people.size() == 5
    assert ages(m.add(mail="c@x", age=33))[7] == 33
    assert people.add_all(new.limit(0), [F.col("mail")]).next_id == 5


def test_next_id_is_looked_up(spark):
    df = spark.createDataFrame([(3, "a"), (9, "b")], "id long, v string")
    m = EntityMap(df, "id")
    assert sorted(r.id for r in m.add(v="c").add(v="d").df.collect()) == [3, 9, 10, 11]
    assert sorted(r.id for r in m.remove([9]).add(v="c").df.collect()) == [3, 10]  # ids aren't used again
    assert EntityMap(df.limit(0), "id").add(v="x").df.first().id == 0
    with pytest.raises(ValueError):
        EntityMap(df, "id", next_id=5).add(v="x")
    with pytest.raises(ValueError):
        m.add(w="x")
    with pytest.raises(ValueError):
        m.add(id=4, v="x")


def test_the_same_entity(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, None, 3)], "id long, v string, n int")
    m = builder(df, "id", equality=("v",))
    assert m.find(v="a", n=99) == 1 and m.find(v=None) == 3 and m.find(v="z") == -1 and EntityMap(df, "id").find(v="a", n=2) == 2
    left, found = m.remove_entity(v="a")
    assert found == 1 and sorted(r.id for r in left.df.collect()) == [2, 3] and m.remove_entity(v="z") == (m, -1)
    assert {r.id: r.v for r in m.replace({"v": "a"}, {"v": "q", "n": 5}).df.collect()} == {1: "q", 2: "a", 3: None}
    with pytest.raises(KeyError):
        m.replace({"v": "z"}, {"v": "q"})
    same = {"v": "a"}
    with pytest.raises(ValueError):
        m.replace(same, same)


def test_rules_of_change(spark, people):
    rule = CustomConstraint("older", "old is null or new.age >= old.age", on_change=True)
    people.constraints.add(rule)
    assert ages(people.update(Is(MAIL, "p1@x"), {"age": F.col("age") + 5}))[1] == 26
    with pytest.raises(ConstraintViolation, match="older"):
        people.update(Is(MAIL, "p1@x"), {"age": F.lit(18)})
    people.add(mail="n@x", age=18)
    found = people.constraints.violations(people.df.withColumn("age", F.lit(17)), "entity_id", people.df).collect()
    assert sorted({r.constraint_name for r in found}) == ["grown", "older"] and len(found) == 10
    with pytest.raises(ValueError):
        UniqueConstraint((Indexer("text", "mail", "string", unique_allowed=False),))


def test_queries_of_queries(spark, people):
    q = people.with_index(property_key("text", "mail")).query
    assert q("age", 20).or_(q("age", 21), q("age", 22)).count() == 3
    assert q("age", key_type="int").is_(20).count() == 1 and q("text", key_type="string").is_("P1@x").count() == 1
    with pytest.raises(TypeError):
        q("age", key_type="string")
    assert q("age").is_in(20, 21).where(F.col("mail") == "P1@x").count() == 1 and q(Row(F.col("age") > 22)).count() == 2
    assert q(~Row(F.col("age") > 22)).count() == 3


def test_constraints(spark, people):
    with pytest.raises(ConstraintViolation, match="mail"):
        people.add(mail="p1@X", age=30)
    with pytest.raises(ConstraintViolation, match="grown"):
        people.add(mail="new", age=3)
    with pytest.raises(ConstraintViolation, match="mail"):  # the first that was added
        people.add(mail="p1@x", age=3)
    freed = people.remove([1]).add(mail="p1@x", age=30)
    assert ages(freed)[5] == 30
    with pytest.raises(ConstraintViolation):
        people.update(Is(property_key("id", "entity_id"), 0), {"mail": F.lit("p2@x")})
    with pytest.raises(ValueError):
        people.constraints.add(UniqueConstraint((MAIL,)))
    delta = spark.createDataFrame([("P1@x",), ("z",), ("Z",), (None,), (None,)], "mail string")
    assert sorted(r.mail for r in UniqueConstraint((MAIL,)).conflicts(delta, people.df).collect()) == ["p1@x", "z"]
    assert people.constraints.has("grown") and people.constraints.remove("grown") and not people.constraints.has("grown")


def test_remove_set_update(spark, people):
    assert set(ages(people.remove([0, 9]))) == {1, 2, 3, 4}
    assert set(ages(people.remove_first(Is(property_key("age", "age"), 23)))) == {0, 1, 2, 4}
    assert people.remove_all().next_id == 0 and people.remove_all(False).next_id == 5
    m = people.set(spark.createDataFrame([(2, 77)], "entity_id long, age int"))
    assert ages(m)[2] == 77 and m.df.where("entity_id = 2").first().mail == "P2@x"
    with pytest.raises(KeyError):
        people.set(spark.createDataFrame([(99, 77)], "entity_id long, age int"))
    m, result = people.apply(Is(MAIL, "p3@x"), {"age": F.col("age") + 1}, F.col("age") * 2)
    assert [tuple(r) for r in result.collect()] == [(3, 48)]
    kinds = {r.change for r in m.remove([0]).add(mail="n", age=50).changes_from(people).collect()}
    assert kinds == {"insert", "delete", "update"}


def test_marks(people):
    people.mark_read_only()
    people.mark_read_only()
    people.unmark_read_only()
    with pytest.raises(ReadOnlyError):
        people.remove([1])
    people.unmark_read_only()
    people.remove([1])
    people.close()
    with pytest.raises(RuntimeError):
        people.remove([1])
    with pytest.raises(ValueError):
        Segments(low=21)
    with pytest.raises(ValueError):
        Segments(low=20, mid=20, high_max=11)


def test_index(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "ab"[i % 2]) for i in range(7)], "id long, k string")
    x = EntityMap(df, "id").with_index(property_key("k", "k")).index("k")
    assert sorted(r.entity_id for r in x.lookup("a").collect()) == [0, 2, 4, 6]
    assert sorted(r.key for r in x.keys().collect()) == ["a", "b"] and x.ids().count() == 6
    assert {r.key: r.cnt for r in x.cardinalities().collect()} == {"a": 4, "b": 2}
    assert {r.key: r.entity_ids for r in x.inverted().collect()} == {"a": [0, 2, 4, 6], "b": [1, 5]}
    assert x.size().first()[0] == 2 and x.equal_key_pairs().count() == 7
    assert x.search(lambda k: k > "a").count() == 2
    assert sorted(r[0] for r in sets.complement(x.lookup("a"), df.select(F.col("id").alias("entity_id"))).collect()) == [1, 3, 5]


def test_running(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = {r.id: r.s for r in running(df, [Descending(F.col("id"))], {"s": F.col("v")}).collect()}
    assert all(got[i] == sum(j % 7 for j in range(i + 1, 1000)) for i in range(0, 1000, 97))
    assert [r.entity_id for r in dense_ids(df, [F.col("v"), F.col("id")], 10).orderBy("v", "id").collect()] == list(range(10, 1010))
    assert groups_of(df, [F.col("id")], 300).groupBy("grp").count().orderBy("grp").collect()[-1][1] == 100
    assert running(df.limit(0), [F.col("id")], {"s": F.col("v")}).count() == 0


def test_relations(spark, people):
    assert by_ids(people.df, "entity_id", list(range(3, 3000))).count() == 2
    assert by_ids(people.df, "entity_id", [1, 99]).count() == 1
    assert not_exists(people.df, people.df.where("age > 21"), {"entity_id": "entity_id"}).count() == 2
    items = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "o int, n int, s string")
    assert [[x.s for x in r["items"]] for r in nest(items, "o", ["s"], "n").orderBy("o").collect()] == [["a", "b"], ["c"]]
    assert navigate(people.df, items, {"entity_id": "o"}, {"k": F.count("s")}).select("entity_id", "k").orderBy("entity_id").collect() == [(1, 2), (2, 1)]
    a = spark.createDataFrame([(0, 25), (30, 31), (7, 7)], "start long, end long")
    b = spark.createDataFrame([(5, 9), (25, 30), (100, 120)], "start long, end long")
    assert range_join(a, b, 10).count() == 4


def test_store(spark, tmp_path, people):
    engine = Engine.start(spark, f"file://{tmp_path}")
    assert engine.root("x") is None and engine.roots() == []
    assert engine.store("x", people.df) == 1
    work = engine.unit_of_work("x")
    work.store(people.df.limit(2))
    work.store(people.df.limit(1))
    assert work.pending_count() == 3 and engine.root("x").count() == 5
    assert work.commit() == 2 and work.commit() is None
    assert engine.root("x").count() == 8 and engine.roots() == ["x"]
    engine.register("people", people.remove([4]))
    engine.store_map("people")
    with pytest.raises(StorageError, match="grown"):  # its predicate is a column, which has no stored form
        engine.load_map("people")
    grown = CustomConstraint("grown", F.col("age") >= 18)
    loaded = engine.load_map("people", custom=(grown,))
    assert loaded.next_id == 5 and set(ages(loaded)) == {0, 1, 2, 3} and loaded.query("age", 21).count() == 1
    for bad in ({"mail": "p1@X", "age": 30}, {"mail": "new", "age": 3}):
        with pytest.raises(ConstraintViolation):
            loaded.add(**bad)
    assert ages(loaded.add(mail="new", age=30))[5] == 30
    assert spark.table("people").count() == 4
    own = builder(people.df, "entity_id", property_key("year", lambda d: d["age"] + 1), custom=(CustomConstraint("old", "age > 3"),))
    engine.register("own", own)
    engine.store_map("own")
    with pytest.raises(StorageError, match="year"):
        engine.load_map("own")
    again = engine.load_map("own", (property_key("year", lambda d: d["age"] + 1),))
    assert again.query("year", 22).count() == 1 and again.constraints.has("old") and again.segments == Segments()
    assert "part_id" not in again.df.columns and engine.load_segments("own", 1, 2).count() == 2
    with pytest.raises(StorageError):
        engine.load_map("nothing")
