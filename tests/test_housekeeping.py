"""Housekeeping: orphans, cache evaluation, budgets, backups, locks."""

import pytest
from pyspark.sql import functions as F

from keymere.functions.keys import property_key
from keymere.operators.entity_map import EntityMap
from keymere.plans import housekeeping as h
from keymere.sources import blobs
from keymere.sources.store import Engine, StorageError


def test_orphans(spark, tmp_path):
    for name in ("a.dat", "b.tmp", "c.bak", "d.dat.corrupted.17", "tmp"):
        (tmp_path / name).write_text("x")
    files = blobs.read_files(spark, str(tmp_path)).select("path", "length")
    assert sorted(r.path.rsplit("/", 1)[1] for r in h.orphan_files(files).collect()) == ["b.tmp", "c.bak", "d.dat.corrupted.17"]


def test_cache_evaluation(spark):
    names = "id int, hit_ratio double, utilisation double, pressure boolean, allocations int, evictions int, entries int, avg_entry double, used long, capacity long"
    rows = [(1, 0.95, 50.0, False, 500, 10, 9, 4096.0, 500, 1000), (2, 0.5, 95.0, True, 500, 300, 9, 100.0, 950, 1000), (3, 0.7, 93.0, False, 50, 0, 0, 0.0, 930, 1000), (4, 0.9, 90.0, False, 50, 0, 0, 0.0, 900, 1000)]
    good, bad, hot, full = h.cache_evaluation(spark.createDataFrame(rows, names)).orderBy("id").collect()
    assert good.rating == "Excellent" and good.issues == [] and good.advice == ["nothing to change"] and not good.should_evict and good.optimal_capacity == 1000 and good.savings == 0
    assert bad.rating == "Poor" and len(bad.issues) == 3 and len(bad.advice) == 4 and bad.should_evict and bad.optimal_capacity == 1500 and bad.savings == 95
    assert hot.rating == "Good" and hot.optimal_capacity == 1200 and full.rating == "Good" and full.optimal_capacity == 1000
    assert h.totals(spark.createDataFrame([], "kind string, reclaimed long, ended timestamp")).first().reclaimed == 0


def test_budget():
    parts = h.Budget(10.0).split()
    assert parts["collection"] == pytest.approx(4) and parts["consolidation"] == pytest.approx(2.4) and sum(parts.values()) == pytest.approx(10)
    assert h.Budget(8.0).over_channels(4) == [2.0] * 4
    out = h.run_tasks({"collection": lambda s: s, "optimisation": lambda s: 1 / 0}, h.Budget(10.0))
    assert [x[0] for x in out] == ["collection", "optimisation"] and out[0][3] == pytest.approx(4) and isinstance(out[1][3], ZeroDivisionError)


def test_backups(spark, tmp_path):
    engine = Engine.start(spark, f"file://{tmp_path}/store")
    engine.store("x", spark.range(5))
    engine.store("y", spark.range(3))
    with pytest.raises(StorageError):
        h.Backups(engine)
    engine.config.backup_directory = f"file://{tmp_path}/backup"
    backups = h.Backups(engine)
    assert backups.full() == ["x", "y"]
    engine.append("x", spark.range(10, 14))
    assert backups.incremental("x", F.col("id"), F.lit(11)) == 2
    assert backups.listed() == [("x", 2), ("y", 1)]
    engine.store("x", spark.range(0))
    backups.restore("x")
    assert sorted(r.id for r in engine.root("x").collect()) == [0, 1, 2, 3, 4, 12, 13]
    with pytest.raises(StorageError):
        backups.restore("z")
    m = EntityMap(spark.range(6).withColumnRenamed("id", "entity_id").withColumn("v", F.lit("a"))).with_index(property_key("v", "v"))
    engine.register("m", m)
    engine.store_map("m")
    backups.full(["m"])
    engine.store("m", spark.range(1))
    backups.restore("m")
    assert engine.load_map("m").query("v", "a").count() == 6  # with its indexers


def test_lock(spark, tmp_path):
    engine = Engine.start(spark, f"file://{tmp_path}/store")
    a, b, late = h.Lock(engine), h.Lock(engine), h.Lock(engine, stale_seconds=0.0)
    assert a.acquire() and a.acquire() and not b.acquire() and not b.release()
    assert late.acquire() and not a.release() and late.release() and b.acquire()


def test_a_crash_between_the_steps_of_a_commit(spark, tmp_path, monkeypatch):
    """Whatever step a writer dies at, the last version stays, and another writer goes on after it."""
    from keymere.sources import store

    engine = Engine.start(spark, f"file://{tmp_path}/store")
    engine.store("x", spark.range(3))

    class Crash(Exception):
        pass

    def dies(self, path, text):
        raise Crash

    with monkeypatch.context() as m:
        m.setattr(Engine, "_put", dies)  # the part is written and the version claimed, but there is no manifest
        with pytest.raises(Crash):
            engine.append("x", spark.range(5))
    assert engine.root("x").count() == 3 and engine.manifest("x")["version"] == 1
    with pytest.raises(store.CommitConflict):  # it may still be writing
        engine.append("x", spark.range(7))
    monkeypatch.setattr(store, "STALE_SECONDS", -1)
    assert engine.append("x", spark.range(7)) == 2 and engine.root("x").count() == 10


def test_two_writers(spark, tmp_path, monkeypatch):
    from keymere.sources import store

    a, b = (Engine.start(spark, f"file://{tmp_path}/store") for _ in range(2))
    a.store("x", spark.range(3))
    write = Engine._write

    def slow(self, *args):
        part = write(self, *args)
        if self is a:
            b.append("x", spark.range(10))  # the other one is faster
        return part

    with monkeypatch.context() as m:
        m.setattr(Engine, "_write", slow)
        with pytest.raises(store.CommitConflict):
            a.append("x", spark.range(100))
    assert a.root("x").count() == 13 and a.append("x", spark.range(100)) == 3
    with pytest.raises(StorageError):
        a.append("x", spark.range(3).selectExpr("cast(id as int) as id"))
    for k in range(12):
        a.append("x", spark.range(1))
    assert len(a.versions("x")) <= store.KEPT_MANIFESTS + 2 and a.root("x").count() == 125
    assert a.compact("x") == 16 and len(a.manifest("x")["parts"]) == 1 and a.root("x").count() == 125


def test_foundation_and_import(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("id long")
    from keymere.sources.store import Foundation

    f = Foundation(spark, f"file://{tmp_path}/a", channels=3).with_type("thing", schema).with_root("things", lambda: spark.range(20)).with_evaluator(lambda s: s.names == ["id"])
    engine = f.start()
    assert engine.types.id_of("thing") == 1000 and engine.root("things").count() == 20
    engine.append("things", spark.range(20, 25))
    again = f.start()
    assert again.root("things").count() == 25 and again.load_roots().keys() == {"things"}
    counts = again.export("things", f"file://{tmp_path}/out", "id").collect()
    assert sum(r.n for r in counts) == 25 and len(counts) == 3
    other = Engine.start(spark, f"file://{tmp_path}/b")
    other.import_files("things", f"file://{tmp_path}/out")
    assert sorted(r.id for r in other.root("things").collect()) == list(range(25))
    with pytest.raises(StorageError):
        Foundation(spark, f"file://{tmp_path}/c").with_root("x", lambda: spark.range(1)).with_evaluator(lambda s: False).start()
    with pytest.raises(ValueError):
        Foundation(spark, "x", channels=0)


def test_upkeep(spark, tmp_path, monkeypatch):
    from keymere.sources import store

    engine = Engine.start(spark, f"file://{tmp_path}/store")
    for k in range(4):
        engine.append("x", spark.range(k, k + 1))
    engine.store("y", spark.range(2))
    engine._write("x", spark.range(9), [])  # the part of a writer that crashed
    work = h.Upkeep(engine, most_parts=3)
    assert work.collect(60.0) == 0  # it may still be writing
    monkeypatch.setattr(store, "STALE_SECONDS", -1)
    done = {name: result for name, _, _, result in work.run(h.Budget(1000.0))}
    assert done == {"collection": 1, "consolidation": ["x"]}
    assert sorted(r.id for r in engine.root("x").collect()) == [0, 1, 2, 3] and len(engine.manifest("x")["parts"]) == 1
    assert work.collect(0.0) == 0 and engine.root("y").count() == 2


def test_channels(spark, tmp_path):
    engine = Engine.start(spark, f"file://{tmp_path}/store", channels=3)
    engine.store_by_channel("x", spark.range(60), "id")
    assert sorted(r.id for r in engine.channels("x").collect()) == list(range(60))
    parts = [{r.id for r in engine.channels("x", [c]).collect()} for c in range(3)]
    assert all(parts) and sum(map(len, parts)) == 60
    engine.append("x", engine.channels("x", [1]))
    assert engine.channels("x", [1]).count() == 2 * len(parts[1]) and engine.channels("none") is None
