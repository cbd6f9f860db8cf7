"""Blobs, paths, scalars, logs, caches, collection, metrics and streams."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keymere.functions import paths, scalars
from keymere.operators import prefix
from keymere.plans import monitor, storage, translog
from keymere.sources import blobs
from keymere.sources.store import Engine, StorageError
from keymere.streaming import feeds


def test_blobs(spark):
    df = spark.createDataFrame([("f", 0, bytearray(b"hello")), ("f", 1, bytearray(b"")), ("f", 2, bytearray(b" world")), ("g", 0, bytearray(b"x"))], "path string, n long, data binary")
    read = lambda o, n: {r.path: bytes(r.data) for r in blobs.read_range(df, "path", "n", "data", o, n).collect()}
    assert read(3, 5) == {"f": b"lo wo"} and read(0, -1) == {"f": b"hello world", "g": b"x"} and read(99, 5) == {}
    assert {r.path: r.size for r in blobs.file_sizes(df, "path", F.octet_length("data")).collect()} == {"f": 11, "g": 1}
    assert {r.path: r.next_no for r in blobs.next_numbers(df, "path", "n").collect()} == {"f": 3, "g": 1}
    cut = blobs.truncate(df, "path", "n", "data", 7)
    assert b"".join(bytes(r.data) for r in cut.where("path = 'f'").orderBy("n").collect()) == b"hello w"
    parts = blobs.chunk(spark.createDataFrame([(1, bytearray(b"abcdefg")), (2, bytearray(b""))], "id int, data binary"), "data", 3).orderBy("blob_no").collect()
    assert [(r.blob_no, bytes(r.data)) for r in parts] == [(0, b"abc"), (1, b"def"), (2, b"g")]
    assert blobs.copy_file(df, "path", "f", "h").count() == 7 and blobs.move_file(df, "path", "f", "h").where("path = 'h'").count() == 3
    assert blobs.delete_file(df, "path", "f").count() == 1
    both = blobs.copy_range(df, "path", "n", "data", "f", 3, 5, "g")
    assert {r.path: bytes(r.data) for r in blobs.read_range(both, "path", "n", "data", 0, -1).collect()} == {"f": b"hello world", "g": b"xlo wo"}
    more = blobs.append_blob(blobs.append_blob(df, "path", "n", "data", "g", b"yz"), "path", "n", "data", "new", b"1")
    assert {r.path: bytes(r.data) for r in blobs.read_range(more, "path", "n", "data", 0, -1).collect()} == {"f": b"hello world", "g": b"xyz", "new": b"1"}
    assert blobs.append_blob(df, "path", "n", "data", "f", b"over", "nio").where("path = 'f'").count() == 1 and blobs.append_blob(df, "path", "n", "data", "f", b"") is df
    dealt = blobs.with_offsets(df.withColumn("size", F.octet_length("data")), "path", "n", F.col("size"), large=True)
    assert sorted((r.path, r.n, r.start_off) for r in dealt.collect()) == [("f", 0, 0), ("f", 1, 5), ("f", 2, 5), ("g", 0, 0)]
    assert blobs.uri("s3", "bucket/a") == "s3a://bucket/a"
    with pytest.raises(ValueError):
        blobs.uri("redis", "x")


def test_blob_files(spark):
    df = spark.createDataFrame([("a/f", 0, bytearray(b"hello")), ("a/f", 1, bytearray(b" world")), ("a/g", 0, bytearray(b"x"))], "path string, n long, data binary")
    files = blobs.BlobFiles(df)
    text = lambda f, name, *at: bytes(f.read(name, *at).first().data)
    assert files.exists("a/f") and not files.exists("a") and not files.is_empty("a") and files.is_empty("b")
    assert text(files, "a/f", 3, 4) == b"lo w" and text(files.truncate("a/f", 7), "a/f") == b"hello w"
    assert text(files.copy("a/f", "a/g", 6), "a/g") == b"xworld" and text(files.copy("a/f", "b/h"), "b/h") == b"hello world"
    moved = files.move("a/f", "c").write("c", b"!")
    assert text(moved, "c") == b"hello world!" and not moved.exists("a/f") and not files.delete("a/g").exists("a/g")
    over = blobs.BlobFiles(df, store="nio").write("a/f", b"new")
    assert text(over, "a/f") == b"new"
    with files.remembered() as sizes:
        assert {r.path: r.size for r in sizes.collect()} == {"a/f": 11, "a/g": 1}


def test_stores_with_a_reader(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blobs, "READERS", {})
    blobs.register_reader("redis", lambda s, path: s.createDataFrame([(path + "/k", 0, bytearray(b"v"))], "path string, n long, data binary"))
    assert blobs.read_store(spark, "redis", "top").first().path == "top/k"
    for n, part in enumerate((b"ab", b"cd")):
        (tmp_path / f"file.{n}").write_bytes(part)
    files = blobs.BlobFiles(blobs.read_store(spark, "local", str(tmp_path)))
    name = files.sizes().first().path
    assert name.endswith("/file") and bytes(files.read(name).first().data) == b"abcd"
    with pytest.raises(ValueError):
        blobs.register_reader("s3", None)


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c.txt",), ("a/d",), ("e",)], "p string")
    row = df.select(paths.container(F.col("p")).alias("c"), paths.parent(F.col("p")).alias("up"), paths.identifier(F.col("p")).alias("i"), paths.file_type(F.col("p")).alias("t"), paths.file_stem(paths.identifier(F.col("p"))).alias("s"))
    assert [tuple(r) for r in row.collect()] == [("a", "a/b", "c.txt", "txt", "c"), ("a", "a", "d", "", "d"), ("e", "", "e", "", "e")]
    assert sorted(map(tuple, paths.children(df, "p", "a").collect())) == [("b", True), ("d", False)]
    n = spark.createDataFrame([("x.y.12",), ("x.y.",), ("xzy.1",)], "n string").select(paths.blob_number(F.col("n"), "x.y").alias("b")).collect()
    assert [r.b for r in n] == [12, None, None]
    ok = lambda name, store: spark.range(1).select(paths.valid_container(F.lit(name), store)).first()[0]
    assert ok("my-bucket", "s3") and not ok("My", "s3") and not ok("192.168.1.1", "s3") and not ok("..", "kafka") and ok("a_b", "kafka") and not ok("a--b", "azure")
    assert ok("my.bucket.", "s3") and not ok("xn--a", "s3") and not ok("Big", "oci") and not ok("a..b", "oci") and ok("7", "oci")
    key = lambda k, store: spark.range(1).select(paths.valid_key(F.lit(k), store)).first()[0]
    assert key("a/b c", "azure") and not key("a<b", "azure") and not key("a.", "azure") and not key("a\tb", "azure") and not key(" a", "oci") and not key("..", "oci") and not key("x" * 1025, "s3")
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(paths.topic_name(F.lit("a/b c/ü"))) == "a_b_c__" and one(paths.topic_name(F.lit("__x"))) == "ns__x" and one(paths.topic_name(F.lit(".."))) == "ns_.."
    assert len(one(paths.topic_name(F.lit("y" * 300)))) == 249 and one(paths.index_topic(F.lit("t"))) == "__t_index" and one(paths.is_valid_path(F.lit("my-bucket/a/b"), "s3"))


def test_scalars(spark):
    data = [b"", b"a", b"hello world" * 9]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, d binary")

    def rolling(d):
        c = 0
        for b in d:
            c = ((c << 1) ^ b) & 0xFFFFFFFF
        return c

    assert [r[0] for r in df.orderBy("i").select(scalars.rolling_checksum(F.col("d"))).collect()] == [rolling(d) for d in data]
    values = [0, 1, -1, 63, 64, -65, 2**40, -(2**63), 2**63 - 1]

    def length(v):
        z = ((v << 1) ^ (v >> 63)) & (2**64 - 1)
        return max(1, -(-z.bit_length() // 7))

    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", scalars.varint_length(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(v, length(v)) for v in values]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalars.ticks_to_micros(F.lit(12345))) == 1234
    assert one(scalars.mask_secrets(F.lit("host=a;Password = x;port=1"))) == "host=a;Password=***;port=1"
    assert one(scalars.rating(F.lit(0.8), 0.9, 0.7, 0.5)) == "Good" and one(scalars.numbered_name(F.lit(7), 3)) == "007"
    assert one(scalars.guarded_ratio(F.lit(1), F.lit(0))) == 0.0 and one(scalars.clamp(F.lit(9), F.lit(1), F.lit(5))) == 5
    assert one(scalars.sha256_text(F.lit("x"))) == hashlib.sha256(b"x").hexdigest()


def test_log(spark):
    log = spark.createDataFrame([(1, 1, 1, 0, 10), (1, 2, 6, 0, 0), (2, 3, 1, 10, 5), (3, 4, 1, 15, 5), (3, 5, 6, 0, 0)], "tx long, seq long, type int, off long, len long")
    done = F.col("type") == translog.COMMIT
    assert sorted(r.tx_id for r in storage.committed(log, F.col("tx"), F.col("seq"), done).collect()) == [1, 3]
    assert storage.replay(log, "tx", "seq", done).count() == 4
    assert storage.replay(log.withColumn("valid", F.col("seq") < 4), "tx", "seq", done).count() == 2
    assert storage.last_committed(log.limit(0), F.col("tx"), done).first()[0] == 0
    want = storage.extents(log.where("type = 1"), F.col("tx"), F.col("off"), F.col("len"))
    actual = spark.createDataFrame([(1, 10), (2, 3)], "file_no long, size long")
    assert {r.file_no: r.state for r in storage.recovery(want, actual).collect()} == {1: "ok", 2: "short", 3: "missing"}
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, checksum string")
    b = spark.createDataFrame([(2, "z"), (3, "q")], "id long, checksum string")
    assert {r.id: r.state for r in storage.integrity(a, b, "id").collect()} == {1: "new", 2: "changed", 3: "missing"}


def test_reachable(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(5, 0), (20, 21)], "src long, dst long")
    live = storage.reachable(spark.createDataFrame([(2,)], "id long"), edges)
    assert sorted(r.id for r in live.collect()) == list(range(7))
    objects = spark.range(25).withColumnRenamed("id", "oid")
    assert storage.sweep(objects, live, "oid").count() == 18


def test_cache_and_files(spark):
    cache = spark.createDataFrame([(i, 10 - i, 3) for i in range(6)], "id long, seen long, size long")
    assert sorted(r.id for r in storage.evictions(cache, [F.col("seen"), F.col("id")], F.col("size"), 7).collect()) == [3, 4, 5]
    chunks = storage.roll_over(cache, [F.col("id")], F.col("size"), 6).orderBy("id").collect()
    assert [r.file_no for r in chunks] == [0, 0, 1, 1, 2, 2]
    unequal = spark.createDataFrame([(0, 4), (1, 4), (2, 0), (3, 5), (4, 25), (5, 1), (6, None), (7, 9)], "id long, size long")
    chunks = storage.roll_over(unequal, [F.col("id")], F.col("size"), 10).orderBy("id").collect()
    assert [r.file_no for r in chunks] == [0, 0, None, 1, 2, 3, None, 3]
    first = storage.roll_over(unequal.where("id = 4"), [F.col("id")], F.col("size"), 10).first()
    assert first.file_no == 1  # the empty first file is left
    old = spark.createDataFrame([(i, i % 4, 2) for i in range(8)], "id long, seen long, size long")
    gone = storage.expired_first(old.withColumn("seen", 10 - F.col("seen")), F.col("seen"), F.lit(9), F.col("id"), F.col("size"), 7)
    assert sorted(r.id for r in gone.collect()) == [2, 3, 6, 7]
    sweep = lambda ms: sorted(r.id for r in storage.cleared(old, F.col("seen") > 2, F.col("id"), F.lit(1), ms).collect())
    assert sweep(8) == [3, 7] and sweep(7) == []
    files = spark.createDataFrame([(i, 1) for i in range(6)], "f long, size long")
    assert storage.consolidation_groups(files, "f", F.col("size") < 5).count() == 5
    assert storage.usage(files.limit(0).withColumn("live", F.lit(0)), "size", "live").first().usage == 0.0


def test_small_files_are_merged(spark, tmp_path):
    for k in range(7):
        spark.range(10 * k, 10 * k + 3).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    files = blobs.read_files(spark, f"{tmp_path}/in/*.parquet").select("path", "length")
    numbered = files.withColumn("id", F.xxhash64("path"))
    groups = storage.consolidation_groups(numbered, "id", F.col("length") < 1 << 20, size=3).join(numbered, "id").select("path", "grp")
    merged = storage.merge_groups(groups, "path", f"{tmp_path}/out")
    assert merged.select("grp").distinct().count() == 2 and merged.count() == 18  # the seventh is alone
    assert len(merged.inputFiles()) == 2 and {r.id for r in merged.collect()} <= {r.id for r in spark.read.parquet(f"{tmp_path}/in").collect()}


def test_metrics(spark):
    events = spark.createDataFrame([("a", 10.0, True), ("a", 2000.0, False), ("b", 1.0, True)], "op string, ms double, ok boolean")
    m = monitor.by_operation(events, F.col("op"), F.col("ms"), F.col("ok"))
    advice = {r.op: r.advice for r in monitor.recommendations(m).collect()}
    assert advice == {"a": ["high_latency", "low_success", "high_variance"], "b": []}
    assert monitor.overall_advice(monitor.totals(m, 60)).first().advice == ["error rate", "few operations"]
    stats = spark.createDataFrame([(0, 0, 95, 100, 0)], "allocations int, evictions int, used int, capacity int, entries int")
    r = monitor.memory(stats).first()
    assert r.hit_ratio == 0.0 and r.avg_entry == 0.0 and r.pressure


def test_streams(spark, tmp_path):
    engine = Engine.start(spark, f"file://{tmp_path}/store")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.limit(50).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    feeds.store_stream(stream, engine, "events", f"{tmp_path}/cp").awaitTermination()
    assert engine.root("events").count() == 50
    feeds.store_stream(stream, engine, "events", f"{tmp_path}/cp").awaitTermination()
    assert engine.root("events").count() == 50
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    for name, frame in (("committed_tx", feeds.committed_stream(timed, "user_id", "ts", F.col("event_type") == "purchase")), ("metric_windows", feeds.metric_stream(timed, "ts", "event_type", "value"))):
        q = frame.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() > 0


def test_committed_stream_counts_whole_transactions(spark, tmp_path):
    minutes = [(1, 9, False), (1, 11, True), (2, 0, False), (2, 45, False), (2, 200, True), (2, 201, False), (3, 5, False), (4, 205, False), (4, 1, True)]
    log = spark.createDataFrame(minutes, "tx long, m long, done boolean").withColumn("ts", F.timestamp_seconds(F.col("m") * 60))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in")
    got = {}
    for k in range(3):  # later entries come in later runs
        log.where(F.col("m").between(*((0, 9), (10, 200), (201, 300))[k])).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        frame = feeds.committed_stream(stream, "tx", "ts", F.col("done"))
        q = frame.writeStream.foreachBatch(lambda b, _: got.update({r.tx: tuple(r) for r in b.collect()})).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    want = {r.tx_id: tuple(r) for r in storage.committed(log, F.col("tx"), F.col("ts"), F.col("done")).collect()}
    assert got == want and {k: v[1] for k, v in got.items()} == {1: 2, 2: 4, 4: 2}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 14), max_size=12), min_size=1, max_size=6), st.integers(1, 20))
def test_filling_over_partitions(parts, most):
    """What each partition states of any filling, chained, is what one pass over all rows gives."""
    container = filling = 0
    chained = []
    for values in parts:
        values = np.array(values, np.int64)
        upto, begun, left = prefix._outcomes(values[values > 0], most)
        assert (np.diff(upto) > 0).all()
        number, *end = prefix._numbers(values, most, container, filling)
        chained += [int(n) for n, v in zip(number, values) if v > 0]
        k = int(np.searchsorted(upto, filling, "left"))
        assert end == [container + int(begun[k]), int(left[k]) if begun[k] else filling + int(left[k])]
        container, filling = end
    want, container, filling = [], 0, 0
    for v in (v for values in parts for v in values if v > 0):
        if filling + v > most:
            container, filling = container + 1, 0
        filling += v
        want.append(container)
    assert chained == want


def test_filled_over_many_partitions(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 60, 3000)
    df = spark.createDataFrame([(int(i), int(v)) for i, v in enumerate(sizes)], "id long, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r.file_no for r in prefix.filled(df.repartition(5), [prefix.Descending(F.col("id"))], F.col("v"), 200).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    container = filling = 0
    for i in range(2999, -1, -1):
        v = int(sizes[i])
        if not v:
            assert got[i] is None
            continue
        if filling + v > 200:
            container, filling = container + 1, 0
        filling += v
        assert got[i] == container
    assert prefix.filled(df.limit(0), [F.col("id")], F.col("v"), 200).count() == 0


def test_log_frames(spark, tmp_path):
    entry = {"type": translog.STORE, "tx_id": 5, "ts_ms": 1, "channel": 2, "seq": 3, "file_no": 4, "offset": 10, "length": 20, "object_ids": [1, -2]}
    frame = translog.encode(entry)
    assert {k: v for k, v in translog.decode(frame).items() if v is not None} == entry
    assert translog.decode(frame[:-1]) is None and translog.decode(frame[:9] + b"x" + frame[10:]) is None and translog.decode(b"") is None
    made = [translog.encode(entry | {"seq": k}) for k in range(4)] + [translog.encode({"type": translog.CREATE, "tx_id": 1, "ts_ms": 0, "channel": 0, "seq": 9, "file_no": 1, "path": "ä.dat"})]
    assert list(translog.split(b"".join(made))) == made
    (tmp_path / "a.log").write_bytes(b"".join(made))
    (tmp_path / "b.log").write_bytes(b"".join(made[:2]) + made[2][:-3] + made[3])  # damaged in the third
    got = translog.read_files(spark, str(tmp_path)).collect()
    assert sorted((r.path or "", r.seq) for r in got) == sorted([("", 0), ("", 1), ("", 2), ("", 3), ("ä.dat", 9), ("", 0), ("", 1)])


def test_frames_are_expressions(spark):
    """Tables of frames are written and read without Python workers, as the functions on single frames do it."""
    rng = np.random.default_rng(4)
    whole = lambda n, *ends: int(rng.choice([0, -1, *ends, *rng.integers(-(2 ** (n - 1)), 2 ** (n - 1) - 1, 3)]))
    q, i = (lambda: whole(64, 2**63 - 1, -(2**63))), (lambda: whole(32, 2**31 - 1, -(2**31)))
    rows = [(k, k % 7 + 1, q(), q(), i(), q(), q(), q(), q(), [q() for _ in range(k % 4)], ["", "ä€😀", "x\0y"][k % 3], i(), q()) for k in range(210)]
    entries = spark.createDataFrame(rows, f"position long, {translog.ENTRY}")
    frames = translog.encoded(entries, F.col("position"))
    again = translog.encoded(translog.decoded(frames), F.col("position"))
    want = {r[0]: translog.encode(dict(zip(entries.columns, r))) for r in rows}
    assert {r.position: bytes(r.frame) for r in frames.collect()} == want
    assert {r.position: bytes(r.frame) for r in again.where("position >= 0").collect()} == want
    plan = translog.up_to_damage(translog.decoded(again).where("valid"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))

    def framed(body):  # length and checksum are right
        return struct.pack("<i", len(body)) + body + struct.pack("<I", zlib.crc32(body))

    made = [None, b"", b"\0" * 36, b"\0" * 37]
    for frame in want.values():
        body = frame[4:-4]
        at, to = int(rng.integers(len(body))), int(rng.integers(256))
        made += [frame[:at], frame[:at] + bytes([to]) + frame[at + 1 :], framed(body[:at]), framed(body + b"\0"), framed(body[:at] + bytes([to]) + body[at + 1 :])]
    head = struct.pack("<bqqiq", translog.CREATE, 1, 2, 3, 4) + struct.pack("<q", 5)
    made += [framed(head + struct.pack("<i", n) + b"ab\xff") for n in (-1, 0, 2, 3, 4, 2**31 - 1)]
    got = translog.decoded(spark.createDataFrame([(k, None if x is None else bytearray(x)) for k, x in enumerate(made)], translog.FRAME)).collect()
    for r in got:
        entry = translog.decode(made[r.position] or b"")
        assert r.asDict() == {"position": r.position, "valid": entry is not None} | (entry or dict.fromkeys(entries.columns[1:]))
    assert [r.valid for r in sorted(got)[-6:]] == [False, True, True, False, False, False]
    with pytest.raises(Exception, match="lacks a field"):
        translog.encoded(entries.limit(1).withColumn("object_ids", F.array(F.lit(None).cast("long"))), F.col("position")).collect()


def test_log_writer_and_recovery(spark, tmp_path):
    engine = Engine.start(spark, f"file://{tmp_path}/store")
    log = translog.Log(engine)
    assert log.entries().count() == 0
    a, b, c = log.begin(), log.begin(), log.begin()
    log.store(a, 1, 0, 100, [1])
    log.store(b, 2, 0, 50, [2])
    log.store(a, 3, 0, 70, [3])
    log.commit(a)
    log.rollback(b)  # c is still open when the writer dies
    log.store(c, 4, 0, 1, [4])
    with pytest.raises(StorageError):
        log.store(b, 2, 0, 50, [2])
    sizes = spark.createDataFrame([(1, 100), (3, 60)], "file_no long, size long")
    found = {r.file_no: (r.expected_size, r.state) for r in translog.recover(engine, "log", sizes).collect()}
    assert found == {1: (100, "ok"), 3: (70, "short")}
    again = translog.Log(engine)
    assert again.position == log.position and again.begin() == 3
    engine.append("log", spark.createDataFrame([(again.position, bytearray(b"damaged"))], translog.FRAME))
    late = translog.Log(engine)
    d = late.begin()
    late.delete(d, 1)
    late.commit(d)
    assert late.entries().where(F.col("tx_id") == d).count() == 0  # behind the damage


def test_recorder_and_monitors(spark, tmp_path):
    engine = Engine.start(spark, f"file://{tmp_path}/store")
    r = monitor.Recorder(engine, at_once=3)
    assert r.events().count() == 0
    for k in range(4):
        r.write(k, 10, 1000 * k, ok=k != 2)
    with pytest.raises(ZeroDivisionError), r.timed("work"):
        1 / 0
    got = {x.op: (x.total, x.failed) for x in monitor.by_operation(r.events(), F.col("op"), F.col("nanos"), F.col("ok")).collect()}
    assert got == {"Write": (4, 1), "work": (1, 1)} and r.events(2).count() == 2
    m = monitor.Monitors()
    m.add("a", "cache", lambda: spark.range(2))
    m.add("b", "files", lambda: spark.range(3))
    assert m.get("b").count() == 3 and m.get("x") is None and list(m.of_kind("cache")) == ["a"] and m.listed(spark).count() == 2
    with pytest.raises(ValueError):
        m.add("a", "cache", lambda: None)


def test_replay_of_a_growing_log(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (1, 3, "c"), (2, 4, None)], "key long, n long, value string")
    assert {r.key: r.value for r in feeds.latest_by_key(log, "key", "n").collect()} == {1: "c", 2: None}
    log.write.parquet(f"{tmp_path}/in")
    stream = feeds.from_earliest(spark, f"{tmp_path}/in", "key long, n long, value string")
    q = stream.writeStream.format("memory").queryName("replayed").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert stream.isStreaming and spark.table("replayed").count() == 4


def test_a_repeated_batch_is_stored_once(spark, tmp_path):
    """A batch whose commit was done before the stream's own checkpoint was written comes again and is skipped."""
    engine = Engine.start(spark, f"file://{tmp_path}/store")
    spark.range(30).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    feeds.store_stream(stream, engine, "x", f"{tmp_path}/one").awaitTermination()
    assert engine.manifest("x")["meta"] == {"epoch": 0} and engine.manifest("x")["version"] == 1
    feeds.store_stream(stream, engine, "x", f"{tmp_path}/lost").awaitTermination()  # batch 0 once more
    assert engine.root("x").count() == 30 and engine.manifest("x")["version"] == 1
