"""Extendible hashing and WARC archives against plain versions."""

import base64
import hashlib

from pyspark.sql import functions as F

from keymere.llm import sharding, warc
from keymere.llm.scratch import Scratch


def _shards(spark, rows, limit):
    docs = spark.createDataFrame(rows, "doc_id long, text string, prefix string, n_bytes string")
    return sharding.shard_rows(docs, limit, Scratch(spark, "t")).collect()


def _hash(i):
    return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)


def test_only_large_buckets_split(spark):
    rows = [(i, "x" * (i % 97), "p", None) for i in range(3000)] + [(None, None, None, None)]
    got = _shards(spark, rows, 900)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes) for r in got) == sorted((i is None, i or 0, len(t or "")) for i, t, *_ in rows)
    size = lambda d, p: sum(len(t or "") for i, t, *_ in rows if _hash(i) >> (60 - d) == p)
    for depth, prefix in {(r.depth, r.prefix) for r in got}:
        assert size(depth, prefix) <= 900
        assert depth == 0 or size(depth - 1, prefix >> 1) > 900
    assert all(r.prefix == _hash(r.doc_id) >> (60 - r.depth) and r.page == 0 for r in got)


def test_repeated_and_large_keys_fill_pages(spark):
    got = _shards(spark, [(7, "x" * 40, None, None)] * 500 + [(8, "y" * 5000, None, None), (9, "z", None, None)], 1000)
    pages = {}
    for r in got:
        pages.setdefault((r.depth, r.prefix, r.page), []).append(r.n_bytes)
    assert len(got) == 502 and all(sum(x) <= 1000 or len(x) == 1 for x in pages.values())
    assert len({r.page for r in got if r.doc_id == 7}) == len([1 for (d, p, g), x in pages.items() if x[0] == 40])


def test_written_shards_hold_each_row_once(spark):
    rows = [(7, "x" * 40, str(i), None) for i in range(500)] + [(8, "y" * 5000, "8", None), (None, "n" * 30, "a", None), (None, "n" * 30, "b", None), (9, None, "c", None)]
    rows += [(100 + i, "z" * 70, "d", "e") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prefix string, n_bytes string")
    scratch = Scratch(spark, "t")
    read = sharding.write_shards(docs, 1000, scratch.path("shards"), scratch)
    got = read.collect()
    assert sorted(map(repr, (tuple(r)[:4] for r in got))) == sorted(map(repr, rows))
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(len(r.text or ""))
    assert all(sum(x) <= 1000 or len(x) == 1 for x in shards.values())
    assert len({r.shard for r in got if r.doc_id == 7}) >= 20
    names = sharding.names_of(read).collect()
    assert all(r.prefix == _hash(r.doc_id) >> (60 - r.depth) for r in names) and len(names) == len(rows)
    assert sharding.write_shards(docs.limit(0), 1000, scratch.path("none"), scratch).count() == 0


def test_small_and_empty_tables(spark):
    assert _shards(spark, [(1, "a", None, None)], 10)[0].depth == 0
    assert sharding.shard_rows(spark.createDataFrame([], "doc_id long, text string"), 10, Scratch(spark, "t")).count() == 0


def test_directory_join_is_the_same(spark, monkeypatch):
    rows = [(i, "x" * 50, None, None) for i in range(400)] + [(3, "y" * 90, None, None)] * 30
    a = sorted(_shards(spark, rows, 700))
    monkeypatch.setattr(sharding, "SENT_SHARDS", 1)
    assert sorted(_shards(spark, rows, 700)) == a


PAGES = [
    (1, "http://b.Example.com/x?q=1", "<p>one</p>"),
    (2, "https://example.com", "<p>same</p>"),
    (3, "https://example.com/\ttab\nline", "<p>same</p>"),
    (4, None, None),
    (5, "no host", ""),
    (6, "http://a.org/#f", "é" * 5000),
    (7, "http://a.org/#f", "<p>same</p>"),
    (None, "http://z.net", "<p>same</p>"),
    (3, "https://example.com/\ttab\nline", "<p>same</p>"),
    (7, "http://a.org/#f", "<p>same</p>"),
]


def _archive(spark, pages, **more):
    rows = spark.createDataFrame([(*p, "x", "y", "z") for p in pages], "page_id long, url string, html string, key string, sha1 string, last string")
    index, captures = warc.archive(spark, rows, Scratch(spark, "t"), **more)
    return index, captures


def test_round_trip(spark):
    index, captures = _archive(spark, PAGES)
    found = index.lookup(captures.select("key", "page_id").distinct())
    got = sorted(index.read(found, with_payload=True).collect(), key=lambda r: (r.page_id or 0, r.record_type))
    assert len(got) == len(PAGES)
    for r in got:
        page, url, html = next(p for p in PAGES if p[0] == r.page_id)
        payload = (html or "").encode()
        same = [p[0] for p in PAGES if (p[2] or "") == (html or "") and p[0] is not None]
        first = max(same)
        revisit = len([1 for p in PAGES if (p[2] or "") == (html or "")]) > 1 and page != first
        assert (r.payload_bytes, r.record_type, r.refers_to) == (len(payload), "revisit" if revisit else "response", first if revisit else None)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert bytes(r.payload) == (b"" if revisit else payload)


def test_records_by_the_standard(spark, monkeypatch):
    """Hot groups or not, each record has an id of its own and a revisit names its response's URI."""
    for hot in (1000, 1, 0):
        monkeypatch.setattr(warc, "HOT_GROUPS", hot)
        _, captures = _archive(spark, PAGES + [(20 + i, f"http://c.org/{i}", "long " * 200_000) for i in range(3)])
        root = captures.inputFiles()[0].split("/captures/")[0].replace("file://", "") + "/archives"
        members = []
        for c in captures.collect():
            with open(f"{root}/{c.file}", "rb") as f:
                f.seek(c.offset)
                members.append(warc.parse(f.read(c.length))[0])
        assert len({m["WARC-Record-ID"] for m in members}) == len(members) == len(PAGES) + 3
        urls = {m["WARC-Page-ID"]: m.get("WARC-Target-URI") for m in members if "WARC-Page-ID" in m}
        revisits = [m for m in members if m["WARC-Type"] == "revisit"]
        assert len(revisits) == 7 and all(m["WARC-Refers-To-Target-URI"] == urls[m["WARC-Refers-To-Page-ID"]] for m in revisits)


def test_lookup(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    pages = [(i, f"http://h{i % 7}.example.com/{i // 3}", f"<p>{i}</p>") for i in range(200)]
    index, captures = _archive(spark, pages)
    wanted = spark.createDataFrame([("com,example,h3)/1", 3), ("com,example,h3)/1", 4), ("zzz)", 1), ("", None), ("com,example,h0)/2", 7)], "key string, page_id long")
    assert sorted((r.key, r.page_id) for r in index.lookup(wanted).collect()) == [("com,example,h0)/2", 7), ("com,example,h3)/1", 3)]
    assert index.lookup(captures.select("key", "page_id")).count() == 200


def test_small_payloads_are_never_revisits(spark):
    index, captures = _archive(spark, [(1, "http://a", "xy"), (2, "http://b", "xy"), (3, "http://c", "xyz"), (4, "http://d", "xyz")], min_bytes=3)
    got = {r.page_id: r.record_type for r in index.read(captures).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty_archive(spark):
    index, captures = _archive(spark, [])
    assert index.read(index.lookup(captures.select("key", "page_id"))).count() == 0


def test_url_keys(spark):
    df = spark.createDataFrame([(p[1],) for p in PAGES[:6]], "u string")
    assert [r[0] for r in df.select(warc.url_key(F.col("u"))).collect()] == ["com,example,b)/x?q=1", "com,example)", "com,example)/%09tab%0Aline", "", ")", "org,a)/#f"]
