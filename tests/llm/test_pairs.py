"""URL filters, Jaccard join, decontamination and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa

import pytest
from pyspark.sql import functions as F

from keymere.llm import decontaminate, host_ranks, jaccard
from keymere.llm.queries import QUERIES, SQL, URL_RULES
from keymere.llm.scratch import Scratch

DIR = "/root/testdata/sf0.001"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _pages():
    link = lambda *hosts: "".join(f'<A HREF = "http://{h}/x">l</A>' for h in hosts)
    return [
        (1, "http://good.org/a?b#c", link("friend.net", "far.net")),
        (2, "HTTP://Sub.GOOD.org/", None),
        (3, "http://friend.net/1", link("far.net")),
        (4, "http://far.net", ""),
        (5, "http://spam.net/", link("x.com", "x.com", "good.org")),
        (6, "http://x.com/de/1", link("spam.net")),
        (7, "https://example.org/es/1", link("example.org")),
        (8, "https://www.example.org/en/12?x", ""),
        (9, "https://www.example.org/en/2", ""),
        (10, "http://x.com/fr/", ""),
        (11, "http://x.com/other", ""),
        (12, None, link("x.com")),
        (13, "nothing", None),
        (14, "http://org/p", ""),
        (15, "a://b://c", ""),
        (16, "http://far.net", ""),
    ]


def _duck(pages):
    con = duckdb.connect()
    frame = pd.DataFrame(pages, columns=["page_id", "url", "html"])
    con.register("pages", frame)
    return con


def test_urls_against_sql(spark):
    pages = _pages()
    got = host_ranks.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string").withColumnRenamed("html", "html"), URL_RULES, Scratch(spark, "t")).collect()
    want = _duck(pages).execute(SQL["op8_url_filters"]).fetchall()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == sorted(want)
    by = {r.page_id: r for r in got}
    assert by[8].rule == "example.org/en/1" and by[9].rule == "org/" and by[2].host == "sub.good.org" and by[14].rule == "org/"
    assert by[5].verdict == "block" and by[3].verdict == "allow" and by[3].trust > 0 and by[12].host == ""
    assert len(got) == len(pages)


def test_many_rules_are_joined(spark, monkeypatch):
    df = spark.createDataFrame(_pages(), "page_id long, url string, html string")
    own = df.withColumn("host", host_ranks.host_of(F.col("url"))).withColumn("path", host_ranks.path_of(F.col("url")))
    run = lambda: sorted(((r.page_id, r.rule, r.rule_verdict) for r in host_ranks.with_rule(own, URL_RULES).collect()), key=str)
    a = run()
    monkeypatch.setattr(host_ranks, "LITERAL_RULES", 0)
    assert run() == a
    assert host_ranks.judge_urls(df.limit(0), URL_RULES, Scratch(spark, "t")).count() == 0


def _ranks(edges, seeds, names):
    """Power iteration in which what reaches a host without links goes back to the seeds."""
    m, s = np.zeros((len(names),) * 2), np.array([seeds.get(x, 0.0) for x in names])
    for x, y, n in edges:
        m[names.index(y), names.index(x)] = n / sum(e[2] for e in edges if e[0] == x)
    r = s
    for _ in range(600):
        r = 0.15 * s + 0.85 * (m @ r + (1 - m.sum(axis=0)) @ r * s)
    return r


def test_ranks_match_power_iteration(spark):
    names = [*"abcdef", *(f"n{i}" for i in range(40))]
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 3.0), ("c", "e", 2.0), ("d", "f", 1.0), ("f", "n0", 1.0)]
    edges += [(f"n{i}", f"n{i + 1}", 1.0) for i in range(39)]  # far from the seeds
    table = [("trust", *e) for e in edges] + [("distrust", y, x, n) for x, y, n in edges]
    seeds = {"trust": {"a": 0.5, "d": 0.5}, "distrust": {"e": 0.2, "c": 0.8}}
    rows = [(k, h, v) for k, own in seeds.items() for h, v in own.items()]
    found = host_ranks.propagate(spark.createDataFrame(table, "kind string, src string, dst string, n double"), spark.createDataFrame(rows, "kind string, host string, seed double"), Scratch(spark, "t"), "x").collect()
    for kind, own in seeds.items():
        want = _ranks([e[1:] for e in table if e[0] == kind], own, names)
        got = {r["host"]: r["rank"] for r in found if r["kind"] == kind}
        assert np.allclose([got.get(x, 0.0) for x in names], want, rtol=1e-4, atol=0)


def test_verdicts_compare_shares_of_all_trust_and_distrust(spark):
    """A trusted seed that links to a blocked host keeps more trust than distrust, whatever part of the walks ends at hosts without links."""
    pages = [(1, "http://good.org/", '<a href="//X.com/a">'), (2, "http://x.com/de/", ""), (3, "http://bad.net/", '<a href=http://x.com/>'), (4, "http://lost.net/", "<a href='/inside'>")]
    pages.append((5, "http://long.net/", "x" * 300_000 + '<a href="http://x.com">'))
    df = spark.createDataFrame([(*p, "own", "own") for p in pages], "page_id long, url string, html string, host string, trust string")
    got = {r.page_id: r for r in host_ranks.judge_urls(df.unionByName(df.where("page_id = 3")), URL_RULES, Scratch(spark, "t")).collect()}
    edges = [("x.com", "good.org", 1.0), ("x.com", "bad.net", 2.0), ("x.com", "long.net", 1.0)]
    want = _ranks(edges, {"x.com": 1.0}, ["x.com", "good.org", "bad.net", "long.net"])
    assert np.allclose([got[k].distrust for k in (2, 1, 3, 5)], want, rtol=1e-4)
    assert [got[k].verdict for k in (1, 2, 3, 4, 5)] == ["allow", "block", "block", "allow", "block"]


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _components(rows):
    sets = {i: _shingles(t) for i, t in rows}
    inverted, parent = defaultdict(list), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in inverted[x] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), root(i)) for i, s in sets.items())


def _near_copies():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    rows = [(1000, None), (1001, ""), (1002, " \t"), (1003, "one two"), (1004, "ONE  two\n"), (1005, "one"), (1006, "É é x y z"), (1007, "é é x y z")]
    i = 0
    for n in (20, 60, 200, 900):
        for _ in range(4):
            base = rng.choices(words, k=n)
            for _ in range(14):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, n // 22))):
                    copy[rng.randrange(len(copy))] = rng.choice(words)
                if rng.random() < 0.3:
                    copy += rng.choices(words, k=n // 12)
                rows.append((i, " ".join(copy).upper() if i % 3 else " ".join(copy)))
                i += 1
    passage = " ".join(rng.choices(words, k=60))
    rows += [(2000 + k, passage + " " + " ".join(rng.choices(words, k=k))) for k in range(0, 90, 3)]
    return rows


def test_jaccard_against_all_pairs(spark, monkeypatch):
    rows = _near_copies()
    rng = random.Random(2)
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, id string")
    run = lambda: sorted(tuple(r)[:3] for r in jaccard.similar_components(docs, Scratch(spark, "t")).collect())
    want = _components(rows)
    assert run() == want
    monkeypatch.setattr(jaccard, "SENT_IDS", 0)
    monkeypatch.setattr(jaccard, "COMMON", 2)  # common shingles come last
    assert run() == want
    # blocks are cut by size and compared tile by tile, few of them in the first round, all but the smallest by trees
    for name, value in (("TILE", 4), ("LEAST_KEYS", 2), ("CENTERS", 1), ("FIRST_BLOCKS", 1), ("LEAF", 3), ("FAN", 2)):
        monkeypatch.setattr(jaccard, name, value)
    assert run() == want


def test_jaccard_query_against_all_pairs(spark):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(tuple(r)[:3] for r in QUERIES["op9_jaccard_join"](spark, "/root/testdata/sf0.01").collect())
    assert got == _components(list(zip(docs.doc_id, docs.text)))


def test_common_shingles(spark, monkeypatch):
    """All repeated shingles with their ranks, and only whole ranks from the highest down where there are too many."""
    texts = ["a b c d e f"] * 40 + ["g h i j k l m"] * 9 + [f"only{i} in this one text" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    shingles = {t: next(iter(jaccard.shingle_sets(pa.array([t], pa.large_string())))) for t in set(texts)}
    monkeypatch.setattr(jaccard, "COMMON", 2)
    value, rank = jaccard.common_shingles(docs, Scratch(spark, "t"))
    assert dict(zip(value.tolist(), rank.tolist())) == {x: r for t, r in (("a b c d e f", 5), ("g h i j k l m", 3)) for x in shingles[t].tolist()}
    assert (np.diff(value.astype(object)) > 0).all()
    monkeypatch.setattr(jaccard, "MOST_COMMON", 3)
    assert sorted(jaccard.common_shingles(docs, Scratch(spark, "t"))[0].tolist()) == sorted(shingles["a b c d e f"].tolist())
    assert len(jaccard.common_shingles(docs.limit(0), Scratch(spark, "t"))[0]) == 0


def test_first_shingles_are_shared_by_similar_sets():
    rng = np.random.default_rng(9)
    common = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    rank = rng.integers(5, 9, len(common)).astype(np.uint8)
    seen = np.zeros(1 << 16, bool)
    seen[common & np.uint64((1 << 16) - 1)] = True
    for n in (1, 2, 4, 5, 6, 9, 10, 40, 333):
        for _ in range(40):
            base = np.concatenate([rng.choice(common, min(n // 2, 250), replace=False), rng.integers(0, 1 << 63, n - min(n // 2, 250), dtype=np.uint64)])
            cut = n // 5  # a set of 80 % of the elements is just similar enough
            x, y = np.unique(base), np.unique(rng.permutation(base)[cut:])
            assert 100 * len(np.intersect1d(x, y)) >= jaccard.SHARE * len(np.union1d(x, y))
            assert len(np.intersect1d(*(jaccard.first_shingles(z, common, rank, seen) for z in (x, y))))


def test_points_bound_the_overlap():
    rng = np.random.default_rng(12)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for n in (1, 5, 200, 1500, 2500, 30_000)]
    sets.append(np.arange(5000, dtype=np.uint64))  # all in one group
    fine, known = jaccard.unpacked([jaccard.packed(s) for s in sets])
    assert known.tolist() == [True] * 6 + [False]
    for s, counts in zip(sets[:6], fine):
        assert counts.tolist() == np.bincount((s >> np.uint64(52)).astype(int), minlength=jaccard.FINE).tolist()
    near = [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 1 << 63, len(s) // 10, dtype=np.uint64)])) for s in sets]
    rows = jaccard.Points.of(np.arange(14), np.array([len(s) for s in sets + near]), [jaccard.packed(s) for s in sets + near], np.arange(14))
    ok = rows.near(np.arange(7), np.arange(7, 14))
    assert all(o for o, x, y in zip(ok, sets, near) if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))) and ok[6]
    assert not rows.near(np.array([2, 3, 4]), np.array([9, 4, 3]) * 0 + 5).any()


def test_first_of_similar(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, "a b c d e f", 1), (5, "a b c d e f", 2), (None, "a b c d e f", 3), (5, "other words of the same id here", 4), (None, "words without an id at all", 5)]
    rows += [(None, "words without an id at all", 6), (7, None, 7), (8, "", 8), (8, "", 9), (2, long, 10), (1, long + " end", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash int")
    got = [tuple(r) for r in jaccard.first_of_similar(docs, Scratch(spark, "t")).collect() if r.text_hash not in (1, 2, 5, 6)]
    assert set(got) == {rows[k] for k in (3, 6, 7, 8, 10)}
    kept = [r.text_hash for r in jaccard.first_of_similar(docs, Scratch(spark, "t")).collect()]
    assert len(kept) == 7 and len({1, 2} & set(kept)) == len({5, 6} & set(kept)) == 1
    assert jaccard.first_of_similar(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_jaccard_repeats_nulls_and_nothing(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, "A b c d e F"), (None, None), (7, None), (9, "long " * 30_000 + "x y z u v")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_components(docs, Scratch(spark, "t")).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (9, 2, 5), (None, 0, None), (7, 0, 7), (9, 6, 9)], key=str)
    assert jaccard.similar_components(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_links_against_all_pairs(spark, monkeypatch):
    rows = _near_copies()
    rows += [(5000 + k, rows[30][1]) for k in range(3)] + [(None, rows[30][1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda: sorted((tuple(r)[::3] for r in jaccard.similar_components(docs, Scratch(spark, "t")).select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=str)
    sets = [_shingles(t) for _, t in rows]
    linked = lambda x, y: bool(x) and 100 * len(x & y) >= 80 * len(x | y)
    want = sorted(((rows[i][0], sum(linked(x, y) for j, y in enumerate(sets) if j != i)) for i, x in enumerate(sets)), key=str)
    assert max(n for _, n in want) > 10
    assert run() == want
    monkeypatch.setattr(jaccard, "LINK_TILE", 4)
    assert run() == want


def test_tree_finds_all_near_points():
    rng = np.random.default_rng(3)
    base = rng.poisson(4, (60, jaccard.GROUPS))
    points = np.repeat(base, 12, axis=0) + rng.integers(0, 2, (720, jaccard.GROUPS)) * (rng.random((720, 1)) < 0.5)
    rows = jaccard.Points(np.arange(720), points.sum(axis=1), points, np.arange(720) // 3)
    tree = jaccard.CountTree(rows)
    for i in range(0, 720, 31):
        others = np.flatnonzero(rows.components != rows.components[i])
        assert sorted(tree.search(i)) == sorted(others[rows.near(np.full(len(others), i), others)])


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(300, 200), (300, 250)]
    got = {r.id: r.component for r in jaccard.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 140)) and got[300] == got[250] == 200


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_infix_distance():
    rng = np.random.default_rng(4)
    for _ in range(200):
        item, text = (rng.integers(1, 5, rng.integers(lo, 9)).astype(np.uint64) for lo in (1, 0))
        d, a, b = decontaminate.infix_distance(item, text)
        want = min(_edit(item, text[x:y]) for x in range(len(text) + 1) for y in range(x, len(text) + 1))
        assert d == want == _edit(item, text[a:b])


def test_passages_are_found(spark):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(3000)]
    items = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate([1, 2, 3, 5, 8, 13, 20, 33, 64, 90] * 4)] + [(98, None), (99, " ... ")]
    rows, planted = [], {}
    for i in range(160):
        item, text = items[i % 40]
        copy = text.split()
        for _ in range(int(decontaminate.RATE * len(copy)) if i >= 80 else 0):
            at = rng.randrange(len(copy))
            kind = rng.randrange(3)
            copy[at : at + 1] = [["new", copy[at]], ["new"], []][kind]
        body = rng.choices(words, k=300)
        body[150:150] = copy
        rows.append((i, (" ".join(body)).upper() if i % 2 else ",  ".join(body)))
        planted[i] = item
    rows += [(900 + i, " ".join(rng.choices(words, k=400))) for i in range(60)] + [(998, None), (999, "")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, item_id int")
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    missed = [i for i, k in planted.items() if (i, k) not in found]
    assert not [i for i in missed if i < 80] and len(missed) <= 3
    text, long = dict(rows), dict(items)
    norm = lambda t: [w.strip(",.").lower() for w in t.split()]
    for r in got:
        own = norm(text[r.doc_id])[r.first_word : r.first_word + r.n_words]
        assert r.distance == _edit(norm(long[r.item_id]), own) <= int(decontaminate.RATE * r.item_words)
    assert all(r.item_words < 3 for r in got if r.doc_id >= 900)
    assert decontaminate.contaminated(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_passages_with_edits_at_one_place_are_found():
    rng = random.Random(21)
    words = [f"u{i}" for i in range(3000)]
    lost = []
    for n in (9, 10, 19, 20, 30, 60, 100, 127, 200):
        items = [(i, " ".join(rng.choices(words, k=n))) for i in range(12)]
        index, k = decontaminate.ItemIndex(items), int(decontaminate.RATE * n)
        for place in (0, (n - k) // 2, n - k):
            for kind in ("cut", "new", "more"):
                texts = []
                for _, text in items:
                    copy = text.split()
                    copy[place : place + (0 if kind == "more" else k)] = [] if kind == "cut" else ["edited"] * k
                    texts.append(" ".join(rng.choices(words, k=40) * (place > 0) + copy + rng.choices(words, k=30)))  # the first ones begin their texts
                part = decontaminate.Words(pa.array(texts, pa.large_string()))
                got = {(m[0], m[1]) for m in index.matches(decontaminate.word_values(part), part.offsets)}
                lost += [(n, place, kind, i) for i in range(12) if (i, i) not in got]
    assert not lost


def test_index_is_small():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(20_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(20, 31)))) for i in range(4000)]
    index = decontaminate.ItemIndex(items)
    assert index.n_bytes() < 12 * sum(len(t) for _, t in items)


def test_repeated_documents_and_equal_distances(spark):
    item = " ".join(f"t{i}" for i in range(20))
    near = item.replace("t3", "x3")
    docs = spark.createDataFrame([(1, f"{near} and {near}", 9), (1, f"{near} and {near}", 9), (2, item, 9), (None, f"{item} {'long ' * 100_000}{item}", 9)], "doc_id long, text string, distance int")
    got = sorted((r.doc_id or 0, r.item_id, r.first_word, r.distance) for r in decontaminate.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect())
    assert got == [(0, 7, 0, 0), (1, 7, 0, 1), (1, 7, 0, 1), (2, 7, 0, 0)]


def test_items_in_blocks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    a = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 15)
    assert sorted(map(tuple, decontaminate.contaminated(docs, items).collect())) == a and a
    monkeypatch.setattr(decontaminate, "BYTES_AT_ONCE", 2000)
    assert sorted(map(tuple, decontaminate.contaminated(docs, items).collect())) == a
    norm = lambda t: " " + " ".join(w.decode() for w in decontaminate.stems([x.encode() for x in t.split()])) + " "
    d, b = docs.toPandas(), items.toPandas()
    texts, wanted = d.text.map(norm), b.text.map(norm)
    exact = {(i, k) for i, t in zip(d.doc_id, texts) for k, w in zip(b.item_id, wanted) if w in t}
    assert exact <= {(r[0], r[1]) for r in a}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    frames = [docs]
    scratch = Scratch(spark, "t")
    for name, stage in corpus_pipeline.STAGES:
        frames.append(scratch.table(stage(spark, frames[-1], DIR), name))
    kept = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert all(f.columns == docs.columns for f in frames[:-1])
    texts = {r.doc_id: r.text for r in docs.collect()}
    # the join keeps exactly the smallest id of each group of what the stages before it kept
    assert kept[3] == {i for i, _, c in _components([(i, texts[i]) for i in sorted(kept[2])]) if i == c}
    assert kept[5] == kept[4] <= kept[3] <= kept[2] <= kept[1] <= kept[0]
    leaks = decontaminate.contaminated(frames[3], spark.read.parquet(f"{DIR}/benchmark.parquet")).select("doc_id").collect()
    assert kept[4] == kept[3] - {r.doc_id for r in leaks}
    assert len(kept[4]) > 0.5 * len(kept[0])


CLASHING = ["score", "level", "kept", "cosine", "rejected", "lang_pred", "n_words", "base_failed", "text_hash", "component_id", "n_shingles", "item_id", "length", "sequence_id", "lid_score", "rule_kept", "hash_text"]


def test_stages_on_odd_tables(spark):
    """Nulls in any column, empty, repeated and very long texts, an empty table and a user's columns with the stages' names."""
    import corpus_pipeline

    plain = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 60").collect()
    rows = [tuple(r) for r in plain] + [tuple(plain[3])] * 2
    rows += [(None, plain[4].text, None, None, None), (901, None, "en", "s", 0), (902, "", None, None, 0), (903, " \n\t", "de", "s", 3), (904, plain[5].text * 300, "en", "s", None), (plain[6].doc_id, plain[7].text + " one more word", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    docs = spark.createDataFrame([(*r, *(f"{c}{k}" for c in CLASHING)) for k, r in enumerate(rows)], schema)
    scratch = Scratch(spark, "t")
    frames = [scratch.table(docs, "docs")]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(scratch.table(stage(spark, frames[-1], DIR), name))
    all_rows = {tuple(r) for r in frames[0].collect()}
    for before, after in zip(frames[:-2], frames[1:-1]):
        assert after.columns == docs.columns and {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()} <= all_rows
    kept = [[r.score for r in f.collect()] for f in frames[:-1]]
    at = lambda k: f"score{k}"
    assert {at(k) for k in (63, 64, 65)} & set(kept[1]) == set() and at(62) in kept[1]  # null and empty texts go, a null id stays
    copies = [at(3), at(60), at(61)]
    assert all(x in kept[1] for x in copies) and len([x for x in kept[3] if x in copies]) <= 1
    assert len(kept[3]) == len(set(kept[3]))
    texts = {r.score: r.text for r in frames[2].collect()}
    want = _components(list(enumerate(texts.values())))
    assert len(kept[3]) == len({c for _, _, c in want})  # one of each group
    assert frames[-1].agg(F.sum("length")).first()[0] == frames[-1].select("doc_id", "doc_tokens", "start", "length").where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    nothing = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, DIR).count() == 0


def test_pipeline_without_labels(spark, tmp_path):
    """No label and no language anywhere: nothing is rejected for its language, and quality has its base rules."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, str(tmp_path))
    assert kept.count() == docs.where("text rlike '\\\\p{L}'").count()
    assert 0 < stages["quality_rules"](spark, kept, str(tmp_path)).count() < kept.count()
    assert {r.lang_pred for r in QUERIES["op5_language_id"](spark, str(tmp_path)).collect()} == {"und"}


@pytest.mark.parametrize("name", [q for q in QUERIES if q in SQL])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
