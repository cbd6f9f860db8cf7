"""Token shards and packing against the tokenizers library itself."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keymere.llm import packing, scratch, token_ids, tokenize
from keymere.llm.elias_fano import EliasFano
from keymere.llm.queries import QUERIES, vocabulary
from keymere.llm.scratch import Scratch
from keymere.llm.text import text_slices
from keymere.llm.tokenize import encode_slice

TEXTS = ["", None, "Hello, world.\nNext  line", " two  spaces ", "déjà vu… x", "a" * 3000, "one two " * 4000, " odd space\x1c!", "Hello, world.\nNext  line", "\n\n", "日本 語", "a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "no\u00a0break, Ünïcode Ǆ İ"]


def _ids(name, text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return t.encode(text or "", add_special_tokens=False).ids + [end]


def _docs(spark, texts=TEXTS):
    rows = [(i * 3 % 7 if i < 7 else i, t, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, length int"), rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=900))
def test_elias_fano(steps):
    values = np.cumsum(np.array(steps, np.int64))
    code = EliasFano.encode(values, int(values[-1]) if len(values) else 0)
    assert code.all().tolist() == values.tolist()
    for i in range(0, len(values), 7):
        assert code.access(i) == values[i]
    with pytest.raises(IndexError):
        code.select(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 20_000))
    bits = 8 * sum(map(len, EliasFano.encode(values, int(values[-1])).parts())) / len(values)
    assert bits < 2.3 + np.log2(1000) + 0.5


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["Word", " the", "dÉjà", "ŉ", "İ", "ß", "ǆ", "µ", "×", "don't", "'s", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\u00a0", "\u3000", ".", ",", "42", "<|endoftext|>", "<|startoftext|>", "<|", "日本", "e\u0301", "😀", "Ω"]) | st.text(max_size=5), max_size=12).map("".join), max_size=5), st.booleans())
def test_ids_are_those_of_the_library(name, texts, plain):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary(name))
    whole.encode_special_tokens = plain
    for at, part in text_slices(pa.array(texts, pa.string())):
        ids, ends = encode_slice(part, vocabulary(name), plain)
        for i in range(len(part)):
            assert ids[ends[i] : ends[i + 1]].tolist() == whole.encode(texts[at + i], add_special_tokens=False).ids


def test_forgotten_pieces_are_encoded_again(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenize, "CACHE_PIECES", 200)
    cache = tokenize.PieceCache(vocabulary("byte_bpe_50k.json"))
    monkeypatch.setitem(tokenize._CACHES, ("small", False), cache)
    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    for _ in range(60):
        text = " ".join(f"w{'abcdefghij'[k % 10] * (k // 10 + 1)}" for k in rng.integers(0, 150, 80)) + " the the the"
        ids, _ = encode_slice(next(text_slices(pa.array([text])))[1], "small")
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
        assert len(cache.known) <= 200 + 85 and b" the" in cache.known.to_pylist()


def test_large_inputs_are_dealt_out_widely(spark, monkeypatch, tmp_path):
    spark.range(200_000).selectExpr("id", "md5(cast(cast(id as string) as binary)) as text").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert scratch.wide(df) == () and scratch.wide(spark.createDataFrame([(1,)], "a int")) == ()
    monkeypatch.setattr(scratch, "TASK_BYTES", 1 << 20)
    (n,) = scratch.wide(df)
    assert 5 < n < 100 and scratch.wide(df.join(df.withColumnRenamed("text", "t"), "id")) in ((2 * n,), (2 * n + 1,))
    assert df.repartitionByRange(n, "id").rdd.getNumPartitions() == n


def test_copies_of_a_row_are_dealt_out(spark, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    docs = spark.range(4000).selectExpr("cast(5 as long) as doc_id", "'the same text' as text")
    manifest = token_ids.token_corpus(docs, vocabulary("word_bpe_49k.json"), 1, Scratch(spark, "t")).collect()
    assert len(manifest) > 1 and max(x.n_docs for x in manifest) < 3000 and sum(x.n_docs for x in manifest) == 4000
    packed = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 0, Scratch(spark, "t"), 64)
    assert packed.select("sequence_id", "offset").distinct().count() == 4000


def test_token_shards(spark):
    docs, rows = _docs(spark)
    manifest = token_ids.token_corpus(docs, vocabulary("word_bpe_49k.json"), 1, Scratch(spark, "t"))
    got = token_ids.read_token_shards(spark, manifest, with_ids=True).orderBy("start").collect()
    assert [x.doc_id for x in got] == sorted(x[0] for x in rows)
    at = 0
    by = {x[0]: x[1] for x in rows}
    for x in got:
        want = _ids("word_bpe_49k.json", by[x.doc_id], 1)
        assert (x.start, x.n_tokens, x.ids) == (at, len(want), want)
        assert x.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    shard = token_ids.ShardReader(manifest.orderBy("shard").first().path)
    assert shard.document(0).tolist() == got[0].ids


def test_token_shards_null_id_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "b"), (5, None), (-2, "a"), (5, None)], "doc_id long, text string")
    got = token_ids.read_token_shards(spark, token_ids.token_corpus(docs, vocabulary("word_bpe_49k.json"), 1, Scratch(spark, "t"))).orderBy("start").collect()
    assert [x.doc_id for x in got] == [None, -2, 5, 5]
    none = token_ids.read_token_shards(spark, token_ids.token_corpus(docs.limit(0), vocabulary("word_bpe_49k.json"), 1, Scratch(spark, "t")))
    assert none.count() == 0


def test_packing(spark):
    docs, rows = _docs(spark)
    out = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 0, Scratch(spark, "t"), 64, with_ids=True)
    got = out.collect()
    by = {x[0]: _ids("byte_bpe_50k.json", x[1], 0) for x in rows}
    sequences = {}
    for i, ids in by.items():
        own = sorted((x for x in got if x.doc_id == i), key=lambda x: x.start)
        assert [y for x in own for y in np.frombuffer(x.ids, "<u4").tolist()] == ids
        assert all(x.doc_tokens == len(ids) and x.ids_crc32 == zlib.crc32(x.ids) for x in own)
        assert [x.start for x in own] == list(np.cumsum([0] + [x.length for x in own])[:-1])
    for x in got:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert sorted(sequences) == list(range(len(sequences)))
    whole = packing.sequences(out, 64, 0).collect()
    assert len(whole) == len(sequences)
    assert all(len(x.ids) == (x.n_ids if x.n_ids & (x.n_ids - 1) == 0 else 64) for x in whole)
    assert packing.pack_documents(docs.limit(0), vocabulary("byte_bpe_50k.json"), 0, Scratch(spark, "t"), 64).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(0, 50), max_size=40))
def test_patterns_use_each_length_once(histogram):
    patterns = packing.pack_histogram(histogram, 64)
    used = {}
    for count, lengths in patterns:
        assert sum(lengths) <= 64
        for n in lengths:
            used[n] = used.get(n, 0) + count
    assert used == {k: v for k, v in histogram.items() if v}


@pytest.mark.parametrize("name, vocabulary_name, end", [("op1_token_ids", "word_bpe_49k.json", 1), ("op4_packing", "byte_bpe_50k.json", 0)])
def test_queries_against_the_library(spark, name, vocabulary_name, end):
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    whole = Tokenizer.from_file(vocabulary(vocabulary_name))
    want = {r.doc_id: np.array(whole.encode(r.text or "", add_special_tokens=False).ids + [end], "<u4") for r in docs}
    got = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    if name == "op1_token_ids":
        start = 0
        for r in sorted(got, key=lambda r: r.start):
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want[r.doc_id]), zlib.crc32(want[r.doc_id].tobytes()))
            start += r.n_tokens
        assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(want)
        return
    ends, last = {}, {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == last.get(r.doc_id, 0) and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
        last[r.doc_id] = r.start + r.length
    assert last == {i: len(x) for i, x in want.items()}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024 and len(ends) * 1024 < 1.03 * sum(map(len, want.values())) + 1024
