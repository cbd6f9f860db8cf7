"""The type dictionary and the settings of the stores."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keymere.functions import binary
from keymere.functions.types import BUILT_IN, FIRST_OWN, Handler, Handlers, TypeConflict, TypeDictionary
from keymere.sources import blobs

PERSON = T.StructType([T.StructField("name", T.StringType()), T.StructField("age", T.IntegerType())])


def test_dictionary(spark):
    d = TypeDictionary()
    assert d.register("Person", PERSON) == FIRST_OWN and d.register("Person", PERSON) == FIRST_OWN
    assert d.register("Other", T.StructType(), 2000) == 2000 and d.register("Next", PERSON) == 2001
    for name, schema, number in (("Person", T.StructType(), None), ("string", PERSON, None), ("X", PERSON, 2000), ("X", PERSON, 3)):
        with pytest.raises(TypeConflict):
            d.register(name, schema, number)
    assert d.name_of(2) == "string" and d.id_of("Person") == FIRST_OWN and d.id_of("?") is None and d.name_of(77) is None
    again = TypeDictionary.from_frame(d.frame(spark))
    assert again.own == d.own and again.schema_of("Person") == PERSON


def test_built_in_types_exist(spark):
    for kind in {k for _, k in BUILT_IN.values()}:
        assert spark.sql(f"select cast(null as {kind}) as x").count() == 1
    assert len({i for i, _ in BUILT_IN.values()}) == len(BUILT_IN)


def test_options_and_existence(spark):
    assert blobs.hadoop_options("s3", access_key="a", path_style=True, region=None) == {"fs.s3a.access.key": "a", "fs.s3a.path.style.access": "true"}
    assert blobs.hadoop_options("azure", "acc", account_key="k") == {"fs.azure.account.key.acc.dfs.core.windows.net": "k"}
    with pytest.raises(ValueError):
        blobs.hadoop_options("s3", nothing=1)
    files = spark.createDataFrame([("a/b",), ("a/c/d",)], "path string")
    look = lambda p: tuple(blobs.exists(files, "path", p).first())
    assert look("a/b") == (True, False, True) and look("a/") == (False, True, False) and look("z") == (False, False, True)


def test_values_as_bytes(spark):
    schema = "a tinyint, b smallint, c int, d long, e float, f double, g boolean, h string, i binary, j decimal(20,3), k date, l timestamp, m timestamp_ntz, n array<long>, o struct<x:int,y:string>"
    from datetime import date, datetime
    from decimal import Decimal

    row = (-1, 300, -70000, 2**60, 1.5, -2.25, True, "ä€", bytearray(b"\0x"), Decimal("-12345.678"), date(1969, 7, 20), datetime(2024, 2, 29, 1, 2, 3, 456), datetime(1960, 1, 1), [1, None, 3], (7, None))
    df = spark.createDataFrame([row, (None,) * 15, (0, 0, 0, 0, 0.0, 0.0, False, "", bytearray(), Decimal(0), date(1970, 1, 1), datetime(1970, 1, 1), datetime(1970, 1, 1), [], (None, ""))], schema)
    stored = binary.serialised(df)
    assert stored.columns == ["data"] and stored.where("octet_length(data) = 15").count() == 1
    assert sorted(map(repr, binary.deserialised(stored, df.schema).collect())) == sorted(map(repr, df.collect()))
    values = [0, 1, -1, 63, 64, -64, -65, 2**40, -(2**63), 2**63 - 1]
    found = spark.createDataFrame([(v,) for v in values], "v long").select("v", binary.varint(F.col("v")).alias("d")).withColumn("back", binary.from_varint(F.col("d"))).collect()

    def plain(v):
        z, out = ((v << 1) ^ (v >> 63)) & (2**64 - 1), []
        while True:
            out.append(z & 127 | (128 if z > 127 else 0))
            z >>= 7
            if not z:
                return bytes(out)

    assert all(r.v == r.back and bytes(r.d) == plain(r.v) for r in found)


def test_handlers(spark):
    handlers = Handlers()
    handlers.add(Handler("upper", F.upper, F.lower))
    df = spark.createDataFrame([("ab",)], "v string")
    assert handlers.to_stored(df, {"v": "upper"}).first().v == "AB" and handlers.from_stored(handlers.to_stored(df, {"v": "upper"}), {"v": "upper"}).first().v == "ab"
    for wrong in (lambda: handlers.add(Handler("upper", F.upper, F.lower)), lambda: handlers.to_stored(df, {"v": "none"})):
        with pytest.raises(TypeConflict):
            wrong()
