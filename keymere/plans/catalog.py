"""Queries over the test tables: one or more for each operator, built from the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import paths, scalars
from ..functions.conditions import And, Is, Not
from ..functions.keys import Indexer, ignore_case, numeric, property_key
from ..operators import index as sets
from ..operators import relations
from ..operators.constraints import CustomConstraint, UniqueConstraint
from ..operators.entity_map import EntityMap
from ..operators.query import EntityQuery
from ..sources import blobs, store
from . import monitor, storage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


class Tables:
    """The tables of a folder. The schema of one is looked up once, as long as the table stays as it is, for that takes a job of its own."""

    _schemas: dict[tuple[str, int, int], StructType] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        path = f"{self._dir}/{name}.parquet"
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        status = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(p)
        key = (status.getPath().toString(), status.getModificationTime(), status.getLen())
        if key not in self._schemas:
            self._schemas[key] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[key]).parquet(path)


def customers(t: Tables) -> EntityMap:
    return EntityMap(t.customer, "c_custkey", indexers={x.name: x for x in (property_key("segment", "c_mktsegment", "string"), ignore_case("segment_ci", "c_mktsegment"), property_key("name", "c_name", "string"), numeric("balance", "c_acctbal"))})


def parts(t: Tables) -> EntityMap:
    return EntityMap(t.part, "p_partkey", indexers={x.name: x for x in (property_key("brand", "p_brand", "string"), numeric("size", "p_size", "int"), ignore_case("name", "p_name"))})


def orders(t: Tables) -> EntityMap:
    year = Indexer("year", lambda df: F.year("o_orderdate"), "int")
    return EntityMap(t.orders, "o_orderkey", indexers={x.name: x for x in (property_key("status", "o_orderstatus", "string"), property_key("priority", "o_orderpriority", "string"), numeric("total", "o_totalprice"), year)})


def ids(q: EntityQuery | DataFrame, id_col: str, *more: str) -> DataFrame:
    df = q.execute() if isinstance(q, EntityQuery) else q
    return df.select(F.col(id_col).alias("entity_id"), *more)


def money(name: str) -> Column:
    return F.col(name).cast("decimal(18,2)")


# -- scans and lookups -------------------------------------------------------
@query
def scan_with_id(spark, sf_dir):
    return ids(customers(Tables(spark, sf_dir)).with_ids(), "c_custkey", "c_name")


@query
def get_by_id(spark, sf_dir):
    return ids(customers(Tables(spark, sf_dir)).get(42), "c_custkey", "c_name", "c_acctbal")


@query
def get_many_by_id(spark, sf_dir):
    return relations.by_ids(Tables(spark, sf_dir).orders, "o_orderkey", [1, 7, 42, 999, 14999, 777777]).select("o_orderkey", "o_custkey", "o_totalprice")


@query
def index_keys(spark, sf_dir):
    return parts(Tables(spark, sf_dir)).index("brand").keys()


@query
def index_lookup(spark, sf_dir):
    return parts(Tables(spark, sf_dir)).index("brand").lookup("Brand#12")


# -- conditions --------------------------------------------------------------
@query
def cond_is(spark, sf_dir):
    return ids(customers(Tables(spark, sf_dir)).query("segment", "BUILDING"), "c_custkey", "c_mktsegment")


@query
def cond_is_not(spark, sf_dir):
    return ids(customers(Tables(spark, sf_dir)).query("segment").is_not("BUILDING"), "c_custkey", "c_mktsegment")


@query
def cond_in(spark, sf_dir):
    return ids(parts(Tables(spark, sf_dir)).query("size").is_in(1, 5, 9, 50), "p_partkey", "p_size")


@query
def cond_not_in(spark, sf_dir):
    return ids(parts(Tables(spark, sf_dir)).query("size").is_not_in(1, 5, 9, 50), "p_partkey", "p_size")


@query
def cond_where_range(spark, sf_dir):
    return ids(orders(Tables(spark, sf_dir)).query("total").where(lambda k: k >= 400000), "o_orderkey", "o_totalprice")


@query
def cond_where_like(spark, sf_dir):
    return ids(customers(Tables(spark, sf_dir)).query("name").where(lambda k: k.contains("0001")), "c_custkey", "c_name")


@query
def cond_and(spark, sf_dir):
    return ids(orders(Tables(spark, sf_dir)).query("status", "F").and_("total").where(lambda k: k >= 250000), "o_orderkey")


@query
def cond_or(spark, sf_dir):
    return ids(orders(Tables(spark, sf_dir)).query("priority", "1-URGENT").or_("priority", "5-LOW"), "o_orderkey")


@query
def cond_fold_left(spark, sf_dir):
    q = orders(Tables(spark, sf_dir)).query("status", "F").and_("priority", "1-URGENT").or_("priority", "5-LOW").and_("total").where(lambda k: k < 100000)
    return ids(q, "o_orderkey")


@query
def cond_not(spark, sf_dir):
    m = orders(Tables(spark, sf_dir))
    return ids(m.query(Not(And(Is(m.indexers["status"], "F"), Is(m.indexers["priority"], "1-URGENT")))), "o_orderkey")


@query
def cond_double_not(spark, sf_dir):
    m = orders(Tables(spark, sf_dir))
    return ids(m.query(~~Is(m.indexers["status"], "P")), "o_orderkey")


@query
def cond_ignore_case(spark, sf_dir):
    return ids(customers(Tables(spark, sf_dir)).query("segment_ci", "buiLDing"), "c_custkey", "c_mktsegment")


@query
def cond_string_to_key(spark, sf_dir):
    return ids(parts(Tables(spark, sf_dir)).query("size", "25"), "p_partkey", "p_size")


@query
def cond_computed_key(spark, sf_dir):
    q = orders(Tables(spark, sf_dir)).query("year", 1997)
    return q.execute().select(F.col("o_orderkey").alias("entity_id"), F.year("o_orderdate").alias("order_year"))


@query
def entity_test_key(spark, sf_dir):
    m = customers(Tables(spark, sf_dir))
    return m.df.select(F.col("c_custkey").alias("entity_id"), sets.same_key(m.df, m.indexers["segment"], "BUILDING").alias("is_match"))


@query
def equal_keys(spark, sf_dir):
    return sets.EntityIndex(Tables(spark, sf_dir).supplier, property_key("nation", "s_nationkey"), "s_suppkey").equal_key_pairs()


# -- paging, counting --------------------------------------------------------
@query
def query_page(spark, sf_dir):
    return ids(orders(Tables(spark, sf_dir)).query("status", "O").skip(30).limit(40), "o_orderkey", "o_totalprice")


@query
def query_first(spark, sf_dir):
    return ids(orders(Tables(spark, sf_dir)).query("status", "O").skip(2).first(), "o_orderkey", "o_totalprice")


@query
def query_count(spark, sf_dir):
    return orders(Tables(spark, sf_dir)).query("status", "O").count_frame()


@query
def query_any(spark, sf_dir):
    return orders(Tables(spark, sf_dir)).query("total").where(lambda k: k > 499000).any_frame()


@query
def map_size(spark, sf_dir):
    return orders(Tables(spark, sf_dir)).size_frame()


# -- id sets and indices -----------------------------------------------------
def _customers_of(q: EntityQuery) -> DataFrame:
    return q.matching().select(F.col("o_custkey").alias("entity_id"))


@query
def id_set_intersect(spark, sf_dir):
    m = orders(Tables(spark, sf_dir))
    return sets.intersect(_customers_of(m.query("status", "F")), _customers_of(m.query("status", "P")))


@query
def id_set_union(spark, sf_dir):
    m = orders(Tables(spark, sf_dir))
    return sets.union(_customers_of(m.query("total").where(lambda k: k > 450000)), _customers_of(m.query("priority", "1-URGENT")))


@query
def id_set_except(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return sets.difference(t.customer.select(F.col("c_custkey").alias("entity_id")), _customers_of(orders(t).query("priority", "1-URGENT")))


@query
def index_stats(spark, sf_dir):
    return parts(Tables(spark, sf_dir)).index("brand").statistics()


@query
def index_totals(spark, sf_dir):
    return parts(Tables(spark, sf_dir)).index("brand").totals()


@query
def inverted_index(spark, sf_dir):
    return sets.EntityIndex(Tables(spark, sf_dir).supplier, property_key("nation", "s_nationkey"), "s_suppkey").summary()


@query
def bitmap_count(spark, sf_dir):
    return customers(Tables(spark, sf_dir)).index("segment").cardinalities()


# -- the benchmark's queries -------------------------------------------------
@query
def bench_filter(spark, sf_dir):
    q = customers(Tables(spark, sf_dir)).query("segment", "BUILDING").and_("balance").is_greater_than(1000)
    return q.execute().select("c_custkey", "c_name", "c_acctbal")


@query
def bench_active_customers(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rich = customers(t).query("balance").is_greater_than(500).execute()
    late = t.orders.where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    return relations.exists(rich, late, {"c_custkey": "o_custkey"}).select("c_custkey", "c_name", "c_acctbal")


@query
def bench_big_orders(spark, sf_dir):
    t = Tables(spark, sf_dir)
    finished = orders(t).query("status", "F").execute()
    # the lines of other orders are dropped before they are summed, and both joins are on the key of the sums
    lines = relations.exists(t.lineitem.select("l_orderkey", "l_extendedprice"), finished, {"l_orderkey": "o_orderkey"})
    big = relations.having(lines, ["l_orderkey"], n=(F.count(F.lit(1)), F.col("n") > 2), total=(F.sum(money("l_extendedprice")), F.col("total") > 200))
    return relations.exists(finished, big, {"o_orderkey": "l_orderkey"}).select("o_orderkey", "o_custkey", "o_totalprice")


@query
def bench_popular_parts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    popular = relations.having(t.lineitem, ["l_partkey"], n=(F.count(F.lit(1)), F.col("n") > 30))
    return relations.exists(parts(t).query("size").is_greater_than(25).execute(), popular, {"p_partkey": "l_partkey"}).select("p_partkey", "p_name", "p_size")


@query
def nav_one_to_many(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = relations.navigate(t.customer.select("c_custkey"), t.orders, {"c_custkey": "o_custkey"}, {"n_orders": F.count(F.lit(1)), "total": F.sum(money("o_totalprice"))})
    return out.withColumn("total", F.col("total").cast("double"))


@query
def nested_filter(spark, sf_dir):
    return relations.conditional(Tables(spark, sf_dir).lineitem, "l_orderkey", n_items=F.count(F.lit(1)), n_expensive=F.count_if(F.col("l_extendedprice") > 50000))


@query
def group_by_key(spark, sf_dir):
    return Tables(spark, sf_dir).orders.groupBy(F.col("o_orderpriority").alias("key")).agg(F.count(F.lit(1)).alias("cnt"))


@query
def sum_expression(spark, sf_dir):
    value = money("l_extendedprice") * F.col("l_quantity").cast("decimal(18,0)")
    return Tables(spark, sf_dir).lineitem.agg(F.sum(value).cast("double").alias("total_value"))


@query
def order_by_top(spark, sf_dir):
    return EntityQuery(Tables(spark, sf_dir).orders, "o_orderkey", {}).order_by(F.col("o_totalprice").desc()).limit(25).execute().select("o_orderkey", "o_totalprice")


# -- constraints and mutations -----------------------------------------------
@query
def unique_violations(spark, sf_dir):
    return UniqueConstraint((property_key("l_orderkey", "l_orderkey"), property_key("l_linenumber", "l_linenumber"))).violations(Tables(spark, sf_dir).lineitem)


@query
def unique_violations_ci(spark, sf_dir):
    return UniqueConstraint((ignore_case("key", "p_name"),)).violations(Tables(spark, sf_dir).part)


@query
def custom_constraint(spark, sf_dir):
    return CustomConstraint("non_negative_balance", F.col("c_acctbal") >= 0).violations(Tables(spark, sf_dir).customer, "c_custkey")


@query
def mut_add_all(spark, sf_dir):
    t = Tables(spark, sf_dir)
    suppliers = EntityMap(t.supplier.select(F.col("s_suppkey").alias("entity_id"), "s_name", F.lit(None).cast("int").alias("n_nationkey")))
    new = t.nation.select(F.col("n_name").alias("s_name"), "n_nationkey")
    return suppliers.add_all(new, [F.col("n_nationkey")]).df.select("entity_id", "s_name")


@query
def mut_remove(spark, sf_dir):
    t = Tables(spark, sf_dir)
    gone = orders(t).query("total").where(lambda k: k > 480000).matching().select("o_custkey")
    return ids(customers(t).remove(gone).df, "c_custkey", "c_name")


@query
def mut_set_replace(spark, sf_dir):
    m = customers(Tables(spark, sf_dir))
    delta = m.df.where(F.col("c_custkey") % 10 == 0).select("c_custkey", F.lit("REPLACED").alias("c_mktsegment"))
    return ids(m.set(delta).df, "c_custkey", "c_mktsegment")


@query
def mut_update(spark, sf_dir):
    m = parts(Tables(spark, sf_dir))
    return ids(m.updated(Is(m.indexers["brand"], "Brand#12"), {"p_size": F.col("p_size") + 100}), "p_partkey", "p_size")


@query
def segment_address(spark, sf_dir):
    return Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("entity_id"), *[c.alias(n) for n, c in scalars.segment_address(F.col("o_orderkey")).items()])


# -- storage -----------------------------------------------------------------
@query
def channel_rollup(spark, sf_dir):
    return storage.file_rollup(Tables(spark, sf_dir).lineitem, F.col("l_orderkey") % 4, F.col("l_suppkey") % 3, F.col("l_quantity").cast("long"))


def _commit():
    return F.col("event_type") == "purchase"


@query
def tx_committed(spark, sf_dir):
    return storage.committed(Tables(spark, sf_dir).events, F.col("user_id"), F.col("event_id"), _commit())


@query
def tx_last_committed(spark, sf_dir):
    return storage.last_committed(Tables(spark, sf_dir).events, F.col("user_id"), _commit())


@query
def recovery_extents(spark, sf_dir):
    return storage.extents(Tables(spark, sf_dir).lineitem, F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_quantity").cast("long"))


@query
def metrics_by_operation(spark, sf_dir):
    out = monitor.by_operation(Tables(spark, sf_dir).events, F.col("event_type"), F.col("value"), F.col("value") < 100)
    return out.withColumn("avg_v", F.round("avg_v", 4))


@query
def metrics_recommend(spark, sf_dir):
    metrics = monitor.by_operation(Tables(spark, sf_dir).events, F.col("event_type"), F.col("value"), F.col("value") < 100)
    return monitor.recommendations(metrics, slow=100, spread=400).select("op", "high_variance", "high_latency")


@query
def recent_events(spark, sf_dir):
    return monitor.recent(Tables(spark, sf_dir).events, "ts", "event_id", 100).select("event_id", "event_type")


@query
def cache_lru_evict(spark, sf_dir):
    return storage.evictions(Tables(spark, sf_dir).events.select("event_id", "user_id", "ts"), [F.col("ts"), F.col("event_id")], F.col("user_id") + 1, 5000).select("event_id", "user_id")


@query
def cache_weight_rule(spark, sf_dir):
    evict = storage.should_evict(F.col("doc_id") * 4096, F.col("n_chars"), F.col("lang") == "en", F.lit(400).cast("long"), F.lit(1000).cast("long"))
    return Tables(spark, sf_dir).documents.select("doc_id", evict.alias("evict"))


@query
def file_retirement(spark, sf_dir):
    return storage.retired_files(Tables(spark, sf_dir).lineitem, F.col("l_partkey"), F.count(F.lit(1)), F.count_if(F.col("l_returnflag") == "N"), F.lit(40), 0.5)


@query
def consolidation_groups(spark, sf_dir):
    return storage.consolidation_groups(Tables(spark, sf_dir).documents.select("doc_id", "n_chars"), "doc_id", F.col("n_chars") < 500)


@query
def blob_offsets(spark, sf_dir):
    out = blobs.with_offsets(Tables(spark, sf_dir).conversations, "conv_id", "turn", F.octet_length("text"))
    return out.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("blob_no"), "start_off")


@query
def blob_range_read(spark, sf_dir):
    out = blobs.range_blobs(Tables(spark, sf_dir).conversations, "conv_id", "turn", F.length("text").cast("long"), 100, 100)
    return out.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("blob_no"))


@query
def blob_next_number(spark, sf_dir):
    return blobs.next_numbers(Tables(spark, sf_dir).conversations, "conv_id", "turn").withColumnRenamed("conv_id", "file_id")


@query
def path_children(spark, sf_dir):
    rest = F.regexp_replace("url", "^[a-z]+://", "")
    return paths.children(Tables(spark, sf_dir).pages.select(rest.alias("path")), "path", "").select(F.col("name").alias("container"))


@query
def path_parts(spark, sf_dir):
    return Tables(spark, sf_dir).pages.select("page_id", paths.container(F.regexp_replace("url", "^[a-z]+://", "")).alias("container"), F.length("url").cast("long").alias("full_len"))


@query
def incremental_backup(spark, sf_dir):
    since = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    return storage.incremental(Tables(spark, sf_dir).events, F.col("ts"), since).select("event_id")


@query
def integrity_checksum(spark, sf_dir):
    return storage.checksums(Tables(spark, sf_dir).documents, "doc_id", "text")


@query
def duplicate_content(spark, sf_dir):
    return storage.duplicate_content(Tables(spark, sf_dir).documents, "text")


@query
def gc_reachable(spark, sf_dir):
    t = Tables(spark, sf_dir)
    # the levels of this graph are known, so each is one semi-join; storage.reachable takes any graph
    regions = t.region.where("r_name = 'ASIA'")
    nations = relations.exists(t.nation, regions, {"n_regionkey": "r_regionkey"})
    owners = relations.exists(t.customer, nations, {"c_nationkey": "n_nationkey"})
    return relations.exists(t.orders, owners, {"o_custkey": "c_custkey"}).select("o_orderkey")


@query
def zigzag_varint_len(spark, sf_dir):
    v = F.col("c_custkey") - 750
    return Tables(spark, sf_dir).customer.select(v.alias("v"), scalars.zigzag(v).alias("zz"))


@query
def type_export_counts(spark, sf_dir):
    return store.export_counts(Tables(spark, sf_dir).documents.where("source <> 'src0'"), "lang", "n_chars")

