"""Further queries of the catalogue, each with its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, scalars
from ..functions.conditions import Is
from ..functions.keys import ignore_case, property_key
from ..operators import index as sets
from ..operators import prefix, relations
from ..operators.constraints import UniqueConstraint
from ..sources import blobs, store
from . import monitor, storage
from .catalog import QUERIES, Query, Tables, customers, ids, orders, parts
from .catalog_sql import SQL


def query(sql: str):
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__], SQL[f.__name__] = run, sql
        return f

    return add


# -- indices -----------------------------------------------------------------
@query("select p_partkey as entity_id from part where p_brand like 'Brand#3%'")
def index_search(t):
    return parts(t).index("brand").search(lambda k: k.startswith("Brand#3"))


@query("select s_suppkey as entity_id from supplier where s_nationkey is not null")
def index_ids(t):
    return sets.EntityIndex(t.supplier, property_key("nation", "s_nationkey"), "s_suppkey").ids()


@query("select distinct coalesce(cast(p_size as varchar), '') as key from part")
def resolve_keys_as_text(t):
    return parts(t).indexers["size"].resolve(t.part, as_text=True)


@query("select c_mktsegment as key, cast(c_custkey >> 16 as bigint) as segment, cast(count(distinct c_custkey) as integer) as n from customer group by 1, 2")
def inverted_segments(t):
    return customers(t).index("segment").inverted().select("key", "segment", F.size("entity_ids").alias("n"))


@query("select c_custkey as entity_id from customer where c_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def id_set_complement(t):
    m = customers(t)
    return sets.complement(m.index("segment").lookup("BUILDING"), ids(m.df, "c_custkey"))


@query("select count(distinct p_brand) as size from part")
def index_size(t):
    return parts(t).index("brand").size()


# -- objects and types -------------------------------------------------------
@query("select doc_id, lang from documents where lang in ('de', 'fr')")
def load_by_types(t):
    return store.by_types(t.documents, "lang", ["de", "fr"]).select("doc_id", "lang")


@query("select max(o_orderkey) as max_object, max(o_custkey) as max_type, count(*) as n from orders")
def id_analysis(t):
    return storage.id_analysis(t.orders, "o_orderkey", "o_custkey")


@query("select o_orderkey, o_totalprice from orders where o_orderkey in (select o_orderkey from orders where o_custkey < 20 and o_orderkey is not null)")
def load_by_id_frame(t):
    return relations.by_ids(t.orders, "o_orderkey", t.orders.where("o_custkey < 20").select("o_orderkey")).select("o_orderkey", "o_totalprice")


# -- windows -----------------------------------------------------------------
@query("select c_custkey, cast((row_number() over (order by c_custkey) - 1) // 128 as bigint) as grp from customer")
def batch_chunks(t):
    return prefix.groups_of(t.customer.select("c_custkey"), [F.col("c_custkey")], 128)


@query("with recursive p as (select o_orderkey, o_custkey as n, sum(o_custkey) over (order by o_orderkey) as e from orders where o_custkey > 0), f(file_no, s) as (select cast(0 as bigint), cast(0 as hugeint) union all select file_no + 1, min(p.e - p.n) from f join p on p.e - f.s > 200000 and p.e - p.n >= f.s and not (f.file_no > 0 and p.e - p.n = f.s) group by file_no) select o.o_orderkey, (select max(file_no) from f where f.s <= p.e - p.n) as file_no from orders o left join p on o.o_orderkey = p.o_orderkey")
def file_roll_over(t):
    return storage.roll_over(t.orders.select("o_orderkey", "o_custkey"), [F.col("o_orderkey")], F.col("o_custkey"), 200000).select("o_orderkey", "file_no")


@query("select event_id, cast(row_number() over (partition by user_id order by event_id) as integer) as seq from events")
def tx_sequence(t):
    return storage.sequence(t.events.select("event_id", "user_id"), "user_id", "event_id").select("event_id", "seq")


@query("select o_orderkey from orders order by md5('1' || cast(o_orderkey as varchar)), o_orderkey limit 50")
def sample_ids(t):
    return relations.sample_of(t.orders, "o_orderkey", 50, 1).select("o_orderkey")


# -- scalars -----------------------------------------------------------------
@query(r"select c_custkey, regexp_replace('host=h;Password=' || c_name || ';x=1', '(password|pwd)\s*=\s*[^;]*', '\1=***', 'gi') as masked from customer")
def masked_secrets(t):
    return t.customer.select("c_custkey", scalars.mask_secrets(F.concat(F.lit("host=h;Password="), "c_name", F.lit(";x=1"))).alias("masked"))


@query("select s_suppkey, lpad(cast(s_suppkey as varchar), 10, '0') as name from supplier")
def numbered_names(t):
    return t.supplier.select("s_suppkey", scalars.numbered_name(F.col("s_suppkey"), 10).alias("name"))


@query("select p_partkey, case when p_size >= 40 then 'Excellent' when p_size >= 25 then 'Good' when p_size >= 10 then 'Fair' else 'Poor' end as rating from part")
def ratings(t):
    return t.part.select("p_partkey", scalars.rating(F.col("p_size"), 40, 25, 10).alias("rating"))


@query("select c_custkey, concat_ws(' ', c_name, c_mktsegment) as full_name, case when c_custkey % 3 = 0 then 0.0 else c_acctbal / (c_custkey % 3) end as mean_value from customer")
def computed_fields(t):
    mean = scalars.guarded_ratio(F.col("c_acctbal"), F.col("c_custkey") % 3)
    return t.customer.select("c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment").alias("full_name"), mean.alias("mean_value"))


@query("select o_orderkey, cast(2003 - year(o_orderdate) as integer) as age from orders")
def ages(t):
    return t.orders.select("o_orderkey", scalars.age_in_years(F.col("o_orderdate"), F.lit("2003-05-01").cast("date")).alias("age"))


@query("select event_id, cast(floor((event_id * 1001) / 100.0) as bigint) as ticks, cast(least(greatest(user_id, 10), 100) as bigint) as clamped from events")
def unit_conversions(t):
    return t.events.select("event_id", scalars.nanos_to_ticks(F.col("event_id") * 1001).alias("ticks"), scalars.clamp(F.col("user_id"), F.lit(10).cast("long"), F.lit(100).cast("long")).alias("clamped"))


@query("select c_custkey, c_name from customer")
def json_round_trip(t):
    row = F.from_json(F.to_json(F.struct("c_custkey", "c_name")), "c_custkey long, c_name string")
    return t.customer.select(row.alias("r")).select("r.*")


@query("select l_orderkey, bool_or(l_quantity > 45) as any_large, bool_and(l_quantity > 5) as all_over_5 from lineitem group by 1")
def nested_any_all(t):
    return relations.conditional(t.lineitem, "l_orderkey", any_large=F.bool_or(F.col("l_quantity") > 45), all_over_5=F.bool_and(F.col("l_quantity") > 5))


# -- constraints and versions ------------------------------------------------
@query("select lower(n_name) as name from nation where n_nationkey < 5 union select lower(n_name) from nation where n_nationkey between 8 and 9")
def unique_conflicts(t):
    name = ignore_case("name", "n_name")
    delta = t.nation.select(F.lower("n_name").alias("n_name")).where("n_nationkey < 5 or n_nationkey between 8 and 9")
    return UniqueConstraint((name,)).conflicts(delta, t.nation)


@query("select change, count(*) as n from (select case when p_partkey % 7 = 0 then 'delete' else 'update' end as change from part where p_partkey % 7 = 0 or p_brand = 'Brand#12') group by 1")
def version_changes(t):
    m = parts(t)
    later = m.update(Is(m.indexers["brand"], "Brand#12"), {"p_size": F.col("p_size") + 1}).remove(t.part.where("p_partkey % 7 = 0").select("p_partkey"))
    return later.changes_from(m).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


# -- blobs and paths ---------------------------------------------------------
@query("select conv_id as file_id, cast(sum(octet_length(encode(text))) as bigint) as size from conversations group by 1")
def blob_file_sizes(t):
    return blobs.file_sizes(t.conversations, "conv_id", F.octet_length("text")).withColumnRenamed("conv_id", "file_id")


@query("select item_id, cast(k as bigint) as blob_no, cast(least(64, octet_length(encode(text)) - 64 * k) as integer) as size from benchmark, range(0, 100) r(k) where 64 * k < octet_length(encode(text))")
def blob_chunks(t):
    rows = t.benchmark.select("item_id", F.col("text").cast("binary").alias("data"))
    return blobs.chunk(rows, "data", 64).select("item_id", "blob_no", F.octet_length("data").alias("size"))


@query("select file_id, blob_no, cast(least(n, 300 - start) as integer) as size from (select conv_id as file_id, turn as blob_no, octet_length(encode(text)) as n, sum(octet_length(encode(text))) over (partition by conv_id order by turn) - octet_length(encode(text)) as start from conversations) where start < 300")
def blob_truncate(t):
    rows = t.conversations.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("blob_no"), F.col("text").cast("binary").alias("data"))
    return blobs.truncate(rows, "file_id", "blob_no", "data", 300).select("file_id", "blob_no", F.octet_length("data").alias("size"))


@query("with b as (select conv_id as file_id, encode(string_agg(text, '' order by turn)) as data from conversations group by 1) select file_id, sha256(data[51:150]) as checksum from b where octet_length(data) > 50")
def blob_range_content(t):
    rows = t.conversations.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("blob_no"), F.col("text").cast("binary").alias("data"))
    return blobs.read_range(rows, "file_id", "blob_no", "data", 50, 100).select("file_id", F.sha2("data", 256).alias("checksum"))


@query("select page_id, split_part(url, '/', -1) as name, regexp_extract(split_part(url, '/', -1), '\\.([^.]*)$', 1) as type from pages where split_part(url, '/', -1) <> ''")
def file_names(t):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return t.pages.where(~F.col("url").endswith("/")).select("page_id", paths.identifier(path).alias("name"), paths.file_type(paths.identifier(path)).alias("type"))


@query("select page_id, regexp_matches(host, '^[a-z0-9][a-z0-9.-]*[a-z0-9]$') and length(host) between 3 and 63 and not contains(host, '..') and not contains(host, '.-') and not contains(host, '-.') as valid from (select page_id, split_part(url, '/', 3) as host from pages)")
def valid_containers(t):
    return t.pages.select("page_id", paths.valid_container(paths.container(F.regexp_replace("url", "^[a-z]+://", "")), "s3").alias("valid"))


@query("with b as (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn) as e, length(text) as n from conversations), r as (select item_id, item_id * 37 as s, item_id * 37 + length(text) as e from benchmark) select conv_id, turn, item_id from b, r where n > 0 and b.e - n <= r.e and r.s <= b.e - 1")
def interval_join(t):
    placed = blobs.with_offsets(t.conversations, "conv_id", "turn", F.length("text"), "start").where(F.length("text") > 0)
    a = placed.select("conv_id", "turn", "start", (F.col("start") + F.length("text") - 1).alias("end"))
    b = t.benchmark.select("item_id", (F.col("item_id") * 37).alias("start"), (F.col("item_id") * 37 + F.length("text")).alias("end"))
    return relations.range_join(a, b, 256).select("conv_id", "turn", "item_id")


# -- logs, recovery, collection ----------------------------------------------
@query("with bad as (select coalesce(min(event_id), 1 << 62) as b from events where event_type = 'error' and event_id > 500) select event_id from events, bad where event_id < b and user_id in (select user_id from events where event_id < b and event_type = 'purchase')")
def log_replay(t):
    log = t.events.withColumn("valid", ~((F.col("event_type") == "error") & (F.col("event_id") > 500)))
    return storage.replay(log, "user_id", "event_id", F.col("event_type") == "purchase").select("event_id")


@query("with e as (select l_suppkey as file_no, max(l_orderkey) as expected_size from lineitem group by 1), a as (select s_suppkey as file_no, s_suppkey * 150 as size from supplier where s_suppkey % 5 <> 0) select e.file_no, case when size is null then 'missing' when size < expected_size then 'short' else 'ok' end as state from e left join a on e.file_no = a.file_no")
def recovery_states(t):
    expected = storage.extents(t.lineitem, F.col("l_suppkey"), F.col("l_orderkey"), F.lit(0))
    actual = t.supplier.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("file_no"), (F.col("s_suppkey") * 150).alias("size"))
    return storage.recovery(expected, actual).select("file_no", "state")


@query("with c as (select doc_id, sha256(text) as h from documents where doc_id % 11 <> 0), s as (select doc_id, case when doc_id % 5 = 0 then 'x' else sha256(text) end as h from documents where doc_id % 7 <> 0) select coalesce(c.doc_id, s.doc_id) as doc_id, case when c.h is null then 'missing' when s.h is null then 'new' when c.h = s.h then 'ok' else 'changed' end as state from c full join s on c.doc_id = s.doc_id")
def integrity_states(t):
    all_ = storage.checksums(t.documents, "doc_id", "text")
    stored = all_.where("doc_id % 7 <> 0").withColumn("checksum", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("checksum")))
    return storage.integrity(all_.where("doc_id % 11 <> 0"), stored, "doc_id")


_GRAPH = "select n_regionkey as src, 100 + n_nationkey as dst from nation union all select 100 + c_nationkey, 1000 + c_custkey from customer union all select 1000 + o_custkey, 100000000 + o_orderkey from orders"


def _graph(t) -> DataFrame:
    kind = lambda c: c.cast("long")
    a = t.nation.select(kind(F.col("n_regionkey")).alias("src"), kind(F.col("n_nationkey") + 100).alias("dst"))
    b = t.customer.select(kind(F.col("c_nationkey") + 100).alias("src"), (F.col("c_custkey") + 1000).alias("dst"))
    c = t.orders.select((F.col("o_custkey") + 1000).alias("src"), (F.col("o_orderkey") + 100000000).alias("dst"))
    return a.unionByName(b).unionByName(c)


def _asia(t) -> DataFrame:
    return t.region.where("r_name = 'ASIA'").select(F.col("r_regionkey").cast("long").alias("id"))


@query(f"with recursive e as ({_GRAPH}), live(id) as (select cast(r_regionkey as bigint) from region where r_name = 'ASIA' union select dst from e join live on src = id) select id from live")
def gc_mark(t):
    return storage.reachable(_asia(t), _graph(t))


@query(f"with recursive e as ({_GRAPH}), live(id) as (select cast(r_regionkey as bigint) from region where r_name = 'ASIA' union select dst from e join live on src = id) select dst as id from e where dst not in (select id from live)")
def gc_sweep(t):
    edges = _graph(t)
    return storage.sweep(edges.select(F.col("dst").alias("id")), storage.reachable(_asia(t), edges), "id")


# -- metrics -----------------------------------------------------------------
@query("select count(*) as files, cast(sum(l_quantity) as bigint) as total, cast(sum(l_quantity) filter (where l_returnflag = 'N') as bigint) as live, cast(sum(l_quantity) filter (where l_returnflag = 'N') as bigint) / cast(sum(l_quantity) as bigint) as usage from lineitem")
def storage_usage(t):
    files = t.lineitem.select(F.col("l_quantity").cast("long").alias("total"), F.when(F.col("l_returnflag") == "N", F.col("l_quantity").cast("long")).alias("live"))
    return storage.usage(files, "total", "live")


@query("select cast(count(*) as bigint) as total, cast(count(*) filter (where value >= 100) as bigint) as failed, cast(count(distinct event_type) as bigint) as operations, count(*) filter (where value >= 100) / count(*) as error_rate, count(*) / 60.0 as per_second from events")
def metrics_totals(t):
    by = monitor.by_operation(t.events, F.col("event_type"), F.col("value"), F.col("value") < 100)
    return monitor.totals(by, 60.0)


@query("select count(*) as allocations, cast(count(*) filter (where event_type = 'error') as bigint) as evictions, cast(sum(user_id) as bigint) as used, 1 - cast(count(*) filter (where event_type = 'error') as double) / count(*) as hit_ratio, cast(sum(user_id) as double) / count(*) as avg_entry, 100 * (cast(sum(user_id) as double) / 1000000) as utilisation, 100 * (cast(sum(user_id) as double) / 1000000) > 90 as pressure from events")
def memory_statistics(t):
    stats = t.events.agg(F.count(F.lit(1)).alias("allocations"), F.count_if(F.col("event_type") == "error").alias("evictions"), F.sum("user_id").alias("used"), F.lit(1000000).alias("capacity"), F.count(F.lit(1)).alias("entries"))
    return monitor.memory(stats).select("allocations", "evictions", "used", "hit_ratio", "avg_entry", "utilisation", "pressure")


@query("select cast(sum(l_quantity) as bigint) as l_quantity, cast(sum(l_suppkey) as bigint) as l_suppkey from lineitem")
def cache_summary(t):
    return monitor.cache_summary(t.lineitem.select(F.col("l_quantity").cast("long"), "l_suppkey"), ["l_quantity", "l_suppkey"])
