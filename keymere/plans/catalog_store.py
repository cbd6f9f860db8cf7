"""Queries of mutations, persistence, logs and monitoring, each with its SQL beside it.

What they store lies in a folder of its own in the shared one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import binary, paths, scalars, types
from ..functions.conditions import And, Is, Or, Where
from ..functions.keys import Indexer, date_time, guid, identity, ignore_case, numeric, property_key
from ..operators import relations
from ..operators.constraints import CustomConstraint, UniqueConstraint, changed_rows
from ..operators.entity_map import builder
from ..sources import blobs
from ..sources import store as stores
from ..sources.shared import own_folder
from ..sources.store import Engine
from . import housekeeping, monitor, storage, translog
from .catalog import customers, ids, orders, parts
from .catalog_more import query


def engine(t, **options) -> Engine:
    return Engine.start(t.spark, own_folder(t.spark, "store"), **options)


def suppliers(t, **more):
    return builder(t.supplier, "s_suppkey", property_key("name", "s_name", "string"), numeric("balance", "s_acctbal"), **more)


# -- scans and keys ----------------------------------------------------------
@query("select c_custkey as entity_id, c_name from customer order by c_custkey limit 20 offset 10")
def rendered_page(t):
    return ids(customers(t).page(20, 10), "c_custkey", "c_name")


@query("select o_orderkey as entity_id from orders where o_orderkey = 77")
def key_identity(t):
    m = builder(t.orders, "o_orderkey", identity=(identity("o_orderkey"),))
    return ids(m.query("identity", 77), "o_orderkey")


@query("select o_orderkey as entity_id from orders where o_orderdate >= timestamp '2000-01-01' and o_orderdate < timestamp '2000-02-01'")
def key_datetime(t):
    m = builder(t.orders, "o_orderkey", date_time("day", "o_orderdate"))
    stamp = lambda x: F.lit(x).cast("timestamp_ntz")
    return ids(m.query("day").where(lambda k: (k >= stamp("2000-01-01")) & (k < stamp("2000-02-01"))), "o_orderkey")


@query("select page_id as entity_id from pages where md5(url) = (select md5(url) from pages where page_id = 3)")
def key_guid(t):
    m = builder(t.pages, "page_id", guid("hash", F.md5(F.col("url").cast("binary"))))
    wanted = t.pages.where("page_id = 3").select(F.upper(F.md5(F.col("url").cast("binary")))).first()[0]
    return ids(m.query("hash", wanted), "page_id")


@query("select c_custkey as entity_id from customer where lower(c_mktsegment) in ('building', 'machinery')")
def key_own_comparer(t):
    m = builder(t.customer, "c_custkey", Indexer("segment", "c_mktsegment", "string", lambda k: F.lower(F.trim(k))))
    return ids(m.query("segment").is_in(" Building ", "MACHINERY"), "c_custkey")


# -- conditions --------------------------------------------------------------
@query("select o_orderkey as entity_id from orders where o_orderstatus = 'F' and year(o_orderdate) = 1997")
def cond_and_typed(t):
    return ids(orders(t).query("status", "F").and_("year", key_type="int").is_(1997), "o_orderkey")


@query("select o_orderkey as entity_id from orders where o_orderstatus = 'P' or o_orderpriority = '5-LOW' or o_totalprice > 490000")
def cond_or_queries(t):
    m = orders(t)
    return ids(m.query("status", "P").or_(m.query("priority", "5-LOW"), m.query("total").is_greater_than(490000)), "o_orderkey")


@query("select o_orderkey as entity_id from orders where o_orderstatus = 'F' and o_totalprice > o_custkey * 100")
def cond_row_predicate(t):
    return ids(orders(t).query("status", "F").where(F.col("o_totalprice") > F.col("o_custkey") * 100), "o_orderkey")


@query("select p_partkey as entity_id from part where (p_size = 3 and p_brand = 'Brand#12') or p_size > 45")
def cond_index_objects(t):
    m = parts(t)
    brand, size = m.indexers["brand"], m.indexers["size"]
    return ids(m.query(Or(And(Is(size, 3), Is(brand, "Brand#12")), Where(size, lambda k: k > 45))), "p_partkey")


@query("select c_custkey, c_name, c_acctbal from customer where c_acctbal > 500 and exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= (select max(o_orderdate) from orders) - interval 30 day)")
def recent_customers(t):
    last = t.orders.agg(F.max("o_orderdate").alias("d"))
    late = t.orders.where(F.col("o_orderdate") >= last.scalar() - F.expr("interval 30 days"))
    return relations.exists(customers(t).query("balance").is_greater_than(500).execute(), late, {"c_custkey": "o_custkey"}).select("c_custkey", "c_name", "c_acctbal")


# -- dictionaries and arrays -------------------------------------------------
@query("select o_orderkey, case o_orderstatus when 'F' then 'done' when 'O' then 'open' end as state, o_orderstatus in ('F', 'O') as known from orders")
def map_lookup(t):
    names = F.create_map(F.lit("F"), F.lit("done"), F.lit("O"), F.lit("open"))
    return t.orders.select("o_orderkey", F.try_element_at(names, "o_orderstatus").alias("state"), F.map_contains_key(names, F.col("o_orderstatus")).alias("known"))


@query("select user_id, max(value) filter (where event_type = 'click') as click, bool_or(event_type = 'purchase') as bought from (select user_id, event_type, max(value) as value from events group by 1, 2) group by 1")
def map_of_group(t):
    by = t.events.groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    made = by.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "value"))).alias("m"))
    return made.select("user_id", relations.map_value(F.col("m"), "click").alias("click"), relations.map_contains(F.col("m"), "purchase").alias("bought"))


@query("select l_orderkey, count(*) as n_items, cast(count(*) filter (where l_extendedprice > 50000) as bigint) as n_expensive, bool_or(l_quantity > 45) as any_large from lineitem group by 1")
def conditional_children(t):
    return relations.conditional(t.lineitem, "l_orderkey", n_items=F.count(F.lit(1)), n_expensive=F.count_if(F.col("l_extendedprice") > 50000), any_large=F.bool_or(F.col("l_quantity") > 45))


# -- mutations ---------------------------------------------------------------
@query("select s_suppkey as entity_id, s_name, s_acctbal from supplier union all select max(s_suppkey) + 1, 'new one', 12.5 from supplier")
def mut_add(t):
    return ids(suppliers(t).add(s_name="new one", s_acctbal=12.5).df, "s_suppkey", "s_name", "s_acctbal")


@query("with s as (select max(s_suppkey) + 1 as top from supplier) select s_suppkey as entity_id, s_name from supplier union all select top + row_number() over (order by n_name desc) - 1, n_name from nation, s union all select top + (select count(*) from nation), 'last' from s")
def mut_add_more(t):
    from ..operators.prefix import Descending

    m = suppliers(t).add_all(t.nation.select(F.col("n_name").alias("s_name")), [Descending(F.col("s_name"))]).add(s_name="last")
    return ids(m.df, "s_suppkey", "s_name")


@query("select c_custkey as entity_id, case when c_custkey % 10 = 0 then 'REPLACED' else c_mktsegment end as c_mktsegment, c_name from customer")
def mut_set(t):
    delta = t.customer.where("c_custkey % 10 = 0").select("c_custkey", F.lit("REPLACED").alias("c_mktsegment"))
    return ids(customers(t).set(delta).df, "c_custkey", "c_mktsegment", "c_name")


@query("select s_suppkey as entity_id, case when s_suppkey = 4 then 'other' else s_name end as s_name, case when s_suppkey = 4 then null else s_nationkey end as s_nationkey from supplier")
def mut_replace(t):
    m = suppliers(t, equality=("s_name",))
    name = t.supplier.where("s_suppkey = 4").first()["s_name"]
    return ids(m.replace({"s_name": name}, {"s_name": "other"}).df, "s_suppkey", "s_name", "s_nationkey")


@query("select s_suppkey as entity_id, s_name from supplier where s_suppkey <> 6")
def mut_remove_entity(t):
    m = suppliers(t, equality=("s_name",))
    left, _ = m.remove_entity(s_name=t.supplier.where("s_suppkey = 6").first()["s_name"])
    return ids(left.df, "s_suppkey", "s_name")


@query("select p_partkey as entity_id, p_size + 100 as result from part where p_brand = 'Brand#12'")
def mut_apply(t):
    m = parts(t)
    _, result = m.apply(Is(m.indexers["brand"], "Brand#12"), {"p_size": F.col("p_size") + 100}, F.col("p_size"))
    return ids(result, "p_partkey", "result")


@query("select p_partkey as entity_id, p_name from part where p_partkey <> (select min(p_partkey) from part where p_brand = 'Brand#12')")
def mut_remove_first(t):
    m = parts(t)
    return ids(m.remove_first(Is(m.indexers["brand"], "Brand#12")).df, "p_partkey", "p_name")


@query("select cast(0 as bigint) as entity_id, 'first' as s_name")
def mut_remove_all(t):
    m = suppliers(t).remove_all().add(s_name="first")
    return ids(m.df, "s_suppkey", "s_name")


@query("select 'never_poorer' as constraint_name, c_custkey as entity_id from customer where c_custkey % 3 = 0 and c_acctbal > 0")
def constraint_on_change(t):
    rule = CustomConstraint("never_poorer", "old is null or new.c_acctbal >= old.c_acctbal", on_change=True)
    later = t.customer.withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 == 0, -F.abs("c_acctbal")).otherwise(F.col("c_acctbal") + 1))
    return rule.change_violations(t.customer, later, "c_custkey")


@query("select c_custkey, c_acctbal as old_balance, cast(0 as double) as new_balance from customer where c_custkey % 5 = 0 and c_acctbal <> 0")
def change_pairs(t):
    later = t.customer.withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.lit(0.0)).otherwise(F.col("c_acctbal")))
    return changed_rows(t.customer, later, "c_custkey").select("c_custkey", F.col("old.c_acctbal").alias("old_balance"), F.col("new.c_acctbal").alias("new_balance"))


@query("select 'name' as constraint_name, 'lower' as case_rule, count(*) as n from (select 1 from part group by lower(p_name) having count(*) > 1)")
def several_unique(t):
    rules = [UniqueConstraint((ignore_case("name", "p_name"),)), UniqueConstraint((property_key("id", "p_partkey"),))]
    found = [x.violations(t.part).agg(F.count(F.lit(1)).alias("n")).select(F.lit(x.name).alias("constraint_name"), F.lit("lower").alias("case_rule"), "n") for x in rules]
    return found[0].unionByName(found[1].where("n > 0"))


# -- roots and maps ----------------------------------------------------------
@query("select c_custkey, c_name, c_mktsegment from customer union all select c_custkey, c_name, c_mktsegment from customer where c_custkey < 10")
def store_and_append(t):
    e, rows = engine(t), t.customer.select("c_custkey", "c_name", "c_mktsegment")
    e.store("customer", rows)
    e.append("customer", rows.where("c_custkey < 10"))
    return e.root("customer")


@query("select n_nationkey, n_name, n_regionkey from nation")
def store_compacted(t):
    e = engine(t)
    for k in range(3):
        e.append("nation", t.nation.where(F.col("n_nationkey") % 3 == k))
    e.compact("nation")
    return e.root("nation")


@query("select c_custkey, c_name, c_mktsegment from customer where c_custkey < 40 union all select c_custkey + 100000, c_name, c_mktsegment from customer where c_custkey < 2")
def unit_of_work(t):
    e, rows = engine(t), t.customer.select("c_custkey", "c_name", "c_mktsegment")
    work = e.unit_of_work("customer")
    work.store_all(rows.where("c_custkey < 20"), rows.where("c_custkey between 20 and 29"))
    work.ensure(rows.where("c_custkey < 40"), "c_custkey")
    work.store(rows.where("c_custkey < 2").withColumn("c_custkey", F.col("c_custkey") + 100000))
    work.commit()
    return e.root("customer")


@query("select s_suppkey as entity_id, s_name from supplier where s_acctbal > 0 union all select max(s_suppkey) + 1, 'after reload' from supplier")
def map_reload(t):
    e = engine(t)
    e.register("suppliers", suppliers(t, unique=(ignore_case("unique_name", "s_name"),), custom=(CustomConstraint("named", "s_name is not null"),)))
    e.store_map("suppliers")
    m = Engine.start(t.spark, e.config.directory).load_map("suppliers").add(s_name="after reload", s_acctbal=1.0)
    return ids(m.query("balance").is_greater_than(0).execute(), "s_suppkey", "s_name")


@query("select s_suppkey as s_suppkey, s_name from supplier where s_suppkey between 5 and 20")
def map_segments(t):
    e = engine(t)
    m = suppliers(t)
    m.per_segment = 3
    e.register("suppliers", m)
    e.store_map("suppliers")
    return e.load_segments("suppliers", 5, 20).select("s_suppkey", "s_name")


@query("select 'nation' as root, count(*) as n from nation union all select 'region', count(*) from region")
def load_roots(t):
    e = engine(t)
    e.store("nation", t.nation)
    e.store("region", t.region)
    found = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("root"), "n") for name, df in e.load_roots().items()]
    return found[0].unionByName(found[1])


@query("select n_nationkey, n_name from nation")
def export_import(t):
    e = engine(t)
    e.store("nation", t.nation.select("n_nationkey", "n_name"))
    folder = own_folder(t.spark, "export")
    e.export("nation", folder, "n_nationkey")
    e.import_files("copy", folder)
    return e.root("copy")


@query("select c_custkey, c_name from customer")
def store_by_channel(t):
    e = engine(t, channels=3)
    e.store_by_channel("customer", t.customer.select("c_custkey", "c_name"), "c_custkey")
    return e.channels("customer").drop("channel")


@query("select n_name as name, 'nation' as kind, cast(null as bigint) as size from nation union all select url, null, cast(length(html) as bigint) from pages")
def backends_concat(t):
    return stores.concat(t.nation.select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")), t.pages.select(F.col("url").alias("name"), F.length("html").cast("long").alias("size"))).select("name", "kind", "size")


@query("select c_custkey as src, 100000 + o_orderkey as dst from customer join orders on o_custkey = c_custkey")
def adjacency_lists(t):
    held = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.col("o_orderkey") + 100000).alias("refs"))
    return storage.adjacency(t.customer.join(held, "c_custkey", "left"), "c_custkey", "refs")


# -- files -------------------------------------------------------------------
_SIZED = "p as (select o_orderkey, n, sum(n) over (order by o_orderkey) as e from (select o_orderkey, case when o_orderkey % 11 = 0 then 0 when o_orderkey % 97 = 1 then 30000 else o_custkey % 50 + 1 end as n from orders) where n > 0)"


@query(f"with recursive {_SIZED}, f(file_no, s) as (select cast(0 as bigint), cast(0 as hugeint) union all select file_no + 1, min(p.e - p.n) from f join p on p.e - f.s > 20000 and p.e - p.n >= f.s and not (f.file_no > 0 and p.e - p.n = f.s) group by file_no) select o.o_orderkey, (select max(file_no) from f where f.s <= p.e - p.n) as file_no from orders o left join p on o.o_orderkey = p.o_orderkey")
def file_roll_over_greedy(t):
    key = F.col("o_orderkey")
    size = F.when(key % 11 == 0, 0).when(key % 97 == 1, 30000).otherwise(F.col("o_custkey") % 50 + 1)
    return storage.roll_over(t.orders.select("o_orderkey", "o_custkey"), [key], size, 20000).select("o_orderkey", "file_no")


@query("select conv_id, turn, cast(sum(octet_length(encode(text))) over (partition by conv_id order by turn) - octet_length(encode(text)) as bigint) as start_off from conversations")
def blob_offsets_dealt(t):
    rows = t.conversations.select("conv_id", "turn", F.octet_length("text").alias("n"))
    return blobs.with_offsets(rows, "conv_id", "turn", F.col("n"), large=True).select("conv_id", "turn", "start_off")


@query("with b as (select conv_id, encode(string_agg(text, '' order by turn)) as data from conversations group by 1), r as (select sha256(data[11:210]) as h, octet_length(data[11:210]) as n from b where conv_id = 1) select cast(5 as bigint) as conv_id, sha256(encode(string_agg(text, '' order by turn)) || (select data[11:210] from b where conv_id = 1)) as checksum from conversations where conv_id = 5")
def blob_copy_range(t):
    rows = t.conversations.select("conv_id", "turn", F.col("text").cast("binary").alias("data"))
    after = blobs.copy_range(rows, "conv_id", "turn", "data", 1, 10, 200, 5)
    return blobs.read_range(after.where("conv_id = 5"), "conv_id", "turn", "data", 0, -1).select("conv_id", F.sha2("data", 256).alias("checksum"))


@query("select page_id, length(url) <= 1024 and not regexp_matches(k, '[<>:\"|?*]') and not regexp_matches(k, '[. ]$') as azure, k <> '' and k not in ('.', '..') as oci from (select page_id, url, regexp_replace(url, '^[a-z]+://[^/]*/?', '') as k from pages)")
def valid_keys(t):
    key = F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")
    return t.pages.select("page_id", paths.valid_key(key, "azure").alias("azure"), paths.valid_key(key, "oci").alias("oci"))


@query("select page_id, right(regexp_replace(regexp_replace(url, '/', '_', 'g'), '[^a-zA-Z0-9._-]', '_', 'g'), 249) as topic from pages")
def topic_names(t):
    return t.pages.select("page_id", paths.topic_name(F.col("url")).alias("topic"))


@query("select doc_id, cast(length(text) > 0 as boolean) as is_file, text is null or text = '' as is_empty from documents")
def blob_exists(t):
    return t.documents.select("doc_id", (F.length("text") > 0).alias("is_file"), F.coalesce(F.col("text") == "", F.lit(True)).alias("is_empty"))


# -- scalars -----------------------------------------------------------------
@query("select v, cast(greatest(1, ceil(length(ltrim(bin(z), '0')) / 7.0)) as integer) as n from (select c_custkey - 750 as v, cast(case when c_custkey >= 750 then 2 * (c_custkey - 750) else -2 * (c_custkey - 750) - 1 end as bigint) as z from customer)")
def varint_lengths(t):
    v = F.col("c_custkey") - 750
    return t.customer.select(v.alias("v"), scalars.varint_length(v).alias("n"))


@query("select s_suppkey, list_reduce([0] || list_transform(range(1, strlen(s_name) + 1), lambda i: cast(ord(substr(s_name, i, 1)) as bigint)), lambda c, b: xor((c << 1) & 4294967295, b)) as checksum from supplier")
def rolling_checksums(t):
    return t.supplier.select("s_suppkey", scalars.rolling_checksum(F.col("s_name").cast("binary")).alias("checksum"))


# -- logs --------------------------------------------------------------------
@query("select user_id, cast(count(*) as integer) as n, min(event_id) as first_entry, bool_or(event_type = 'purchase') as committed from events group by 1")
def tx_entries(t):
    got = storage.ordered_entries(t.events, "user_id", "event_id", ["event_type"], F.col("event_type") == "purchase")
    return got.select("user_id", F.size("entries").alias("n"), F.get("entries", F.lit(0))["event_id"].alias("first_entry"), "committed")


def _log(t) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", translog.COMMIT).when(F.col("event_type") == "error", translog.ROLLBACK).otherwise(translog.STORE)
    known = {"type": kind.cast("int"), "tx_id": F.col("user_id"), "ts_ms": F.lit(0).cast("long"), "channel": F.lit(0), "seq": F.col("event_id"), "file_no": F.col("user_id") % 7, "offset": F.col("event_id"), "length": F.lit(10).cast("long"), "object_ids": F.array("event_id", "user_id"), "path": F.lit(None).cast("string"), "op_count": F.lit(1), "target_no": F.lit(None).cast("long")}
    entries = t.events.select("event_id", *[c.alias(n) for n, c in known.items()])
    return translog.decoded(translog.encoded(entries, F.col("event_id")))


@query("select event_id as position, user_id as tx_id, case event_type when 'purchase' then 6 when 'error' then 7 else 1 end as type, case when event_type in ('purchase', 'error') then null else [event_id, user_id] end as object_ids from events")
def log_round_trip(t):
    return _log(t).select("position", "tx_id", "type", "object_ids")


@query("select user_id as tx_id, count(*) as n_entries, coalesce(max_by(event_type, event_id) filter (where event_type in ('purchase', 'error')) = 'purchase', false) as committed from events group by 1")
def log_transactions(t):
    return translog.transactions(_log(t))


@query("select event_id as position from events where event_id < 700")
def log_to_damage(t):
    entries = t.events.select("event_id").withColumn("frame", F.lit(None).cast("binary"))
    good = translog.encoded(_log(t).where("position <> 700"), F.col("position"))
    bad = entries.where("event_id = 700").select(F.col("event_id").alias("position"), "frame")
    return translog.up_to_damage(translog.decoded(good.unionByName(bad))).select("position")


@query("select * from (values (1::bigint, 2::bigint, true), (2, 2, false), (3, 3, true)) v(tx_id, n_entries, committed)")
def log_writer(t):
    log = translog.Log(engine(t))
    a, b, c = log.begin(), log.begin(), log.begin()
    log.store(a, 1, 0, 10, [7, 8])
    log.create(c, 2, "two.dat")
    log.store(b, 1, 10, 5, [9])
    log.commit(a)
    log.rollback(b)
    log.truncate(c, 2, 0)
    log.commit(c)
    return translog.transactions(log.entries())


@query("with bad as (select 1 as x) select user_id % 50 as key, max_by(value, event_id) as value from events, bad group by 1")
def replayed_state(t):
    from ..streaming.feeds import latest_by_key

    log = t.events.select((F.col("user_id") % 50).alias("key"), "event_id", "value")
    return latest_by_key(log, "key", "event_id")


# -- caches and housekeeping -------------------------------------------------
@query("select event_id, user_id from (select event_id, user_id, coalesce(sum(user_id + 1) over (order by ts >= timestamp '2024-01-05', ts, event_id rows between unbounded preceding and 1 preceding), 0) as freed from events) where freed < 9000")
def cache_expired_first(t):
    rows = t.events.select("event_id", "user_id", "ts")
    return storage.expired_first(rows, F.col("ts"), F.lit("2024-01-05").cast("timestamp_ntz"), F.col("event_id"), F.col("user_id") + 1, 9000).select("event_id", "user_id")


@query("select doc_id from documents where n_chars > 900 and (select sum(1) from documents) <= 1000000")
def cache_sweep(t):
    return storage.cleared(t.documents.select("doc_id", "n_chars"), F.col("n_chars") > 900, F.col("doc_id"), F.lit(1), 1_000_000).select("doc_id")


_CACHES = "caches as (select c_custkey as id, (c_custkey % 101) / 100.0 as hits, cast(c_custkey % 97 + 10 as double) as used, c_custkey % 3 = 0 as pressure, c_custkey % 400 as allocations, c_custkey % 300 as evictions, c_custkey % 5 as entries, cast(c_custkey * 3 as double) as avg_entry from customer)"


@query(
    f"with {_CACHES} select id, case when hits >= 0.85 and used <= 85.0 then 'Excellent' when hits >= 0.85 * 0.8 and used <= 85.0 * 1.1 then 'Good' when hits >= 0.85 * 0.6 and used <= 85.0 * 1.2 then 'Fair' else 'Poor' end as rating, "
    "cast(case when used > 85 then 1 else 0 end + case when hits < 0.85 then 1 else 0 end + case when pressure then 1 else 0 end as integer) as n_issues, "
    "cast(case when used > 85 then 1 else 0 end + case when hits < 0.85 then 1 else 0 end + case when evictions > allocations * 0.5 then 1 else 0 end + case when entries > 0 and avg_entry < 1024 then 1 else 0 end + case when hits >= 0.85 and used <= 85 then 1 else 0 end as integer) as n_advice, "
    "used > 85 or (hits < 0.85 and allocations > 100) as should_evict, "
    "cast(floor(1000000 * case when hits >= 0.85 then 1.0 when hits < 0.85 * 0.8 then 1.5 when used > 85 then 1.2 else 1.0 end) as bigint) as optimal_capacity, "
    "cast(case when used > 85 then floor(500000 * ((used - 85) / 100.0)) else 0 end as bigint) as savings from caches"
)
def cache_evaluation(t):
    key = F.col("c_custkey")
    facts = {"hit_ratio": key % 101 / 100.0, "utilisation": (key % 97 + 10).cast("double"), "pressure": key % 3 == 0, "allocations": key % 400, "evictions": key % 300, "entries": key % 5, "avg_entry": (key * 3).cast("double"), "used": F.lit(500000), "capacity": F.lit(1000000)}
    out = housekeeping.cache_evaluation(t.customer.select(key.alias("id"), *[c.alias(n) for n, c in facts.items()]))
    return out.select("id", "rating", F.size("issues").alias("n_issues"), F.size("advice").alias("n_advice"), "should_evict", "optimal_capacity", "savings")


@query("select cast(count(*) filter (where event_type = 'click') as bigint) as collections, cast(count(*) filter (where event_type = 'view') as bigint) as consolidations, cast(sum(user_id) as bigint) as reclaimed, max(event_id) as last_run from events")
def housekeeping_totals(t):
    kind = F.when(F.col("event_type") == "click", "collection").when(F.col("event_type") == "view", "consolidation")
    return housekeeping.totals(t.events.select(kind.alias("kind"), F.col("user_id").alias("reclaimed"), F.col("event_id").alias("ended")))


@query("select c_custkey, c_custkey % 2 = 0 and c_custkey % 9 <> 0 as is_live, c_custkey % 9 = 0 as is_deleted, case when c_custkey % 4 <> 0 then 'white' when c_custkey % 8 = 0 then 'grey' else 'black' end as colour from customer")
def entity_states(t):
    key = F.col("c_custkey")
    return storage.entity_state(t.customer.select("c_custkey"), key % 2 == 0, key % 9 == 0, key % 4 == 0, key % 8 == 0)


@query("select c_custkey, case when c_custkey in (select o_custkey from orders where o_totalprice > 400000) then 99 else 5 end as last_touched from customer")
def entities_touched(t):
    used = t.orders.where("o_totalprice > 400000").select("o_custkey")
    return storage.touched(t.customer.select("c_custkey", F.lit(5).alias("last_touched")), used, "c_custkey", F.lit(99))


# -- monitoring --------------------------------------------------------------
@query("select ['error rate', 'few operations'] as advice")
def metrics_overall(t):
    by = monitor.by_operation(t.events, F.col("event_type"), F.col("value"), F.col("value") < 100)
    return monitor.overall_advice(monitor.totals(by, 1e9))


@query("select * from (values ('Commit', 1::bigint, 0::bigint), ('Read', 2, 0), ('Write', 1, 1), ('load', 1, 0)) v(op, total, failed)")
def recorded_operations(t):
    r = monitor.Recorder(engine(t), at_once=2)
    r.read(1, 100, 5000)
    r.read(2, 100, 7000, cache_hit=True)
    r.write(3, 10, 900, ok=False)
    r.commit(5, 100)
    with r.timed("load"):
        pass
    return monitor.by_operation(r.events(), F.col("op"), F.col("nanos"), F.col("ok")).select("op", "total", "failed")


@query("select 'caches' as name, cast(sum(l_quantity) as bigint) as total from lineitem union all select 'files', cast(sum(l_suppkey) as bigint) from lineitem")
def named_monitors(t):
    m = monitor.Monitors()
    m.add("caches", "cache", lambda: monitor.cache_summary(t.lineitem.select(F.col("l_quantity").cast("long").alias("total")), ["total"]))
    m.add("files", "storage", lambda: monitor.cache_summary(t.lineitem.select(F.col("l_suppkey").alias("total")), ["total"]))
    first = m.of_kind("cache")["caches"].select(F.lit("caches").alias("name"), "total")
    return first.unionByName(m.get("files").select(F.lit("files").alias("name"), "total"))


@query("select event_type, round(avg(value), 4) as avg_rate from events group by 1")
def average_rates(t):
    return monitor.average_rate(t.events, "value", "event_type").withColumn("avg_rate", F.round("avg_rate", 4))


@query("select cast(l_orderkey % 4 as bigint) as channel, cast(l_suppkey % 3 as bigint) as file_no, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as bytes, cast(sum(case when l_returnflag = 'N' then cast(l_quantity as bigint) else 0 end) as bigint) as live, sum(case when l_returnflag = 'N' then cast(l_quantity as bigint) else 0 end) / sum(cast(l_quantity as bigint)) as usage from lineitem group by rollup(1, 2)")
def channel_usage(t):
    size = F.col("l_quantity").cast("long")
    return storage.file_rollup(t.lineitem, F.col("l_orderkey") % 4, F.col("l_suppkey") % 3, size, F.when(F.col("l_returnflag") == "N", size).otherwise(0))


# -- stored forms of values --------------------------------------------------
@query("select c_custkey, c_custkey - 750 as back, cast(greatest(1, ceil(length(ltrim(bin(case when c_custkey >= 750 then 2 * (c_custkey - 750) else -2 * (c_custkey - 750) - 1 end), '0')) / 7.0)) as integer) as n, lower(hex(encode(chr(cast(case when c_custkey between 750 and 813 then 2 * (c_custkey - 750) else 0 end as integer))))) = '00' or c_custkey between 751 and 813 as known from customer")
def varint_round_trip(t):
    data = binary.varint(F.col("c_custkey") - 750)
    first = F.when(F.col("c_custkey").between(751, 813), F.conv(F.hex(data), 16, 10).cast("long") == 2 * (F.col("c_custkey") - 750)).otherwise(F.lit(True))
    return t.customer.select("c_custkey", binary.from_varint(data).alias("back"), F.octet_length(data).alias("n"), first.alias("known"))


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate as varchar) as o_orderdate from orders")
def binary_round_trip(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return binary.deserialised(binary.serialised(rows), rows.schema).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("select c_custkey, c_name, c_acctbal from customer")
def handled_types(t):
    handlers = types.Handlers()
    handlers.add(types.Handler("cents", lambda c: F.round(c * 100).cast("long"), lambda c: c / 100.0))
    stored = handlers.to_stored(t.customer.select("c_custkey", "c_name", "c_acctbal"), {"c_acctbal": "cents"})
    return handlers.from_stored(stored, {"c_acctbal": "cents"})


@query("select p_partkey, try_cast(p_brand as integer) as not_a_number, try_cast(split_part(p_brand, '#', 2) as integer) as brand_no, try_cast(cast(p_size as varchar) || '.5' as double) as half, cast(try_cast('1997-01-' || cast(p_size as varchar) as date) as varchar) as day from part")
def parsed_keys(t):
    key = lambda c, kind: c.try_cast(kind)
    size = F.col("p_size").cast("string")
    return t.part.select("p_partkey", key(F.col("p_brand"), "int").alias("not_a_number"), key(F.split_part("p_brand", F.lit("#"), F.lit(2)), "int").alias("brand_no"), key(F.concat(size, F.lit(".5")), "double").alias("half"), key(F.concat(F.lit("1997-01-"), size), "date").cast("string").alias("day"))


@query("select s_suppkey as entity_id, s_name from supplier order by md5('42' || cast(s_suppkey as varchar)), s_suppkey limit 20")
def sample_with_seed(t):
    return ids(relations.sample_of(t.supplier, "s_suppkey", 20, 42), "s_suppkey", "s_name")


# -- the file system of blobs ------------------------------------------------
def _blob_files(t):
    return blobs.BlobFiles(t.conversations.select(F.concat(F.lit("box/"), F.col("conv_id").cast("string")).alias("path"), "turn", F.col("text").cast("binary").alias("data")), "path", "turn", "data")


@query("with f as (select 'box/' || cast(conv_id as varchar) as path, cast(sum(octet_length(encode(text))) as bigint) as size from conversations group by 1) select case path when 'box/1' then 'box/moved' else path end as path, size from f where path <> 'box/2' union all select 'box/3-copy', size from f where path = 'box/3' union all select 'box/new', 3")
def blob_file_system(t):
    files = _blob_files(t).move("box/1", "box/moved").delete("box/2").copy("box/3", "box/3-copy").write("box/new", b"abc")
    return files.sizes().select("path", "size")


@query("select sha256(encode(string_agg(text, '' order by turn))) as checksum, true as there, false as missing from conversations where conv_id = 4")
def blob_file_read(t):
    files = _blob_files(t)
    data = files.read("box/4").select(F.sha2("data", 256).alias("checksum"))
    return data.select("checksum", F.lit(files.exists("box/4")).alias("there"), F.lit(files.exists("box/nothing")).alias("missing"))


# -- upkeep ------------------------------------------------------------------
@query("select doc_id, case when doc_id % 5 = 0 then 'restored' when doc_id % 7 = 0 then 'lost' else 'kept' end as outcome, case when doc_id % 5 <> 0 and doc_id % 7 = 0 then null else sha256(text) end as checksum from documents")
def integrity_repair(t):
    whole = t.documents.select("doc_id", "text")
    stored = whole.where("doc_id % 7 <> 0 or doc_id % 5 = 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, "damaged").otherwise(F.col("text")))
    checks = storage.checksums(whole, "doc_id", "text")
    backup = whole.where("doc_id % 5 = 0")
    out = storage.repaired(stored, checks, backup, "doc_id", "text")
    return out.select("doc_id", "outcome", F.when(F.col("outcome") != "lost", F.sha2(F.col("text").cast("binary"), 256)).alias("checksum"))


@query("select s_suppkey as file_no, case when s_suppkey % 5 = 0 then 'quarantine' when s_suppkey % 3 = 0 then 'restore' else 'keep' end as step from supplier")
def recovery_steps(t):
    state = F.when(F.col("s_suppkey") % 5 == 0, "short").when(F.col("s_suppkey") % 3 == 0, "missing").otherwise("ok")
    return storage.recovery_steps(t.supplier.select(F.col("s_suppkey").alias("file_no"), state.alias("state")))


@query("select * from (values ('collection', true), ('consolidation', true), ('optimisation', false)) v(task, done)")
def upkeep_run(t):
    def fails(seconds: float) -> None:
        raise RuntimeError("nothing to optimise")

    work = {"collection": lambda s: t.region.count(), "consolidation": lambda s: s, "optimisation": fails}
    done = housekeeping.run_tasks(work, housekeeping.Budget(10.0))
    return t.spark.createDataFrame([(name, not isinstance(result, Exception)) for name, _, _, result in done], "task string, done boolean")


@query("select l_suppkey as file_no, count(*) as n, cast(sum(l_quantity) as bigint) as total from lineitem group by 1")
def file_statistics(t):
    return storage.file_statistics(t.lineitem, F.col("l_suppkey"), F.col("l_quantity").cast("long"))


@query("select cast(n_nationkey as bigint) as id, n_name from nation where n_regionkey = 2")
def entities_with_action(t):
    """Each entity is handed to an action, which keeps it in an accumulator of ids."""
    seen = t.spark.sparkContext.accumulator(0)
    m = builder(t.nation.where("n_regionkey = 2"), "n_nationkey")
    m.iterate_indexed(lambda i, row: seen.add(1))
    kept = m.peek(-1).count() + seen.value
    return m.df.where(F.lit(kept) == m.size()).select(F.col("n_nationkey").cast("long").alias("id"), "n_name")
