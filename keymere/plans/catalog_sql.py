"""The SQL form of each query of :mod:`keymere.plans.catalog`, for DuckDB over the test tables."""

SQL: dict[str, str] = {
    "scan_with_id": "select c_custkey as entity_id, c_name from customer",
    "get_by_id": "select c_custkey as entity_id, c_name, c_acctbal from customer where c_custkey = 42",
    "get_many_by_id": "select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey in (1,7,42,999,14999,777777)",
    "index_keys": "select distinct p_brand as key from part",
    "index_lookup": "select p_partkey as entity_id from part where p_brand = 'Brand#12'",
    "cond_is": "select c_custkey as entity_id, c_mktsegment from customer where c_mktsegment = 'BUILDING'",
    "cond_is_not": "select c_custkey as entity_id, c_mktsegment from customer where c_mktsegment <> 'BUILDING'",
    "cond_in": "select p_partkey as entity_id, p_size from part where p_size in (1,5,9,50)",
    "cond_not_in": "select p_partkey as entity_id, p_size from part where p_size not in (1,5,9,50)",
    "cond_where_range": "select o_orderkey as entity_id, o_totalprice from orders where o_totalprice >= 400000",
    "cond_where_like": "select c_custkey as entity_id, c_name from customer where c_name like '%0001%'",
    "cond_and": "select o_orderkey as entity_id from orders where o_orderstatus = 'F' and o_totalprice >= 250000",
    "cond_or": "select o_orderkey as entity_id from orders where o_orderpriority = '1-URGENT' or o_orderpriority = '5-LOW'",
    "cond_fold_left": "select o_orderkey as entity_id from orders where ((o_orderstatus='F' and o_orderpriority='1-URGENT') or o_orderpriority='5-LOW') and o_totalprice < 100000",
    "cond_not": "select o_orderkey as entity_id from orders where not (o_orderstatus='F' and o_orderpriority='1-URGENT')",
    "cond_double_not": "select o_orderkey as entity_id from orders where o_orderstatus='P'",
    "cond_ignore_case": "select c_custkey as entity_id, c_mktsegment from customer where lower(c_mktsegment) = lower('buiLDing')",
    "cond_string_to_key": "select p_partkey as entity_id, p_size from part where p_size = cast('25' as integer)",
    "cond_computed_key": "select o_orderkey as entity_id, cast(year(o_orderdate) as integer) as order_year from orders where year(o_orderdate) = 1997",
    "entity_test_key": "select c_custkey as entity_id, (c_mktsegment is not distinct from 'BUILDING') as is_match from customer",
    "equal_keys": "select a.s_suppkey as id1, b.s_suppkey as id2 from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey",
    "query_page": "select o_orderkey as entity_id, o_totalprice from orders where o_orderstatus='O' order by o_orderkey limit 40 offset 30",
    "query_first": "select o_orderkey as entity_id, o_totalprice from orders where o_orderstatus='O' order by o_orderkey limit 1 offset 2",
    "query_count": "select count(*) as cnt from orders where o_orderstatus='O'",
    "query_any": "select count(*) > 0 as has_any from orders where o_totalprice > 499000",
    "map_size": "select count(*) as size, max(o_orderkey) as highest_used_id, count(*) = 0 as is_empty from orders",
    "id_set_intersect": "select o_custkey as entity_id from orders where o_orderstatus='F' intersect select o_custkey from orders where o_orderstatus='P'",
    "id_set_union": "select o_custkey as entity_id from orders where o_totalprice>450000 union select o_custkey from orders where o_orderpriority='1-URGENT'",
    "id_set_except": "select c_custkey as entity_id from customer except select o_custkey from orders where o_orderpriority='1-URGENT'",
    "index_stats": "select p_brand as key, count(*) as entity_count, cast(length(p_brand)*2 + count(*)//8 + 1 + 32 as bigint) as mem_bytes from part group by p_brand",
    "index_totals": "select count(*) as unique_keys, cast(sum(n) as bigint) as total_entities, cast(sum(m) as bigint) as mem_bytes from (select count(*) n, length(p_brand)*2 + count(*)//8 + 1 + 32 m from part group by p_brand)",
    "inverted_index": "select s_nationkey as key, count(distinct s_suppkey) as n, min(s_suppkey) as lo, max(s_suppkey) as hi from supplier group by 1",
    "bitmap_count": "select c_mktsegment as key, count(distinct c_custkey) as cnt from customer group by 1",
    "bench_filter": "select c_custkey, c_name, c_acctbal from customer where c_mktsegment='BUILDING' and c_acctbal > 1000",
    "bench_active_customers": "select c_custkey, c_name, c_acctbal from customer where c_acctbal > 500 and exists (select 1 from orders where o_custkey=c_custkey and o_orderdate >= timestamp '2001-01-01')",
    "bench_big_orders": "select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus='F' and o_orderkey in (select l_orderkey from lineitem group by l_orderkey having count(*)>2 and sum(cast(l_extendedprice as decimal(18,2)))>200)",
    "bench_popular_parts": "select p_partkey, p_name, p_size from part where p_size > 25 and p_partkey in (select l_partkey from lineitem group by l_partkey having count(*)>30)",
    "nav_one_to_many": "select o_custkey as c_custkey, count(*) as n_orders, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from orders group by 1",
    "nested_filter": "select l_orderkey, count(*) as n_items, cast(count(*) filter (where l_extendedprice > 50000) as bigint) as n_expensive from lineitem group by 1",
    "group_by_key": "select o_orderpriority as key, count(*) as cnt from orders group by 1",
    "sum_expression": "select cast(sum(cast(l_extendedprice as decimal(18,2)) * cast(l_quantity as decimal(18,0))) as double) as total_value from lineitem",
    "order_by_top": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25",
    "unique_violations": "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1,2 having count(*)>1",
    "unique_violations_ci": "select lower(p_name) as key, count(*) as n from part group by 1 having count(*)>1",
    "custom_constraint": "select 'non_negative_balance' as constraint_name, c_custkey as entity_id from customer where not (c_acctbal >= 0)",
    "mut_add_all": "select s_suppkey as entity_id, s_name from supplier union all select (select max(s_suppkey) from supplier) + row_number() over (order by n_nationkey) as entity_id, n_name as s_name from nation",
    "mut_remove": "select c_custkey as entity_id, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 480000)",
    "mut_set_replace": "select c.c_custkey as entity_id, coalesce(d.v, c.c_mktsegment) as c_mktsegment from customer c left join (select c_custkey, 'REPLACED' v from customer where c_custkey % 10 = 0) d using (c_custkey)",
    "mut_update": "select p_partkey as entity_id, case when p_brand='Brand#12' then p_size + 100 else p_size end as p_size from part",
    "segment_address": "select o_orderkey as entity_id, cast(o_orderkey & 255 as bigint) as low, cast((o_orderkey >> 8) & 1023 as bigint) as mid, cast(o_orderkey >> 18 as bigint) as high from orders",
    "channel_rollup": "select cast(l_orderkey % 4 as bigint) as channel, cast(l_suppkey % 3 as bigint) as file_no, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as bytes from lineitem group by rollup(1,2)",
    "tx_committed": "select user_id as tx_id, count(*) as n_entries, min(event_id) as first_seq, max(event_id) as last_seq from events group by 1 having bool_or(event_type='purchase')",
    "tx_last_committed": "select coalesce(max(user_id),0) as last_tx from events where event_type='purchase'",
    "recovery_extents": "select l_suppkey as file_no, max(l_orderkey + cast(l_quantity as bigint)) as expected_size from lineitem group by 1",
    "metrics_by_operation": "select event_type as op, count(*) as total, cast(count(*) filter (where value < 100) as bigint) as ok, cast(count(*) filter (where value >= 100) as bigint) as failed, min(value) as min_v, max(value) as max_v, round(avg(value), 4) as avg_v, round(cast(count(*) filter (where value < 100) as double)/count(*), 6) as success_rate, round(cast(count(*) filter (where value >= 100) as double)/count(*), 6) as failure_rate from events group by 1",
    "metrics_recommend": "select event_type as op, (max(value)-min(value) > 400) as high_variance, (avg(value) > 100) as high_latency from events group by 1",
    "recent_events": "select event_id, event_type from events order by ts desc, event_id desc limit 100",
    "cache_lru_evict": "select event_id, user_id from (select event_id, user_id, coalesce(sum(user_id + 1) over (order by ts, event_id rows between unbounded preceding and 1 preceding),0) as freed_before from events) where freed_before < 5000",
    "cache_weight_rule": "select doc_id, (cast(1000 as bigint) - 400 < (n_chars * ((doc_id * 4096) >> 16)) << (case when lang='en' then 0 else 1 end)) as evict from documents",
    "file_retirement": "select l_partkey as file_no from lineitem group by 1 having count(*) > 40 or count(*) filter (where l_returnflag='N') < count(*) * 0.5",
    "consolidation_groups": "select doc_id, grp from (select doc_id, grp, count(*) over (partition by grp) as c from (select doc_id, (row_number() over (order by doc_id) - 1)//5 as grp from documents where n_chars < 500)) where c > 1",
    "blob_offsets": "select conv_id as file_id, turn as blob_no, cast(coalesce(sum(octet_length(encode(text))) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding),0) as bigint) as start_off from conversations",
    "blob_range_read": "select file_id, blob_no from (select conv_id file_id, turn blob_no, length(text) sz, sum(length(text)) over (partition by conv_id order by turn) - length(text) as s from conversations) where s <= 199 and s + sz - 1 >= 100",
    "blob_next_number": "select conv_id as file_id, max(turn)+1 as next_no from conversations group by 1",
    "path_children": "select distinct split_part(url,'/',3) as container from pages",
    "path_parts": "select page_id, split_part(url,'/',3) as container, length(url) as full_len from pages",
    "incremental_backup": "select event_id from events where ts > timestamp '2024-01-25 00:00:00'",
    "integrity_checksum": "select doc_id, sha256(text) as checksum from documents",
    "duplicate_content": "select sha256(text) as checksum, count(*) as n from documents group by 1 having count(*)>1",
    "gc_reachable": "with live as (select n_nationkey from nation join region on n_regionkey=r_regionkey where r_name='ASIA') select o_orderkey from orders join customer on o_custkey=c_custkey where c_nationkey in (select n_nationkey from live)",
    "zigzag_varint_len": "select cast(c_custkey - 750 as bigint) as v, xor(cast((c_custkey - 750) * 2 as bigint), cast(case when c_custkey < 750 then -1 else 0 end as bigint)) as zz from customer",
    "type_export_counts": "select lang as type_name, cast(sum(n_chars) as bigint) as byte_count, count(*) as entity_count from documents where source <> 'src0' group by 1",
}
