"""Dataflow of the storage layer: logs, recovery, integrity, backup, cache, collection, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import guarded_ratio, sha256_text
from ..operators.prefix import Descending, filled, groups_of, running
from ..sources.shared import cut


def transactions(log: DataFrame, tx: Column, seq: Column, commit: Column) -> DataFrame:
    """Each transaction: entries, first and last sequence number, whether it was committed."""
    keyed = log.select(tx.alias("tx_id"), seq.alias("seq"), commit.alias("c"))
    return keyed.groupBy("tx_id").agg(F.count(F.lit(1)).alias("n_entries"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.bool_or("c").alias("committed"))


def committed(log: DataFrame, tx: Column, seq: Column, commit: Column) -> DataFrame:
    return transactions(log, tx, seq, commit).where("committed").drop("committed")


def replay(log: DataFrame, tx: str, seq: str, commit: Column) -> DataFrame:
    """Entries of committed transactions up to the first bad entry (``valid`` false), if the log has that column."""
    if "valid" in log.columns:
        bad = log.where("not valid").agg(F.min(seq).alias("bad"))
        log = log.where(F.col(seq) < F.coalesce(bad.scalar(), F.lit((1 << 63) - 1)))
    done = log.groupBy(tx).agg(F.bool_or(commit).alias("_c")).where("_c").select(tx)
    return log.join(done, tx, "left_semi")


def ordered_entries(log: DataFrame, tx: str, seq: str, entry: list[str], commit: Column) -> DataFrame:
    """Each transaction with its entries in order as an array, and whether it was committed. For transactions that fit a row."""
    items = F.sort_array(F.collect_list(F.struct(seq, *entry))).alias("entries")
    return log.groupBy(tx).agg(items, F.bool_or(commit).alias("committed"))


def sequence(log: DataFrame, tx: str, order: str, name: str = "seq") -> DataFrame:
    """Number the entries of each transaction from 1."""
    return log.withColumn(name, F.row_number().over(Window.partitionBy(tx).orderBy(order)))


def last_committed(log: DataFrame, tx: Column, commit: Column) -> DataFrame:
    return log.where(commit).agg(F.coalesce(F.max(tx), F.lit(0)).alias("last_tx"))


def extents(log: DataFrame, file: Column, offset: Column, length: Column) -> DataFrame:
    """The size that each file should have by its log."""
    return log.groupBy(file.alias("file_no")).agg(F.max(offset + length).alias("expected_size"))


def recovery(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """What is wrong with each logged file: missing, short or ok (longer files are cut by later writes)."""
    joined = expected.join(actual.select("file_no", "size"), "file_no", "left")
    state = F.when(F.col("size").isNull(), "missing").when(F.col("size") < F.col("expected_size"), "short").otherwise("ok")
    return joined.withColumn("state", state)


def checksums(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.select(id_col, sha256_text(F.col(text)).alias("checksum"))


def duplicate_content(df: DataFrame, text: str) -> DataFrame:
    return df.groupBy(sha256_text(F.col(text)).alias("checksum")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def integrity(current: DataFrame, stored: DataFrame, id_col: str) -> DataFrame:
    """new, changed, ok or missing for each item by its checksum."""
    joined = current.join(stored.select(id_col, F.col("checksum").alias("_old")), id_col, "full")
    state = F.when(F.col("checksum").isNull(), "missing").when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("checksum"), "ok").otherwise("changed")
    return joined.select(id_col, state.alias("state"))


def repaired(stored: DataFrame, checks: DataFrame, backup: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows as they should be: kept where the checksum is right, else restored from the backup, else lost (``outcome``)."""
    right = checks.select(id_col, F.col("checksum").alias("_right"))
    own = stored.select(id_col, F.col(text).alias("_own"))
    spare = backup.select(id_col, F.col(text).alias("_spare"))
    rows = right.join(own, id_col, "left").join(spare, id_col, "left")
    kept = F.coalesce(sha256_text(F.col("_own")) == F.col("_right"), F.lit(False))
    fits = F.coalesce(sha256_text(F.col("_spare")) == F.col("_right"), F.lit(False))
    outcome = F.when(kept, "kept").when(fits, "restored").otherwise("lost")
    return rows.select(id_col, F.when(kept, F.col("_own")).when(fits, F.col("_spare")).alias(text), outcome.alias("outcome"))


def recovery_steps(states: DataFrame) -> DataFrame:
    """What a start does with each file after :func:`recovery`: a short one goes to quarantine, a missing one is restored."""
    step = F.when(F.col("state") == "short", "quarantine").when(F.col("state") == "missing", "restore").otherwise("keep")
    return states.select("file_no", step.alias("step"))


def id_analysis(objects: DataFrame, object_id: str, type_id: str) -> DataFrame:
    """The highest ids of objects and types, and the number of objects: where a store goes on after a start."""
    return objects.agg(F.max(object_id).alias("max_object"), F.max(type_id).alias("max_type"), F.count(F.lit(1)).alias("n"))


def file_statistics(files: DataFrame, file: Column, size: Column) -> DataFrame:
    return files.groupBy(file.alias("file_no")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("total"))


def incremental(files: DataFrame, modified: Column, since: Column) -> DataFrame:
    return files.where(modified > since)


def evictions(cache: DataFrame, order: list[Column | Descending], size: Column, target: int | Column) -> DataFrame:
    """Least recently used entries, until ``target`` bytes are freed. Hand in the columns that are needed only."""
    return running(cache, order, {"freed_before": size}).where(F.col("freed_before") < target)


def expired_first(cache: DataFrame, last_access: Column, expired_before: Column, tie: Column, size: Column, target: int) -> DataFrame:
    """The same, but entries that weren't used since ``expired_before`` go first, in the order of their last use."""
    fresh = F.coalesce(last_access >= expired_before, F.lit(False))
    return evictions(cache, [fresh, last_access, tie], size, target)


def cleared(cache: DataFrame, evict: Column, tie: Column, cost_ms: Column, budget_ms: int) -> DataFrame:
    """A sweep within a time budget: the entries to clear, and ``done`` where the budget was enough for all entries.

    Entries are looked at in the order of ``tie``, each at its cost; a sweep
    whose budget ends before the last entry clears nothing.
    """
    rows = cache.withColumns({"_evict": evict, "_cost": cost_ms})
    total = rows.agg(F.coalesce(F.sum("_cost"), F.lit(0)).alias("n"))
    return rows.withColumn("done", total.scalar() <= budget_ms).where("_evict and done").drop("_evict", "_cost")


def should_evict(age_ms: Column, cached: Column, has_references: Column, cache_size: Column, threshold: Column, timeout_ms: Column | None = None) -> Column:
    """The weight rule: old enough, or the room left is less than length times age (in 65 s), doubled without references."""
    weight = cached * F.shiftright(age_ms, 16)
    doubled = F.when(has_references, weight).otherwise(F.shiftleft(weight, 1))
    out = (threshold - cache_size) < doubled
    return out if timeout_ms is None else (age_ms >= timeout_ms) | out


def retired_files(files: DataFrame, file: Column, size: Column, live: Column, most: Column, share: float) -> DataFrame:
    """Files larger than ``most`` or with less than ``share`` of live data."""
    sums = files.groupBy(file.alias("file_no")).agg(size.alias("_size"), live.alias("_live"))
    return sums.where((F.col("_size") > most) | (F.col("_live") < F.col("_size") * share)).select("file_no")


def consolidation_groups(files: DataFrame, id_col: str, small: Column, size: int = 5) -> DataFrame:
    """Small files in groups of ``size``; a single one in the last group is left out."""
    grouped = groups_of(files.where(small).select(id_col), [F.col(id_col)], size)
    alone = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp")
    return grouped.join(alone, "grp", "left_semi").select(id_col, "grp")


def roll_over(chunks: DataFrame, order: list[Column | Descending], size: Column, most: int) -> DataFrame:
    """File number of each chunk: a new file is begun when the chunk would make the current one larger than ``most`` bytes."""
    return filled(chunks, order, size, most)


def merge_groups(groups: DataFrame, path_col: str, target: str) -> DataFrame:
    """Write the rows of each group of small Parquet files as a folder of its own below ``target``; returns them with their ``grp``.

    groups: the files' paths and ``grp``. Rows find their group by the file
    that they come from, in one job; a group goes to one task, as its files
    are small.
    """
    spark = groups.sparkSession
    paths = [r[0] for r in groups.select(path_col).collect()]  # a row per file, as in any listing
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    rows = spark.read.parquet(*paths).withColumn("_file", plain(F.col("_metadata.file_path")))
    named = groups.select(plain(F.col(path_col)).alias("_file"), "grp")
    rows.join(F.broadcast(named), "_file").drop("_file").repartition("grp").write.partitionBy("grp").parquet(target)
    return spark.read.parquet(target)


def reachable(roots: DataFrame, edges: DataFrame, checkpoint_every: int = 4) -> DataFrame:
    """Ids reachable from ``roots`` (id) along ``edges`` (src, dst): a breadth-first search by joins.

    As many rounds as the longest shortest path; each front is checkpointed
    in the shared folder.
    """
    seen = front = roots.select("id").distinct()
    step = 0
    while True:
        front = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        step += 1
        front = cut(front)
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if step % checkpoint_every == 0:
            seen = cut(seen)


def sweep(objects: DataFrame, live: DataFrame, id_col: str) -> DataFrame:
    return objects.join(live.select(F.col("id").alias(id_col)), id_col, "left_anti")


def touched(entities: DataFrame, ids: DataFrame, id_col: str, now: Column) -> DataFrame:
    """Entities whose last use is now, for the ids in question."""
    hit = ids.select(F.col(ids.columns[0]).alias(id_col)).distinct().withColumn("_hit", F.lit(True))
    return entities.join(hit, id_col, "left").withColumn("last_touched", F.when(F.col("_hit"), now).otherwise(F.col("last_touched"))).drop("_hit")


def entity_state(entities: DataFrame, cached: Column, deleted: Column, marked: Column, queued: Column) -> DataFrame:
    """is_live, is_deleted and the collector's colour (white: not reached, grey: reached, black: done) of each entity."""
    colour = F.when(~marked, "white").when(queued, "grey").otherwise("black")
    return entities.withColumns({"is_live": cached & ~deleted, "is_deleted": deleted, "colour": colour})


def adjacency(objects: DataFrame, id_col: str, references: str) -> DataFrame:
    """The edges of a store, as an export lists them: src, dst; nothing for null references."""
    return objects.select(F.col(id_col).alias("src"), F.explode(references).alias("dst")).where("dst is not null")


def file_rollup(files: DataFrame, channel: Column, file: Column, size: Column, live: Column | None = None) -> DataFrame:
    """Totals by file, channel and storage; with ``live`` also the share of live bytes."""
    sums = [F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("bytes")]
    if live is None:
        return files.rollup(channel.alias("channel"), file.alias("file_no")).agg(*sums)
    out = files.rollup(channel.alias("channel"), file.alias("file_no")).agg(*sums, F.coalesce(F.sum(live), F.lit(0)).cast("long").alias("live"))
    return out.withColumn("usage", guarded_ratio(F.col("live"), F.col("bytes")))


def usage(files: DataFrame, total: str, live: str) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum(total).alias("total"), F.sum(live).alias("live")).withColumn("usage", guarded_ratio(F.coalesce("live", F.lit(0)), F.coalesce("total", F.lit(0))))
