"""Reading states: latest, as of an instant, previous, lookups, histories, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordertape.plans import stage


def latest_by(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of every key; ``max_by`` combines before its shuffle, unlike a window."""
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("__row"))
    return picked.select("__row.*")


def as_of(rows: DataFrame, key: str, ts_col: str, instant, *order: str) -> DataFrame:
    """The last row of every key not after an instant."""
    return latest_by(rows.where(F.col(ts_col) <= instant), key, *order)


def previous(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    return rows.withColumn(f"prev_{value}", F.lag(value).over(Window.partitionBy(key).orderBy(*order)))


def lookup(index: DataFrame, states: DataFrame, probes: DataFrame, kind: str, probe_col: str = "id_value") -> DataFrame:
    """States of probed identifiers (0 or 1 each), probes kept."""
    wanted = index.where(F.col("id_kind") == kind).select(F.col("id_value").alias(probe_col), "chain_id")
    return probes.join(wanted, probe_col).join(states, "chain_id")


def membership(versions: DataFrame, column: str) -> DataFrame:
    """``(value, chain_id)``: every value a chain ever had (entries are never removed)."""
    return versions.where(F.col(column).isNotNull()).select(F.col(column).alias("value"), "chain_id").distinct()


def by_member(versions: DataFrame, states: DataFrame, column: str, value: str, policy: str = "A") -> DataFrame:
    """States of chains that ever (policy A) or now (policy B) carry a value."""
    if policy == "B":
        return states.where(F.col(column) == value)
    return states.join(membership(versions, column).where(F.col("value") == value).select("chain_id"), "chain_id", "left_semi")


def children(states: DataFrame) -> DataFrame:
    """``(parent_chain, parent_id, child_chain, child_id)``: children by any id of the parent."""
    own = states.select(F.col("chain_id").alias("parent_chain"), F.explode(F.array_distinct(F.array_compact(F.concat(F.array("order_id", "cl_ord_id"), "cl_ord_id_history")))).alias("parent_id"))
    kids = states.where(F.col("tagged_parent_id").isNotNull()).select(
        F.col("tagged_parent_id").alias("parent_id"), F.col("chain_id").alias("child_chain"), F.coalesce("order_id", "cl_ord_id").alias("child_id")
    )
    return kids.join(own, "parent_id").where("parent_chain <> child_chain").distinct()


def history(messages: DataFrame, key: str, value: str, cap: int = 0) -> DataFrame:
    """``(key, history)``: values in order; a positive cap keeps the newest."""
    grouped = messages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", value))).alias("h")).select(key, F.transform("h", lambda x: x[value]).alias("history"))
    if cap > 0:
        grouped = grouped.withColumn("history", F.slice("history", F.greatest(F.size("history") - cap + 1, F.lit(1)), F.lit(cap)))
    return grouped


def gaps(log: DataFrame, seq_col: str = "seq", segment_col: str | None = None) -> DataFrame:
    """Rows whose sequence number does not follow the one before (within a segment when given).

    Without segments the log is cut into ranges; each range looks back into itself and, for its first row, at the last number of the
    range before it, so no task sorts the whole log.
    """
    if segment_col:
        found = log.withColumn("prev_seq", F.lag(seq_col).over(Window.partitionBy(segment_col).orderBy(seq_col)))
    else:
        ranged = stage.save(log.repartitionByRange(seq_col).sortWithinPartitions(seq_col).withColumn("__p", F.spark_partition_id()), "ranges")
        ends = ranged.groupBy("__p").agg(F.max(seq_col).alias("__end"))  # one row for each range
        before = ends.select("__p", F.lag("__end").over(Window.orderBy("__p")).alias("__before"))
        inside = F.lag(seq_col).over(Window.partitionBy("__p").orderBy(seq_col))
        found = ranged.join(F.broadcast(before), "__p", "left").withColumn("prev_seq", F.coalesce(inside, "__before")).drop("__p", "__before")
    return found.where(F.col(seq_col) - F.col("prev_seq") != 1)
