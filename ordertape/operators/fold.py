"""The order fold: every message of a chain becomes a version of the order's state.

Only the status with its open requests is sequential: it takes one pass over the
sorted rows of a partition. Everything else is a running window (last non-blank
value with handler-specific input). All of it shares one partitioning by chain;
nothing is staged and no message is joined with itself.

Input columns are the lifted text columns plus ``chain_id``, ``seq`` and ``ts``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordertape.functions import codec
from ordertape.functions.codes import ORD_STATUS, decode, is_terminal

def _chain() -> Window:
    return Window.partitionBy("chain_id").orderBy("seq")


def _so_far() -> Window:
    return _chain().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def filled(c: str | Column) -> Column:
    """The value unless it is blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"\S"), c)  # found at the first character that is no blank


def latest(value: Column) -> Column:
    return F.last(value, ignorenulls=True).over(_so_far())


#: What a row of the status pass does: (kind of message, counted report) as a small number.
_DOES = {"D": 1, "8": 2, "F": 3, "G": 4, "9": 5}
_NAMES = ["UNSPECIFIED", *dict.fromkeys([*ORD_STATUS.values(), "PENDING_NEW", "PENDING_CANCEL", "PENDING_REPLACE"])]
_HELPERS = ("__first", "__does", "__given", "__asked")


def _status_of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The status rules over rows sorted by chain and sequence; of a chain no more than its open requests is held.

    The other columns pass through; the helper columns are last, and the status after and before each message takes their place.
    """
    new, cancel, replace = (_NAMES.index(f"PENDING_{x}") for x in ("NEW", "CANCEL", "REPLACE"))
    names, status, prior = pa.array(_NAMES), 0, {}
    for batch in batches:
        after, before = [], []
        first, does, given, asked = (batch.column(k).to_pylist() for k in range(batch.num_columns - len(_HELPERS), batch.num_columns))
        for f, d, g, r in zip(first, does, given, asked):
            if f:
                status = 0
                if prior:
                    prior = {}
            before.append(None if f else status)
            if d == 2:
                status = status if g is None else g
                if r is not None:  # a report that confirms a request
                    prior.pop(r, None)
            elif d == 1:
                status = status or new
            elif d == 3 or d == 4:
                if r is not None:
                    prior[r] = status
                status = cancel if d == 3 else replace
            elif d == 5:
                back = prior.pop(r, None) if r is not None else None
                status = back if back is not None else status if g is None else g
            after.append(status)
        kept = batch.num_columns - len(_HELPERS)
        told = [names.take(pa.array(x, pa.int32())) for x in (after, before)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *told], names=[*batch.schema.names[:kept], "__after", "__before"])


def _with_status(rows: DataFrame) -> DataFrame:
    """``rows`` (one partition for a chain) with the status ``__after`` and ``__before`` each message in place of the helper columns."""
    kept = [c for c in rows.columns if c not in _HELPERS]
    out = T.StructType([*(rows.schema[c] for c in kept), T.StructField("__after", T.StringType()), T.StructField("__before", T.StringType())])
    return rows.sortWithinPartitions("chain_id", "seq").select(*kept, *_HELPERS).mapInArrow(_status_of_sorted, out)


_REPORTED = ("exec_id",)
_STATED = ("ord_status", "exec_type", "exec_id", "cl_ord_id")
#: Lifted columns that a version column is made of, where they are not the one of its own name.
_MADE_OF = {
    "cl_ord_id_history": ("cl_ord_id",), "exec_id_count": _REPORTED, "new_exec_id": _REPORTED, "ord_status": _STATED, "is_terminal": _STATED, "prev_ord_status": _STATED,
    "last_exec_type": ("exec_type", *_REPORTED), **{c: (c, *_REPORTED) for c in ("cum_qty", "leaves_qty", "avg_px", "last_qty", "last_px", "last_mkt")},
    "text": ("text", *_STATED), "ord_rej_reason": ("ord_rej_reason", *_STATED), "busted_count": ("exec_ref_id", "exec_trans_type", *_REPORTED),
    "new_busted_id": ("exec_ref_id", "exec_trans_type", *_REPORTED), "tagged_parent_id": ("secondary_cl_ord_id",), "cause_parent_id": ("secondary_cl_ord_id",),
    "cause_cl_ord_id": ("cl_ord_id",), "cause_exec_id": ("exec_id",), "chain_key": ("cl_ord_id", "order_id"),
    **dict.fromkeys(("chain_id", "seq", "ts", "update_count", "first_seen_ts", "last_update_ts", "last_msg_type", "cause_msg_type"), ()),
}
#: Version columns that need the status of the same message first, and those that are made by the pass over statuses.
_LATE, _TOLD = ("text", "ord_rej_reason"), ("ord_status", "prev_ord_status", "is_terminal")


def inputs(columns: tuple[str, ...]) -> tuple[str, ...]:
    """Lifted columns that :func:`versions` reads for these columns."""
    return tuple(dict.fromkeys(["msg_type", *(x for c in columns for x in _MADE_OF.get(c, (c,)))]))


def versions(messages: DataFrame, parent_tag: str = "secondary_cl_ord_id", columns: tuple[str, ...] | None = None) -> DataFrame:
    """One row per message: the state of its order after it, with the message's own columns as ``cause_*``; or only ``columns`` of it.

    The ids that an order has had grow with it, so a version only says which
    ones its message added (``new_exec_id``, ``new_busted_id``) and how many there are; :func:`latest_states` lists them.
    Messages are dealt by their chain once; only ``text`` and ``ord_rej_reason``, which need the status first, take that step again.
    With ``columns``, ``prev_ord_status`` can be asked for too, and only :func:`inputs` of them are read.
    """
    wanted = None if columns is None else tuple(columns)
    has = lambda *names: wanted is None or any(n in wanted for n in names)
    told, late = has(*_TOLD, *_LATE), has(*_LATE)
    kind = F.col("msg_type")
    report, filled_exec = kind == "8", F.when(kind == "8", filled("exec_id"))
    again = lambda c: F.row_number().over(Window.partitionBy("chain_id", c).orderBy("seq")) > 1
    rows = messages.repartition("chain_id")
    # rows that are not reports of an execution never count as a duplicate, nor before one
    if wanted is None or any("exec_id" in _MADE_OF.get(c, ()) and c != "cause_exec_id" for c in wanted):
        rows = rows.withColumn("__exec", filled_exec).withColumn("__dup", F.col("__exec").isNotNull() & again("__exec"))
        fresh = report & ~F.col("__dup")
        rows = rows.withColumn("__exec", F.when(fresh, F.col("__exec")))
    else:
        fresh = F.lit(None).cast("boolean")
    if has("cl_ord_id_history", "chain_key"):
        rows = rows.withColumn("__asked", filled("cl_ord_id"))
        rows = rows.withColumn("__new", F.col("__asked").isNotNull() & ~again("__asked")).drop("__asked")
    if has("new_busted_id", "busted_count"):
        rows = rows.withColumn("__bust", F.when(fresh & decode("exec_trans_type", F.col("exec_trans_type")).isin("CANCEL", "CORRECT"), filled("exec_ref_id")))
        rows = rows.withColumn("__bust", F.when(~again("__bust"), F.col("__bust")))
    if told or has("last_exec_type"):
        rows = rows.withColumn("__exec_type", latest(F.when(fresh & filled("exec_type").isNotNull(), decode("exec_type", F.col("exec_type")))))
    if told:
        given = F.when(filled("ord_status").isNotNull(), (F.array_position(F.lit(_NAMES), decode("ord_status", F.col("ord_status"))) - 1).cast("int"))
        confirms = kind.isin("F", "G", "9") | (fresh & F.col("__exec_type").isin("CANCELED", "REPLACED"))
        does = F.coalesce(*(F.when((kind == k) & (fresh if k == "8" else F.lit(True)), F.lit(n)) for k, n in _DOES.items()), F.lit(0))
        rows = rows.withColumns({
            "__first": F.row_number().over(_chain()) == 1, "__does": does, "__given": given, "__asked": F.when(confirms, filled("cl_ord_id")),
        })
    if late:
        rows = _with_status(rows).repartition("chain_id")
    terms = (kind == "D") | report
    rejected = fresh & ((F.col("__exec_type") == "REJECTED") | (F.col("__after") == "REJECTED"))
    amount = lambda c: F.when(fresh & filled(c).isNotNull(), codec.number(F.col(c), 0))
    term = lambda c: F.when(terms, codec.number(filled(c)))
    own = lambda c: F.coalesce(c, F.lit(0.0))
    parent = F.when(filled(parent_tag).isNotNull(), F.col(parent_tag)) if parent_tag in messages.columns else F.lit(None).cast("string")
    history = lambda: F.collect_list(F.when(F.col("__new"), F.col("cl_ord_id"))).over(_so_far())
    last_id, last_order = latest(F.when(kind != "9", filled("cl_ord_id"))), latest(filled("order_id"))
    made = {
        "chain_id": F.col("chain_id"), "seq": F.col("seq"), "ts": F.col("ts"),
        "order_id": last_order, "cl_ord_id": last_id, "orig_cl_ord_id": latest(filled("orig_cl_ord_id")), "cl_ord_id_history": history(),
        "exec_id_count": F.count("__exec").over(_so_far()).cast("int"), "new_exec_id": F.col("__exec"),
        "account": latest(filled("account")), "symbol": latest(filled("symbol")),
        "side": latest(F.when(filled("side").isNotNull(), decode("side", F.col("side")))),
        "ord_type": latest(F.when(terms & filled("ord_type").isNotNull(), decode("ord_type", F.col("ord_type")))),
        **{c: own(latest(term(c))) for c in ("order_qty", "price", "stop_px")},
        "time_in_force": latest(F.when(terms & filled("time_in_force").isNotNull(), decode("time_in_force", F.col("time_in_force")))),
        "currency": latest(F.when(terms, filled("currency"))),
        "ord_status": F.col("__after"), "last_exec_type": F.col("__exec_type"),
        **{c: own(latest(amount(c))) for c in ("cum_qty", "leaves_qty", "avg_px", "last_qty", "last_px")},
        "last_mkt": latest(F.when(fresh, filled("last_mkt"))),
        "text": latest(F.when(rejected | kind.isin("9", "Q"), filled("text"))),
        "ord_rej_reason": latest(F.when(rejected, codec.whole(F.col("ord_rej_reason")))),
        "cxl_rej_reason": latest(F.when(kind == "9", codec.whole(F.col("cxl_rej_reason")))),
        "busted_count": F.count("__bust").over(_so_far()).cast("int"), "new_busted_id": F.col("__bust"),
        "tagged_parent_id": latest(parent), "cause_parent_id": parent, "update_count": F.row_number().over(_chain()).cast("bigint"),
        "first_seen_ts": F.first("ts").over(_so_far()), "last_update_ts": F.col("ts"), "last_msg_type": kind,
        "cause_msg_type": kind, "cause_cl_ord_id": F.col("cl_ord_id"), "cause_exec_id": F.col("exec_id"),
        "is_terminal": is_terminal(F.col("__after")), "prev_ord_status": F.col("__before"), "chain_key": F.coalesce(F.get(history(), F.lit(0)), last_id, last_order),
    }
    if wanted is None:
        return rows.select(*(c.alias(n) for n, c in made.items() if n != "prev_ord_status"))
    if not told or late:
        return rows.select(*(made[n].alias(n) for n in wanted))
    first = [n for n in dict.fromkeys(("chain_id", "seq", *wanted)) if n not in _TOLD]
    found = _with_status(rows.select(*(made[n].alias(n) for n in first), *_HELPERS))
    return found.select(*(made[n].alias(n) if n in _TOLD else n for n in wanted))


def latest_states(changed: DataFrame) -> DataFrame:
    """The last version of every order, with the lists of its execution ids and busted ids in order (one aggregation; those that ``changed`` tells)."""
    ids = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", c)))), lambda x: x[c])
    kept = [c for c in changed.columns if c not in ("new_exec_id", "new_busted_id")]
    listed = {n: c for n, c in (("exec_ids", "new_exec_id"), ("busted_exec_ids", "new_busted_id")) if c in changed.columns}
    grouped = changed.groupBy("chain_id").agg(F.max_by(F.struct(*kept), "seq").alias("v"), *(ids(c).alias(n) for n, c in listed.items()))
    return grouped.select("v.*", *listed)
