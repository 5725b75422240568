"""Schemas of the two archive datasets and of a folded order state."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L, _I, _B, _TS, _DT = (
    T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampNTZType(), T.DateType()
)


def _struct(*parts: tuple[T.DataType, str]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for kind, names in parts for name in names.split()])


FIX_MESSAGES = _struct(
    (_DT, "event_date"), (_TS, "ts"), (_S, "writer_id"), (_L, "ingest_seq"),
    (_S, "msg_type account symbol cl_ord_id orig_cl_ord_id order_id exec_id exec_ref_id secondary_cl_ord_id side ord_type"),
    (_D, "order_qty price stop_px"), (_S, "time_in_force currency ord_status exec_type exec_trans_type"), (_D, "last_qty last_px"),
    (_S, "last_mkt"), (_D, "cum_qty leaves_qty avg_px"), (_S, "text"), (_I, "ord_rej_reason cxl_rej_reason"), (_S, "cxl_rej_response_to dk_reason"),
    (_TS, "sending_ts transact_ts"), (_L, "msg_seq_num"), (_S, "sender_comp_id target_comp_id poss_dup_flag raw_fix"),
)

ORDER_STATE = _struct(
    (_DT, "event_date"), (_TS, "ts"), (_S, "writer_id"), (_L, "ingest_seq"),
    (_S, "chain_key order_id cl_ord_id orig_cl_ord_id account symbol side ord_type"), (_D, "order_qty price stop_px"),
    (_S, "time_in_force currency ord_status prev_ord_status last_exec_type"), (_B, "is_terminal"), (_D, "cum_qty leaves_qty avg_px last_qty last_px"),
    (_S, "last_mkt text"), (_I, "ord_rej_reason cxl_rej_reason"), (_S, "parent_order_id"), (_B, "is_parent"), (_I, "child_order_count"),
    (_S, "cl_ord_id_chain"), (_I, "exec_id_count"), (_L, "update_count"), (_TS, "first_seen_ts last_update_ts"),
    (_S, "last_msg_type change_kind cause_msg_type cause_cl_ord_id cause_exec_id"),
)

#: Tag of every message column that the fold and the archive read, with its archive type.
LIFTED = {
    "msg_type": (35, _S), "account": (1, _S), "symbol": (55, _S), "cl_ord_id": (11, _S), "orig_cl_ord_id": (41, _S), "order_id": (37, _S),
    "exec_id": (17, _S), "exec_ref_id": (19, _S), "secondary_cl_ord_id": (526, _S), "side": (54, _S), "ord_type": (40, _S),
    "order_qty": (38, _D), "price": (44, _D), "stop_px": (99, _D), "time_in_force": (59, _S), "currency": (15, _S), "ord_status": (39, _S),
    "exec_type": (150, _S), "exec_trans_type": (20, _S), "last_qty": (32, _D), "last_px": (31, _D), "last_mkt": (30, _S), "cum_qty": (14, _D),
    "leaves_qty": (151, _D), "avg_px": (6, _D), "text": (58, _S), "ord_rej_reason": (103, _I), "cxl_rej_reason": (102, _I),
    "cxl_rej_response_to": (434, _S), "dk_reason": (127, _S), "sending_ts": (52, _TS), "transact_ts": (60, _TS), "msg_seq_num": (34, _L),
    "sender_comp_id": (49, _S), "target_comp_id": (56, _S), "poss_dup_flag": (43, _S),
}
