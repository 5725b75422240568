"""Code sets and the field dictionary of the message protocol.

The values below are fixed by the FIX 4.2 specification.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Wire codes and short names.
SIDE = {"1": "BUY", "2": "SELL", "3": "BUY_MINUS", "4": "SELL_PLUS", "5": "SELL_SHORT", "6": "SELL_SHORT_EXEMPT",
        "7": "UNDISCLOSED", "8": "CROSS", "9": "CROSS_SHORT"}
ORD_TYPE = {"1": "MARKET", "2": "LIMIT", "3": "STOP", "4": "STOP_LIMIT", "5": "MARKET_ON_CLOSE", "6": "WITH_OR_WITHOUT",
            "7": "LIMIT_OR_BETTER", "8": "LIMIT_WITH_OR_WITHOUT", "9": "ON_BASIS", "A": "ON_CLOSE", "B": "LIMIT_ON_CLOSE", "P": "PEGGED"}
TIME_IN_FORCE = {"0": "DAY", "1": "GTC", "2": "OPG", "3": "IOC", "4": "FOK", "5": "GTX", "6": "GTD"}
ORD_STATUS = {"0": "NEW", "1": "PARTIALLY_FILLED", "2": "FILLED", "3": "DONE_FOR_DAY", "4": "CANCELED", "5": "REPLACED",
              "6": "PENDING_CANCEL", "7": "STOPPED", "8": "REJECTED", "9": "SUSPENDED", "A": "PENDING_NEW", "B": "CALCULATED",
              "C": "EXPIRED", "D": "ACCEPTED_FOR_BIDDING", "E": "PENDING_REPLACE"}
EXEC_TYPE = {"0": "NEW", "1": "PARTIAL_FILL", "2": "FILL", "3": "DONE_FOR_DAY", "4": "CANCELED", "5": "REPLACED",
             "6": "PENDING_CANCEL", "7": "STOPPED", "8": "REJECTED", "9": "SUSPENDED", "A": "PENDING_NEW", "B": "CALCULATED",
             "C": "EXPIRED", "D": "RESTATED", "E": "PENDING_REPLACE"}
EXEC_TRANS_TYPE = {"0": "NEW", "1": "CANCEL", "2": "CORRECT", "3": "STATUS"}
CXL_REJ_RESPONSE_TO = {"1": "ORDER_CANCEL_REQUEST", "2": "ORDER_CANCEL_REPLACE_REQUEST"}
DOMAINS = {"side": SIDE, "ord_type": ORD_TYPE, "time_in_force": TIME_IN_FORCE, "ord_status": ORD_STATUS, "exec_type": EXEC_TYPE,
           "exec_trans_type": EXEC_TRANS_TYPE, "cxl_rej_response_to": CXL_REJ_RESPONSE_TO}
TERMINAL = ("FILLED", "CANCELED", "REJECTED", "EXPIRED", "DONE_FOR_DAY")
UNSPECIFIED = "UNSPECIFIED"

# Tag numbers, names and types.
FIELDS = [
    (8, "BeginString", "STRING"), (9, "BodyLength", "LENGTH"), (35, "MsgType", "STRING"), (34, "MsgSeqNum", "INT"),
    (49, "SenderCompID", "STRING"), (56, "TargetCompID", "STRING"), (50, "SenderSubID", "STRING"), (57, "TargetSubID", "STRING"),
    (52, "SendingTime", "UTC_TIMESTAMP"), (43, "PossDupFlag", "BOOLEAN"), (97, "PossResend", "BOOLEAN"),
    (115, "OnBehalfOfCompID", "STRING"), (128, "DeliverToCompID", "STRING"),
    (93, "SignatureLength", "LENGTH"), (89, "Signature", "DATA"), (10, "CheckSum", "STRING"),
    (11, "ClOrdID", "STRING"), (41, "OrigClOrdID", "STRING"), (37, "OrderID", "STRING"), (198, "SecondaryOrderID", "STRING"),
    (17, "ExecID", "STRING"), (19, "ExecRefID", "STRING"), (66, "ListID", "STRING"), (526, "SecondaryClOrdID", "STRING"),
    (1, "Account", "STRING"), (55, "Symbol", "STRING"), (54, "Side", "CHAR"), (40, "OrdType", "CHAR"), (38, "OrderQty", "QTY"),
    (44, "Price", "PRICE"), (99, "StopPx", "PRICE"), (59, "TimeInForce", "CHAR"), (15, "Currency", "CURRENCY"), (21, "HandlInst", "CHAR"),
    (126, "ExpireTime", "UTC_TIMESTAMP"), (60, "TransactTime", "UTC_TIMESTAMP"),
    (39, "OrdStatus", "CHAR"), (150, "ExecType", "CHAR"), (20, "ExecTransType", "CHAR"), (14, "CumQty", "QTY"), (151, "LeavesQty", "QTY"),
    (6, "AvgPx", "PRICE"), (32, "LastShares", "QTY"), (31, "LastPx", "PRICE"), (30, "LastMkt", "EXCHANGE"),
    (58, "Text", "STRING"), (103, "OrdRejReason", "INT"), (102, "CxlRejReason", "INT"), (434, "CxlRejResponseTo", "CHAR"), (127, "DKReason", "CHAR"),
    (78, "NoAllocs", "NUM_IN_GROUP"), (79, "AllocAccount", "STRING"), (80, "AllocShares", "QTY"),
    (382, "NoContraBrokers", "NUM_IN_GROUP"), (375, "ContraBroker", "STRING"), (337, "ContraTrader", "STRING"),
    (437, "ContraTradeQty", "QTY"), (438, "ContraTradeTime", "UTC_TIMESTAMP"),
    (347, "MessageEncoding", "STRING"), (354, "EncodedTextLen", "LENGTH"), (355, "EncodedText", "DATA"),
]
HEADER = (8, 9, 35, 34, 49, 56, 50, 57, 52, 43, 97, 115, 128)
TRAILER = (93, 89, 10)
MESSAGES = {"D": "NewOrderSingle", "8": "ExecutionReport", "9": "OrderCancelReject", "F": "OrderCancelRequest",
            "G": "OrderCancelReplaceRequest", "H": "OrderStatusRequest", "Q": "DontKnowTrade"}
#: count tag -> (delimiter tag, member tags, message types)
GROUPS = {78: (79, (79, 80), ("D", "G")), 382: (375, (375, 337, 437, 438), ("8",))}
#: length tag -> data tag
DATA_FIELDS = {90: 91, 93: 89, 95: 96, 348: 349, 350: 351, 352: 353, 354: 355}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def decode(domain: str, code: Column) -> Column:
    """Short name of a wire code; unknown and null codes are UNSPECIFIED (NEW for the transaction type)."""
    fallback = "NEW" if domain == "exec_trans_type" else UNSPECIFIED
    return F.coalesce(F.try_element_at(_map(DOMAINS[domain]), F.coalesce(code, F.lit(""))), F.lit(fallback))


def encode(domain: str, name: Column) -> Column:
    """Wire code of a short name; empty for UNSPECIFIED, unknown and null names."""
    back = {v: k for k, v in DOMAINS[domain].items()}
    return F.coalesce(F.try_element_at(_map(back), F.coalesce(name, F.lit(""))), F.lit(""))


def is_terminal(status: Column) -> Column:
    return F.coalesce(status.isin(*TERMINAL), F.lit(False))


def dictionary(spark: SparkSession) -> DataFrame:
    """``(tag, name, type, section, count_tag, is_delimiter)``: small enough to broadcast always."""
    member = {t: count for count, (_, members, _) in GROUPS.items() for t in members}
    first = {d for d, _, _ in GROUPS.values()}
    rows = [
        (tag, name, kind, "header" if tag in HEADER else "trailer" if tag in TRAILER else "body", member.get(tag), tag in first)
        for tag, name, kind in FIELDS
    ]
    return spark.createDataFrame(rows, "tag int, name string, type string, section string, count_tag int, is_delimiter boolean")
