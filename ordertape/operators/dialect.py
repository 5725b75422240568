"""The second message dialect: structured groups, the fold with duplicate, stale and pending rules.

Its fold decides every message by what was *applied* before (a stale report does
not move the time that later reports are compared with, and only the last
``seen_limit`` execution ids count as seen), so it is one pass over rows sorted
by order and sequence, with the state of one order in memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertape.operators.chain import PROBES
from ordertape.operators.fold import filled

# Count tag -> (delimiter, members, nested groups by count tag).
FEES = {136: (137, (137, 138, 139), {})}
GROUPS = {78: (79, (79, 80, 366), FEES), 382: (375, (375, 337, 437, 438), {})}
TERMINAL = ("2", "4", "8", "C")
SEEN_LIMIT = 64


def has_identity(policy: str = "B") -> Column:
    """Whether a lifted message carries any identifier of a policy."""
    return F.coalesce(*(filled(column) for column, _, _, _ in PROBES[policy])).isNotNull()


class GroupError(ValueError):
    pass


def read_groups(fields: list[tuple[int, str]], groups: dict = GROUPS) -> tuple[list[tuple[int, str]], list[dict]]:
    """Body fields and groups; a group is ``{"count_tag", "entries": [{"fields", "groups"}]}`` and may nest.

    At most the declared number of entries is taken; a member before the
    delimiter opens an entry; a count that is no number or negative is an error.
    """

    def group(at: int, count_tag: int, definition: tuple) -> tuple[dict, int]:
        delimiter, members, nested = definition
        text = fields[at][1]
        if not text.lstrip("+-").isascii() or not text.lstrip("+-").isdigit():
            raise GroupError(f"{count_tag} is no number")
        declared, at = int(text), at + 1
        if declared < 0:
            raise GroupError(f"{count_tag} is negative")
        entries: list[dict] = []
        while at < len(fields):
            tag = fields[at][0]
            if tag not in members and tag not in nested:
                break
            if not entries or tag == delimiter:
                if len(entries) >= declared:
                    break
                entries.append({"fields": [], "groups": []})
            if tag in nested:
                inner, at = group(at, tag, nested[tag])
                entries[-1]["groups"].append(inner)
            else:
                entries[-1]["fields"].append(fields[at])
                at += 1
        return {"count_tag": count_tag, "entries": entries}, at

    body, found, at = [], [], 0
    while at < len(fields):
        if fields[at][0] in groups:
            one, at = group(at, fields[at][0], groups[fields[at][0]])
            found.append(one)
        else:
            body.append(fields[at])
            at += 1
    return body, found


_FIELD = "struct<tag:int,value:string>"
_INNER = f"struct<count_tag:int,entries:array<struct<fields:array<{_FIELD}>>>>"
_OUTER = f"array<struct<count_tag:int,entries:array<struct<fields:array<{_FIELD}>,groups:array<{_INNER}>>>>>"
STRUCTURED = f"struct<body:array<{_FIELD}>,groups:{_OUTER},error:string>"


def _structure(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    def plain(fields):
        return [{"tag": t, "value": v} for t, v in fields]

    def entry(e, deep):
        out = {"fields": plain(e["fields"])}
        return out | {"groups": [{"count_tag": g["count_tag"], "entries": [entry(x, False) for x in g["entries"]]} for g in e["groups"]]} if deep else out

    for fields in parts:
        body, groups, errors = [], [], []
        for f in fields:
            try:
                rest, found = read_groups([(int(x["tag"]), x["value"]) for x in f]) if f is not None else ([], [])
                error = None if f is not None else "no fields"
            except GroupError as e:
                rest, found, error = [], [], str(e)
            body.append(plain(rest))
            groups.append([{"count_tag": g["count_tag"], "entries": [entry(e, True) for e in g["entries"]]} for g in found])
            errors.append(error)
        yield pd.DataFrame({"body": body, "groups": groups, "error": errors})


def structured(messages: DataFrame, fields_col: str = "fields") -> DataFrame:
    """``messages`` with ``structure``: body, groups (two levels) and what is wrong with them.

    Only messages that hold a count tag reach the Python worker with their fields.
    """
    f = F.col(fields_col)
    grouped = F.exists(f, lambda x: x["tag"].isin(*GROUPS))
    reader = F.pandas_udf(_structure, STRUCTURED)
    plain = F.struct(f.alias("body"), F.array().cast(_OUTER).alias("groups"), F.when(f.isNull(), F.lit("no fields")).alias("error"))
    return messages.withColumn("structure", F.when(grouped, reader(F.when(grouped, f))).otherwise(plain))


_TEXT = ("cl_ord_id", "orig_cl_ord_id", "order_id", "account", "symbol", "side", "ord_type", "time_in_force", "ord_status", "exec_type", "exec_trans_type",
         "text", "ord_rej_reason", "cxl_rej_reason", "cxl_rej_response_to", "dk_reason", "transact_ts")
_NUMBER = ("order_qty", "price", "stop_px", "last_qty", "last_px", "leaves_qty", "cum_qty", "avg_px")
# What a message of each type lays over the state, wherever it says something.
OVERLAY = {
    "D": ("cl_ord_id account symbol side ord_type time_in_force text transact_ts order_qty price stop_px").split(),
    "8": [c for c in (*_TEXT, *_NUMBER) if c not in ("cxl_rej_reason", "cxl_rej_response_to", "dk_reason")],
    "G": ("orig_cl_ord_id cl_ord_id account symbol side ord_type time_in_force transact_ts order_qty price stop_px").split(),
    "F": ("orig_cl_ord_id cl_ord_id account symbol side transact_ts order_qty").split(),
    "9": ("orig_cl_ord_id cl_ord_id ord_status cxl_rej_reason cxl_rej_response_to text account transact_ts").split(),
    "Q": ("order_id symbol side dk_reason text").split(),
    "H": [],
}
_NAMES_ORDER = {column for column, space, _, _ in PROBES["B"] if space == "O"}
_STATE = (*_TEXT, *_NUMBER)
VERSIONS = (
    "chain_id bigint, seq bigint, applied boolean, version bigint, " + ", ".join(f"{c} string" for c in _TEXT) + ", " + ", ".join(f"{c} double" for c in _NUMBER)
    + ", pending_cancel boolean, pending_replace boolean, dk_trade boolean, last_exec_id string, seen_exec_ids array<string>, cl_ord_id_history array<string>"
    + ", last_msg_type string"
)


class Order:
    """State of one order under the second dialect's rules."""

    def __init__(self, seen_limit: int, apply_stale: bool) -> None:
        self.limit, self.apply_stale = seen_limit, apply_stale
        self.now: dict = dict.fromkeys(_STATE)
        self.version, self.last = 0, None
        self.cancel = self.replace = self.dk = False
        self.exec_id, self.seen, self.history = None, [], []

    def _lay(self, row: dict, names: list[str]) -> None:
        for c in names:
            if row[c] is not None:
                self.now[c] = row[c]

    def _executed(self, row: dict) -> None:
        if row["exec_id"] is not None:
            self.exec_id = row["exec_id"]
            if row["exec_id"] not in self.seen:
                self.seen = [*self.seen, row["exec_id"]][-self.limit:]

    def _remember(self, row: dict) -> None:
        if row["cl_ord_id"] is not None and row["cl_ord_id"] not in self.history:
            self.history = [*self.history, row["cl_ord_id"]]

    def take(self, row: dict) -> bool:
        """Apply a message; whether it changed more than identity."""
        kind, now = row["msg_type"], self.now
        applied = True
        if kind == "8" and row["exec_id"] in self.seen and row["exec_trans_type"] in (None, "0"):
            self._lay(row, ["cl_ord_id", "orig_cl_ord_id", "order_id"])
            self._executed(row)
            self._remember(row)
            applied = False
        elif kind == "8" and not self.apply_stale and None not in (row["transact_ts"], now["transact_ts"]) and row["transact_ts"] < now["transact_ts"]:
            self._executed(row)
            applied = False
        else:
            self._lay(row, OVERLAY.get(kind, []))
            if kind in "D8GF9":
                self._remember(row)
            if kind == "D":
                now["ord_status"] = now["ord_status"] or "A"
                if row["order_qty"] is not None:
                    now["leaves_qty"] = row["order_qty"] if now["leaves_qty"] is None else now["leaves_qty"]
                    now["cum_qty"] = 0.0 if now["cum_qty"] is None else now["cum_qty"]
            elif kind == "8":
                self._executed(row)
                status = now["ord_status"]
                if status is not None:
                    self.cancel, self.replace = status == "6", status == "E"
            elif kind in "FG" and now["ord_status"] not in TERMINAL:
                now["ord_status"] = now["exec_type"] = "6" if kind == "F" else "E"
                self.cancel, self.replace = self.cancel or kind == "F", self.replace or kind == "G"
            elif kind == "9":
                self.cancel = self.cancel and row["cxl_rej_response_to"] == "2"
                self.replace = self.replace and row["cxl_rej_response_to"] == "1"
            elif kind == "Q":
                self._executed(row)
                self.dk = True
            self.version, self.last = self.version + 1, kind
        if kind in "8FG9Q" and row["order_id"] is not None:  # identifiers are bound whatever became of the message
            now["order_id"] = row["order_id"]
        return applied


def versions(resolved: DataFrame, seen_limit: int = SEEN_LIMIT, apply_stale: bool = False) -> DataFrame:
    """One row per message (:data:`VERSIONS`): the order's state after it. ``resolved`` has lifted columns and ``chain_id`` (policy B).

    ``version`` counts applied messages. An order is bounded by what its state
    holds, not by the number of its messages.
    """
    names = ("chain_id", "seq", "msg_type", *_TEXT, *_NUMBER, "exec_id")
    blank = lambda c: filled(c).alias(c)
    rows = resolved.select(
        F.col("chain_id").cast("bigint"), "seq", "msg_type", *(blank(c) for c in _TEXT), *(F.trim(c).try_cast("double").alias(c) for c in _NUMBER), blank("exec_id")
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, order = None, None
        for part in parts:
            out = []
            columns = [part[c].astype(object).where(part[c].notna(), None).tolist() for c in names]
            for values in zip(*columns):
                row = dict(zip(names, values))
                if order is None or row["chain_id"] != chain:
                    chain, order = row["chain_id"], Order(seen_limit, apply_stale)
                applied = order.take(row)
                out.append((chain, row["seq"], applied, order.version, *(order.now[c] for c in _STATE), order.cancel, order.replace, order.dk, order.exec_id,
                            order.seen, order.history, order.last))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in VERSIONS.split(", ")])

    return rows.repartition("chain_id").sortWithinPartitions("chain_id", "seq").mapInPandas(run, VERSIONS)
