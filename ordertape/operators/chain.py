"""Chain resolution: which order every message belongs to.

A message is looked up by its identifiers in the order they are trusted and
binds all of them to the chain it resolves to. What an identifier is bound to
just before a message is decided by one earlier message alone: the last one
that re-pointed it, or else the first that named it. So every message has at
most one earlier message to follow, and its chain is the root of that forest:

1. the first binding of each order id (an aggregation) decides for most
   messages: they follow it, and keep no row of their own until the end;
2. for the others, the first binding of each identifier of the next space tells
   which of their identifiers are known, and so which one they select, and a
   window over the uses of that space finds the last binding message that did
   *not* select that same identifier; messages between the two follow it too,
   so runs of any length are skipped in one step. A space that no message
   still looks into is not read;
3. pointer jumping over the messages that others follow (a small part of all)
   ends after as many rounds as the logarithm of the identifier changes.

Nothing is replayed and no component is gathered: an identifier that a third of
all messages carry is cut into ranges of ``SPLIT`` uses, whose last bindings
are carried over by a second, small window. Stage tables and shuffles go as soon
as no later step reads them, and messages meet their chains by the order id.

``chain_id`` is the sequence number of the chain's first message: stable, and
no global counter is needed. :func:`chain_names` gives the counter names.

Policy A lets every message re-point all of its identifiers. Policy B lets
original and referenced ids bind only if nothing did, knows the identifiers of
each message type, drops messages without identifiers and lets status requests
look up but never bind or open. Identifiers of different spaces never meet: an
order id that equals a client id names another thing, under either policy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordertape.operators.fold import filled
from ordertape.plans import stage

#: (column, identifier space, whether it re-points, message types that carry it; None: all)
PROBES = {
    "A": (("order_id", "O", True, None), ("orig_cl_ord_id", "C", True, None), ("cl_ord_id", "C", True, None), ("exec_id", "E", True, None)),
    "B": (("order_id", "O", True, "8FG9HQ"), ("cl_ord_id", "C", True, "D8FG9H"), ("orig_cl_ord_id", "C", False, "8FG9"), ("exec_id", "E", True, "8Q"),
          ("exec_ref_id", "E", False, "8")),
}
#: Uses of one identifier that a window task takes at most (a larger identifier is cut by sequence ranges).
SPLIT = 1 << 20


def _uses(messages: DataFrame, policy: str) -> Column:
    """``array<struct<probe, id, puts, binds>>`` of a message's identifiers, most trusted first; ``id`` is null for those it lacks."""
    typed = "msg_type" in messages.columns
    found = []
    for k, (column, space, puts, types) in enumerate(PROBES[policy]):
        value = F.concat(F.lit(space + ":"), filled(column))
        if types is not None and typed:
            value = F.when(F.col("msg_type").isin(*types), value)
        binds = F.col("msg_type") != "H" if policy == "B" and typed else F.lit(True)
        found.append(F.struct(F.lit(k).alias("probe"), value.alias("id"), F.lit(puts).alias("puts"), F.coalesce(binds, F.lit(True)).alias("binds")))
    return F.array(*found)


def identifiers(messages: DataFrame, policy: str = "A") -> Column:
    """A message's identifiers with their space, such as ``C:<client id>``."""
    return F.array_compact(F.transform(_uses(messages, policy), lambda u: u["id"]))


def _named(messages: DataFrame, policy: str) -> DataFrame:
    """``messages`` with ``__binds`` and their identifiers ``__0``, ``__1``, ...: by place in :data:`PROBES`, null for those they lack."""
    uses = _uses(messages, policy)
    ids = {f"__{k}": F.get(uses, F.lit(k))["id"] for k in range(len(PROBES[policy]))}
    return messages.withColumns({"__binds": F.get(uses, F.lit(0))["binds"], **ids})


def _ids(places: list[int]) -> Column:
    """The distinct identifiers in these places."""
    return F.array_distinct(F.array_compact(F.array(*(F.col(f"__{k}") for k in places))))


def _selecting(named: DataFrame, asking: DataFrame, policy: str, space: str, split: int) -> DataFrame:
    """``(seq, up)`` of the messages of ``asking`` that select an identifier of a space.

    Only what they ask for is matched with the other uses of the space: a use is its message's number and the identifier, and nothing else.
    """
    places = [k for k, p in enumerate(PROBES[policy]) if p[1] == space]
    every = named.select("seq", "__binds", F.explode(_ids(places)).alias("id"))
    known = stage.save(every.groupBy("id").agg(
        F.min(F.when(F.col("__binds"), F.col("seq"))).alias("first"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.count(F.lit(1)).alias("n")
    ), "chain-known")
    probed = asking.select("seq", F.posexplode(F.array(*(F.col(f"__{k}") for k in places))).alias("probe", "id")).where("id is not null")
    found = probed.join(known.where("first is not null").select("id", "first"), "id").where("first < seq")
    asks = stage.save(found.groupBy("seq").agg(F.min(F.struct("probe", "id", "first")).alias("c")).select("seq", "c.id", "c.first"), "chain-asks")
    puts = named.where("__binds").select("seq", F.explode(_ids([k for k in places if PROBES[policy][k][2]])).alias("id"))
    # an ask stands before the use that it is; a use that is no ask re-points its identifier
    both = asks.select("seq", "id", "first", F.lit(0).alias("use")).unionByName(puts.withColumn("use", F.lit(1)), allowMissingColumns=True)
    large = stage.save(known.where(F.col("n") > split).select("id", "low", "high", F.ceil(F.col("n") / F.lit(split)).cast("int").alias("parts")), "chain-large")
    cut = large.limit(1).count() > 0
    if cut:
        part = ((F.col("seq") - F.col("low")) / (F.col("high") - F.col("low") + 1) * F.col("parts")).cast("int")
        ranged = lambda rows: rows.join(F.broadcast(large), "id", "left").withColumn("part", F.coalesce(part, F.lit(0))).drop("low", "high", "parts")
        both = ranged(both)
    keys = ("id", "part") if cut else ("id",)
    w = Window.partitionBy(*keys).orderBy("seq", "use")
    asked = F.coalesce(F.lag("seq").over(w) == F.col("seq"), F.lit(False))
    marked = both.withColumn("mark", F.when((F.col("use") == 1) & ~asked, F.col("seq")))
    near = marked.withColumn("near", F.max("mark").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("use = 0")
    if not cut:
        return near.select("seq", F.coalesce("near", "first").alias("up"))
    # the last mark of earlier ranges; one row for each range of a large identifier
    marks = ranged(puts.join(F.broadcast(large.select("id")), "id", "left_semi").join(asks, ["id", "seq"], "left_anti"))
    ends = marks.groupBy("id", "part").agg(F.max("seq").alias("mark"))
    ranges = large.select("id", F.explode(F.sequence(F.lit(0), "parts")).alias("part")).join(ends, ["id", "part"], "left")
    before = ranges.select("id", "part", F.max("mark").over(Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    return near.join(before, ["id", "part"], "left").select("seq", F.coalesce("near", "carried", "first").alias("up"))


def _pointers(named: DataFrame, policy: str, split: int) -> tuple[DataFrame, DataFrame]:
    """``(id, first)`` of order ids, and ``(seq, up)`` of the other messages: the earlier message that decides where one belongs.

    ``up`` is null for a message that opens a chain. The order id is trusted most, so a message selects it whenever an earlier one has bound it, and
    only the first that binds it may re-point it: all later ones follow that one, and need no row of their own here. What remains are the first
    messages of the order ids, those without one, and those that bind nothing.
    """
    others = [f"__{k}" for k in range(1, len(PROBES[policy]))]
    of_order = named.where("__0 is not null")
    firsts = stage.save(of_order.where("__binds").groupBy("__0").agg(F.min("seq").alias("first"), F.min_by(F.struct(*others), "seq").alias("x")), "chain-firsts")
    anything = F.lit(True) if policy == "A" else F.col("__binds") & (F.coalesce(*others).isNotNull())
    rest = named.where("__0 is null").select("seq", *others, anything.alias("opens"))
    rest = rest.unionByName(firsts.select(F.col("first").alias("seq"), "x.*", F.lit(True).alias("opens")))
    looking = of_order.where("not __binds").join(firsts.select("__0", "first"), "__0", "left")
    rest = rest.unionByName(looking.where("coalesce(first >= seq, true)").select("seq", *others, F.lit(False).alias("opens")))
    rest = stage.save(rest, "chain-rest")
    found = [looking.where("first < seq").select("seq", F.col("first").alias("up"))]
    for space in dict.fromkeys(p[1] for p in PROBES[policy][1:]):
        mine = [f"__{k}" for k, p in enumerate(PROBES[policy]) if p[1] == space]
        asking = rest.where(F.coalesce(*mine).isNotNull())
        if not asking.limit(1).count():
            continue
        found.append(stage.save(_selecting(named, asking, policy, space, split), "chain-found"))
        following = stage.save(rest.join(found[-1].select("seq"), "seq", "left_anti"), "chain-rest")
        stage.drop(rest)
        rest = following
    pointers = rest.where("opens").select("seq", F.lit(None).cast("bigint").alias("up"))
    for rows in found:
        pointers = pointers.unionByName(rows)
    return firsts.drop("x"), pointers


def resolve(messages: DataFrame, policy: str = "A", split: int = SPLIT, max_rounds: int = 60) -> DataFrame:
    """``messages`` with ``chain_id``; ``seq`` is unique. They are read several times: a stage table of the needed columns is best.

    Under policy A a message without identifiers is a chain of its own; under
    policy B it is dropped, and so is a status request that finds nothing.
    """
    named = _named(messages, policy)
    firsts, pointers = _pointers(named, policy, split)
    found = stage.save(pointers, "chain-pointers")
    # messages that follow an order id have no row yet; those that are followed themselves get theirs
    absent = found.where("up is not null").select(F.col("up").alias("seq")).distinct().join(found.select("seq"), "seq", "left_anti")
    absent = stage.save(absent, "chain-absent")
    if absent.limit(1).count():
        through = named.where("__0 is not null").select("seq", "__0").join(absent, "seq", "left_semi").join(firsts, "__0")
        every = stage.save(found.unionByName(through.select("seq", F.col("first").alias("up"))), "chain-pointers")
        stage.drop(found)
        found = every
    followed = found.where("up is not null").select(F.col("up").alias("seq")).distinct()
    hops = stage.save(found.where("up is not null").join(followed, "seq", "left_semi"), "chain-hops")
    for _ in range(max_rounds):
        further = hops.select(F.col("seq").alias("up"), F.col("up").alias("over"))
        jumped = stage.save(hops.join(further, "up", "left").select("seq", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")), "chain-hops")
        moved = jumped.where("moved").limit(1).count()
        stage.drop(hops)
        hops = jumped.drop("moved")
        hops._stage_path = jumped._stage_path
        if not moved:
            break
    else:
        raise RuntimeError(f"chains did not settle in {max_rounds} rounds")
    roots = hops.select(F.col("seq").alias("up"), F.col("up").alias("root"))
    chains = stage.save(found.join(roots, "up", "left").select("seq", F.coalesce("root", "up", "seq").alias("chain_id")), "chain-chains")
    stage.drop(found, hops)
    orders = stage.save(firsts.join(chains.withColumnRenamed("seq", "first"), "first").select("__0", "chain_id"), "chain-orders")
    kept = [F.col(c) for c in messages.columns]
    by_order = named.where("__0 is not null and __binds").join(orders, "__0").select(*kept, "chain_id")
    others = named.where("__0 is null or not __binds").select(*kept).join(chains, "seq", "left" if policy == "A" else "inner")
    return by_order.unionByName(others.select(*kept, F.coalesce("chain_id", "seq").alias("chain_id")))


def chain_names(resolved: DataFrame) -> DataFrame:
    """``(chain_id, chain_no, chain_name)``: chains numbered by their first message, without a single-task sort."""
    chains = resolved.select("chain_id").distinct()
    spread = stage.save(chains.repartitionByRange("chain_id").sortWithinPartitions("chain_id").withColumn("p", F.spark_partition_id()), "chains")
    inside = spread.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy("chain_id")))
    # one row per partition
    before = spread.groupBy("p").count().select(
        "p", (F.sum("count").over(Window.orderBy("p")) - F.col("count")).alias("base")
    )
    return inside.join(F.broadcast(before), "p").select(
        "chain_id", (F.col("base") + F.col("n")).cast("bigint").alias("chain_no"), F.concat(F.lit("chain-"), (F.col("base") + F.col("n")).cast("string")).alias("chain_name")
    )


def order_keys(resolved: DataFrame) -> DataFrame:
    """``(chain_id, order_key, previous_key, seq)``: policy B's changing key of an order, one row for each change.

    The key is the client id (else the original id) of the first message until a message brings an order id, which then renames the order.
    """
    types = {column: types for column, _, _, types in PROBES["B"]}
    held = lambda c: F.when(F.col("msg_type").isin(*types[c]), filled(c))
    w = Window.partitionBy("chain_id").orderBy("seq")
    named = F.when(F.col("msg_type") != "H", held("order_id"))
    first = F.when(F.row_number().over(w) == 1, F.coalesce(held("cl_ord_id"), held("orig_cl_ord_id")))
    keys = resolved.select("chain_id", "seq", F.coalesce(named, first).alias("order_key")).where("order_key is not null")
    return keys.withColumn("previous_key", F.lag("order_key").over(w)).where("not (order_key <=> previous_key)").select("chain_id", "order_key", "previous_key", "seq")


def id_index(resolved: DataFrame, policy: str = "A") -> DataFrame:
    """``(id_kind, id_value, chain_id, seq)``: the chain each identifier points to after the last message.

    The last message that re-points an identifier decides, else the first that names it.
    """
    uses = resolved.select("seq", "chain_id", F.explode(_uses(resolved, policy)).alias("u")).where("u.binds and u.id is not null")
    put = F.col("u.puts")
    bound = uses.groupBy("u.id").agg(
        F.max_by(F.struct("chain_id", "seq"), F.when(put, F.col("seq"))).alias("last"), F.min_by(F.struct("chain_id", "seq"), "seq").alias("first")
    ).select("id", F.coalesce("last", "first").alias("x"))
    return bound.select(F.substring("id", 1, 1).alias("id_kind"), F.expr("substring(id, 3)").alias("id_value"), "x.chain_id", "x.seq")


def load_index(spark: SparkSession, states: DataFrame) -> DataFrame:
    """The index rebuilt from latest states alone (ids that a state still knows)."""
    pairs = F.concat(
        F.when(F.col("order_id").isNotNull(), F.array(F.struct(F.lit("O").alias("k"), F.col("order_id").alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>")),
        F.transform("cl_ord_id_history", lambda x: F.struct(F.lit("C").alias("k"), x.alias("v"))),
        F.transform("exec_ids", lambda x: F.struct(F.lit("E").alias("k"), x.alias("v"))),
    )
    return states.select("chain_id", "seq", F.explode(pairs).alias("x")).select(F.col("x.k").alias("id_kind"), F.col("x.v").alias("id_value"), "chain_id", "seq")
