"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions alone.

Every shard has many virtual nodes on a ring of cells.  A key goes clockwise to the next node; the arc before a node is its
catch.  A shard takes no more rows than its bound; rows beyond it walk on clockwise until they meet a shard with room.  With
no slack the bounds sum up to the number of rows, so the shards' counts differ by one at most.

The walk is made on counts per arc, a table whose size depends on the ring alone.  Rows know their rank along the ring from
a range sort, and find their shard and slot by it; so a key that a third of all rows share is nobody's single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemill.llm.common import spare, stored

SHARDS, NODES = 40, 128
#: rows that one partition of the range sort holds, about
PART_ROWS = 500_000


def _place(text: Column) -> Column:
    """Place on a ring of 2^32: the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 8), 16, 10).cast("bigint")


def ring(spark: SparkSession, shards: int = SHARDS, nodes: int = NODES) -> DataFrame:
    """(cell, arc, shard) for each cell of the ring: the next node clockwise, named by its cell, and the shard that has it.

    There are eight to sixteen cells to a virtual node, 65,536 at least.  Of several nodes in a cell the first one counts.
    """
    bits = max(16, (8 * shards * nodes - 1).bit_length())
    point = spark.range(shards * nodes).select((F.col("id") % shards).alias("shard"), F.floor(F.col("id") / shards).alias("node"))
    point = point.withColumn("at", _place(F.concat_ws("#", F.lit("shard"), "shard", "node")))
    point = point.groupBy(F.shiftright("at", 32 - bits).alias("cell")).agg(F.min_by("shard", F.struct("at", "shard")).alias("shard"))
    cells = spark.range(1 << bits).select(F.col("id").alias("cell")).join(point, "cell", "left")
    node = F.when(F.col("shard").isNotNull(), F.struct(F.col("cell").alias("arc"), "shard"))
    back = Window.orderBy(F.desc("cell"))  # over the ring, not the data; a frame that grows from its end costs one step a cell
    ahead = F.last(node, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    # beyond the last node the ring goes on to the first, which is met again as an arc at the end
    begin = F.struct(F.lit(1 << bits).alias("arc"), F.min(node).over(Window.partitionBy())["shard"].alias("shard"))
    return cells.select("cell", F.coalesce(ahead, begin).alias("owner")).select("cell", "owner.arc", "owner.shard")


def walk(arcs: DataFrame, shards: int, slack: float) -> DataFrame:
    """The plan from (arc, shard, rows): per arc what stays at its shard, and where the rest goes.

    Columns: arc, home, low (rows before the arc on the ring), stay, slot (of the first that stays), over (rows that overflow
    before it) and targets, an array of (first, rows, shard, slot) by rank among the rows that overflow.  These queue up in ring
    order: at each node the first in the queue take the room that its shard still has.  After two rounds all have a place.
    """
    before = Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    everything = F.sum("rows").over(Window.partitionBy())
    bound = F.expr(f"div(total, {shards}) + if(shard < total % {shards}, 1, 0)") if slack == 0 else F.ceil(F.col("total") * (1 + slack) / shards)
    counted = arcs.withColumn("total", everything).withColumn("bound", bound.cast("bigint"))
    counted = counted.withColumn("low", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("slot", F.coalesce(F.sum("rows").over(own), F.lit(0)))
    counted = counted.withColumn("stay", F.greatest(F.lit(0), F.least("rows", F.col("bound") - F.col("slot")))).withColumn("more", F.col("rows") - F.col("stay"))
    counted = counted.withColumn("over", F.coalesce(F.sum("more").over(before), F.lit(0)))
    counted = counted.withColumn("room", F.col("bound") - F.sum("stay").over(Window.partitionBy("shard")))
    row = counted.agg(F.array_sort(F.collect_list(F.struct("arc", "shard", "low", "stay", "slot", "more", "over", "bound", "room"))).alias("arcs"))
    rooms = f"transform(sequence(0, {shards - 1}), s -> coalesce(get(filter(arcs, a -> a.shard = s), 0).room, 0L))"
    # waiting: rows in the queue; done: rows that have found a place
    taken = "least(q.waiting + a.more, q.rooms[int(a.shard)])"
    step = f"""if({taken} = 0, struct(q.waiting + a.more as waiting, q.rooms as rooms, q.done as done, q.out as out),
        struct(q.waiting + a.more - {taken} as waiting, transform(q.rooms, (r, i) -> if(i = a.shard, r - {taken}, r)) as rooms, q.done + {taken} as done,
               concat(q.out, array(struct(q.done as first, {taken} as rows, a.shard as shard, a.bound - q.rooms[int(a.shard)] as slot))) as out))"""
    nothing = "cast(array() as array<struct<first:bigint,rows:bigint,shard:bigint,slot:bigint>>)"
    rounds = "concat(transform(arcs, a -> struct(a.more as more, a.shard as shard, a.bound as bound)), transform(arcs, a -> struct(0L as more, a.shard as shard, a.bound as bound)))"
    targets = f"if(a.more > 0, filter(q.out, o -> o.first < a.over + a.more and o.first + o.rows > a.over), {nothing})"
    last = f"transform(arcs, a -> struct(a.arc as arc, a.shard as home, a.low as low, a.stay as stay, a.slot as slot, a.over as over, {targets} as targets))"
    begin = f"struct(0L as waiting, {rooms} as rooms, 0L as done, {nothing} as out)"
    return row.select(F.expr(f"inline(aggregate({rounds}, {begin}, (q, a) -> {step}, q -> {last}))"))


def assign(df: DataFrame, key: str, shards: int = SHARDS, nodes: int = NODES, slack: float = 0.0, ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``shard`` (int, 0 to ``shards`` - 1) and ``slot`` (long, gapless from 0 in each shard).

    A shard takes (1 + ``slack``) of an even share at most; without slack the counts are one apart at most.  ``key`` places a
    row on the ring as text (a null key where the empty text goes); rows of one key are in the order of the columns ``ties``, and
    equal ones may change places.  An empty table gives no rows.  All columns are kept, a taken name gives a spare one.
    """
    spark = df.sparkSession
    at, salt, part, cell, rank = (spare(df, n) for n in ("_at", "_salt", "_part", "_cell", "_rank"))
    shard, slot = spare(df, "shard"), spare(df, "slot")
    # written before anything hangs on the numbers, so that they stay when a task runs again
    placed = stored(df.withColumn(at, _place(F.coalesce(F.col(key).cast("string"), F.lit("")))).withColumn(salt, F.monotonically_increasing_id()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), placed.count() // PART_ROWS + 1)
    order = [at, key, *ties, salt]
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(salt, F.monotonically_increasing_id())
    bits = max(16, (8 * shards * nodes - 1).bit_length())
    ordered = stored(ordered.withColumn(part, F.shiftright(salt, 33)).withColumn(cell, F.shiftright(at, 32 - bits)))
    cells = stored(ring(spark, shards, nodes))
    filled = ordered.groupBy(F.col(cell).alias("cell")).agg(F.count("*").alias("rows"))
    arcs = cells.join(filled, "cell", "left").groupBy("arc", "shard").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    plan = walk(arcs, shards, slack)
    # three tables that are broadcast: as many rows as cells, arcs, and partitions of the sort
    sizes = ordered.groupBy(F.col(part).alias("_p")).agg(F.count("*").alias("_n"))
    firsts = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    lead = F.struct("arc", "home", "low", "stay", "slot", "over", "targets")
    steps = plan.select(F.col("arc").alias("_arc"), lead.alias("_step")).join(cells.select(F.col("cell").alias("_c"), F.col("arc").alias("_arc")), "_arc").select("_c", "_step")
    tables = {"_p": spare(df, "_p"), "_first": spare(df, "_first"), "_c": spare(df, "_c"), "_step": spare(df, "_step")}
    firsts, steps = (t.select(*[F.col(c).alias(tables[c]) for c in t.columns]) for t in (firsts, steps))
    found = ordered.join(F.broadcast(firsts), F.col(part) == F.col(tables["_p"])).join(F.broadcast(steps), F.col(cell) == F.col(tables["_c"]))
    go = f"`{tables['_step']}`"
    found = found.withColumn(rank, F.col(tables["_first"]) + F.col(salt).bitwiseAND((1 << 33) - 1) - F.expr(f"{go}.low"))
    # rank among the rows that overflow, and where the queue takes it
    late = f"({go}.over + `{rank}` - {go}.stay)"
    target = F.expr(f"if(`{rank}` < {go}.stay, named_struct('first', 0L, 'rows', 0L, 'shard', {go}.home, 'slot', {go}.slot + `{rank}`), filter({go}.targets, t -> t.first <= {late} and {late} < t.first + t.rows)[0])")
    return found.withColumn(cell, target).select(
        *df.columns, F.expr(f"`{cell}`.shard").cast("int").alias(shard),
        F.expr(f"`{cell}`.slot + if(`{rank}` < {go}.stay, 0L, {late} - `{cell}`.first)").alias(slot))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, nodes: int = NODES) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 16 more), text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: counts of shards differ by one at most; bytes are not balanced.  ``grown_shard`` is null, as the bounds
    move with the number of shards (few rows move when one is added, see the tests).  A null text has no bytes.  Rows with
    equal ids lie next to each other on the ring, in the order of their checksum and size; equal rows are rows of their own.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("bigint") + 16).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    found = assign(narrow, "doc_id", shards, nodes, 0.0, ("text_crc32", "size"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
