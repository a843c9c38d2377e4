"""Shards by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.llm.scratch import stored

POINTS = 1 << 16


def ring(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """The virtual nodes around the ring: arc (from 0), pos, prev, and in ``order`` the
    shards in the order in which a walk clockwise from the arc first meets them. Of nodes
    on one point the smallest shard's counts. At most shards * vnodes rows."""
    nodes = (spark.range(shards * vnodes)
             .select((F.col("id") / vnodes).cast("int").alias("shard"),
                     F.pmod(F.xxhash64(F.lit("node"), F.col("id")), F.lit(POINTS)).cast("int").alias("pos"))
             .groupBy("pos").agg(F.min("shard").alias("shard")))
    whole = nodes.agg(F.array_sort(F.collect_list(F.struct("pos", "shard"))).alias("nodes"))
    return whole.selectExpr("nodes", "nodes.shard AS owners", "posexplode(nodes) AS (arc, node)").selectExpr(
        "arc", "node.pos AS pos",
        "CASE WHEN arc > 0 THEN nodes[arc - 1].pos ELSE -1 END AS prev",
        "CASE WHEN arc = size(nodes) - 1 THEN true ELSE false END AS last",
        "array_distinct(concat(slice(owners, arc + 1, size(owners)), slice(owners, 1, arc))) AS order")


def points(nodes: DataFrame) -> DataFrame:
    """The arc of each of the ring's points: that of the next node clockwise."""
    own = nodes.selectExpr("arc", "explode(sequence(prev + 1, pos)) AS point")
    around = nodes.where("last").selectExpr("0 AS arc", f"explode(sequence(pos + 1, {POINTS})) AS point")
    return own.unionByName(around).where(f"point < {POINTS}")


FILL = """
aggregate(arcs,
  named_struct('free', free, 'cuts', cast(array() AS array<struct<arc:int,lo:bigint,hi:bigint,shard:int,slot:bigint>>)),
  (done, a) -> aggregate(a.order,
    named_struct('left', a.n, 'free', done.free, 'cuts', done.cuts),
    (s, shard) -> if(s.left = 0 OR s.free[shard] = 0, s, named_struct(
      'left', s.left - least(s.left, s.free[shard]),
      'free', transform(s.free, (x, i) -> if(i = shard, x - least(s.left, x), x)),
      'cuts', concat(s.cuts, array(named_struct(
        'arc', a.arc, 'lo', a.n - s.left, 'hi', a.n - s.left + least(s.left, s.free[shard]), 'shard', shard,
        'slot', room[shard] - s.free[shard]))))),
    s -> named_struct('free', s.free, 'cuts', s.cuts)),
  done -> done.cuts)
"""


def ring_shards(rows: DataFrame, key: str = "doc_id", shards: int = 24, vnodes: int = 64,
                salts: int = 32) -> DataFrame:
    """All rows and columns of ``rows`` with shard (0 to shards - 1) and slot (0, 1, ...
    within the shard). Pass narrow rows: they are shuffled once and stored.

    Each key's hash is a point on a ring on which every shard has ``vnodes`` nodes. A row
    belongs to the next node clockwise; where that node's shard is full, the row goes on
    clockwise to the first shard with room. The shards' rooms add up to the number of rows
    and differ by one at most, so row counts do too, and only overflow leaves the shard
    that the plain ring would choose.

    What overflows is settled on counts per arc, in one walk around the ring: its size
    depends on shards * vnodes only. Rows get their rank in the arc in two steps, by arc and salt
    and then by the counts of the salts; the salt comes from all columns, so rows that
    share a key are spread as well. A shard cuts an arc's ranks at most once when it fills
    up, so there are at most shards * vnodes + shards cuts and these are broadcast.

    Null keys are a key of their own; repeated rows get slots of their own; an empty table
    gives an empty one. Columns named shard or slot are replaced; names beginning with two
    underscores are reserved.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    nodes = stored(ring(spark, shards, vnodes), "ring")
    hashed = rows.withColumns({"__hash": F.xxhash64(F.col(key)),
                               "__salt": F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")})
    hashed = hashed.withColumn("__point", F.shiftrightunsigned("__hash", 48).cast("int"))
    at = points(nodes).select(F.col("point").alias("__point"), F.col("arc").alias("__arc"))
    in_arc = Window.partitionBy("__arc", "__salt").orderBy("__hash", *rows.columns)
    ranked = stored(hashed.join(F.broadcast(at), "__point")
                    .withColumn("__row", F.row_number().over(in_arc) - 1)
                    .drop("__point", "__hash"), "ranked")
    before = Window.partitionBy("__arc").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranked.groupBy("__arc", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    offsets = stored(counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))), "offsets")
    per_arc = offsets.groupBy("__arc").agg(F.sum("__n").alias("n"))
    arcs = (nodes.join(per_arc, nodes["arc"] == per_arc["__arc"]).selectExpr("arc", "n", "order")
            .agg(F.array_sort(F.collect_list(F.struct("arc", "n", "order"))).alias("arcs")))
    room = arcs.selectExpr("arcs", "aggregate(arcs, 0L, (s, a) -> s + a.n) AS total").selectExpr(
        "arcs", f"transform(sequence(0, {shards - 1}), i -> total div {shards}"
                f" + cast(i < total % {shards} AS bigint)) AS room")
    cuts = stored(room.selectExpr("arcs", "room", "room AS free").selectExpr(f"inline({FILL})"), "cuts")
    cuts = cuts.select(*(F.col(c).alias(f"__{c}") for c in cuts.columns))
    offsets = offsets.select(F.col("__arc").alias("__of"), F.col("__salt").alias("__with"), "__before")
    placed = (ranked.join(F.broadcast(offsets), (F.col("__arc") == F.col("__of")) & (F.col("__salt") == F.col("__with")))
              .withColumn("__rank", F.col("__row") + F.col("__before"))
              .withColumnRenamed("__arc", "__in"))
    placed = placed.join(F.broadcast(cuts), (F.col("__in") == F.col("__arc"))
                         & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
    return placed.select(*rows.columns, F.col("__shard").alias("shard"),
                         (F.col("__slot") + F.col("__rank") - F.col("__lo")).alias("slot"))
