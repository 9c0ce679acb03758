"""As-of join: to every left row the last right row of its key that isn't later.

Both sides lie in one table ordered by key and time and are cut into range partitions, so a key that holds a third of all rows
is spread over as many partitions as it needs.  Within a partition the last right row is carried forward by a window;
over the partitions' bounds goes one row for each partition and the key that it goes on with, however long the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlake.runtime import Scratch


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, tie: str | None = None, strict: bool = False, prefix: str = "right_", scratch: Scratch | None = None) -> DataFrame:
    """All left rows with the columns of the right row of the same ``key`` whose ``time`` is the latest not after theirs (``strict``:
    before theirs), named with ``prefix``; null where there is none.

    Of right rows of one time the one with the largest ``tie`` counts (any where it isn't given and they are alike in
    all).  Rows with a null key or time match nothing: left ones keep nulls.  Rows that repeat stay as often as they are.
    """
    scratch = scratch or Scratch(left.sparkSession, "asof")
    mine = F.struct(*(F.col(c) for c in left.columns))
    own = F.struct(*(F.col(c) for c in right.columns))
    kind = right.select(own.alias("r")).schema["r"].dataType
    mine_kind = left.select(mine.alias("l")).schema["l"].dataType
    usable = F.col(key).isNotNull() & F.col(time).isNotNull()
    # at one time right rows come first, or last where they must be earlier
    rights = right.where(usable).select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(2 if strict else 0).alias("side"), (F.col(tie) if tie else F.lit(None).cast("long")).alias("tie"), F.lit(None).cast(mine_kind).alias("l"), own.alias("r"))
    lefts = left.where(usable).select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(rights.schema["tie"].dataType).alias("tie"), mine.alias("l"), F.lit(None).cast(kind).alias("r"))
    order = ["t", "side", "tie"]
    salt = F.monotonically_increasing_id()  # rows alike in all else are split by it
    ranged = lefts.unionByName(rights).withColumn("salt", salt).repartitionByRange("k", *order, "salt").withColumn("part", F.spark_partition_id())
    ranged = scratch.keep(ranged, "ranged")
    # the last right row of a key in each of its partitions, and of those before
    place = F.struct("t", "side", "tie", "salt")
    ends = ranged.groupBy("k", "part").agg(F.max_by("r", F.when(F.col("r").isNotNull(), place)).alias("r"))
    earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("k", "part", F.last("r", ignorenulls=True).over(earlier).alias("before")).where("before is not null")
    so_far = Window.partitionBy("part", "k").orderBy(*order, "salt").rowsBetween(Window.unboundedPreceding, 0)
    seen = ranged.withColumn("last", F.last("r", ignorenulls=True).over(so_far)).where("side = 1").select("k", "part", "l", "last")
    # a partition goes on with one key at most, so these are no more rows than partitions
    found = seen.join(F.broadcast(carried), ["k", "part"], "left").select("l", F.coalesce("last", "before").alias("r"))
    out = [*(F.col("l")[c].alias(c) for c in left.columns), *(F.col("r")[c].alias(prefix + c) for c in right.columns)]
    odd = left.where(~F.coalesce(usable, F.lit(False))).select(mine.alias("l"), F.lit(None).cast(kind).alias("r"))
    return found.select(*out).unionByName(odd.select(*out))
