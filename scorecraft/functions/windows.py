"""Skew-safe building blocks for per-key order logic.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task.  The
helpers here keep per-key order logic bounded when one key holds a large share
of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


RANGES = 1 << 15              # of a group's span that a counting round tells apart
FEW = 100_000                 # groups whose table is broadcast
RANKED = 1_000_000            # rows of a group that one task may rank


def first_n_per_group(df: DataFrame, group_cols: list[str], position: Column, quotas: DataFrame, most: int) -> DataFrame:
    """The rows of smallest ``position`` of every group, as many as ``quotas`` (group_cols,
    quota) says, none more than ``most``: ranked in two stages where ``most`` bounds the last
    one, else by ``first_n_by_threshold``.  Ties go by the columns in order."""
    buckets = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if most * buckets > RANKED:
        return first_n_by_threshold(df, group_cols, position, quotas)
    first = top_n_per_group(df.withColumn("_pos", position), group_cols, [F.col("_pos"), *[F.col(c) for c in df.columns]], most)
    return first.join(quotas, group_cols).filter("_rank <= quota").select(*df.columns)


def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list[Column],
                    n: int, rank_col: str = "_rank") -> DataFrame:
    """Keep the first ``n`` rows per group (ties broken by ``order_cols``): the first
    ``n`` of every (group, hash bucket of the whole row) are found in parallel, then the first
    ``n`` of those.  The last stage sees at most ``buckets * n`` rows of a group."""
    buckets = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(buckets)))
    for keys in ([*group_cols, "_salt"], group_cols):
        w = Window.partitionBy(*keys).orderBy(*order_cols)
        salted = salted.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)
    return salted.drop("_salt")


def first_n_by_threshold(df: DataFrame, group_cols: list[str], position: Column, quotas: DataFrame,
                         rounds: int = 2, ranges: int = RANGES) -> DataFrame:
    """The rows of ``df`` whose ``position`` (whole numbers less than 2**62 apart) is among the
    smallest of their group, as many as ``quotas`` (group_cols, quota) says.

    A distributed k-th smallest: every round cuts each group's interval that still holds the
    border into ``ranges`` ranges, counts rows per range (partial sums, so a group may be all
    rows) and keeps the one range with the border; then one filter takes all rows below it.
    No task ranks a group.  Only rows in the last range, 1/``ranges`` ** ``rounds`` of the
    group's span, are ranked (ties by the columns in order)."""
    # Groups are labels or categories, a few; a larger table of them is joined as Spark sees fit.
    hint = F.broadcast if quotas.limit(FEW + 1).count() <= FEW else (lambda table: table)
    rows = df.withColumn("_pos", position.cast("long"))
    spans = rows.groupBy(*group_cols).agg(F.min("_pos").alias("_low"), (F.max("_pos") - F.min("_pos") + 1).alias("_width"))
    # Per group: the interval [_low, _low + _width) with the border, and the rows wanted in it.
    state = spans.join(hint(quotas), group_cols).select(*group_cols, "_low", "_width", F.col("quota").cast("long").alias("_need"))
    within = (F.col("_pos") >= F.col("_low")) & (F.col("_pos") < F.col("_low") + F.col("_width"))
    for _ in range(rounds):
        state = state.withColumn("_step", F.expr(f"(_width + {ranges - 1}) div {ranges}"))
        held = (rows.join(hint(state), group_cols).filter(within)
                .groupBy(*group_cols, "_low", "_width", "_step", "_need", F.expr("(_pos - _low) div _step").alias("_r"))
                .agg(F.count(F.lit(1)).alias("_n")))
        # At most ``ranges`` rows of a group, gathered in one array.
        border = held.groupBy(*group_cols, "_low", "_width", "_step", "_need").agg(
            F.sort_array(F.collect_list(F.struct("_r", "_n"))).alias("_h"))
        # The ranges before the border and the rows in them; a group that wants all its rows has no border.
        walk = F.aggregate("_h", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("r")),
                           lambda a, x: F.when(a["r"] >= 0, a).when(a["seen"] + x["_n"] >= F.col("_need"),
                                                                  F.struct(a["seen"].alias("seen"), x["_r"].alias("r")))
                           .otherwise(F.struct((a["seen"] + x["_n"]).alias("seen"), a["r"].alias("r"))))
        found = F.col("_w.r") >= 0
        state = border.withColumn("_w", walk).select(
            *group_cols, F.when(found, F.col("_low") + F.col("_w.r") * F.col("_step")).otherwise(F.col("_low")).alias("_low"),
            F.when(found, F.col("_step")).otherwise(F.col("_width")).alias("_width"),
            F.when(found, F.col("_need") - F.col("_w.seen")).otherwise(F.col("_need")).alias("_need"), (~found).alias("_all"))
    cut = rows.join(hint(state), group_cols)
    sure = cut.filter((F.col("_pos") < F.col("_low")) | F.col("_all"))
    order = Window.partitionBy(*group_cols).orderBy("_pos", *df.columns)
    last = (cut.filter(within & ~F.col("_all")).withColumn("_i", F.row_number().over(order))
            .filter(F.col("_i") <= F.col("_need")).drop("_i"))
    return sure.unionByName(last).drop("_pos", "_low", "_width", "_need", "_all")


def running_max_blocked(df: DataFrame, keys: list[str], pos_col: str, value: Column,
                        out_col: str, block: int = 4096) -> DataFrame:
    """Running ``max(value)`` over rows ordered by the integer ``pos_col`` within
    ``keys`` (inclusive of the current row).

    Two-level scan: positions are cut into blocks of ``block`` rows; the window
    runs within (keys, block) so no task holds more than one block of a key,
    and the carry from earlier blocks comes from a per-block aggregate that is
    ``block`` times smaller than the input.
    """
    blk = "_blk"
    val = "_val"
    d = df.withColumn(blk, F.floor(F.col(pos_col) / F.lit(block))).withColumn(val, value)
    w_in = (Window.partitionBy(*keys, blk).orderBy(pos_col)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("_in_blk", F.max(val).over(w_in))
    per_blk = d.groupBy(*keys, blk).agg(F.max(val).alias("_blk_max"))
    w_prev = (Window.partitionBy(*keys).orderBy(blk)
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = per_blk.select(*keys, blk, F.max("_blk_max").over(w_prev).alias("_carry"))
    return (d.join(carry, [*keys, blk], "left")
            .withColumn(out_col, F.greatest(F.col("_in_blk"), F.col("_carry")))
            .drop(blk, val, "_in_blk", "_carry"))
