"""Matching of gold and predicted items in flat tables: a row for each item, ``side`` 0 for gold and 1 for predictions, ``n`` for its place.

Equal items are numbered on both sides, spans are swept in the order of their starts, and boxes meet in strips as wide as the widest box, so work is in proportion to items and to
pairs that overlap, however many items a sample has. All of it is windows and joins within a sample: rows that are dealt by sample are not dealt anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GOLD, PRED = 0, 1


def other_side(gold: Column, pred: Column) -> Column:
    """What the other side has: of a gold item what predictions have, and the reverse."""
    return F.when(F.col("side") == GOLD, pred).otherwise(gold)


def numbered_matches(items: DataFrame, key: list[str], name: str = "matched") -> DataFrame:
    """items and whether each has a partner of equal key on the other side, one to one: of equal items the first ones, by ``n``, are matched. Null parts of keys are equal."""
    own = Window.partitionBy(*key).orderBy("side", "n")  # one order for numbers and counts: gold items come first
    gold, pred = (F.count_if(F.col("side") == s).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for s in (GOLD, PRED))
    return items.withColumn(name, F.row_number().over(own) <= F.when(F.col("side") == GOLD, pred).otherwise(2 * gold))


def side_counts(items: DataFrame, key: list[str]) -> DataFrame:
    """(key, gold, pred): how many items of a key each side has."""
    return items.groupBy(*key).agg(*[F.count_if(F.col("side") == s).alias(name) for s, name in ((GOLD, "gold"), (PRED, "pred"))])


def shared_counts(items: DataFrame, group: str, key: list[str], name: str = "tp") -> DataFrame:
    """(group, name): how many items of a group's two sides are equal, one to one."""
    return side_counts(items, [group, *key]).groupBy(group).agg(F.sum(F.least("gold", "pred")).alias(name))


def same_places(items: DataFrame, group: list[str], name: str, among: Column | None = None) -> DataFrame:
    """items and whether the other side has one with the same span in the group; ``among`` says which items count as such."""
    at, there = Window.partitionBy(*group, "start", "end"), F.lit(True) if among is None else among
    return items.withColumn(name, other_side(*[F.count_if((F.col("side") == s) & there).over(at) for s in (GOLD, PRED)]) > 0)


def swept_overlaps(items: DataFrame, group: list[str], name: str, among: Column | None = None) -> DataFrame:
    """items and whether a span of the other side in the group overlaps theirs; empty spans overlap nothing. ``among`` says which items count for others.

    One order for two sweeps: the furthest end of the spans before, which begin no later, and the start of the next one, since those after begin no earlier."""
    full = F.col("start") < F.col("end")
    order = Window.partitionBy(*group).orderBy("start", "end")
    there = full if among is None else full & among
    of = lambda side, c: F.when((F.col("side") == side) & there, F.col(c))
    rows = items.withColumns({f"__start_{s}": of(s, "start") for s in (GOLD, PRED)})
    furthest = other_side(*[F.max(of(s, "end")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for s in (GOLD, PRED)])
    nearest = other_side(*[F.expr(f"lead(__start_{s}) IGNORE NULLS").over(order) for s in (GOLD, PRED)])
    found = full & (F.coalesce(furthest > F.col("start"), F.lit(False)) | F.coalesce(nearest < F.col("end"), F.lit(False)))
    return rows.withColumn(name, found).drop(*[f"__start_{s}" for s in (GOLD, PRED)])


def swept_containments(items: DataFrame, group: list[str], name: str) -> DataFrame:
    """items and whether a gold span lies in a predicted one of the group that is longer; of a prediction, whether it is such a longer one.

    A longer span begins earlier and ends no earlier, or begins at the same place and ends later."""
    up, down = (Window.partitionBy(*group).orderBy(order).rangeBetween(Window.unboundedPreceding, -1) for order in (F.asc("start"), F.desc("start")))
    at = Window.partitionBy(*group, "start")
    gold, pred = F.when(F.col("side") == GOLD, F.col("end")), F.when(F.col("side") == PRED, F.col("end"))
    inside = (F.max(pred).over(up) >= F.col("end")), (F.max(pred).over(at) > F.col("end"))
    around = (F.min(gold).over(down) <= F.col("end")), (F.min(gold).over(at) < F.col("end"))
    either = lambda pair: F.coalesce(pair[0], F.lit(False)) | F.coalesce(pair[1], F.lit(False))
    return items.withColumn(name, F.when(F.col("side") == GOLD, either(inside)).otherwise(either(around)))


def attached(items: DataFrame, facts: DataFrame, group: str, key: str, order: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """items with the columns of facts (group, key, ...), of which an item has one row or none (nulls). ``order`` names an order that items have within their group already, ``parts`` the
    number of partitions that they are dealt to.

    A join by both keys would deal items anew that are dealt by the group. Here only facts are: the first item of a group gets them as a list, they are written out beside it and meet
    their items in a window, so work stays in proportion to both."""
    own = [c for c in facts.columns if c not in (group, key)]
    there = facts.withColumnRenamed(group, "__of")
    listed = (there.repartition(parts, "__of") if parts else there).groupBy("__of").agg(F.collect_list(F.struct(key, *own)).alias("__facts"))
    first = items.withColumn("__first", F.row_number().over(Window.partitionBy(group).orderBy(*(order or [key]))) == 1)
    met = first.join(listed, (F.col(group) == F.col("__of")) & F.col("__first"), "left")
    item = F.array(F.lit(None).cast(listed.schema["__facts"].dataType.elementType))
    rows = met.select(*items.columns, F.explode(F.concat(item, F.coalesce("__facts", F.slice(item, 1, 0)))).alias("__f"))
    at = Window.partitionBy(group, key)
    told = rows.withColumn(key, F.coalesce(f"__f.{key}", key)).withColumns({c: F.max(f"__f.{c}").over(at) for c in own})
    return told.where("__f is null").drop("__f")


CORNERS = ["x1", "y1", "x2", "y2"]


def facing(items: DataFrame, group: list[str]) -> DataFrame:
    """The items of groups that have both sides."""
    of = Window.partitionBy(*group)
    return items.withColumn("met", F.min("side").over(of) != F.max("side").over(of)).where("met").drop("met")


def overlapping_boxes(items: DataFrame, group: list[str], keep: list[str]) -> DataFrame:
    """(group, gold_..., pred_..., inter, iou, cover, purity) of every gold and predicted box of a group that share some area, with the columns ``keep`` of both.

    ``cover`` is the shared part of the gold box and ``purity`` that of the predicted one. Boxes are dealt to strips as wide as the group's widest, two at most each; a pair is made in the
    first strip that both are in. Boxes with corners that aren't finite numbers share nothing."""
    wide = F.col("x2") - F.col("x1")
    sound = (wide > 0) & (F.col("y2") > F.col("y1")) & (wide < float("inf")) & (F.abs("x1") < float("inf"))
    of = Window.partitionBy(*group)
    # boxes of groups that have one side only meet nothing
    sized = items.where(sound).select(*group, "side", *keep, *CORNERS, F.max(wide).over(of).alias("w"), (F.min("side").over(of) != F.max("side").over(of)).alias("met")).where("met").drop("met")
    strip = lambda c: F.floor(F.col(c) / F.col("w"))
    dealt = sized.select("*", strip("x1").alias("first"), F.explode(F.sequence(strip("x1"), strip("x2"))).alias("strip")).drop("w")
    sides = [dealt.where(F.col("side") == s).select(*group, "strip", *[F.col(c).alias(f"{name}_{c}") for c in (*keep, *CORNERS, "first")]) for s, name in ((GOLD, "gold"), (PRED, "pred"))]
    c = lambda name: F.col(name)
    both = sides[0].join(sides[1], [*group, "strip"]).where(c("strip") == F.greatest("gold_first", "pred_first"))
    inter = (F.least("gold_x2", "pred_x2") - F.greatest("gold_x1", "pred_x1")) * (F.least("gold_y2", "pred_y2") - F.greatest("gold_y1", "pred_y1"))
    area = lambda s: (c(f"{s}_x2") - c(f"{s}_x1")) * (c(f"{s}_y2") - c(f"{s}_y1"))
    met = both.where((c("gold_x1") < c("pred_x2")) & (c("pred_x1") < c("gold_x2")) & (c("gold_y1") < c("pred_y2")) & (c("pred_y1") < c("gold_y2")))
    made = met.select(*group, *[f"{s}_{k}" for s in ("gold", "pred") for k in keep], inter.alias("inter"), area("gold").alias("ga"), area("pred").alias("pa"))
    return made.select("*", (c("inter") / (c("ga") + c("pa") - c("inter"))).alias("iou"), (c("inter") / c("ga")).alias("cover"), (c("inter") / c("pa")).alias("purity")).drop("ga", "pa")


def greedy_pairs(pairs: DataFrame, group: list[str], keep: list[str] | None = None) -> DataFrame:
    """(group, pred_n, gold_n, keep): predictions in order each take the free gold item with the largest ``iou``, of equal ones the first.

    ``pairs`` (group, pred_n, gold_n, iou, keep) are those that may be taken. Only a group's pairs meet in a row, in the order in which they are tried."""
    keep = keep or []
    tried = F.sort_array(F.collect_list(F.struct(F.col("pred_n").alias("p"), (-F.col("iou")).alias("o"), F.col("gold_n").alias("g"), *keep)))
    grouped = pairs.groupBy(*group).agg(tried.alias("t"))
    taken = grouped.schema["t"].dataType.simpleString()

    def take(done: Column, x: Column) -> Column:
        return F.when(F.exists(done, lambda d: (d["p"] == x["p"]) | (d["g"] == x["g"])), done).otherwise(F.concat(done, F.array(x)))

    chosen = F.when(F.size("t") == 1, F.col("t")).otherwise(F.aggregate("t", F.array().cast(taken), take))
    return grouped.select(*group, F.explode(chosen).alias("c")).select(*group, F.col("c.p").alias("pred_n"), F.col("c.g").alias("gold_n"), *[f"c.{k}" for k in keep])
