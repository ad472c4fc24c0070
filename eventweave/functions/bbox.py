"""Boxes ``[left, top, right, bottom]`` as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventweave.functions.text import let


def normalize_bbox(box: Column, numbers: bool = False) -> Column:
    """Four numbers as doubles (numeric strings too), else null. ``numbers`` says that the elements are of a numeric type."""
    cast = F.transform(box, lambda v: v.cast("double") if numbers else v.cast("string").try_cast("double"))
    return let(cast, lambda c: F.when((F.size(c) == 4) & ~F.exists(c, lambda v: v.isNull()), c))


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1])


def intersection(a: Column, b: Column) -> Column:
    wide = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    return wide * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union with exclusive corners; 0 without overlap or area. Plain arithmetic: give boxes that are cheap to name."""
    both = intersection(a, b)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def clamped_iou(a: Column, b: Column, least: float = 1e-8) -> Column:
    """Intersection over union with the union at least ``least``: never null or undefined, 0 for boxes without area."""
    both = area(F.array(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / F.greatest(union, F.lit(least))


def pixel_match(a: Column, b: Column, threshold: float = 0.5) -> Column:
    """Whether pixel boxes (inclusive corners) overlap by more than threshold; two missing boxes match, one doesn't."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]) + 1)
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]) + 1)
    both = wide * high
    union = (a[2] - a[0] + 1) * (a[3] - a[1] + 1) + (b[2] - b[0] + 1) * (b[3] - b[1] + 1) - both
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(F.try_divide(both, union) > threshold)


def judged(iou_: Column, cover: Column, pure: Column, matched: float = 0.5, low: float = 0.2, cover_high: float = 0.8, purity_low: float = 0.6) -> Column:
    """How a predicted box misses, by the overlap and its shares of the gold box (``cover``) and the predicted one (``pure``)."""
    return (
        F.when(iou_ >= matched, "matched")
        .when(iou_ <= 0, "no_overlap")
        .when(iou_ < low, "weak_overlap")
        .when((cover >= cover_high) & (pure < purity_low), "box_not_precise_enough_oversized")
        .when((pure >= cover_high) & (cover < purity_low), "box_not_precise_enough_undersized")
        .otherwise("box_not_precise_enough_shifted")
    )


def box_quality(pred: Column, gold: Column, matched: float = 0.5, low: float = 0.2, cover_high: float = 0.8, purity_low: float = 0.6) -> Column:
    """How a predicted box misses: no or weak overlap, too large, too small, or shifted; ``matched`` at the threshold or above."""
    both = intersection(pred, gold)
    share = lambda own: F.coalesce(F.try_divide(both, area(own)), F.lit(0.0))
    made = F.struct(iou(pred, gold).alias("iou"), share(gold).alias("cover"), share(pred).alias("pure"))
    return let(made, lambda x: judged(x["iou"], x["cover"], x["pure"], matched, low, cover_high, purity_low))


def quality_bucket(quality: Column, side: str) -> Column:
    """The counter of an unmatched box: ``side`` is fp or fn. A quality without a counter of its own counts as spurious or missing."""
    rest = "image.fp_spurious_argument" if side == "fp" else "image.fn_missing_argument"

    def name(q: Column) -> Column:
        suffix = F.when(q.isin("weak_overlap", "no_overlap"), F.concat(q, F.lit("_same_role"))).when(q.startswith("box_"), q)
        return F.coalesce(F.concat(F.lit(f"image.{side}_"), suffix), F.lit(rest))

    return let(quality, name)


def rescale(value: Column, shift: Column, scale: Column) -> Column:
    """A coordinate of a resized image in the original: a whole number, or null without one."""
    return F.try_divide(F.greatest(value - shift, F.lit(0.0)), scale).cast("int")
