"""Boxes with x, y, w, h in page units (0 to 1, from the top left), as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, prefix: str = "", suffix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}{suffix}") for c in ("x", "y", "w", "h")))

    @property
    def area(self) -> Column:
        return self.w * self.h

    @property
    def centre(self) -> tuple[Column, Column]:
        return self.x + self.w / 2, self.y + self.h / 2

    def valid(self, eps: float = 0.0) -> Column:
        """0 <= x, y; w, h > 0; within the page. Null parts are not valid."""
        return F.coalesce((self.x >= -eps) & (self.y >= -eps) & (self.w > 0) & (self.h > 0) & (self.x + self.w <= 1 + eps) & (self.y + self.h <= 1 + eps), F.lit(False))

    def clamped(self) -> Box:
        x, y = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) for c in (self.x, self.y))
        return Box(x, y, F.greatest(F.lit(0.0), F.least(self.w, 1 - x)), F.greatest(F.lit(0.0), F.least(self.h, 1 - y)))

    def intersection(self, other: Box) -> Column:
        across = F.least(self.x + self.w, other.x + other.w) - F.greatest(self.x, other.x)
        down = F.least(self.y + self.h, other.y + other.h) - F.greatest(self.y, other.y)
        return F.greatest(F.lit(0.0), across) * F.greatest(F.lit(0.0), down)

    def iou(self, other: Box) -> Column:
        both = self.intersection(other)
        either = self.area + other.area - both
        return F.when(either > 0, both / either).otherwise(0.0)

    def coverage(self, inner: Box) -> Column:
        """How much of `inner` lies in this box; not symmetric."""
        return F.when(inner.area > 0, self.intersection(inner) / inner.area).otherwise(0.0)

    def overlap(self, other: Box, floor: float = 1e-9) -> Column:
        """Intersection over this box's own area."""
        return self.intersection(other) / F.greatest(F.lit(floor), self.area)

    def holds_centre(self, other: Box, margin: float = 0.01) -> Column:
        cx, cy = other.centre
        return (cx >= self.x - margin) & (cx <= self.x + self.w + margin) & (cy >= self.y - margin) & (cy <= self.y + self.h + margin)

    def union(self, other: Box) -> Box:
        x, y = F.least(self.x, other.x), F.least(self.y, other.y)
        return Box(x, y, F.greatest(self.x + self.w, other.x + other.w) - x, F.greatest(self.y + self.h, other.y + other.h) - y)

    def grown(self, by: float) -> Box:
        """Larger by `by` on each side, within the page."""
        x, y = F.greatest(F.lit(0.0), self.x - by), F.greatest(F.lit(0.0), self.y - by)
        return Box(x, y, F.least(F.lit(1.0), self.x + self.w + by) - x, F.least(F.lit(1.0), self.y + self.h + by) - y)

    def same_column(self, other: Box, least: float = 0.6) -> Column:
        """The narrower one overlaps across by at least that share."""
        across = F.greatest(F.lit(0.0), F.least(self.x + self.w, other.x + other.w) - F.greatest(self.x, other.x))
        return across / F.greatest(F.lit(1e-9), F.least(self.w, other.w)) >= least


def from_pixels(left: Column, top: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Box:
    """A dragged rectangle in pixels, from any corner, as a box."""
    return Box(F.least(left, left + width) / page_width, F.least(top, top + height) / page_height, F.abs(width) / page_width, F.abs(height) / page_height)


def to_pixels(box: Box, page_width: Column, page_height: Column) -> tuple[Column, Column, Column, Column]:
    """Whole pixels; sides are at least one."""
    side = lambda c, p: F.greatest(F.lit(1), F.round(c * p).cast("int"))
    return F.round(box.x * page_width).cast("int"), F.round(box.y * page_height).cast("int"), side(box.w, page_width), side(box.h, page_height)
