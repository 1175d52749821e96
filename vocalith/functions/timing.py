"""Frame grids: from kernels and strides to frames, times and windows. A grid is a `Grid` of numbers or Columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slack of frame bounds, in frames.
SLACK = 1e-9


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def frame_timing(kernels: list[int], strides: list[int], num_samples) -> Column:
    """STRUCT(hop, receptive_field, frame_count) of stacked convolutions over so many samples."""
    hop, field = 1, 1
    for k, s in zip(kernels, strides):
        field += (k - 1) * hop
        hop *= s
    layers = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in zip(kernels, strides)])
    frames = F.aggregate(layers, _c(num_samples).cast("long"), lambda n, l: F.greatest(F.lit(0).cast("long"), F.floor((n - l["k"]) / l["s"]) + 1))
    return F.struct(F.lit(hop).alias("hop"), F.lit(field).alias("receptive_field"), frames.alias("frame_count"))


@dataclass(frozen=True)
class Grid:
    """Times in one unit (seconds, or milliseconds): `stride` and `support` of a frame, the first frame's `origin` (centre), `count` frames."""

    stride: float
    support: float
    origin: float
    count: object

    def same_as(self, other: Grid) -> bool:
        return (self.stride, self.support, self.origin, self.count) == (other.stride, other.support, other.origin, other.count)


def frame_interval(frame, grid: Grid) -> tuple[Column, Column]:
    """[start, end) of a frame's support."""
    start = _c(frame) * grid.stride
    return start, start + grid.support


def _bound(t, grid: Grid) -> Column:
    n = _c(grid.count).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(n, F.ceil((_c(t) - grid.origin) / grid.stride - SLACK)))


def frame_bounds(start, end, grid: Grid) -> tuple[Column, Column]:
    """[first, last) of the frames whose centres lie in [start, end)."""
    return _bound(start, grid), _bound(end, grid)


def nearest_frame(t, grid: Grid) -> Column:
    """The frame whose centre is nearest, the later of two; clipped to the grid."""
    n = _c(grid.count).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(n - 1, F.floor((_c(t) - grid.origin) / grid.stride + 0.5)))


def time_to_frame(t, grid: Grid, duration) -> Column:
    """As `nearest_frame`; null outside [0, duration]."""
    return F.when((_c(t) >= 0) & (_c(t) <= duration), nearest_frame(t, grid))


def map_interval(start, end, grid: Grid) -> Column:
    """STRUCT(first, last, method): frames with centres in the interval, else the frame nearest its middle. Null without an interval."""
    first, last = frame_bounds(start, end, grid)
    near = nearest_frame((_c(start) + _c(end)) / 2, grid)
    some = first < last
    made = F.struct(F.when(some, first).otherwise(near).alias("first"), F.when(some, last).otherwise(near + 1).alias("last"), F.when(some, "frame_centers_in_interval").otherwise("nearest_center_fallback").alias("method"))
    return F.when(_c(start).isNotNull() & _c(end).isNotNull(), made)


def map_frame_window(start, end, source: Grid, target: Grid) -> Column:
    """STRUCT(first, last, method): a span of source frames in the target grid, by the supports' times. Null outside the source."""
    s, e = _c(start).cast("long"), _c(end).cast("long")
    ok = (s >= 0) & (s < e) & (e <= source.count)
    if source.same_as(target):
        return F.when(ok, F.struct(s.alias("first"), e.alias("last"), F.lit("identical_grid").alias("method")))
    return F.when(ok, map_interval(frame_interval(s, source)[0], frame_interval(e - 1, source)[1], target))


def expand_context(start, end, limit, margin) -> tuple[Column, Column]:
    """The interval with `margin` on both sides, clipped to [0, limit]; null stays null."""
    s, e = _c(start), _c(end)
    return F.when(s.isNotNull(), F.greatest(F.lit(0), s - margin)), F.when(e.isNotNull(), F.least(_c(limit), e + margin))


def sum_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
