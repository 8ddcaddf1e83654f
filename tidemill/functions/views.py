"""Views of a signal: where they start, how short ones are padded, and all of them as rows (SEG01-08, WIN13)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.hashing import draw

MODES = ("random_crop", "center_crop", "full", "sliding", "pad_or_crop", "multi_crop")
POLICIES = {
    None: None,
    "crop_or_pad": None,
    "keep_1s": ("full", None),
    "pad_to_model_duration": ("pad_or_crop", "zero"),
    "tile_to_model_duration": ("pad_or_crop", "repeat"),
    "repeat_pad_to_model_duration": ("pad_or_crop", "repeat"),
    "sliding_windows": ("sliding", None),
}


@dataclass(frozen=True)
class Views:
    """How a signal is cut. ``seconds`` of a view; ``hop`` between sliding ones (default: a view's length)."""

    seconds: float
    train_mode: str = "random_crop"
    eval_mode: str = "center_crop"
    policy: str | None = None
    pad: str = "zero"
    pad_side: str = "right"
    count: int = 1
    hop: float | None = None
    sliding_in_training: bool = False

    def __post_init__(self):
        if self.seconds <= 0 or self.count < 1 or (self.hop is not None and self.hop <= 0):
            raise ValueError("a view needs a positive length, count and hop")
        for name, value, known in (("train_mode", self.train_mode, MODES), ("eval_mode", self.eval_mode, MODES), ("policy", self.policy, tuple(POLICIES)), ("pad", self.pad, ("zero", "repeat", "reflect")), ("pad_side", self.pad_side, ("right", "center", "random"))):
            if value not in known:
                raise ValueError(f"{name} is none of {known}: {value!r}")

    def resolved(self, training: bool) -> tuple[str, str]:
        """Mode and padding that hold."""
        forced = POLICIES[self.policy] or (None, None)
        mode = forced[0] or (self.train_mode if training else self.eval_mode)
        if training and mode == "sliding" and not self.sliding_in_training:
            raise ValueError("sliding views are not allowed in training")
        return mode, forced[1] or self.pad


def samples_of(seconds: float, rate: Column) -> Column:
    """SEG02: rounded half to even, one at least."""
    return F.greatest(F.rint(F.lit(seconds) * rate).cast("int"), F.lit(1))


def center_start(n: Column, size: Column) -> Column:
    return F.greatest(F.floor((n - size) / 2).cast("int"), F.lit(0))


def sliding_starts(n: Column, size: Column, hop: Column) -> Column:
    """SEG03: every hop, and the last possible start."""
    last = F.greatest(n - size, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, hop), F.array(last)))


def spread_starts(n: Column, size: Column, count: int) -> Column:
    """SEG04: evenly from the first to the last; one alone is in the middle."""
    if count == 1:
        return F.array(center_start(n, size))
    last = F.greatest(n - size, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.rint(k * last / float(count - 1)).cast("int"))


def random_start(n: Column, size: Column, seed: int, position: Column) -> Column:
    """SEG05: uniform over all starts."""
    return F.floor(draw(seed, position, "start") * (F.greatest(n - size, F.lit(0)) + 1)).cast("int")


def padded(x: Column, size: Column, how: str, side: str = "right", seed: int = 0, position: Column | None = None) -> Column:
    """SEG06: to ``size`` samples by zeros, by repeating, or by reflecting (zeros for a single sample)."""
    n, zero = F.size(x), F.lit(0.0)
    missing = F.greatest(size - n, F.lit(0))
    before = {"right": F.lit(0), "center": F.floor(missing / 2), "random": F.floor(draw(seed, position if position is not None else F.lit(0), "side") * (missing + 1))}[side].cast("int")

    def at(k: Column) -> Column:
        i = k - before
        if how == "zero":
            j = F.when((i >= 0) & (i < n), i)
        elif how == "repeat":
            j = F.when(n > 0, F.pmod(i, F.greatest(n, F.lit(1))))
        else:
            m = F.pmod(i, F.greatest(2 * n - 2, F.lit(1)))
            j = F.when(n > 1, F.when(m < n, m).otherwise(2 * n - 2 - m)).when((i >= 0) & (i < n), i)
        return F.coalesce(F.when(j.isNotNull(), F.get(x, F.coalesce(j, F.lit(0)))).cast("double"), zero)

    return F.transform(F.sequence(F.lit(0), size - 1), at)


def view_at(x: Column, start: Column, size: Column, how: str, side: str = "right", seed: int = 0, position: Column | None = None) -> Column:
    """SEG07: from ``start``, padded where the signal ends."""
    a = F.greatest(F.least(start, F.size(x) - 1), F.lit(0))
    part = F.slice(x, a + 1, size)
    return F.when(F.size(part) < size, padded(part, size, how, side, seed, position)).otherwise(F.transform(part, lambda v: v.cast("double")))


def starts_of(n: Column, size: Column, rate: Column, views: Views, mode: str, seed: int, position: Column) -> Column:
    if mode == "sliding":
        return sliding_starts(n, size, samples_of(views.hop or views.seconds, rate))
    if mode == "multi_crop":
        return spread_starts(n, size, views.count)
    return F.array({"random_crop": random_start(n, size, seed, position), "center_crop": center_start(n, size), "pad_or_crop": center_start(n, size), "full": F.lit(0)}[mode])


def segment(df: DataFrame, views: Views, *, signal: str, rate: str, position: str, training: bool = False, seed: int = 0) -> DataFrame:
    """SEG01, SEG08: a row for each view: view_index, view_start_time, view_end_time, view, original_duration.

    The end time is the start plus a view's length even where the view was padded.
    """
    mode, how = views.resolved(training)
    x, r, p = F.col(signal), F.col(rate), F.col(position)
    n = F.size(x)
    size = n if mode == "full" else samples_of(views.seconds, r)
    rows = df.select("*", F.posexplode(starts_of(n, size, r, views, mode, seed, p)).alias("view_index", "_start"))
    view = F.transform(x, lambda v: v.cast("double")) if mode == "full" else view_at(x, F.col("_start"), size, how, views.pad_side, seed, p)
    return rows.select(*df.columns, "view_index", (F.col("_start") / r).alias("view_start_time"), ((F.col("_start") + size) / r).alias("view_end_time"), view.alias("view"), (n / r).alias("original_duration"))
