"""Label columns: encodings, smoothing, mixing, vocabularies (LAB01-10, PRJ11, JOIN09)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(n: int, f) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)


def one_hot(label: Column, classes: int, smoothing: float = 0.0) -> Column:
    """LAB02: 1 - s + s/K at the label and s/K elsewhere."""
    off = smoothing / classes
    return _each(classes, lambda k: F.when(k == label, 1.0 - smoothing + off).otherwise(off))


def multi_hot(indices: Column, classes: int) -> Column:
    """LAB03: 1 at each index."""
    return _each(classes, lambda k: F.array_contains(indices, k).cast("double"))


def event_frames(events: Column, classes: int, frames: int, hop: float) -> Column:
    """LAB04: [frames, classes]; an event (start, end, label) covers floor(start/hop) to ceil(end/hop), one frame at least."""

    def covers(e: Column, t: Column, k: Column) -> Column:
        first = F.floor(e["start"] / hop)
        last = F.greatest(F.least(F.ceil(e["end"] / hop), F.lit(frames)), F.least(first + 1, F.lit(frames)))
        return (e["label"] == k) & (t >= first) & (t < last)

    return _each(frames, lambda t: _each(classes, lambda k: F.exists(events, lambda e: covers(e, t, k)).cast("double")))


def smooth(vector: Column, classes: int, smoothing: float) -> Column:
    """LAB05"""
    return F.transform(vector, lambda y: y * (1 - smoothing) + smoothing / classes)


def for_mixing(label: Column, mode: str, classes: int, smoothing: float = 0.0) -> Column:
    """LAB06: what a label must be before it is mixed; ``single_label`` numbers become vectors."""
    if mode == "single_label":
        return one_hot(label, classes, smoothing)
    if mode in ("multi_label", "event_frames", "dense"):
        return label
    raise ValueError(f"unknown label mode {mode!r}")


def blend(a: Column, b: Column, share: Column, either: bool = False) -> Column:
    """LAB07: share * a + (1 - share) * b, or with ``either`` the larger of both."""
    return F.zip_with(a, b, (lambda x, y: F.greatest(x, y)) if either else (lambda x, y: share * x + (1 - share) * y))


def class_name(label: Column, names: list[str]) -> Column:
    """JOIN09, PRJ11: the label's name; none for a label without one."""
    return F.get(F.array(*map(F.lit, names)), label)


def transform_label(label: Column, mode: str, *, classes: int | None = None, smoothing: float = 0.0, frames: int | None = None, hop: float | None = None) -> Column:
    """LAB01: index, one_hot, multi_hot, text or event_frames."""
    make = {
        "index": lambda x: x.cast("long"),
        "text": lambda x: x.cast("string"),
        "one_hot": partial(one_hot, classes=classes, smoothing=smoothing),
        "multi_hot": partial(multi_hot, classes=classes),
        "event_frames": partial(event_frames, classes=classes, frames=frames, hop=hop),
    }
    if mode not in make:
        raise ValueError(f"unknown label transform {mode!r}")
    return make[mode](label)


def classification_label(label: Column, *, one_hot_labels: bool, classes: int | None, smoothing: float = 0.0, mode: str = "single_label") -> Column:
    """LAB08: what a classifier is trained on."""
    if mode == "multi_label":
        return F.transform(label, lambda x: x.cast("float"))
    return one_hot(label, classes, smoothing) if one_hot_labels else label.cast("long")


def encoded(value: Column, vocabulary_id: Column) -> Column:
    """LAB09: a joined vocabulary id, -1 for values that the vocabulary lacks."""
    return F.coalesce(vocabulary_id, F.when(value.isNotNull(), -1), F.lit(-1)).cast("long")


def argmax(scores: Column) -> Column:
    """LAB10: the first place of the largest value."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("long")
