"""From named sources to padded batches, seeded epochs, resumable replay, corruption fan-out (LIFE01-05, AC13, VC19, SNK07, SNK11, SNK19).

A pipeline is four DataFrame functions. Everything is one lazy plan: order and randomness are columns, so a seed gives
the same rows however the work is spread, and no epoch has to be run for the next to be known.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from tidemill.functions.hashing import canonical_json, digest_of, epoch_seed
from tidemill.operators import batching
from tidemill.operators.metrics import batch_count
from tidemill.operators.positions import POS, enumerate_rows, shuffled
from tidemill.operators.snapshot import Admitted, CachePolicy, protected_cache
from tidemill.operators.stats import with_metadata_mode
from tidemill.sources.registry import fetch

TYPES = ("train", "validation", "test")
REPLAY_SCHEMA = "tidemill-replay-1"


def _same(df: DataFrame) -> DataFrame:
    return df


@dataclass(frozen=True)
class Stages:
    """``augment`` and ``late_augment`` take (rows, seed); late_augment gets batches before they are padded."""

    preprocess: Callable[[DataFrame], DataFrame] = _same
    augment: Callable[[DataFrame, int], DataFrame] | None = None
    postprocess: Callable[[DataFrame], DataFrame] = _same
    late_augment: Callable[[DataFrame, int], DataFrame] | None = None


@dataclass(frozen=True)
class Options:
    """What of a run can be stated as plain values; also its executed configuration (SNK19)."""

    names: tuple[str, ...]
    splits: tuple[str, ...] | dict
    dataset_type: str
    batch_size: int
    seed: int
    order: tuple[str, ...]
    drop_remainder: bool = False
    shuffle: bool = True
    metadata_mode: str = "full"
    augment_eval: bool = False
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        """LIFE05"""
        if self.dataset_type not in TYPES:
            raise ValueError(f"dataset_type is none of {TYPES}")
        if isinstance(self.batch_size, bool) or not isinstance(self.batch_size, int) or self.batch_size < 1:
            raise ValueError("batch_size must be a positive whole number")
        if self.metadata_mode not in ("full", "numeric_only", "none"):
            raise ValueError("metadata_mode must be full, numeric_only or none")
        if not self.order:
            raise ValueError("rows need an order")

    @property
    def training(self) -> bool:
        return self.dataset_type == "train"

    def to_json(self) -> str:
        return canonical_json(asdict(self))


def prepared(spark: SparkSession, options: Options, stages: Stages, *, data_dir: str | None = None, source_filter: Column | None = None, filter_by: Column | None = None, cache: str | None = None, cache_policy: CachePolicy | None = None) -> DataFrame | None:
    """LIFE01, up to the cache: sources, adapters, positions, preprocessing, filter."""
    df = fetch(spark, list(options.names), options.splits if isinstance(options.splits, dict) else list(options.splits), data_dir, source_filter=source_filter)
    if df is None:
        return None
    rows = enumerate_rows(df, "_source", "_split", *options.order)
    out = stages.preprocess(rows)
    if cache is not None:
        out = protected_cache(out, cache, stage="preprocess", policy=cache_policy or CachePolicy(), fingerprint=digest_of({"options": json.loads(options.to_json()), "schema": out.schema.jsonValue()}))
    return out if filter_by is None else _numbered(out.filter(filter_by))


def _numbered(df: DataFrame) -> DataFrame:
    """Positions without the gaps that a filter leaves."""
    return enumerate_rows(df.withColumnRenamed(POS, "_was"), "_was").drop("_was")


def finalized(df: DataFrame, options: Options, stages: Stages, *, seed: int | None = None) -> DataFrame:
    """LIFE02, LIFE03: augment, shuffle (training), postprocess, metadata, batches, late augmentation, padding.

    A pure function of the rows and the seed: (batch_id, rows, padding_mask).
    """
    seed = options.seed if seed is None else seed
    if stages.augment is not None and (options.training or options.augment_eval):
        df = stages.augment(df, epoch_seed("augment", seed, 0, 0))
    if options.training and options.shuffle:
        df = shuffled(df, epoch_seed("shuffle", seed, 0, 0) & 0x7FFFFFFF)
    df = with_metadata_mode(stages.postprocess(df), options.metadata_mode)
    columns = [c for c in df.columns if c not in (POS, "_source", "_split")]
    out = batching.batch(df, options.batch_size, columns, drop_remainder=options.drop_remainder)
    if stages.late_augment is not None and (options.training or options.augment_eval):
        out = stages.late_augment(out, epoch_seed("late", seed, 0, 0))
    return batching.padded(out, options.batch_size)


def load(spark: SparkSession, names: list[str], splits, dataset_type: str, batch_size: int, seed: int, *, order: list[str], stages: Stages = Stages(), data_dir: str | None = None, source_filter: Column | None = None, filter_by: Column | None = None, cache: str | None = None, count: bool = False, **more):
    """LIFE01: (batches, number of batches); (None, 0) where nothing loads. The number is counted only if asked for."""
    options = Options(tuple(names), splits if isinstance(splits, dict) else tuple(splits), dataset_type, batch_size, seed, tuple(order), **more)
    keep = Stages(_kept(stages.preprocess), stages.augment, _kept(stages.postprocess), stages.late_augment)
    rows = prepared(spark, options, keep, data_dir=data_dir, source_filter=source_filter, filter_by=filter_by, cache=cache)
    if rows is None:
        return None, 0
    return finalized(rows, options, keep), batch_count(rows.count(), batch_size, options.drop_remainder) if count else None


def _kept(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A stage that selects columns without naming the position, made to keep it."""

    def run(df: DataFrame) -> DataFrame:
        out = f(df)
        if POS in out.columns:
            return out
        # select the stage's own output next to the position, from one and the same plan
        marked = f(Marked(df))
        return marked if isinstance(marked, DataFrame) else marked.df

    return run


class Marked:
    """A DataFrame whose projections keep the position column."""

    def __init__(self, df: DataFrame):
        self.df = df

    def select(self, *columns):
        flat = list(columns[0]) if len(columns) == 1 and isinstance(columns[0], (list, tuple)) else list(columns)
        return Marked(self.df.select(*flat, POS))

    def __getattr__(self, name):
        got = getattr(self.df, name)
        if not callable(got):
            return got

        def call(*args, **kwargs):
            out = got(*args, **kwargs)
            return Marked(out) if isinstance(out, DataFrame) else out

        return call

    def __getitem__(self, name):
        return self.df[name]


@dataclass(frozen=True)
class ReplayState:
    """LIFE04: where an epoch is to go on, and what it belongs to."""

    inventory: str
    config: str
    run_seed: int
    epoch: int
    view: int
    batch_size: int
    next_batch: int = 0

    def to_json(self) -> str:
        return canonical_json({"schema": REPLAY_SCHEMA, **asdict(self)})

    @classmethod
    def from_json(cls, text: str) -> ReplayState:
        got = json.loads(text)
        if got.pop("schema", None) != REPLAY_SCHEMA:
            raise ValueError("the state has another schema")
        return cls(**got)


@dataclass(frozen=True)
class Replay:
    batches: DataFrame
    state: ReplayState
    remaining_batches: int
    remaining_rows: int

    def advanced(self, n: int = 1) -> ReplayState:
        """The state after ``n`` more batches."""
        return ReplayState(**{**asdict(self.state), "next_batch": self.state.next_batch + n})


def replay(admitted: Admitted, *, stages: Stages, dataset_type: str, batch_size: int, seed: int, epoch: int, view: int = 0, state: ReplayState | None = None, stateless: bool = False, drop_remainder: bool = False) -> Replay:
    """LIFE04, SNK07: an epoch of a verified snapshot, whole or from a saved state on.

    ``stateless``: the caller certifies that the stages draw from the seed they are given only. Evaluation keeps its
    last batch. A state of another snapshot, configuration, seed, epoch or batch size is refused.
    """
    if not stateless:
        raise ValueError("replay needs stages that are certified to be stateless")
    if drop_remainder and dataset_type != "train":
        raise ValueError("evaluation must not drop its remainder")
    options = Options(("snapshot",), ("all",), dataset_type, batch_size, seed, (POS,), drop_remainder=drop_remainder)
    fresh = ReplayState(admitted.digest, digest_of(json.loads(options.to_json())), seed, epoch, view, batch_size)
    if state is not None:
        for name, value in asdict(fresh).items():
            if name != "next_batch" and getattr(state, name) != value:
                raise ValueError(f"the state's {name} is {getattr(state, name)!r}, not {value!r}")
    cursor = state.next_batch if state else 0
    n = admitted.manifest["retained"]
    left = batching.remaining(n, batch_size, cursor, drop_remainder)
    keep = Stages(_kept(stages.preprocess), stages.augment, _kept(stages.postprocess), stages.late_augment)
    rows = _numbered(admitted.data) if admitted.manifest["excluded"] else admitted.data  # records that were left out leave gaps
    rows = keep.preprocess(rows)
    out = finalized(rows, options, keep, seed=epoch_seed(REPLAY_SCHEMA, seed, epoch, view))
    return Replay(batching.resumed(out, cursor), state or fresh, *left)


def fan_out(base: DataFrame, corruptions: list[str], corrupt: Callable[[DataFrame, str, int], DataFrame], options: Options, stages: Stages) -> dict[str, DataFrame]:
    """AC13, VC19: one finalised dataset for each corruption of one shared base; the place in the list salts the seeds."""
    if len(set(corruptions)) != len(corruptions):
        raise ValueError("a corruption is there twice")
    return {name: finalized(corrupt(base, name, i * 1_000_003), options, stages) for i, name in enumerate(corruptions)}


def numpy_rows(batches: DataFrame):
    """The real rows of batches in order."""
    for row in batches.orderBy("batch_id").toLocalIterator(prefetchPartitions=True):
        yield [r for r, real in zip(row["rows"], row["padding_mask"], strict=True) if real]


def numpy_batches(batches: DataFrame):
    """SNK18: batches in order, one at a time, as dictionaries of arrays."""
    import numpy as np

    for row in batches.orderBy("batch_id").toLocalIterator(prefetchPartitions=True):
        fields = row["rows"][0].asDict() if row["rows"] else {}
        out = {k: np.array([r[k] for r in row["rows"]]) for k in fields}
        yield {**out, "padding_mask": np.array(row["padding_mask"])}
