"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

A source is cut into blocks of ``block_rows`` documents. Weights are whole numbers that add up to ``period`` (10^10, so
shares are as good as exact), and a source of weight w out of D releases block j at slot floor(j * D / w) and must have
placed it by slot ceil((j + 1) * D / w). At each slot the released block with the earliest deadline goes out. As the
weights fill the period, no slot stays empty and no deadline is missed: after any number of slots, a source differs
from its share by less than one block. The slots of all blocks are worked out by one fold in the JVM over integers,
sources times slots steps in one task; blocks then find their slot in a join by source and number.

A document's number within its source comes from counts of (source, hash range) groups, so a source with a third of
all rows is spread over as many tasks as any other rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm._shared import shared_dir, stage

#: What weights add up to: rounding moves a source by less than a thousandth of a block in ten million slots, and a
#: product with a number of blocks or slots stays below 2^63 up to 900 million of them.
PERIOD = 10**10
#: Slots that are scheduled, by the number of blocks; only a source with many rows and next to no weight needs more.
LONGEST = 4
#: Slots whose places are appended at once.
CHUNK = 256
#: Blocks that a table is cut into, at most about: what the fold goes through. Larger tables have larger blocks.
MOST_BLOCKS = 1 << 20
#: Rows of a group, on average, if one source held all: a source's rows are numbered by groups of the order hash.
GROUP_ROWS = 1 << 14


def whole(a: Column, b: Column) -> Column:
    """The quotient of two longs, cut off; no detour by doubles."""
    return F.call_function("div", a, b)


def window_of(block: Column, w: Column, period: int) -> tuple[Column, Column]:
    """Release and deadline of a block of a source of weight ``w``."""
    return whole(block * period, w), whole((block + 1) * period + w - 1, w)


def slots_of(weights: Column, period: int, total: Column) -> Column:
    """Array of weights that add up to ``period`` -> for each of ``total`` slots, at least, the source's place ``s`` in
    the array and the number ``j`` of its block."""

    def step(done: Column, t: Column) -> Column:
        def due(w: Column, s: Column) -> Column:
            placed = F.get(done["placed"], s)
            return F.when(placed * period < (t + 1) * w, F.struct(window_of(placed, w, period)[1].alias("deadline"), s.alias("s"), placed.alias("j")))

        pick = F.array(F.array_min(F.transform(weights, due)))
        return F.transform(
            pick,
            lambda p: F.struct(
                F.transform(done["placed"], lambda n, s: n + F.when(s == p["s"], 1).otherwise(0)).alias("placed"),
                F.concat(done["slots"], F.array(F.struct(p["s"].alias("s"), p["j"].alias("j")))).alias("slots"),
            ),
        )[0]

    none = F.array().cast("array<struct<s:int,j:bigint>>")

    def chunk(done: Column, k: Column) -> Column:
        start = F.struct(done["placed"].alias("placed"), none.alias("slots"))
        inner = F.array(F.aggregate(F.sequence(k * CHUNK, k * CHUNK + CHUNK - 1), start, step))
        return F.transform(inner, lambda x: F.struct(x["placed"].alias("placed"), F.concat(done["chunks"], F.array(x["slots"])).alias("chunks")))[0]

    start = F.struct(F.transform(weights, lambda w: F.lit(0).cast("long")).alias("placed"), F.array().cast("array<array<struct<s:int,j:bigint>>>").alias("chunks"))
    chunks = F.sequence(F.lit(0).cast("long"), whole(total - 1, F.lit(CHUNK).cast("long")))
    return F.flatten(F.aggregate(chunks, start, chunk)["chunks"])


def integer_weights(sizes: DataFrame, period: int, temperature: float, weights: dict[str, float] | None) -> DataFrame:
    """(source, rows) -> (source, rows, w): by share, one of ``period`` at least, left-overs by largest remainder."""
    everyone = Window.partitionBy()  # as many rows as sources
    if weights is None:
        share = F.pow(F.col("rows").cast("double"), F.lit(temperature))
    else:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.lit(None).cast("map<string,double>")
        share = F.coalesce(F.try_element_at(named, F.col("source")), F.lit(0.0))
    total, n = F.sum("share").over(everyone), F.count("*").over(everyone)
    t = sizes.withColumn("share", share).withColumn("share", F.when(total > 0, F.col("share") / total).otherwise(F.lit(1.0) / n))
    t = t.withColumn("small", F.col("share") * period < 1)
    big = F.sum(F.when(~F.col("small"), F.col("share"))).over(everyone)
    room = period - F.sum(F.col("small").cast("int")).over(everyone)
    t = t.withColumn("exact", F.when(F.col("small"), F.lit(1.0)).otherwise(F.col("share") / big * room))
    t = t.withColumn("base", F.greatest(F.floor("exact"), F.lit(1)).cast("long"))
    fits = F.when(n <= period, F.lit(period)).otherwise(F.raise_error(F.lit("more sources than the period")).cast("long"))
    t = t.withColumn("spare", fits - F.sum("base").over(everyone))
    more = F.row_number().over(everyone.orderBy((F.col("exact") - F.col("base")).desc(), "source"))
    less = F.row_number().over(everyone.orderBy(F.desc("base"), "source"))
    change = F.when(more <= F.col("spare"), 1).when(less <= -F.col("spare"), -1).otherwise(0)
    return t.select("source", "rows", (F.col("base") + change).cast("long").alias("w"))


def pfair_mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5, block_rows: int | None = None, period: int = PERIOD, seed: int = 17) -> DataFrame:
    """``docs`` with columns ``mix_block, mix_release, mix_deadline, mix_slot, mix_position, in_mix``; no row is lost.

    ``weights``: source -> target weight; sources it leaves out get one part in ``period``. None: sizes to the power
    ``temperature``. ``block_rows``: rows of a block; None: 8, or more where that would make over MOST_BLOCKS blocks.
    The order within a source is a seeded shuffle of the rows. ``mix_position`` orders the mixture:
    slot * block_rows + place in the block. ``in_mix``: the row lies before the first slot that its source can no
    longer fill wholly, so the mixture up to there holds the targets; what follows is the surplus of the others.
    Blocks that have no place in LONGEST times as many slots as there are blocks follow in turns, each its own window.

    A null source counts as the empty name. Null keys and rows that repeat a key are rows like others: the shuffle is
    by a hash of the whole row, so only equal rows stand together, in any order. An empty table gives an empty result.
    Columns of ``docs`` that carry one of the new names are replaced.
    """
    total = docs.count()
    block_rows = block_rows or max(8, -(-total // MOST_BLOCKS))
    bits = (total // GROUP_ROWS).bit_length() + 2
    new = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position", "in_mix")
    kept = [c for c in docs.columns if c not in new]
    rows = docs.select(
        *kept,
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_mix_source"),
        F.xxhash64(F.lit(seed), F.col(key), *[F.col(f"`{c}`") for c in kept]).alias("_mix_order"),
    ).withColumn("_mix_range", F.shiftright("_mix_order", 64 - bits).cast("int"))
    counts = rows.groupBy("_mix_source", "_mix_range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("_mix_source").orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_mix_source", "_mix_range", F.coalesce(before, F.lit(0)).alias("_mix_before"))

    sizes = counts.groupBy(F.col("_mix_source").alias("source")).agg(F.sum("n").alias("rows"))
    sized = integer_weights(sizes, period, temperature, weights)
    one = sized.agg(F.array_sort(F.collect_list(F.struct("source", "rows", "w"))).alias("of")).filter(F.size("of") > 0)
    blocks_of = F.transform("of", lambda x: whole(x["rows"] + block_rows - 1, F.lit(block_rows).cast("long")))
    blocks = F.aggregate(blocks_of, F.lit(0).cast("long"), lambda a, b: a + b)
    last = F.array_max(F.transform("of", lambda x: window_of(whole(x["rows"] - 1, F.lit(block_rows).cast("long")), x["w"], period)[1]))
    one = one.select("of", F.least(last, LONGEST * blocks + F.size("of")).alias("total"))
    sources = one.select("total", F.size("of").alias("n"), F.posexplode("of").alias("s", "x"))
    sources = sources.select(F.col("x.source").alias("_mix_source"), F.col("s").alias("_mix_s"), F.col("x.w").alias("_mix_w"), F.col("total").alias("_mix_total"), F.col("n").alias("_mix_sources"))
    # the first slot for which a source has no whole block left; the least of them ends the mixture proper
    plan = one.select("of", "total", slots_of(F.transform("of", lambda x: x["w"]), period, F.col("total")).alias("slots"))
    short = F.transform("slots", lambda x, i: F.when(x["j"] == whole(F.get(F.col("of"), x["s"])["rows"], F.lit(block_rows).cast("long")), i.cast("long")))
    plan = plan.select("slots", F.coalesce(F.array_min(short), "total").alias("_mix_horizon"))
    plan = plan.select("_mix_horizon", F.posexplode("slots").alias("slot", "x"))
    plan = plan.select(F.col("x.s").alias("_mix_s"), F.col("x.j").alias("mix_block"), F.col("slot").cast("long").alias("_mix_slot"), "_mix_horizon")

    within = Window.partitionBy("_mix_source", "_mix_range").orderBy("_mix_order")
    numbered = rows.withColumn("_mix_n", F.row_number().over(within) - 1).join(starts, ["_mix_source", "_mix_range"])
    at = F.col("_mix_before") + F.col("_mix_n")
    numbered = numbered.withColumn("_mix_at", at).withColumn("mix_block", F.floor(F.col("_mix_at") / block_rows))
    out = numbered.join(F.broadcast(sources), "_mix_source").join(plan.hint("merge"), ["_mix_s", "mix_block"], "left")  # the plan grows with the table: no broadcast
    # a chunk may end past the total, and what follows must not meet it
    after = F.col("_mix_total") + CHUNK + F.col("mix_block") * F.col("_mix_sources") + F.col("_mix_s")
    release, deadline = window_of(F.col("mix_block"), F.col("_mix_w"), period)
    placed = F.col("_mix_slot").isNotNull()
    return out.withColumn("mix_slot", F.coalesce("_mix_slot", after)).select(
        *[F.col(f"`{c}`") for c in kept],
        "mix_block",
        F.when(placed, release).otherwise(F.col("mix_slot")).alias("mix_release"),
        F.when(placed, deadline).otherwise(F.col("mix_slot") + 1).alias("mix_deadline"),
        "mix_slot",
        (F.col("mix_slot") * block_rows + F.col("_mix_at") % block_rows).alias("mix_position"),
        F.coalesce(F.col("_mix_slot") < F.col("_mix_horizon"), F.lit(False)).alias("in_mix"),
    )


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """``docs``, every row and no other column, in files that follow the mixture: reading them in order reads the mix."""
    return pfair_mix(docs, **options).repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*docs.columns)


def with_file_order(docs: DataFrame, name: str = "mix_position") -> DataFrame:
    """``docs`` as read from Parquet, and ``name``: the row's place, from 0, when all files are read in order.

    A table of rows carries no order of its own and tasks take files by size, so the order of ``in_mixed_order`` is
    taken from where each row stands: Spark's number of the file, then the row in it. Rows that do not come straight
    from files are written first, in the order of their partitions.
    """

    def placed(df: DataFrame) -> DataFrame:
        return df.select("*", F.col("_metadata.file_name").alias("_mix_file"), F.col("_metadata.row_index").alias("_mix_row"))

    try:
        rows = placed(docs)
        rows.schema  # noqa: B018 - resolves the names
    except AnalysisException:
        rows = placed(stage(docs, f"{shared_dir(docs.sparkSession, 'mixed')}/rows"))
    # part-<task>-<job>-c<file of the task>: by number, as names of more than five digits do not sort
    number = [F.regexp_extract("_mix_file", p, 1).cast("long") for p in (r"^part-(\d+)", r"-c(\d+)\.")]
    counts = rows.groupBy("_mix_file").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(*number, "_mix_file").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_mix_file", F.coalesce(before, F.lit(0)).alias("_mix_before"))
    return rows.join(F.broadcast(starts), "_mix_file").select(*[F.col(f"`{c}`") for c in docs.columns], (F.col("_mix_before") + F.col("_mix_row")).alias(name))
