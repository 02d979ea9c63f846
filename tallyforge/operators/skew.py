"""Ordered computations that never bring one whole key into one task.

A window over a hot key sorts all its rows in one task. Each helper here splits a key into chunks
that follow the sort order, works per (key, chunk), and links the chunks through a table with one
row per (key, chunk). The cuts come from quantiles of the key's own rows, or from a function of the
sort column that the caller gives; they only decide how the work is spread, never the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.maths import col
from tallyforge.session import scratch_path

SKETCH_ACCURACY = 10_000
BRACKET_MARGIN = 4e-4  # rank share kept on each side of a quantile; the sketch is off by at most 1e-4
CELLS = 1024  # chunks a key is split into at most
CHUNK_ROWS = 1 << 20  # a key with fewer rows is one chunk
SMALL_GROUP = 1 << 16  # a group of at most so many rows is sorted as one array
VALUE_ROWS = 1 << 20  # rows of a file of written values, and so of a task that reads it


def position_in(edges, value) -> Column:
    """How many of the ascending array ``edges`` (fewer than ``CELLS``) lie below ``value``, by bisection; 0 without edges."""
    halves = F.array(*[F.lit(1 << b) for b in reversed(range(CELLS.bit_length() - 1))])
    found = F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get(edges, at + half - 1) < value, at + half).otherwise(at))
    return F.when(edges.isNull(), F.lit(0)).otherwise(F.coalesce(found, F.lit(0)))


def _key(keys: list[str]) -> Column:
    """The key as one struct: it is never null, so that null keys meet in joins."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))


def own_chunks(df: DataFrame, keys: list[str], order: str, chunk_rows: int = CHUNK_ROWS, cut: str | None = None) -> DataFrame:
    """Adds ``_chunk``: cuts each key with more than ``chunk_rows`` rows at quantiles of its own ``order`` column.

    ``order`` may be a struct, so equal leading values are cut by the columns behind them. A key's cuts are a hash sample of
    about 8 values a chunk, thinned; they depend on the rows alone. Only rows equal in all of ``order`` stay together.
    ``cut`` names a further column: whether the key of the row is cut at all.

    The cuts are broadcast, so that no row moves for them: there is at most about one to ``chunk_rows`` rows of the table, a
    million for 10^12 rows. Without a hot key the rows are read once more, to count them.
    """
    rows = df.withColumn("_g", _key(keys))
    hot = rows.groupBy("_g").agg(F.count("*").alias("_n")).where(F.col("_n") > chunk_rows)
    wanted = F.least(F.lit(CELLS - 1), F.ceil(F.col("_n") / chunk_rows))
    cuts = (
        rows.select("_g", order).join(F.broadcast(hot), "_g")
        .where(F.pmod(F.xxhash64(order), F.greatest(F.lit(1), F.floor(F.col("_n") / (8 * wanted)))) == 0)
        .groupBy("_g").agg(F.array_sort(F.collect_set(order)).alias("_s"), F.first(wanted).alias("_wanted"))
        .select("_g", F.filter("_s", lambda x, i: (i + 1) % F.ceil(F.size("_s") / F.col("_wanted")) == 0).alias("_cuts"))
    )
    whether = [F.col("_cuts").isNotNull().alias(cut)] if cut else []
    return rows.join(F.broadcast(cuts), "_g", "left").select(*df.columns, position_in(F.col("_cuts"), F.col(order)).alias("_chunk"), *whether)


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the largest ``order`` per key, combined map-side (no window, no hot task)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.`{c}`").alias(c) for c in rest])


def chunked_lag(df: DataFrame, keys: list[str], order: list[str], chunk: Column | None, columns: dict[str, str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``lag(column, 1)`` per key as new columns ``{new: old}``.

    ``chunk`` is a function of the sort column that cuts every key; without it only keys of more than ``chunk_rows`` rows are cut, at
    quantiles of their own, and no other row is moved twice.
    """
    if chunk is None:
        part = own_chunks(df.withColumn("_order", F.struct(*order)), keys, "_order", chunk_rows, "_cut").drop("_order")
    else:
        part = df.withColumns({"_chunk": chunk, "_cut": F.lit(True)})
    cells = [*keys, "_chunk"]
    w = Window.partitionBy(*cells).orderBy(*order)
    old = F.struct(*[F.col(o).alias(n) for n, o in columns.items()])
    inner = part.withColumn("_prev", F.lag(old).over(w))
    tails = part.where("_cut").groupBy(*cells).agg(F.max_by(old, F.struct(*order)).alias("_tail"))
    carried = tails.select(
        *cells, F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carry")
    )
    joined = inner.join(carried, cells, "left")
    prev = F.coalesce(F.col("_prev"), F.col("_carry"))
    return joined.select(*df.columns, *[prev[n].alias(n) for n in columns])


def chunked_running(
    df: DataFrame, keys: list[str], order: list, sums: dict[str, str], chunk: Column | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Running sums ``{new: old}`` per key up to and including the row, in ascending ``order`` (columns or names); a null key is a key.

    ``chunk`` is for an order whose even cuts are known, such as a hash; otherwise the rows' own quantiles cut it.
    """
    keyed = df.withColumn("_order", F.struct(*[col(o).alias(f"o{i}") for i, o in enumerate(order)]))
    part = own_chunks(keyed, keys, "_order", chunk_rows) if chunk is None else keyed.withColumn("_chunk", chunk)
    part = part.withColumn("_g", _key(keys))
    w = Window.partitionBy("_g", "_chunk").orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = part.select("*", *[F.sum(o).over(w).alias(f"_in_{n}") for n, o in sums.items()])
    totals = part.groupBy("_g", "_chunk").agg(*[F.sum(o).alias(f"_all_{n}") for n, o in sums.items()])
    before = Window.partitionBy("_g").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "_g", "_chunk", *[F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums]
    )
    return inner.join(carried, ["_g", "_chunk"], "left").select(
        *df.columns, *[(F.col(f"_in_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums]
    )


def chunked_row_number(
    df: DataFrame, keys: list[str], order: list, name: str, chunk: Column | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """``row_number`` in ascending ``order``; works without keys, too."""
    out = chunked_running(df.withColumn("_one", F.lit(1)), keys, order, {name: "_one"}, chunk, chunk_rows)
    return out.select(*df.columns, F.col(name).cast("bigint").alias(name))


def chunked_rank(df: DataFrame, keys: list[str], score: str, ties: list[str], name: str = "rank", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``row_number`` by score descending (NaN first, null last), then ``ties``."""
    falling = [F.col(score).isNull(), ~F.isnan(score), -F.col(score)]
    return chunked_row_number(df, keys, [*falling, *ties], name, None, chunk_rows)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: tuple[float, ...], small: int = SMALL_GROUP) -> DataFrame:
    """Count, mean, min, max and exact interpolated quantiles ``_p0, _p1, …`` of groups of any size.

    The values are written once and read back, as later passes must meet the values of the first: a sum of doubles may change its
    last bit when it is computed again. Groups of up to ``SMALL_GROUP`` rows meet in one exchange and are sorted as one array each. The others, at most one to
    ``SMALL_GROUP`` rows of the table, are broadcast where rows meet them, so none of their rows moves: a sketch brackets each
    wanted rank, and a second pass counts the rows below each bracket and keeps only the values inside one (about 0.1 % of a group
    per quantile) and the next value on either side. Only those are ranked; they still meet in one task per group. A rank outside
    its bracket fails the job instead of giving a wrong number.
    """
    path = scratch_path(df.sparkSession, "values")
    df.where(F.col(value).isNotNull()).select(_key(keys).alias("_g"), (F.col(value).cast("double") + 0.0).alias("_v")).write.option("maxRecordsPerFile", VALUE_ROWS).parquet(path)
    base = df.sparkSession.read.parquet(path)
    hot = base.groupBy("_g").agg(F.count("*").alias("_n")).where(F.col("_n") > small).select("_g")
    rest = base.join(F.broadcast(hot), "_g", "left_anti")
    out = _sorted_quantiles(rest, probabilities).unionByName(_bracketed_quantiles(base.join(F.broadcast(hot), "_g"), probabilities))
    return out.select(*[F.col("_g")[k].alias(k) for k in keys], "n", *[f"_p{i}" for i in range(len(probabilities))], "mean", "minimum", "maximum")


def _between(low: Column, high: Column, share: Column) -> Column:
    return F.when(low == high, low).otherwise(low * (1 - share) + high * share)  # equal: also infinities


def _sorted_quantiles(base: DataFrame, probabilities: tuple[float, ...]) -> DataFrame:
    """``exact_quantiles`` of ``(_g, _v)`` by one sorted array per group."""
    moved = base.repartition("_g")  # else each split is sorted by group before the exchange, however large it is
    groups = moved.groupBy("_g").agg(F.avg("_v").alias("mean"), F.array_sort(F.collect_list("_v")).alias("_s")).withColumn("n", F.size("_s").cast("bigint"))

    def at(p: float) -> Column:
        position = F.lit(float(p)) * (F.col("n") - 1)
        below = F.floor(position).cast("int")
        above = F.least(below + 1, F.col("n").cast("int") - 1)
        return _between(F.get("_s", below), F.get("_s", above), position - below)

    ends = [F.get("_s", F.lit(0)).alias("minimum"), F.get("_s", F.size("_s") - 1).alias("maximum")]
    return groups.select("_g", "n", *[at(p).alias(f"_p{i}") for i, p in enumerate(probabilities)], "mean", *ends)


def _bracketed_quantiles(base: DataFrame, probabilities: tuple[float, ...]) -> DataFrame:
    """``exact_quantiles`` of ``(_g, _v)`` with few groups of any size."""
    over = ["_g"]
    ids = range(len(probabilities))
    marks = [x for p in probabilities for x in (max(p - BRACKET_MARGIN, 0.0), min(p + BRACKET_MARGIN, 1.0))]
    stats = base.groupBy(*over).agg(
        F.count("*").alias("n"), F.avg("_v").alias("mean"), F.min("_v").alias("minimum"), F.max("_v").alias("maximum"),
        F.percentile_approx("_v", marks, SKETCH_ACCURACY).alias("_marks"),
    )
    fixed = ["n", "mean", "minimum", "maximum", *[f"_{end}{i}" for i in ids for end in ("lo", "hi")]]
    ranges = stats.select(
        *over, "n", "mean", "minimum", "maximum",
        *[F.col("_marks")[2 * i].alias(f"_lo{i}") for i in ids],
        *[F.col("_marks")[2 * i + 1].alias(f"_hi{i}") for i in ids],
    )
    inside = F.lit(False)
    for i in ids:
        inside = inside | F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
    kept = (
        base.join(F.broadcast(ranges), over)
        .withColumn("_in", F.when(inside, F.col("_v")))
        .groupBy(*over, "_in")
        .agg(
            F.count("*").alias("_c"), *[F.count_if(F.col("_v") < F.col(f"_lo{i}")).alias(f"_below{i}") for i in ids],
            *[F.max(F.when(F.col("_v") < F.col(f"_lo{i}"), F.col("_v"))).alias(f"_before{i}") for i in ids],
            *[F.min(F.when(F.col("_v") > F.col(f"_hi{i}"), F.col("_v"))).alias(f"_after{i}") for i in ids],
            *[F.first(c).alias(c) for c in fixed],
        )
    )
    whole = Window.partitionBy(*over)
    upto = whole.orderBy(F.col("_in").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = kept.select(
        "*",
        *[
            (F.sum(f"_below{i}").over(whole) + F.coalesce(F.sum(F.when(F.col("_in") >= F.col(f"_lo{i}"), F.col("_c"))).over(upto), F.lit(0))).alias(f"_upto{i}")
            for i in ids
        ],
    )

    def held(i: int, rank: Column) -> Column:
        within = F.col("_in").between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
        hit = within & (F.col(f"_upto{i}") - F.col("_c") < rank) & (rank <= F.col(f"_upto{i}"))
        below, inside = F.sum(f"_below{i}"), F.sum(F.when(within, F.col("_c")).otherwise(0))
        first = F.first(rank)  # the same in all rows of a group
        beside = F.when(first == below, F.max(f"_before{i}")).when(first == below + inside + 1, F.min(f"_after{i}"))
        return F.coalesce(F.max(F.when(hit, F.col("_in"))), beside)

    def ends(i: int) -> list[Column]:
        position = F.lit(float(probabilities[i])) * (F.col("n") - 1)
        lower = F.floor(position) + 1
        return [
            held(i, lower).alias(f"_l{i}"), held(i, F.least(lower + 1, F.col("n"))).alias(f"_u{i}"),
            F.first(position - F.floor(position)).alias(f"_s{i}"),
        ]

    picked = ranked.groupBy(*over).agg(*[c for i in ids for c in ends(i)], *[F.first(c).alias(c) for c in fixed[:4]])
    failed = F.raise_error(F.lit("quantile rank outside its bracket")).cast("double")
    values = [
        F.when(F.col(f"_l{i}").isNull() | F.col(f"_u{i}").isNull(), failed)
        .otherwise(_between(F.col(f"_l{i}"), F.col(f"_u{i}"), F.col(f"_s{i}")))
        .alias(f"_p{i}")
        for i in ids
    ]
    return picked.select("_g", "n", *values, "mean", "minimum", "maximum")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
