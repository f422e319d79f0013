"""Exact ranks, quantiles, tail means and running sums that survive a hot group.

A plain ``row_number() over (partition by g order by v)`` puts a whole group in
one task. Here the group is first collapsed to distinct values (map-side
combined), cut into value buckets, and each bucket is accumulated on its own;
bucket totals (at most ``BUCKETS + 1`` rows per group) supply the offsets. The
cut points are the values with the smallest hashes: a uniform sample of the
distinct values that is the same on every evaluation and whatever the
partitioning, so both readers of the buckets agree. The result is exact for
any cut points; they only balance the work.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourmark.session import checkpoint_dir

BUCKETS = 256
#: Sketch size, the share of ranks its answers may be off by (three times its 99 % error), values of a bracket a group may hold
#: at a time, ranks at which a sketch is read, and rows up to which a group is one bracket.
SKETCH, SLACK, HELD, GRID, SMALL = 4096, 0.003, 50_000, 512, 1000


def _count_below(cuts: Column, value: Column, size: int) -> Column:
    """How many entries of a sorted array lie below ``value``: binary search in log2 steps."""
    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        open_ = acc["lo"] < acc["hi"]
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = open_ & (F.get(cuts, mid) < value)
        return F.struct(
            F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~right, mid).otherwise(acc["hi"]).alias("hi")
        )

    steps = F.array(*[F.lit(i) for i in range(size.bit_length())])
    return F.aggregate(steps, start, halve)["lo"]


def _bucketed(df: DataFrame, groups: Sequence[str], order: str, count: str, buckets: int) -> DataFrame:
    """Add ``_bucket``: how many of the group's cut points lie below ``order``.

    ``count`` is an exact (integer) column; hashing it too makes this branch
    read the same columns as the others, so all share one shuffle.

    The sample is bounded to ``buckets`` values per group by a windowed limit
    that Spark applies before the shuffle as well (WindowGroupLimit). A group
    with fewer values is one bucket and carries no cut points.
    """
    pick = Window.partitionBy(*groups).orderBy(F.xxhash64(order, count), order)
    cuts = (
        df.select(*groups, order, count)
        .withColumn("_pick", F.row_number().over(pick))
        .filter(F.col("_pick") <= buckets)
        .groupBy(*groups)
        .agg(F.array_sort(F.collect_list(order)).alias("_cuts"))
        .filter(F.size("_cuts") >= buckets)
    )
    joined = _with_groups(df, cuts, groups, "left") if groups else df.withColumn("_cuts", cuts.select("_cuts").scalar())
    bucket = F.when(F.col("_cuts").isNull(), 0).otherwise(_count_below(F.col("_cuts"), F.col(order), buckets))
    return joined.withColumn("_bucket", bucket).drop("_cuts")


def _with_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group columns in which null is a value like others."""
    renamed = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_key_{k}" for k in keys])


def running_sums(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    sums: dict[str, str],
    buckets: int = BUCKETS,
) -> DataFrame:
    """Inclusive running sum and group total of each column.

    ``df`` must hold one row per ``(groups, order)``. ``sums`` maps a source
    column to a prefix ``p``; the result gains ``p_cum`` and ``p_total``. The
    first summed column must be an exact count.
    """
    groups = list(groups)
    rows = _bucketed(df, groups, order, next(iter(sums)), buckets)
    keys = groups + ["_bucket"]
    totals = rows.groupBy(*keys).agg(*[F.sum(c).alias(f"_{p}") for c, p in sums.items()])
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_{p}").over(before), F.lit(0)).alias(f"_{p}_before") for p in sums.values()],
        *[F.sum(f"_{p}").over(whole).alias(f"{p}_total") for p in sums.values()],
    )
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"_{p}_local": F.sum(c).over(inside) for c, p in sums.items()})
    out = _with_groups(local, offsets, keys)
    out = out.withColumns({f"{p}_cum": F.col(f"_{p}_before") + F.col(f"_{p}_local") for p in sums.values()})
    return out.drop("_bucket", *[f"_{p}_{s}" for p in sums.values() for s in ("before", "local")])


def value_ranks(df: DataFrame, groups: Sequence[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """Distinct ``(groups, value)`` with multiplicity ``n``, ``n_cum`` and ``n_total``."""
    counts = (
        df.filter(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*groups, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return running_sums(counts, groups, value, {"n": "n"}, buckets)


def average_ranks(df: DataFrame, groups: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Rows of ``df`` that have a value, with its average rank (ties share the mean position) and ``n_total``."""
    ranks = value_ranks(df, groups, value).select(
        *groups, value, (F.col("n_cum") - (F.col("n") - 1) / 2.0).alias(out), "n_total"
    )
    return _with_groups(df, ranks, [*groups, value])


def rank_window_average(df: DataFrame, groups: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Average rank for groups of known small size (a day's hours): one window, no collapse."""
    ordered = Window.partitionBy(*groups).orderBy(value)
    ties = Window.partitionBy(*groups, value)
    return df.withColumn(out, F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def _first_last() -> tuple[Column, Column]:
    """Zero-based positions a distinct value occupies."""
    return F.col("n_cum") - F.col("n"), F.col("n_cum") - 1


@dataclass(frozen=True)
class Target:
    """A zero-based position in a group's sorted values (a column over ``n_total``), the one after it, or the sum beyond."""

    name: str
    position: Column
    pair: bool = False
    beyond: bool = False


def _settled(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def located(df: DataFrame, groups: Sequence[str], value: str, targets: Sequence[Target], held: int = HELD, sketch: int = SKETCH, slack: float = SLACK) -> DataFrame:
    """Per group: n_total, lowest, highest, and per target ``name_at``, ``name_next`` (of pairs), and ``name_beyond`` with ``name_fill``.

    A first scan sketches every group (a mergeable quantile sketch of fixed
    size) and brackets each position; a second one counts exactly what lies below
    and at the ends of the bracket and holds only the values within. A group
    whose brackets would hold more than ``held`` values is bracketed again within
    them first. A position that fell outside its bracket, which the counts show, is found by
    full ranking instead, so results never rest on the sketch. ``name_beyond`` is
    the sum of all values above that at the position, ``name_fill`` how many copies of
    it stand at the position and after. Nulls and NaN are left out.
    """
    keys = list(groups) or ["_all"]
    number = range(len(targets))
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    rows = rows.select(*groups, F.col(value).cast("double").alias("_v")) if groups else rows.select(F.lit(0).alias("_all"), F.col(value).cast("double").alias("_v"))
    n, v = F.col("n_total"), F.col("_v")
    facts = ["n_total", "lowest", "highest", *[f"_p{i}" for i in number]]
    ranks = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"), F.min(v).alias("lowest"), F.max(v).alias("highest"), F.kll_sketch_agg_double(v, F.lit(sketch)).alias("_s"))
    whole = whole.select(*keys, "n_total", "lowest", "highest", F.when(n > SMALL, F.kll_sketch_get_quantile_double("_s", ranks)).alias("_r"))
    state = whole.select(
        *keys, "n_total", "lowest", "highest", *[t.position.cast("bigint").alias(f"_p{i}") for i, t in enumerate(targets)],
        *[c for i in number for c in (F.lit(0).cast("bigint").alias(f"_b{i}"), n.alias(f"_m{i}"), F.col("lowest").alias(f"_lo{i}"), F.col("highest").alias(f"_hi{i}"), F.col("_r").alias(f"_r{i}"))],
    )
    while True:
        state = _settled(state.select(*keys, *facts, *[c for i, t in enumerate(targets) for c in _narrowed(i, t, slack)]))
        # what a bracket may hold shrinks by the slack each time, so large groups take one round more
        wide = state.agg(F.max(F.greatest(*[F.col(f"_m{i}") for i in number], F.lit(0)))).first()[0] or 0
        near = _with_groups(rows, state.select(*keys, F.struct(*[c for c in state.columns if c not in keys]).alias("_t")), keys)
        lo, hi = (lambda i: F.col(f"_t._lo{i}")), (lambda i: F.col(f"_t._hi{i}"))
        within = lambda i: (v > lo(i)) & (v < hi(i))
        if wide <= SMALL or wide * 2 * (slack + 1 / GRID) <= held:
            break
        # only what lies strictly within counts, so a value with very many copies at an end does not keep the bracket wide
        again = near.groupBy(*keys).agg(F.first("_t").alias("_t"), *[c for i in number for c in (
            F.count_if(v <= lo(i)).alias(f"_b{i}"), F.count_if(within(i)).alias(f"_m{i}"), F.kll_sketch_agg_double(F.when(within(i), v), F.lit(sketch)).alias(f"_s{i}"),
        )])
        state = again.select(*keys, *[f"_t.{c}" for c in facts], *[c for i in number for c in (
            F.col(f"_b{i}"), F.col(f"_m{i}"), lo(i).alias(f"_lo{i}"), hi(i).alias(f"_hi{i}"), F.when(F.col(f"_m{i}") > SMALL, F.kll_sketch_get_quantile_double(f"_s{i}", ranks)).alias(f"_r{i}"),
        )])
    counted = near.groupBy(*keys).agg(F.first("_t").alias("_t"), *[c for i in number for c in (
        F.count_if(v < lo(i)).alias(f"_b{i}"), F.count_if(v == lo(i)).alias(f"_l{i}"), F.count_if((v == hi(i)) & (hi(i) > lo(i))).alias(f"_h{i}"),
        F.collect_list(F.when(within(i), v)).alias(f"_x{i}"), *([F.sum(F.when(v > hi(i), v)).alias(f"_a{i}")] if targets[i].beyond else []),
    )])
    exact = counted.select(*keys, *[f"_t.{c}" for c in facts], *[c for i in number for c in (lo(i).alias(f"_lo{i}"), hi(i).alias(f"_hi{i}"))], *[c for c in counted.columns if c not in keys and c != "_t"])
    exact = exact.withColumns({f"_x{i}": F.sort_array(f"_x{i}") for i in number})
    found = []
    for i, t in enumerate(targets):
        at = _at(i, F.col(f"_p{i}"))
        after = _at(i, F.least(F.col(f"_p{i}") + 1, n - 1))
        found.append(at.alias(f"{t.name}_at"))
        if t.pair:
            found.append(after.alias(f"{t.name}_next"))
        if t.beyond:
            lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
            inner = F.aggregate(F.filter(f"_x{i}", lambda x: x > at), F.lit(0.0), lambda a, x: a + x)
            above = F.coalesce(F.col(f"_a{i}"), F.lit(0.0)) + F.when(at < hi, hi * F.col(f"_h{i}")).otherwise(0.0) + inner
            found.append(above.alias(f"{t.name}_beyond"))
            over = n - F.col(f"_b{i}") - F.col(f"_l{i}") - F.size(f"_x{i}") - F.col(f"_h{i}")  # above the bracket
            over = over + F.when(at < hi, F.col(f"_h{i}")).otherwise(0) + F.size(F.filter(f"_x{i}", lambda x: x > at))
            found.append((n - F.col(f"_p{i}") - over).alias(f"{t.name}_fill"))
    out = _settled(exact.select(*keys, "n_total", "lowest", "highest", *found))
    missed = F.exists(F.array(*[F.col(f"{t.name}_{c}") for t in targets for c in (["at", "next"] if t.pair else ["at"])]), lambda x: x.isNull())
    lost = out.filter(missed).select(*keys)
    if lost.limit(1).count():
        out = out.filter(~missed).unionByName(_ranked_targets(_with_groups(rows, lost, keys, "left_semi"), keys, targets))
    return out if groups else out.drop("_all")


def _narrowed(i: int, t: Target, slack: float) -> list[Column]:
    """The state of target ``i`` with the bracket its sketch gives; small groups and the ends of a group stay as they are."""
    p, below, inside = F.col(f"_p{i}"), F.col(f"_b{i}"), F.col(f"_m{i}")
    last = p + 1 if t.pair else p
    read = F.col(f"_r{i}")
    rows = F.greatest(inside, F.lit(1))
    low = F.floor(((p - below) / rows - slack) * GRID).cast("int")
    high = F.greatest(F.lit(0), F.ceil(((last - below) / rows + slack) * GRID).cast("int"))
    lo = F.when((inside > SMALL) & (low > 0) & (low <= GRID), F.greatest(F.col(f"_lo{i}"), F.get(read, low))).otherwise(F.col(f"_lo{i}"))
    hi = F.when((inside > SMALL) & (high < GRID), F.least(F.col(f"_hi{i}"), F.get(read, high))).otherwise(F.col(f"_hi{i}"))
    return [below, inside, lo.alias(f"_lo{i}"), hi.alias(f"_hi{i}")]


def _at(i: int, position: Column) -> Column:
    """The value at a position of target ``i`` by its exact counts; null outside the bracket."""
    q, lows, inner, highs = position - F.col(f"_b{i}"), F.col(f"_l{i}"), F.size(f"_x{i}"), F.col(f"_h{i}")
    return (
        F.when(q < 0, F.lit(None)).when(q < lows, F.col(f"_lo{i}")).when(q < lows + inner, F.get(F.col(f"_x{i}"), (q - lows).cast("int")))
        .when(q < lows + inner + highs, F.col(f"_hi{i}"))
    )


def _ranked_targets(rows: DataFrame, keys: Sequence[str], targets: Sequence[Target]) -> DataFrame:
    """The columns of ``located`` by full ranking."""
    first, last = _first_last()
    n, v = F.col("n_total"), F.col("_v")
    holds = lambda p: (first <= p) & (p <= last)
    ranked = value_ranks(rows, keys, "_v")
    out = [F.max("n_total").alias("n_total"), F.min("_v").alias("lowest"), F.max("_v").alias("highest")]
    for t in targets:
        p = t.position.cast("bigint")
        out.append(F.max(F.when(holds(p), v)).alias(f"{t.name}_at"))
        if t.pair:
            out.append(F.max(F.when(holds(F.least(p + 1, n - 1)), v)).alias(f"{t.name}_next"))
        if t.beyond:
            out.append(F.coalesce(F.sum(F.when(first > p, v * F.col("n"))), F.lit(0.0)).alias(f"{t.name}_beyond"))
            out.append(F.max(F.when(holds(p), n - p - (n - 1 - last))).alias(f"{t.name}_fill"))
    return ranked.groupBy(*keys).agg(*out)


def _level(name: str, level: float) -> tuple[Target, Column]:
    """The target of one linear quantile, and the quantile from what is found."""
    position = (F.col("n_total") - 1) * F.lit(float(level))
    at, after = F.col(f"{name}_at"), F.col(f"{name}_next")
    between = position > F.floor(position)
    return Target(name, F.floor(position), pair=True), F.when(between, at + (after - at) * (position - F.floor(position))).otherwise(at)


def _tail(alpha: float) -> tuple[Target, Column, Column]:
    """The target of an upper tail, its mean and its size: the largest ``max(1, ceil((1 - alpha) n))`` values.

    The tail is all values above that at its first position, and the copies of it from there on.
    """
    n = F.col("n_total")
    tail = F.greatest(F.lit(1), F.ceil(F.round((1.0 - alpha) * n, 9))).cast("bigint")
    mean = (F.col("_tail_beyond") + F.col("_tail_at") * F.col("_tail_fill")) / tail
    return Target("_tail", n - tail, beyond=True), mean, tail


def quantile_and_tail(df: DataFrame, groups: Sequence[str], value: str, alpha: float, quantile: str, tail: str) -> DataFrame:
    """One quantile and the mean beyond it from the same two scans."""
    level, expression = _level("_q", alpha)
    target, mean, _ = _tail(alpha)
    return located(df, groups, value, [level, target]).select(*groups, expression.alias(quantile), mean.alias(tail))


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, levels: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Linear-interpolated quantiles as one wide row per group."""
    parts = [_level(f"_{i}", level) for i, level in enumerate(levels)]
    found = located(df, groups, value, [t for t, _ in parts])
    return found.select(*groups, *[e.alias(name) for (_, e), name in zip(parts, names, strict=True)])


def describe(df: DataFrame, groups: Sequence[str], value: str, levels: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Rows, minimum, maximum and exact quantiles of a column."""
    parts = [_level(f"_{i}", level) for i, level in enumerate(levels)]
    found = located(df, groups, value, [t for t, _ in parts])
    quantiles = [e.alias(name) for (_, e), name in zip(parts, names, strict=True)]
    return found.select(*groups, F.col("n_total").alias("rows"), "lowest", F.col("highest").alias("peak"), *quantiles)


def order_statistic(
    df: DataFrame, groups: Sequence[str], value: str, position: Column, out: str = "value"
) -> DataFrame:
    """The value at a one-based ``position`` (an expression over ``n_total``) per group; none beyond its ends."""
    found = located(df, groups, value, [Target("_x", F.greatest(F.lit(0), F.least(F.col("n_total"), position) - 1))])
    return found.filter((position >= 1) & (position <= F.col("n_total"))).select(*groups, F.col("_x_at").alias(out), "n_total")


def upper_tail_means(
    df: DataFrame, groups: Sequence[str], value: str, alpha: float, out: str = "cvar"
) -> DataFrame:
    """Mean of the largest ``max(1, ceil((1 - alpha) * n))`` values per group."""
    target, mean, tail = _tail(alpha)
    return located(df, groups, value, [target]).select(*groups, mean.alias(out), tail.alias("tail_count"))


def minimum_cvar(df: DataFrame, groups: Sequence[str], value: str, alpha: float, out: str = "cvar") -> DataFrame:
    """Exact empirical CVaR: minimum over thresholds of ``eta + E[(x - eta)+] / (1 - alpha)``.

    Running count and sum give every threshold's mean excess at once, in place
    of a self-join of all losses with all thresholds.
    """
    losses = (
        df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n")).withColumn("_sum", F.col(value) * F.col("n"))
    )
    ranked = running_sums(losses, groups, value, {"n": "n", "_sum": "s"})
    excess = (F.col("s_total") - F.col("s_cum")) - F.col(value) * (F.col("n_total") - F.col("n_cum"))
    objective = F.col(value) + excess / F.col("n_total") / F.lit(1.0 - alpha)
    return ranked.groupBy(*groups).agg(F.min(objective).alias(out))


def top_n(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, flag: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group (a pre-shuffle limit keeps groups small)."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    if flag is not None:
        return ranked.withColumn(flag, (F.col("_rn") <= n).cast("int")).drop("_rn")
    return ranked.filter(F.col("_rn") <= n).drop("_rn")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest record per key by ``max_by``: partial aggregation, no sort of the group."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def small_group_tail_mean(df: DataFrame, groups: Sequence[str], value: str, alpha: float, out: str) -> DataFrame:
    """Upper-tail mean for many groups of known small size (days of one resample): one window."""
    w = Window.partitionBy(*groups)
    ranked = df.select(*groups, value).withColumns(
        {"_rn": F.row_number().over(w.orderBy(F.col(value).desc())), "_n": F.count(F.lit(1)).over(w)}
    )
    tail = F.greatest(F.lit(1), F.ceil(F.round((1.0 - alpha) * F.col("_n"), 9)))
    return ranked.filter(F.col("_rn") <= tail).groupBy(*groups).agg(F.avg(value).alias(out))
