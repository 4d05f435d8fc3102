"""Latency and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathmere.session import cut_lineage

PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
FLOOR = 1e-9


#: Values that may still differ when the rounds of a rank end; so many rows meet in one window.
FEW = 100_000
#: Cells of the histogram of one round: each round keeps about three of them.
CELLS = 256


def values_at_ranks(
    df: DataFrame, keys: list[str], column: str, ranks: dict[str, tuple[float, Column]], few: int = FEW, cells: int = CELLS
) -> DataFrame:
    """Exact order statistics per group, without holding a group in one task.

    ``ranks`` maps an output name to (fraction, rank), the rank counted from 1 as an expression
    of the group size ``n``. A round cuts the bracket of each rank at two edges of an equi-depth
    histogram around it, counts the values below, at, between and above these edges (combined on
    the map side) and takes the histogram of the part in between. Counts are exact, so the part
    that holds the rank is known: an edge itself, the inside (about ``3 / cells`` of the bracket)
    or a side. Rounds end when every bracket holds at most ``few`` values or one value; groups
    within ``few`` need none. Ties end as an edge, whatever their number. Integers and decimals
    beyond 53 bits are exact as well; a bracket whose values the histogram, which counts in
    doubles, cannot part is left to the window.
    """
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_v"))
    state = rank_brackets(rows, keys, ranks, few, cells)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    inside = [F.when((F.col(f"{name}.lo") < F.col(f"{name}.hi")) & F.col("_v").between(F.col(f"{name}.lo"), F.col(f"{name}.hi")), F.lit(name)) for name in ranks]
    near = rows.join(state, same).select(*[f"_k{i}" for i in range(len(keys))], "_v", F.explode(F.array_compact(F.array(*inside))).alias("_t"), *ranks)
    by = [f"_k{i}" for i in range(len(keys))] + ["_t"]
    at = F.coalesce(*[F.when(F.col("_t") == name, F.col(f"{name}.at")) for name in ranks])
    counted = near.groupBy(*by, "_v", at.alias("_at")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_v"))
    hits = counted.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_at")) & (F.col("_upto") - F.col("_c") < F.col("_at")))
    found = hits.groupBy(*[F.col(f"_k{i}").alias(f"_f{i}") for i in range(len(keys))]).agg(*[F.min(F.when(F.col("_t") == name, F.col("_v"))).alias(f"_value_{name}") for name in ranks])
    matched = [F.col(f"_k{i}").eqNullSafe(F.col(f"_f{i}")) for i in range(len(keys))]
    values = [F.when(F.col(f"{name}.lo") < F.col(f"{name}.hi"), F.col(f"_value_{name}")).otherwise(F.col(f"{name}.lo")).alias(name) for name in ranks]
    return state.join(found, matched, "left").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "n", *values)


def rank_brackets(rows: DataFrame, keys: list[str], ranks: dict[str, tuple[float, Column]], few: int = FEW, cells: int = CELLS) -> DataFrame:
    """Groups (``_k0``, ...) of ``rows`` (keys, ``_v``) with ``n`` and a closed bracket of values for each rank."""
    if cells < 8:
        raise ValueError("a round needs at least 8 cells to cut a bracket")
    grid = [k / cells for k in range(cells + 1)]
    histogram = lambda value: F.percentile_approx(value, grid, 16 * cells)
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), histogram(F.col("_v")).alias("_q"))
    bracket = lambda at, lo, hi, inside, q, before: F.struct(
        at.alias("at"), lo.alias("lo"), hi.alias("hi"), inside.alias("inside"), q.alias("q"), (inside > before * 0.75).alias("stuck")
    )
    whole = [bracket(rank.cast("long"), F.col("_lo"), F.col("_hi"), F.col("n"), F.col("_q"), F.lit(float("inf"))).alias(name) for name, (_, rank) in ranks.items()]
    state = cut_lineage(stats.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n", *whole))
    wide = lambda name: (F.col(f"{name}.inside") > few) & (F.col(f"{name}.lo") < F.col(f"{name}.hi")) & ~F.col(f"{name}.stuck")
    size = F.sum(sum((F.when(wide(name), F.col(f"{name}.inside")).otherwise(0) for name in ranks), F.lit(0).cast("decimal(38,0)")))
    left = state.agg(size).first()[0]
    while left:
        state = cut_lineage(_narrowed(rows, state, keys, list(ranks), wide, histogram, bracket, cells))
        left = state.agg(size).first()[0]
    return state


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str], names: list[str], wide, histogram, bracket, cells: int) -> DataFrame:
    """The state after one round: ``at`` counts from the start of each new bracket."""
    v = F.col("_v")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]

    def edge(name: str, step: int, default: str) -> Column:
        cell = F.floor((F.col(f"{name}.at") - 1) / F.col(f"{name}.inside") * cells)
        at = F.greatest(F.least(cell + step, F.lit(cells)), F.lit(0)).cast("int")
        edge = F.coalesce(F.get(f"{name}.q", at), F.col(f"{name}.{default}"))
        # an approximate edge is kept inside the bracket
        return F.greatest(F.least(edge, F.col(f"{name}.hi")), F.col(f"{name}.lo"))

    edges = {f"_a_{n}": F.when(wide(n), edge(n, -1, "lo")) for n in names} | {f"_b_{n}": F.when(wide(n), edge(n, 2, "hi")) for n in names}
    open_ = state.where(_any(wide(n) for n in names)).withColumns(edges)
    near = rows.join(open_, same).where(_any(wide(n) & v.between(F.col(f"{n}.lo"), F.col(f"{n}.hi")) for n in names))
    counts: list[Column] = []
    for n in names:
        a, b = F.col(f"_a_{n}"), F.col(f"_b_{n}")
        within = v.between(F.col(f"{n}.lo"), F.col(f"{n}.hi"))
        between = (v > a) & (v < b)
        counts += [F.struct(
            F.count_if(within & (v < a)).alias("below"), F.count_if(v == a).alias("first"), F.count_if(between).alias("mid"),
            F.count_if((v == b) & (b > a)).alias("last"), F.max(F.when(within & (v < a), v)).alias("under"), F.min(F.when(within & (v > b), v)).alias("over"),
            F.min(F.when(between, v)).alias("least"), F.max(F.when(between, v)).alias("most"), histogram(F.when(between, v)).alias("q"),
        ).alias(f"_c_{n}")]
    group = [f"_k{i}" for i in range(len(keys))]
    # the edges are the same in all rows of a group
    met = near.groupBy(*group, *edges).agg(*counts)
    renamed = met.select(*[F.col(g).alias(f"_m{i}") for i, g in enumerate(group)], *edges, *[f"_c_{n}" for n in names])
    both = state.join(renamed, [F.col(g).eqNullSafe(F.col(f"_m{i}")) for i, g in enumerate(group)], "left")

    def chosen(n: str) -> Column:
        c = lambda field: F.col(f"_c_{n}.{field}")
        at, none, size = F.col(f"{n}.at"), F.lit(None), F.col(f"{n}.inside")
        one = F.lit(1).cast("long")
        upto_first = c("below") + c("first")
        upto_mid = upto_first + c("mid")
        upto_last = upto_mid + c("last")
        return (
            F.when(~wide(n), F.col(n))
            .when(at <= c("below"), bracket(at, F.col(f"{n}.lo"), c("under"), c("below"), none, size))
            .when(at <= upto_first, bracket(one, F.col(f"_a_{n}"), F.col(f"_a_{n}"), c("first"), none, size))
            .when(at <= upto_mid, bracket(at - upto_first, c("least"), c("most"), c("mid"), c("q"), size))
            .when(at <= upto_last, bracket(one, F.col(f"_b_{n}"), F.col(f"_b_{n}"), c("last"), none, size))
            .otherwise(bracket(at - upto_last, c("over"), F.col(f"{n}.hi"), size - upto_last, none, size))
        )

    return both.select(*group, "n", *[chosen(n).alias(n) for n in names])


def _any(conditions) -> Column:
    found = F.lit(False)
    for condition in conditions:
        found = found | condition
    return found


def nearest_rank(fraction: float) -> tuple[float, Column]:
    """Smallest value with at least this fraction of all values at or below it."""
    return fraction, F.greatest(F.ceil(F.lit(fraction) * F.col("n")), F.lit(1))


def upper_median(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Element at position n/2 counted from 0: the upper of two middle values."""
    at = (0.5, F.floor(F.col("n") / 2) + 1)
    return values_at_ranks(df, keys, column, {"median": at})


def middle_two_median(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Median that averages the two middle values."""
    ranks = {
        "_low": (0.5, F.floor((F.col("n") + 1) / 2)),
        "_high": (0.5, F.floor(F.col("n") / 2) + 1),
    }
    found = values_at_ranks(df, keys, column, ranks)
    return found.withColumn("median", (F.col("_low") + F.col("_high")) / 2).drop("_low", "_high")


def latency_summary(metrics: DataFrame) -> DataFrame:
    """Count and nearest-rank percentiles of total time per operation and outcome."""
    ranks = {name: nearest_rank(p) for name, p in PERCENTILES.items()}
    return values_at_ranks(metrics, ["operation", "outcome"], "total_ms", ranks)


def stage_summary(metrics: DataFrame) -> DataFrame:
    """Same per operation and stage of the ``stages`` map."""
    stages = metrics.select("operation", F.explode("stages").alias("stage", "ms"))
    ranks = {name: nearest_rank(p) for name, p in PERCENTILES.items()}
    return values_at_ranks(stages, ["operation", "stage"], "ms", ranks)


def run_summary(runs: DataFrame) -> DataFrame:
    """Middle-two medians per scenario and variant."""
    return middle_two_median(runs, ["scenario", "variant"], "value")


def geometric_mean(column: Column) -> Column:
    # greatest() would turn a null into the floor
    return F.exp(F.avg(F.when(column.isNotNull(), F.ln(F.greatest(column, F.lit(FLOOR))))))


def speedup_by_slice(runs: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Geometric means of two variants per scenario, their ratio and an all-agree flag."""
    mean = lambda v: geometric_mean(F.when(F.col("variant") == v, F.col("value")))
    return (
        runs.groupBy("scenario")
        .agg(
            F.count("*").alias("n"),
            mean(baseline).alias("baseline_mean"),
            mean(candidate).alias("candidate_mean"),
            F.bool_and("semantic_ok").alias("all_equal"),
        )
        .withColumn("speedup", F.col("baseline_mean") / F.greatest("candidate_mean", F.lit(FLOOR)))
    )
