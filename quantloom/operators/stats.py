"""Multiple-testing statistics: deflated Sharpe ratio, stationary bootstrap, reality checks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.scalar import EULER_GAMMA, normal_cdf_of, normal_ppf, normal_ppf_of, not_nan, sample_kurtosis, sample_skew

INF = float("inf")


def expected_max_factor(n_trials: int) -> float:
    """Expected maximum of so many standard normal trials; 0 for one."""
    if n_trials < 1:
        raise ValueError(f"n_trials must be at least 1: {n_trials}")
    if n_trials == 1:
        return 0.0
    return (1 - EULER_GAMMA) * normal_ppf(1 - 1 / n_trials) + EULER_GAMMA * normal_ppf(1 - 1 / (n_trials * math.e))


def expected_max_sharpe(n_trials: int, var_trials: float) -> float:
    if var_trials < 0:
        raise ValueError(f"var_trials must not be negative: {var_trials}")
    return math.sqrt(var_trials) * expected_max_factor(n_trials)


def moments(rows: DataFrame, r: str = "r", by: Sequence[str] = ()) -> DataFrame:
    """Per run: n, mean, sd, and bias-corrected skew and kurtosis (3 for a normal), over the known returns."""
    rows = rows.withColumn("__r", not_nan(F.col(r)))
    g = rows.groupBy(*by).agg(F.count("__r").alias("n"), F.avg("__r").alias("mean"), F.stddev_samp("__r").alias("sd"), F.skewness("__r").alias("g1"), F.kurtosis("__r").alias("g2"))
    n = F.col("n").cast("double")
    return g.select(*by, "n", "mean", "sd", sample_skew(F.col("g1"), n).alias("skew"), (sample_kurtosis(F.col("g2"), n) + 3).alias("kurtosis"))


def expected_max_factor_of(n_trials: Column) -> Column:
    """The same for a number of trials in each row; null where it is below 1."""
    n = n_trials.cast("double")
    several = (1 - EULER_GAMMA) * normal_ppf_of(1 - 1 / n) + EULER_GAMMA * normal_ppf_of(1 - 1 / (n * math.e))
    return F.when(n == 1, 0.0).when(n > 1, several)


def sharpe_moments(rows: DataFrame, r: str = "r", by: Sequence[str] = ()) -> DataFrame:
    """Per run: the moments, sharpe per bar and term, the variance of sharpe times n - 1; null where it isn't positive."""
    m = moments(rows, r, by).withColumn("sharpe", F.when(F.col("n") >= 2, F.try_divide(F.col("mean"), F.when(F.col("sd") > 1e-14, F.col("sd")))))
    sr = F.col("sharpe")
    term = 1 - F.col("skew") * sr + (F.col("kurtosis") - 1) / 4 * sr * sr
    return m.withColumn("term", F.when(term > 0, term))


def hurdle_and_z(n_trials: int | Column, var_trials: float | None = None) -> tuple[Column, Column]:
    """sr0 and z over the columns of ``sharpe_moments``, for one number of trials of any."""
    spread = F.lit(float(var_trials)) if var_trials is not None else F.try_divide(F.col("term"), F.col("n") - 1)
    sr0 = F.sqrt(spread) * (expected_max_factor_of(n_trials) if isinstance(n_trials, Column) else F.lit(expected_max_factor(n_trials)))
    return sr0, F.try_divide((F.col("sharpe") - sr0) * F.sqrt((F.col("n") - 1).cast("double")), F.sqrt("term"))


def deflated_sharpe_z(rows: DataFrame, n_trials: int | Column, r: str = "r", by: Sequence[str] = (), var_trials: float | None = None) -> DataFrame:
    """Per run: sharpe per bar, the hurdle sr0 and z, whose normal probability is the deflated Sharpe ratio. A column of trials is one of ``by``."""
    sr0, z = hurdle_and_z(n_trials, var_trials)
    return sharpe_moments(rows, r, by).withColumns({"sr0": sr0, "z": z}).drop("term")


def deflated_sharpe(rows: DataFrame, n_trials: int | Column, r: str = "r", by: Sequence[str] = (), var_trials: float | None = None) -> DataFrame:
    """The same with dsr, the probability itself."""
    return deflated_sharpe_z(rows, n_trials, r, by, var_trials).withColumn("dsr", normal_cdf_of(F.col("z")))


def _draw(kind: str, seed: int) -> Column:
    """A number from 0 to below 2 ** 32 that depends on replication and step alone."""
    text = F.concat_ws(":", F.lit(kind), F.lit(str(seed)), F.col("b").cast("string"), F.col("step").cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def bootstrap_runs(spark: SparkSession, n: int | DataFrame, n_boot: int, avg_block: float, seed: int = 0) -> DataFrame:
    """(b, n, step, start, length): the stationary bootstrap as runs. Each step restarts at random with probability 1 / avg_block, else goes on by one, round the end.

    A run is what follows one restart: ``length`` rows from ``start`` on. What doesn't restart is dropped where it is drawn, so about n / avg_block rows a replication go
    on. n, the number of rows, is a number or one row with a column n, which is then worked out with the rest.
    """
    if isinstance(n, int) and n < 1 or n_boot < 1 or avg_block <= 0:
        raise ValueError(f"n, n_boot and avg_block must be positive: {n}, {n_boot}, {avg_block}")
    p = min(1.0, 1.0 / avg_block)
    size = n.select(F.col("n").cast("long").alias("n")) if isinstance(n, DataFrame) else spark.range(1).select(F.lit(n).cast("long").alias("n"))
    steps = F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("step")
    rows = spark.range(n_boot).withColumnRenamed("id", "b").crossJoin(F.broadcast(size.where("n > 0"))).select("b", "n", steps)
    rows = rows.where((F.col("step") == 0) | (_draw("restart", seed) < int(p * (1 << 32)))).withColumn("start", _draw("start", seed) % F.col("n"))
    following = F.lead("step").over(Window.partitionBy("b").orderBy("step"))
    return rows.withColumn("length", F.coalesce(following, F.col("n")) - F.col("step"))


def bootstrap_indices(spark: SparkSession, n: int | DataFrame, n_boot: int, avg_block: float, seed: int = 0) -> DataFrame:
    """(b, step, t): the row that each step of each replication draws."""
    runs = bootstrap_runs(spark, n, n_boot, avg_block, seed)
    each = runs.select("b", "n", "step", "start", F.explode(F.sequence(F.lit(0), (F.col("length") - 1).cast("int"))).alias("on"))
    return each.select("b", (F.col("step") + F.col("on")).alias("step"), ((F.col("start") + F.col("on")) % F.col("n")).alias("t"))


def column_stats(perf: DataFrame) -> DataFrame:
    """(k, n, mean, omega) of perf (t, k, d); omega is infinite where a column doesn't vary."""
    s = perf.groupBy("k").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    return s.select("k", "n", "mean", F.when(F.col("sd") > 1e-14, F.col("sd")).otherwise(INF).alias("omega"))


def bootstrap_means(perf: DataFrame, drawn: DataFrame) -> DataFrame:
    """(b, k, boot_mean): column means over each replication's rows. perf is a matrix: each t from 0 to n - 1 stands once in each column k.

    Of runs (``bootstrap_runs``) each gives differences of its column's running sum, three rows whatever its length; of single rows (``bootstrap_indices``) those
    drawn several times are counted, not repeated.
    """
    if "length" not in drawn.columns:
        counted = drawn.groupBy("b", "t").agg(F.count("*").alias("c"))
        return counted.join(perf, "t").groupBy("b", "k").agg((F.sum(F.col("c") * F.col("d")) / F.sum("c")).alias("boot_mean"))
    until = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    sums = perf.select("k", (F.col("t") + 1).cast("long").alias("at"), F.sum("d").over(until).alias("sum"))
    end = F.col("start") + F.col("length")
    # from start to the end, then from 0 on
    ends = [(F.col("start"), -1), (F.least(end, F.col("n")), 1), (end - F.col("n"), 1)]
    points = drawn.select("b", "n", F.explode(F.array(*(F.struct(at.alias("at"), F.lit(sign).alias("sign")) for at, sign in ends))).alias("x"))
    points = points.select("b", "n", "x.at", "x.sign").where(F.col("at") > 0)
    return points.join(sums, "at").groupBy("b", "k").agg((F.sum(F.col("sign") * F.col("sum")) / F.max("n")).alias("boot_mean"))


def white_reality_check(perf: DataFrame, drawn: DataFrame) -> DataFrame:
    """One row: statistic, p_value and k_best of White's reality check."""
    s = column_stats(perf)
    root = F.sqrt(F.col("n").cast("double"))
    best = s.agg(F.max(root * F.col("mean")).alias("statistic"), F.max_by("k", F.struct("mean", (-F.col("k")).alias("o"))).alias("k_best"))
    boot = bootstrap_means(perf, drawn).join(F.broadcast(s), "k")
    each = boot.groupBy("b").agg(F.max(root * (F.col("boot_mean") - F.col("mean"))).alias("v"))
    return each.crossJoin(best).groupBy("statistic", "k_best").agg(F.avg((F.col("v") >= F.col("statistic")).cast("double")).alias("p_value"))


def hansen_spa(perf: DataFrame, drawn: DataFrame) -> DataFrame:
    """One row: statistic, p_value (consistent), p_value_lower, p_value_upper and k_best of Hansen's test."""
    s = column_stats(perf)
    n = F.col("n").cast("double")
    s = s.withColumn("tk", F.sqrt(n) * F.col("mean") / F.col("omega"))
    least = -F.sqrt(2 * F.log(F.log(F.greatest(n, F.lit(3.0)))))
    zero = F.lit(0.0)
    s = s.withColumns({"c": F.when(F.col("tk") >= least, F.col("mean")).otherwise(zero), "l": F.when(F.col("tk") > 0, F.col("mean")).otherwise(zero), "u": F.col("mean")})
    best = s.agg(F.greatest(zero, F.max("tk")).alias("statistic"), F.max_by("k", F.struct("tk", (-F.col("k")).alias("o"))).alias("k_best"))
    boot = bootstrap_means(perf, drawn).join(F.broadcast(s), "k")
    each = boot.groupBy("b").agg(*(F.greatest(zero, F.max(F.sqrt(n) * (F.col("boot_mean") - F.col(x)) / F.col("omega"))).alias(x) for x in "clu"))
    p = lambda x: F.avg((F.col(x) >= F.col("statistic")).cast("double"))
    return each.crossJoin(best).groupBy("statistic", "k_best").agg(p("c").alias("p_value"), p("l").alias("p_value_lower"), p("u").alias("p_value_upper"))


def distinct_trials(trials: DataFrame, deduplicate: bool = True) -> DataFrame:
    """One row: n_trials (at least 1; different columns' rows once) and n_raw."""
    key = F.sha2(F.to_json(F.struct(*trials.columns)), 256)
    n = F.count_distinct(key) if deduplicate else F.count("*")
    return trials.agg(F.greatest(F.lit(1).cast("long"), n).alias("n_trials"), F.count("*").alias("n_raw"))
