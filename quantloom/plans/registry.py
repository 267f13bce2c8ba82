"""The panel queries and their oracle SQL.

Prices come from lineitem: asset = return flag and line status, price = revenue per unit, by day or week. Every query
works on all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scalar import impact_cost, linear_cost, period_key, request_key
from quantloom.operators.asof import asof_join
from quantloom.operators.backtest import rebalances, run_backtest
from quantloom.operators.metrics import attribution, drawdowns, equity_returns, performance
from quantloom.operators.panel import after, complete_grid, exposures, last_months, last_prices, trim_trailing_gaps, usability, with_returns
from quantloom.operators.risk import covariance, portfolio_variance, raw_weights, with_volatility
from quantloom.operators.signal import momentum
from quantloom.operators.splits import locked_split, out_of_sample, purged_folds, walk_forward, years_to_bars
from quantloom.operators.stats import bootstrap_indices, bootstrap_means, bootstrap_runs, deflated_sharpe, deflated_sharpe_z, distinct_trials, expected_max_factor_of, hansen_spa, moments, white_reality_check
from quantloom.plans import live, liverun, oracle, report, validate
from quantloom.plans.oracle import backtest, r, with_
from quantloom.sources.config import Strategy
from quantloom.sources.scratch import kept

ASSETS = ("AF", "AO", "NF", "NO", "RF", "RO")
WEEK = Strategy(universe=ASSETS, lookbacks=(4, 13, 26, 52), vol_window=13, periods_per_year=52, direction="long_only", rebalance="monthly", wf_train_years=2)
LONG_SHORT = Strategy(universe=ASSETS, lookbacks=(4, 13, 26, 52), vol_window=13, periods_per_year=52, direction="long_short", rebalance="monthly", wf_train_years=2)
DAY = Strategy(universe=ASSETS)
DAY_LONG_SHORT = Strategy(universe=ASSETS, direction="long_short")
WF = (104, 52, 52)
ASOF, DECISION, EQUITY = "2000-06-30", "2000-06-30", 1_000_000.0
BOOT, BLOCK = 2000, 10.0

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def out(df: DataFrame, *plain: str, digits: int = 8, other: dict[str, int] | None = None, **rounded: str) -> DataFrame:
    """Plain columns as they are (dates as text), others rounded to ``digits`` (or their ``other`` number) without negative zeros."""
    dates = {c for c, t in df.dtypes if t == "date"}
    cols = [F.col(c).cast("string").alias(c) if c in dates else F.col(c) for c in plain]
    for name, of in rounded.items():
        x = F.round(F.col(of), (other or {}).get(name, digits))
        cols.append(F.when(x == 0, 0.0).otherwise(x).alias(name))
    return df.select(*cols)


def same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def rs(*names: str, digits: int = 8) -> str:
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


def prices(spark, sf_dir: str, weekly: bool) -> DataFrame:
    # exact cents, so that prices don't depend on the order of summing
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity")
    day = F.date_trunc("week", "l_shipdate").cast("date") if weekly else F.to_date("l_shipdate")
    return item.groupBy(day.alias("dt"), F.concat("l_returnflag", "l_linestatus").alias("asset")).agg((F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.sum("l_quantity")).alias("px"))


def grid(spark, sf_dir: str, weekly: bool = True) -> DataFrame:
    return complete_grid(prices(spark, sf_dir, weekly))


def weighted(spark, sf_dir: str, cfg: Strategy = WEEK) -> DataFrame:
    return validate.strategy_weights(grid(spark, sf_dir), cfg)


def tested(spark, sf_dir: str, cfg: Strategy = WEEK):
    return run_backtest(weighted(spark, sf_dir, cfg), cfg.rebalance, cfg.cost_bps_per_side, cfg.initial_capital)


D, W = oracle.panel(False), oracle.panel(True)
WT = oracle.weights(WEEK)
BT = backtest("wt", WEEK.rebalance, repr(WEEK.cost_bps_per_side), WEEK.initial_capital)
DT = "CAST(dt AS VARCHAR) AS dt"


@query(with_(D, select=f"SELECT {DT}, bar, asset, px FROM grid"))
def panel_grid(spark, sf_dir):
    return out(grid(spark, sf_dir, False), "dt", "bar", "asset", "px")


@query(with_(D, select=f"SELECT {DT}, bar, asset, {rs('ret')} FROM ret"))
def returns_1bar(spark, sf_dir):
    return out(with_returns(grid(spark, sf_dir, False)), "dt", "bar", "asset", **same("ret"))


@query(with_(D, oracle.signal(DAY), select=f"SELECT {DT}, bar, asset, {rs('signal')} FROM sig"))
def momentum_signal(spark, sf_dir):
    return out(momentum(grid(spark, sf_dir, False), DAY.lookbacks, "long_only"), "dt", "bar", "asset", **same("signal"))


@query(with_(D, oracle.signal(DAY_LONG_SHORT), select=f"SELECT {DT}, bar, asset, {rs('signal')} FROM sig"))
def momentum_signal_long_short(spark, sf_dir):
    return out(momentum(grid(spark, sf_dir, False), DAY.lookbacks, "long_short"), "dt", "bar", "asset", **same("signal"))


@query(with_(D, "sig AS (SELECT * FROM ret)", oracle.volatility(60.0, 252.0), select=f"SELECT {DT}, bar, asset, {rs('sigma')} FROM vol"))
def ewma_vol(spark, sf_dir):
    return out(with_volatility(with_returns(grid(spark, sf_dir, False)), 60.0, 252.0), "dt", "bar", "asset", **same("sigma"))


@query(with_(D, oracle.covariance(60.0, 252.0), select=f"SELECT {DT}, bar, asset_i, asset_j, {rs('cov', digits=7)} FROM cov"))
def ewma_cov(spark, sf_dir):
    return out(covariance(with_returns(grid(spark, sf_dir, False)), 60.0, 252.0), "dt", "bar", "asset_i", "asset_j", digits=7, **same("cov"))


@query(with_(W, WT, select=f"SELECT bar, {rs('variance')} FROM var"))
def portfolio_variance_weekly(spark, sf_dir):
    panel = with_returns(momentum(grid(spark, sf_dir), WEEK.lookbacks, WEEK.direction))
    return out(portfolio_variance(raw_weights(panel, WEEK), covariance(panel, 13.0, 52.0)), "bar", **same("variance"))


@query(with_(W, WT, select=f"SELECT {DT}, bar, asset, {rs('signal', 'sigma', 'target_w')} FROM wt"))
def target_weights_weekly(spark, sf_dir):
    return out(weighted(spark, sf_dir), "dt", "bar", "asset", **same("signal", "sigma", "target_w"))


@query(with_(W, oracle.weights(LONG_SHORT), select=f"SELECT {DT}, bar, asset, {rs('target_w')} FROM wt"))
def target_weights_long_short(spark, sf_dir):
    return out(weighted(spark, sf_dir, LONG_SHORT), "dt", "bar", "asset", **same("target_w"))


@query(with_(W, WT, select=f"SELECT {DT}, bar, {rs('gross', 'net')} FROM (SELECT dt, bar, sum(abs(target_w)) AS gross, sum(target_w) AS net FROM wt GROUP BY dt, bar)"))
def gross_net_exposure(spark, sf_dir):
    return out(exposures(weighted(spark, sf_dir), "target_w"), "dt", "bar", **same("gross", "net"))


def _calendar(cadence: str):
    m = oracle.mask(cadence) if cadence == "daily" else oracle.mask(cadence) % ""

    @query(with_(D, select=f"SELECT {DT}, bar, reb AS rebalance, CAST(sum(CASE WHEN reb THEN 1 ELSE 0 END) OVER (ORDER BY bar) AS BIGINT) AS segment FROM (SELECT *, {m} AS reb FROM cal)"), f"rebalance_calendar_{cadence}")
    def calendar(spark, sf_dir):
        return out(rebalances(grid(spark, sf_dir, False), cadence), "dt", "bar", "rebalance", "segment")


for _c in ("daily", "weekly", "monthly"):
    _calendar(_c)


@query(with_(W, WT, BT, select=f"SELECT {DT}, bar, reb AS rebalance, {rs('turnover')}, {rs('equity', digits=6)} FROM bars", recursive=True))
def momentum_backtest_weekly(spark, sf_dir):
    """The flagship: prices, signal, risk, weights and the backtest's equity."""
    return out(tested(spark, sf_dir).bars, "bar", "dt", "rebalance", other={"equity": 6}, **same("turnover", "equity"))


@query(with_(W, oracle.weights(LONG_SHORT), backtest("wt", "weekly", "10.0", 1.0), select=f"SELECT {DT}, bar, {rs('turnover', 'equity')} FROM bars", recursive=True))
def backtest_long_short(spark, sf_dir):
    b = run_backtest(weighted(spark, sf_dir, LONG_SHORT), "weekly", 10.0, 1.0)
    return out(b.bars, "dt", "bar", **same("turnover", "equity"))


@query(with_(W, WT, BT, select=f"SELECT {DT}, bar, asset, {rs('w')} FROM held", recursive=True))
def held_weights(spark, sf_dir):
    return out(tested(spark, sf_dir).held, "dt", "bar", "asset", **same("w"))


@query(with_(W, WT, BT, select=f"SELECT {DT}, bar, asset, {rs('delta_weight', 'cost')} FROM trades", recursive=True))
def trade_ledger(spark, sf_dir):
    return out(tested(spark, sf_dir).trades, "dt", "bar", "asset", **same("delta_weight", "cost"))


@query(with_(W, WT, BT, oracle.returns_of(), select=f"SELECT CAST(i.dt AS VARCHAR) AS dt, i.bar, {r('i.dd')} AS drawdown, s.below FROM isl i JOIN runs s ON s.island = i.island", recursive=True))
def drawdown_curve(spark, sf_dir):
    return out(drawdowns(tested(spark, sf_dir).bars), "dt", "bar", "below", **same("drawdown"))


@query(
    with_(W, WT, BT, oracle.returns_of(), select=f"""SELECT CAST(i.dt AS VARCHAR) AS dt, i.bar, {r('i.equity', 6)} AS equity, {r('i.dd * 100', 6)} AS drawdown_pct, {r('h.gross')} AS gross, {r('h.net')} AS net
  FROM isl i JOIN (SELECT bar, sum(abs(w)) AS gross, sum(w) AS net FROM held GROUP BY bar) h ON h.bar = i.bar""", recursive=True)
)
def report_series(spark, sf_dir):
    return out(report.run_series(tested(spark, sf_dir)), "dt", "bar", other={"equity": 6, "drawdown_pct": 6}, **same("equity", "drawdown_pct", "gross", "net"))


METRICS = ("cagr", "annual_vol", "sharpe", "sortino", "profit_factor", "hit_rate", "max_drawdown", "calmar", "annual_turnover", "avg_exposure", "total_cost", "final_equity")
_PERF = f"n_periods, max_drawdown_duration, {rs(*METRICS, digits=6)}"


@query(with_(W, WT, BT, oracle.performance(52.0), select=f"SELECT {_PERF} FROM perf", recursive=True))
def performance_metrics(spark, sf_dir):
    b = tested(spark, sf_dir)
    return out(performance(b.bars, 52.0), "n_periods", "max_drawdown_duration", digits=6, **same(*METRICS))


@query(
    with_(W, WT, BT, select=f"""SELECT asset, {r('pnl', 6)} AS pnl FROM (SELECT asset, sum(CASE WHEN abs(tot) > 1e-12 THEN d / tot * gain ELSE 0 END) AS pnl FROM (
  SELECT h.asset, h.w0 * e.eq0 AS d, sum(h.w0 * e.eq0) OVER (PARTITION BY h.bar) AS tot, e.gain FROM (SELECT bar, asset, lag(w) OVER (PARTITION BY asset ORDER BY bar) AS w0 FROM held) h
  JOIN (SELECT bar, lag(equity) OVER (ORDER BY bar) AS eq0, equity - lag(equity) OVER (ORDER BY bar) AS gain FROM bars) e ON e.bar = h.bar WHERE e.eq0 IS NOT NULL) GROUP BY asset)""", recursive=True)
)
def per_asset_pnl(spark, sf_dir):
    b = tested(spark, sf_dir)
    return out(attribution(b.bars, b.held), "asset", digits=6, **same("pnl"))


LEVELS = "lv AS (SELECT * FROM (VALUES (2.0::DOUBLE, TRUE), (5.0::DOUBLE, FALSE), (10.0::DOUBLE, FALSE)) AS t(bps, is_base)), cw AS (SELECT l.bps, w.* FROM wt w CROSS JOIN lv l)"


@query(with_(W, WT, LEVELS, backtest("cw", WEEK.rebalance, "bps", WEEK.initial_capital, ["bps"]), oracle.performance(52.0, ["bps"]), select=f"SELECT p.bps, lv.is_base, {_PERF} FROM perf p JOIN lv ON lv.bps = p.bps", recursive=True))
def cost_stress(spark, sf_dir):
    return out(validate.cost_stress(weighted(spark, sf_dir), WEEK), "bps", "is_base", "n_periods", "max_drawdown_duration", digits=6, **same(*METRICS))


@query("SELECT l_orderkey, l_linenumber, " + r("abs(l_discount) * 7 * 1e-4") + " AS linear, " + r("CASE WHEN l_quantity > 0 THEN 0.1 * abs(l_tax) * sqrt(abs(l_discount) / l_quantity) ELSE 0 END") + " AS impact FROM lineitem")
def trading_costs(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity")
    costs = item.withColumns({"linear": linear_cost(F.col("l_discount"), 7.0), "impact": impact_cost(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), 0.1)})
    return out(costs, "l_orderkey", "l_linenumber", **same("linear", "impact"))


@query(with_(D, select=f"SELECT {DT}, bar, CASE WHEN bar < floor((SELECT count(*) FROM cal) * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS role FROM cal"), "locked_split")
def locked(spark, sf_dir):
    return out(locked_split(grid(spark, sf_dir, False).select("dt", "bar").distinct(), 0.7), "dt", "bar", "role")


WINDOWS = f"""win AS (SELECT CAST(i AS INTEGER) AS fold, CAST(i * {WF[2]} AS INTEGER) AS start FROM range(0, 100000) t(i) WHERE i * {WF[2]} + {WF[0] + WF[1]} <= (SELECT count(*) FROM cal)),
wins AS (SELECT fold, 'train' AS role, start AS lo, start + {WF[0]} AS hi FROM win UNION ALL SELECT fold, 'test', start + {WF[0]}, start + {WF[0] + WF[1]} FROM win)"""


@query(with_(W, WINDOWS, select="SELECT * FROM wins"))
def walk_forward_windows(spark, sf_dir):
    return walk_forward(grid(spark, sf_dir).select("dt", "bar").distinct(), *WF)


FOLDS = "fw AS (SELECT s.fold, w.dt, w.bar - s.lo AS bar, w.asset, w.px, w.target_w FROM wt w JOIN wins s ON s.role = 'test' AND w.bar >= s.lo AND w.bar < s.hi)"
_FOLDED = (FOLDS, backtest("fw", WEEK.rebalance, repr(WEEK.cost_bps_per_side), WEEK.initial_capital, ["fold"]), oracle.performance(52.0, ["fold"]))


@query(with_(W, WT, WINDOWS, *_FOLDED, select=f"SELECT p.fold, {r('p.sharpe', 6)} AS sharpe, {r('g.total_return')} AS total_return FROM perf p JOIN (SELECT fold, arg_max(equity, bar) / arg_min(equity, bar) - 1 AS total_return FROM bars GROUP BY fold) g ON g.fold = p.fold", recursive=True))
def walk_forward_metrics(spark, sf_dir):
    w = validate.written_panel(weighted(spark, sf_dir))
    m = validate.window_metrics(w, walk_forward(w.select("dt", "bar").distinct(), *WF), WEEK)
    return out(m, "fold", other={"sharpe": 6}, **same("sharpe", "total_return"))


@query(
    with_(W, WT, WINDOWS, *_FOLDED, select=f"""SELECT n_windows, {rs('mean_sharpe', 'std_sharpe', 'positive_fraction', 'dispersion', digits=6)}, coalesce(n_windows >= 2 AND mean_sharpe > 0 AND positive_fraction >= 0.5 AND dispersion <= 2, FALSE) AS is_stable FROM (
  SELECT *, CASE WHEN abs(mean_sharpe) > 1e-9 THEN std_sharpe / abs(mean_sharpe) ELSE 'Infinity'::DOUBLE END AS dispersion FROM (
  SELECT count(*) AS n_windows, avg(sharpe) AS mean_sharpe, CASE WHEN count(sharpe) = 1 THEN 0 ELSE stddev_samp(sharpe) END AS std_sharpe, avg(CASE WHEN sharpe > 0 THEN 1.0::DOUBLE WHEN sharpe <= 0 THEN 0.0::DOUBLE END) AS positive_fraction FROM perf))""", recursive=True)
)
def walk_forward_stability(spark, sf_dir):
    w = validate.written_panel(weighted(spark, sf_dir))
    s = validate.stability(validate.window_metrics(w, walk_forward(w.select("dt", "bar").distinct(), *WF), WEEK))
    return out(s, "n_windows", "is_stable", digits=6, **same("mean_sharpe", "std_sharpe", "positive_fraction", "dispersion"))


@query(with_(W, WINDOWS, select=f"SELECT DISTINCT CAST(c.dt AS VARCHAR) AS dt, c.bar FROM cal c JOIN wins s ON s.role = 'test' AND c.bar >= s.lo AND c.bar < s.hi"))
def oos_track(spark, sf_dir):
    bars = grid(spark, sf_dir).select("dt", "bar").distinct()
    return out(out_of_sample(bars, walk_forward(bars, *WF)), "dt", "bar")


@query(
    with_(D, """f AS (SELECT bar AS pos, ntile(5) OVER (ORDER BY bar) - 1 AS f FROM cal), s AS (SELECT CAST(f AS INTEGER) AS fold, min(pos) AS lo, max(pos) AS hi FROM f GROUP BY f),
c AS (SELECT s.fold, p.bar AS pos, p.bar BETWEEN lo AND hi AS is_test, NOT p.bar BETWEEN lo AND hi AND p.bar + 252 >= lo AND p.bar - 252 <= hi AS is_purged,
  p.bar > hi AND p.bar <= hi + round_even(0.01::DOUBLE * (SELECT count(*) FROM cal), 0) AS is_embargoed FROM cal p CROSS JOIN s)""", select="SELECT *, NOT is_test AND NOT is_purged AND NOT is_embargoed AS is_train FROM c")
)
def purged_cv(spark, sf_dir):
    return purged_folds(grid(spark, sf_dir, False), 5, 252, 0.01)


_MOM = "mo AS (SELECT asset, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, skewness(ret) AS skew, kurtosis(ret) + 3 AS kurtosis FROM ret GROUP BY asset)"


@query(with_(W, _MOM, select=f"SELECT asset, n, {rs('mean', 'sd', 'skew', 'kurtosis', digits=6)} FROM mo"))
def moments_skew_kurt(spark, sf_dir):
    return out(moments(with_returns(grid(spark, sf_dir)), "ret", ["asset"]), "asset", "n", digits=6, **same("mean", "sd", "skew", "kurtosis"))


_Z = """z AS (SELECT *, (sharpe - sr0) * sqrt(n - 1) / sqrt(term) AS z FROM (SELECT *, sqrt(term / (n - 1)) * FACTOR AS sr0 FROM (
  SELECT asset, n, mean / sd AS sharpe, CASE WHEN 1 - skew * (mean / sd) + (kurtosis - 1) / 4 * (mean / sd) * (mean / sd) > 0 THEN 1 - skew * (mean / sd) + (kurtosis - 1) / 4 * (mean / sd) * (mean / sd) END AS term FROM mo)))"""


def _z_sql(more: str = "") -> str:
    # the expected maximum of five normal trials: (1 - g) z(1 - 1/5) + g z(1 - 1/(5 e)), with the normal quantiles as numbers
    factor = "((1 - 0.5772156649015329) * 0.8416212335729143 + 0.5772156649015329 * 1.4496656592240218)"
    return with_(W, _MOM, _Z.replace("FACTOR", factor), select=f"SELECT asset, n, {more}{rs('sharpe', 'sr0', 'z', digits=6)} FROM z")


@query(_z_sql())
def deflated_sharpe_z_per_asset(spark, sf_dir):
    return out(deflated_sharpe_z(with_returns(grid(spark, sf_dir)), 5, "ret", ["asset"]), "asset", "n", digits=6, **same("sharpe", "sr0", "z"))


# no normal distribution there: Simpson's rule over the density, 2,000 steps from 0
_PHI = "0.5::DOUBLE + z / 6000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(z * i / 2000, 2) / 2)))"


@query(_z_sql(r(_PHI, 6) + " AS dsr, "))
def deflated_sharpe_per_asset(spark, sf_dir):
    found = deflated_sharpe(with_returns(grid(spark, sf_dir)), 5, "ret", ["asset"])
    return out(found, "asset", "n", digits=6, **same("dsr", "sharpe", "sr0", "z"))


# as many trials as an order has lines; quantiles by bisection over the same rule
@query(f"""WITH t AS (SELECT n, count(*) AS n_orders FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY n),
q AS (SELECT n, n_orders, unnest([1 - 1 / n::DOUBLE, 1 - 1 / (n * exp(1))]) AS p, unnest([1, 2]) AS k FROM t WHERE n > 1),
b AS (SELECT n, n_orders, k, list_reduce(list_prepend([-9.0::DOUBLE, 9.0::DOUBLE], list_transform(range(0, 60), lambda j: [p, 0.0::DOUBLE])),
  lambda lh, x: CASE WHEN {_PHI.replace('z', '((lh[1] + lh[2]) / 2)')} < p THEN [(lh[1] + lh[2]) / 2, lh[2]] ELSE [lh[1], (lh[1] + lh[2]) / 2] END)[1] AS z FROM q)
SELECT n AS n_trials, n_orders, {r('sum(CASE WHEN k = 1 THEN (1 - 0.5772156649015329) * z ELSE 0.5772156649015329 * z END)', 6)} AS factor FROM b GROUP BY n, n_orders UNION ALL SELECT n, n_orders, 0.0 FROM t WHERE n = 1""")
def expected_max_factors(spark, sf_dir):
    """The expected maximum of as many normal trials as orders have lines."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.count("*").alias("n_trials"))
    return out(lines.groupBy("n_trials").agg(F.count("*").alias("n_orders")).withColumn("factor", expected_max_factor_of(F.col("n_trials"))), "n_trials", "n_orders", digits=6, **same("factor"))


@query(with_(D, select=f"SELECT {DT}, bar, asset, px FROM grid WHERE dt > (SELECT max(dt) FROM grid) - INTERVAL 12 MONTH"))
def retrospective_slice(spark, sf_dir):
    return out(last_months(grid(spark, sf_dir, False), 12), "dt", "bar", "asset", "px")


@query(with_(D, select=f"SELECT {DT}, bar, asset, px FROM grid WHERE dt > DATE '{DECISION}'"))
def forward_slice(spark, sf_dir):
    return out(after(grid(spark, sf_dir, False), DECISION), "dt", "bar", "asset", "px")


_BOOK = f"book AS (SELECT asset AS symbol, arg_max(target_w, dt) AS target_w FROM wt WHERE dt <= DATE '{ASOF}' GROUP BY asset)"


@query(with_(W, WT, _BOOK, select=f"SELECT symbol, {rs('target_w')} FROM book"))
def asof_book(spark, sf_dir):
    return out(live.target_book(weighted(spark, sf_dir), ASOF), "symbol", **same("target_w"))


_ORDERS = f"od AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, list_extract({list(ASSETS)}, CAST(o_custkey % {len(ASSETS)} AS INTEGER) + 1) AS asset FROM orders)"


@query(with_(W, WT, _ORDERS, select=f"SELECT o.o_orderkey, CAST(o.day AS VARCHAR) AS day, o.asset, CAST(w.dt AS VARCHAR) AS dt, w.bar, {r('w.target_w')} AS target_w FROM od o ASOF LEFT JOIN wt w ON w.asset = o.asset AND w.dt <= o.day"))
def asof_join_orders(spark, sf_dir):
    """The weight that each order's asset had on the order's date: the last one at or before it."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    asset = F.element_at(F.array(*map(F.lit, ASSETS)), (F.col("o_custkey") % len(ASSETS) + 1).cast("int"))
    asked = orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"), asset.alias("asset"))
    found = asof_join(asked, weighted(spark, sf_dir).select("asset", "dt", "bar", "target_w"), "day", "dt", ["asset"])
    return out(found, "o_orderkey", "day", "asset", "dt", "bar", **same("target_w"))


@query(with_(D, select=f"SELECT asset, px FROM (SELECT asset, arg_max(px, bar) FILTER (px IS NOT NULL) AS px FROM grid GROUP BY asset)"), "last_prices")
def last_known(spark, sf_dir):
    return out(last_prices(grid(spark, sf_dir, False)), "asset", "px")


# prices of the last months are made gaps
_TRIM = "tg AS (SELECT dt, bar, asset, CASE WHEN dt <= DATE '2001-06-30' THEN px END AS px FROM grid)"


@query(with_(D, _TRIM, select=f"SELECT {DT}, bar, asset, px FROM tg WHERE bar <= (SELECT max(bar) FROM tg WHERE px IS NOT NULL)"))
def trim_trailing(spark, sf_dir):
    g = grid(spark, sf_dir, False).withColumn("px", F.when(F.col("dt") <= F.lit("2001-06-30").cast("date"), F.col("px")))
    return out(trim_trailing_gaps(g), "dt", "bar", "asset", "px")


@query(with_(W, select=f"SELECT (SELECT count(*) FROM cal) AS n_bars, count(DISTINCT asset) AS n_assets, (SELECT count(*) FROM cal) >= 52 + 13 + 5 AND count(DISTINCT asset) > 0 AS usable FROM grid WHERE px IS NOT NULL AND asset IN {ASSETS}"))
def usability_gate(spark, sf_dir):
    return usability(grid(spark, sf_dir), WEEK.lookbacks, WEEK.vol_window, ASSETS)


_POS = """pos AS (SELECT l_returnflag || CASE WHEN l_linenumber = 1 THEN l_linestatus ELSE '' END AS symbol, round(sum(l_quantity) / 1000, 0) AS qty, sum(l_extendedprice) / 1000 AS market_value FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1),
lp AS (SELECT asset AS symbol, arg_max(px, bar) FILTER (px IS NOT NULL) AS px FROM grid GROUP BY asset)"""


def _positions(spark, sf_dir: str) -> DataFrame:
    """Some held assets, and symbols that are no assets (a return flag alone)."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag <> 'N'").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_extendedprice")
    symbol = F.concat("l_returnflag", F.when(F.col("l_linenumber") == 1, F.col("l_linestatus")).otherwise(""))
    return item.groupBy(symbol.alias("symbol")).agg(F.round(F.sum("l_quantity") / 1000, 0).alias("qty"), (F.sum("l_extendedprice") / 1000).alias("market_value"))


def _planned(spark, sf_dir: str):
    # few rows each, which all that follows reads again
    g = kept(grid(spark, sf_dir), "grid")
    target = kept(live.target_book(validate.strategy_weights(g, WEEK), ASOF), "book")
    px = last_prices(g).withColumnRenamed("asset", "symbol")
    held = _positions(spark, sf_dir)
    return target, held, px


_PLAN = f"""un AS (SELECT coalesce(b.symbol, p.symbol) AS symbol, coalesce(b.target_w, 0) AS tw, coalesce(p.qty, 0) AS qty, p.market_value AS mv, p.symbol IS NOT NULL AS has FROM book b FULL JOIN pos p ON b.symbol = p.symbol),
od AS (SELECT u.*, l.px, trunc((tw * {EQUITY} - u.qty * l.px) / l.px) AS d FROM un u JOIN lp l ON l.symbol = u.symbol WHERE l.px > 0 AND abs(tw * {EQUITY} - u.qty * l.px) >= 100),
ords AS (SELECT symbol, CASE WHEN d > 0 THEN 'buy' ELSE 'sell' END AS side, abs(d) AS qty, px AS est_price, abs(d) * px AS notional, tw AS target_weight, qty * px / {EQUITY} AS current_weight, CASE WHEN tw = 0 AND qty <> 0 THEN 'close' ELSE 'rebalance' END AS reason FROM od WHERE d <> 0)"""
_ORDER = ("est_price", "notional", "target_weight", "current_weight")


@query(with_(W, WT, _BOOK, _POS, _PLAN, select=f"SELECT symbol, side, qty, reason, {rs(*_ORDER, digits=6)} FROM ords"))
def plan_orders(spark, sf_dir):
    target, held, px = _planned(spark, sf_dir)
    return out(live.plan_orders(target, held, px, EQUITY, 100.0, max_gross=WEEK.max_gross_leverage), "symbol", "side", "qty", "reason", digits=6, **same(*_ORDER))


_SUM = ("buy_notional", "sell_notional", "gross_notional", "est_cost", "target_gross")


@query(with_(W, WT, _BOOK, _POS, _PLAN, select=f"SELECT n_orders, {rs(*_SUM, digits=6)} FROM (SELECT count(*) AS n_orders, coalesce(sum(CASE WHEN side = 'buy' THEN notional END), 0) AS buy_notional, coalesce(sum(CASE WHEN side = 'sell' THEN notional END), 0) AS sell_notional, coalesce(sum(notional), 0) AS gross_notional, coalesce(sum(notional), 0) * 2 * 1e-4 AS est_cost, (SELECT sum(abs(target_w)) FROM book) AS target_gross FROM ords)"))
def plan_summary(spark, sf_dir):
    target, held, px = _planned(spark, sf_dir)
    return out(live.plan_summary(live.plan_orders(target, held, px, EQUITY, 100.0, max_gross=WEEK.max_gross_leverage), target, 2.0), "n_orders", digits=6, **same(*_SUM))


_REC = f"rec AS (SELECT u.symbol, tw AS target_weight, CASE WHEN NOT has THEN 0 WHEN l.px > 0 THEN qty * l.px / {EQUITY} ELSE mv / {EQUITY} END AS current_weight FROM un u LEFT JOIN lp l ON l.symbol = u.symbol)"


@query(with_(W, WT, _BOOK, _POS, _PLAN, _REC, select=f"SELECT symbol, {rs('target_weight', 'current_weight', digits=6)}, {r('target_weight - current_weight', 6)} AS deviation FROM rec"))
def reconcile(spark, sf_dir):
    return out(live.reconcile(*_planned(spark, sf_dir), EQUITY), "symbol", digits=6, **same("target_weight", "current_weight", "deviation"))


@query(with_(W, WT, _BOOK, _POS, _PLAN, _REC, select=f"SELECT {rs('l1', 'max_deviation', 'target_gross', 'current_gross', digits=6)}, current_gross <= 1e-6 AND target_gross > 0.25 AS flat, l1 > 0.25 AS off_target, (current_gross <= 1e-6 AND target_gross > 0.25) OR l1 > 0.25 AS anomaly FROM (SELECT sum(abs(target_weight - current_weight)) AS l1, max(abs(target_weight - current_weight)) AS max_deviation, sum(abs(target_weight)) AS target_gross, sum(abs(current_weight)) AS current_gross FROM rec)"))
def reconcile_summary(spark, sf_dir):
    s = live.reconcile_summary(live.reconcile(*_planned(spark, sf_dir), EQUITY))
    return out(s, "flat", "off_target", "anomaly", digits=6, **same("l1", "max_deviation", "target_gross", "current_gross"))


# a minimum so high that some targets get no order
@query(with_(W, WT, _BOOK, _POS, _PLAN.replace(">= 100)", ">= 150000)"), select=f"SELECT symbol, {r('target_w')} AS target_w FROM book WHERE abs(target_w) > 1e-9 AND symbol NOT IN (SELECT symbol FROM ords)"))
def in_target_no_order(spark, sf_dir):
    target, held, px = _planned(spark, sf_dir)
    return out(live.without_order(target, live.plan_orders(target, held, px, EQUITY, 150_000.0)), "symbol", **same("target_w"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS daily, strftime(ts, '%G-W%V') AS weekly, strftime(ts, '%Y-%m') AS monthly, count(*) AS n FROM events GROUP BY 1, 2, 3")
def period_keys(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("d"))
    return ev.groupBy(*(period_key(F.col("d"), c).alias(c) for c in ("daily", "weekly", "monthly"))).agg(F.count("*").alias("n"))


@query("SELECT greatest(1, count(DISTINCT (event_type, user_id))) AS n_trials, count(*) AS n_raw FROM events")
def distinct_trial_count(spark, sf_dir):
    return distinct_trials(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "user_id"))


@query("SELECT l_suppkey, substr(sha256(concat(array_to_string(list_sort(list(DISTINCT l_returnflag || l_linestatus)), ','), '|', CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR), '|', CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR))), 1, 16) AS key FROM lineitem GROUP BY l_suppkey")
def cache_keys(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate")
    day = lambda f: F.to_date(f("l_shipdate")).cast("string")
    asked = item.groupBy("l_suppkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("tickers"), day(F.min).alias("start"), day(F.max).alias("end"))
    return asked.select("l_suppkey", request_key(F.col("tickers"), F.col("start"), F.col("end")).alias("key"))


@query("SELECT round(l_tax * 100, 0) AS bps, bool_or(l_linenumber = 1) AS is_base FROM lineitem GROUP BY 1")
def config_levels_dedup(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_tax", "l_linenumber")
    return validate.distinct_levels(item.select(F.round(F.col("l_tax") * 100, 0).alias("bps"), (F.col("l_linenumber") == 1).alias("is_base")))


def _number(kind: str) -> str:
    return f"CAST('0x' || substr(md5('{kind}:0:' || b || ':' || step), 1, 8) AS BIGINT)"


BOOTSTRAP = f"""nn AS (SELECT count(*) - 1 AS n FROM cal), bs AS (SELECT b, step FROM range(0, {BOOT}) x(b), range(0, (SELECT n FROM nn)) y(step)),
op AS (SELECT b, step, CASE WHEN step = 0 OR {_number('restart')} < {int(1 / BLOCK * 2**32)} THEN {{'s': step, 'o': {_number('start')} % (SELECT n FROM nn)}} END AS opened FROM bs),
ix AS (SELECT b, step, (l.o + step - l.s) % (SELECT n FROM nn) AS t FROM (SELECT b, step, last_value(opened IGNORE NULLS) OVER (PARTITION BY b ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM op)),
perf AS (SELECT bar - 1 AS t, CAST(dense_rank() OVER (ORDER BY asset) - 1 AS INTEGER) AS k, coalesce(ret, 0) AS d FROM ret WHERE bar > 0)"""


def _perf(spark, sf_dir: str):
    rows = with_returns(grid(spark, sf_dir)).where("bar > 0")
    # a row for each asset
    rank = rows.select("asset").distinct().withColumn("k", F.row_number().over(Window.orderBy("asset")) - 1)
    perf = rows.join(rank, "asset").select((F.col("bar") - 1).alias("t"), "k", F.coalesce("ret", F.lit(0.0)).alias("d"))
    return perf, perf.agg((F.max("t") + 1).alias("n"))


def _perf_and_runs(spark, sf_dir: str):
    perf, n = _perf(spark, sf_dir)
    return perf, bootstrap_runs(spark, n, BOOT, BLOCK)


@query(with_(W, BOOTSTRAP, select="SELECT CAST(b AS BIGINT) AS b, CAST(step AS INTEGER) AS step, t, CAST(cal.dt AS VARCHAR) AS dt FROM ix JOIN cal ON cal.bar = ix.t + 1"))
def stationary_bootstrap(spark, sf_dir):
    """Which bar's returns each step of each replication draws."""
    bars = grid(spark, sf_dir).select((F.col("bar") - 1).cast("long").alias("t"), "dt").distinct()
    return out(bootstrap_indices(spark, _perf(spark, sf_dir)[1], BOOT, BLOCK).join(bars, "t"), "b", "step", "t", "dt")


@query(with_(W, BOOTSTRAP, select=f"SELECT CAST(b AS BIGINT) AS b, k, {r('m')} AS boot_mean FROM (SELECT b, k, avg(d) AS m FROM ix JOIN perf ON perf.t = ix.t GROUP BY b, k)"))
def bootstrap_column_means(spark, sf_dir):
    return out(bootstrap_means(*_perf_and_runs(spark, sf_dir)), "b", "k", **same("boot_mean"))


_BM = """st AS (SELECT k, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS omega FROM perf GROUP BY k), bm AS (SELECT b, k, avg(d) AS m FROM ix JOIN perf ON perf.t = ix.t GROUP BY b, k)"""


@query(with_(W, BOOTSTRAP, _BM, select=f"SELECT {r('o.v', 6)} AS statistic, o.k AS k_best, avg(CASE WHEN e.v >= o.v THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p_value FROM (SELECT bm.b, max(sqrt(n) * (m - mean)) AS v FROM bm JOIN st ON st.k = bm.k GROUP BY bm.b) e, (SELECT max(sqrt(n) * mean) AS v, arg_max(k, mean) AS k FROM st) o GROUP BY o.v, o.k"))
def white_check(spark, sf_dir):
    return out(white_reality_check(*_perf_and_runs(spark, sf_dir)), "k_best", "p_value", digits=6, **same("statistic"))


_SPA = """sp AS (SELECT *, sqrt(n) * mean / omega AS tk FROM st), rc AS (SELECT *, CASE WHEN tk >= -sqrt(2 * ln(ln(greatest(n, 3)))) THEN mean ELSE 0 END AS c, CASE WHEN tk > 0 THEN mean ELSE 0 END AS l FROM sp),
ea AS (SELECT bm.b, greatest(0, max(sqrt(n) * (m - c) / omega)) AS c, greatest(0, max(sqrt(n) * (m - l) / omega)) AS l, greatest(0, max(sqrt(n) * (m - mean) / omega)) AS u FROM bm JOIN rc ON rc.k = bm.k GROUP BY bm.b),
ob AS (SELECT greatest(0, max(tk)) AS v, arg_max(k, tk) AS k FROM sp)"""


@query(with_(W, BOOTSTRAP, _BM, _SPA, select=f"SELECT {r('v', 6)} AS statistic, k AS k_best, " + ", ".join(f"avg(CASE WHEN ea.{x} >= v THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS {n}" for x, n in (("c", "p_value"), ("l", "p_value_lower"), ("u", "p_value_upper"))) + " FROM ea, ob GROUP BY v, k"))
def spa_test(spark, sf_dir):
    return out(hansen_spa(*_perf_and_runs(spark, sf_dir)), "k_best", "p_value", "p_value_lower", "p_value_upper", digits=6, **same("statistic"))


def _verdict_sql(rows: str, n_rows: str, trials: dict[str, str], windows: str, extra: str, leg: str, select: str) -> str:
    """The replay of ``rows`` (r: dt, bar, asset, px, target_w from bar 0), its deflated Sharpe z and stability over ``windows``.

    A probability beyond the threshold is a z beyond the normal quantile of 0.6.
    """
    cost, capital = repr(WEEK.cost_bps_per_side), WEEK.initial_capital
    z = ",".join(f"(sharpe0 - sqrt(term / (n0 - 1)) * {f}) * sqrt(n0 - 1) / sqrt(term) AS z{k}" for k, f in trials.items())
    return with_(
        W, WT, rows, n_rows, windows,
        backtest("r", WEEK.rebalance, cost, capital, p="a_"), oracle.performance(52.0, p="a_"),
        """mz AS (SELECT n0, sharpe0, CASE WHEN t > 0 THEN t END AS term FROM (SELECT *, 1 - sk * sharpe0 + (ku + 3 - 1) / 4 * sharpe0 * sharpe0 AS t FROM (SELECT count(r) AS n0, avg(r) / stddev_samp(r) AS sharpe0, skewness(r) AS sk, kurtosis(r) AS ku FROM a_er)))""",
        f"zz AS (SELECT {z} FROM mz)",
        "fw AS (SELECT s.fold, w.dt, w.bar - s.lo AS bar, w.asset, w.px, w.target_w FROM " + extra + " w JOIN wins s ON s.role = 'test' AND w.bar >= s.lo AND w.bar < s.hi)",
        *_FOLDED[1:],
        """st AS (SELECT *, coalesce(n_windows >= 2 AND mean_sharpe > 0 AND positive_fraction >= 0.5 AND dispersion <= 2, FALSE) AS is_stable FROM (
  SELECT *, CASE WHEN abs(mean_sharpe) > 1e-9 THEN std_sharpe / abs(mean_sharpe) ELSE 'Infinity'::DOUBLE END AS dispersion FROM (
  SELECT count(*) AS n_windows, avg(sharpe) AS mean_sharpe, CASE WHEN count(sharpe) = 1 THEN 0 ELSE stddev_samp(sharpe) END AS std_sharpe, avg(CASE WHEN sharpe > 0 THEN 1.0::DOUBLE WHEN sharpe <= 0 THEN 0.0::DOUBLE END) AS positive_fraction FROM perf)))""",
        select=select.replace("LEG", leg), recursive=True,
    )


_QUANTILE = "0.2533471031357997"
_FIVE = "((1 - 0.5772156649015329) * 0.8416212335729143 + 0.5772156649015329 * 1.4496656592240218)"
_STEADY = ("mean_sharpe", "std_sharpe", "positive_fraction", "dispersion")
_SAID = f"n_periods, max_drawdown_duration, n_windows, is_stable, {rs(*METRICS, *_STEADY, digits=6)}"


def _windows_sql(source: str, train: int, test: int, step: int) -> str:
    n = f"(SELECT count(DISTINCT bar) FROM {source})"
    return f"""win AS (SELECT CAST(i AS INTEGER) AS fold, CAST(i * {step} AS INTEGER) AS start FROM range(0, 100000) t(i) WHERE i * {step} + {train + test} <= {n}),
wins AS (SELECT fold, 'train' AS role, start AS lo, start + {train} AS hi FROM win UNION ALL SELECT fold, 'test', start + {train}, start + {train + test} FROM win)"""


_FINAL = _verdict_sql(
    f"r AS (SELECT dt, CAST(bar - floor((SELECT count(*) FROM cal) * {WEEK.train_test_ratio!r}::DOUBLE) AS INTEGER) AS bar, asset, px, target_w FROM wt WHERE bar >= floor((SELECT count(*) FROM cal) * {WEEK.train_test_ratio!r}::DOUBLE))",
    "nr AS (SELECT count(DISTINCT bar) AS n_bars FROM r)", {"": _FIVE}, _windows_sql("wt", *(years_to_bars(x, 52) for x in (WEEK.wf_train_years, WEEK.wf_test_years, WEEK.wf_step_years))), "wt", "is_stable",
    f"SELECT {_SAID}, {r('z', 6)} AS z, coalesce(z > {_QUANTILE}, FALSE) AND LEG AS retain FROM a_perf, zz, st",
)


@query(_FINAL)
def final_verdict(spark, sf_dir):
    found = validate.final_verdict(weighted(spark, sf_dir), WEEK, 5)
    return out(found, "n_periods", "max_drawdown_duration", "n_windows", "is_stable", "retain", digits=6, **same(*METRICS, *_STEADY, "z"))


_HOLDOUT = _verdict_sql(
    f"r AS (SELECT dt, CAST(bar - min(bar) OVER () AS INTEGER) AS bar, asset, px, target_w FROM wt WHERE dt > DATE '{DECISION}')",
    "nr AS (SELECT count(DISTINCT bar) AS n_bars FROM r)", {"1": "0", "5": _FIVE}, _windows_sql("r", 26, 13, 13), "r", "(is_stable OR n_windows < 2)",
    f"SELECT n_bars, n_bars >= 52 AS sufficient, {_SAID}, {r('z1', 6)} AS z_1, {r('z5', 6)} AS z_5, coalesce(z1 > {_QUANTILE}, FALSE) AND LEG AS retain_1, coalesce(z5 > {_QUANTILE}, FALSE) AND LEG AS retain_5 FROM nr, a_perf, zz, st",
)


@query(_HOLDOUT)
def holdout_verdict(spark, sf_dir):
    found = validate.holdout_verdict(weighted(spark, sf_dir), WEEK, DECISION, 5, validate.Holdout(min_bars=52, wf_bars=(26, 13, 13)))
    return out(found, "n_bars", "sufficient", "n_periods", "max_drawdown_duration", "n_windows", "is_stable", "retain_1", "retain_5", digits=6, **same(*METRICS, *_STEADY, "z_1", "z_5"))


_LAST_YEARS = _verdict_sql(
    "r AS (SELECT dt, CAST(bar - min(bar) OVER () AS INTEGER) AS bar, asset, px, target_w FROM wt WHERE dt > (SELECT max(dt) FROM wt) - INTERVAL 24 MONTH)",
    "nr AS (SELECT count(DISTINCT bar) AS n_bars FROM r)", {"1": "0", "5": _FIVE}, _windows_sql("r", 26, 13, 13), "r", "(is_stable OR n_windows < 2)",
    f"SELECT n_bars, n_bars >= 52 AS sufficient, {_SAID}, {r('z1', 6)} AS z_1, {r('z5', 6)} AS z_5, coalesce(z1 > {_QUANTILE}, FALSE) AND LEG AS retain_1, coalesce(z5 > {_QUANTILE}, FALSE) AND LEG AS retain_5 FROM nr, a_perf, zz, st",
)


@query(_LAST_YEARS)
def holdout_retrospective(spark, sf_dir):
    """The hold-out of the last two years."""
    how = validate.Holdout("retrospective", months=24, min_bars=52, wf_bars=(26, 13, 13))
    found = validate.holdout_verdict(weighted(spark, sf_dir), WEEK, DECISION, 5, how)
    return out(found, "n_bars", "sufficient", "n_periods", "max_drawdown_duration", "n_windows", "is_stable", "retain_1", "retain_5", digits=6, **same(*METRICS, *_STEADY, "z_1", "z_5"))


# a run for each week; some are dry, forced, on a synthetic source or of another configuration
_RUNS = f"""ru AS (SELECT dt AS day, bar, bar % 5 <> 0 AS live, bar % 13 = 0 AS force, bar % 17 <> 0 AS is_real, bar % 19 <> 0 AS is_known FROM cal),
hp AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS day, l_returnflag || CASE WHEN l_linenumber = 1 THEN 'X' ELSE l_linestatus END AS symbol, round(sum(l_quantity) / 10, 0) AS qty, sum(l_extendedprice) / 10 AS mv FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2),
lq AS (SELECT dt AS day, asset AS symbol, last_value(px IGNORE NULLS) OVER (PARTITION BY asset ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px FROM grid),
r1 AS (SELECT *, strftime(day, '%Y-%m') AS period, live AND NOT (is_real AND is_known) AS refused, live AND is_real AND is_known AS could FROM ru),
r2 AS (SELECT *, coalesce(bool_or(could) OVER (PARTITION BY period ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS done FROM r1),
r3 AS (SELECT *, could AND (NOT done OR force) AS submits FROM r2),
r4 AS (SELECT *, max(CASE WHEN submits THEN day END) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sent, CASE WHEN submits THEN 'submit' WHEN refused THEN 'refuse' WHEN could THEN 'skip' ELSE 'preview' END AS action FROM r3),
rf AS (SELECT r.day, w.asset AS symbol, w.target_w AS tw FROM r4 r JOIN wt w ON w.dt = CASE WHEN r.action = 'skip' THEN r.sent ELSE r.day END),
rb AS (SELECT coalesce(f.day, h.day) AS day, coalesce(f.symbol, h.symbol) AS symbol, coalesce(tw, 0) AS tw, CASE WHEN h.symbol IS NULL THEN 0 WHEN q.px > 0 THEN h.qty * q.px / {EQUITY} ELSE h.mv / {EQUITY} END AS cw
  FROM rf f FULL JOIN hp h ON h.day = f.day AND h.symbol = f.symbol LEFT JOIN lq q ON q.day = coalesce(f.day, h.day) AND q.symbol = coalesce(f.symbol, h.symbol)),
rs AS (SELECT day, sum(abs(tw - cw)) AS l1, sum(abs(tw)) AS tg, sum(abs(cw)) AS cg FROM rb GROUP BY day),
r5 AS (SELECT r.*, s.l1, s.tg, s.cg, (s.cg <= 1e-6 AND s.tg > WIDE) OR s.l1 > WIDE AS anomaly FROM r4 r JOIN rs s ON s.day = r.day),
ro AS (SELECT day, count(*) AS n_orders, sum(abs(d) * px) AS notional FROM (SELECT r.day, q.px, trunc((coalesce(w.target_w, 0) * {EQUITY} - coalesce(h.qty, 0) * q.px) / q.px) AS d, abs(coalesce(w.target_w, 0) * {EQUITY} - coalesce(h.qty, 0) * q.px) AS change
  FROM r4 r JOIN (SELECT dt AS day, asset AS symbol FROM wt UNION SELECT day, symbol FROM hp) u ON u.day = r.day JOIN lq q ON q.day = r.day AND q.symbol = u.symbol LEFT JOIN wt w ON w.dt = r.day AND w.asset = u.symbol LEFT JOIN hp h ON h.day = r.day AND h.symbol = u.symbol WHERE q.px > 0) WHERE d <> 0 AND change >= 100 GROUP BY day)""".replace("WIDE", "0.5")


def _live(spark, sf_dir: str) -> liverun.LiveRuns:
    panel = weighted(spark, sf_dir)
    bar = F.col("bar")
    runs = panel.select(F.col("dt").alias("asof"), "bar").distinct().select("asof", F.lit(EQUITY).alias("equity"), (bar % 5 != 0).alias("live"), (bar % 13 == 0).alias("force"), F.when(bar % 17 != 0, "real").otherwise("synthetic").alias("source"), F.when(bar % 19 != 0, "known").otherwise("other").alias("config_hash"))
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag <> 'R'").select("l_shipdate", "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_extendedprice")
    symbol = F.concat("l_returnflag", F.when(F.col("l_linenumber") == 1, "X").otherwise(F.col("l_linestatus")))
    held = item.groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("asof"), symbol.alias("symbol")).agg(F.round(F.sum("l_quantity") / 10, 0).alias("qty"), (F.sum("l_extendedprice") / 10).alias("market_value"))
    earlier = runs.select("asof", F.lit("").alias("symbol"), F.lit(0.0).alias("target_w")).where("false")
    return liverun.live_runs(panel, runs, held, earlier, WEEK, "known", liverun.Limits(min_notional=100.0, tolerance=0.5))


@query(with_(W, WT, _RUNS, select=f"""SELECT CAST(r.day AS VARCHAR) AS "asof", period, action, CASE WHEN action = 'skip' THEN 'submitted' ELSE 'today' END AS reference, {r('l1', 6)} AS l1, {r('cg', 6)} AS current_gross, {r('tg', 6)} AS target_gross,
  anomaly, CASE WHEN action = 'refuse' THEN 1 WHEN action = 'skip' AND anomaly THEN 2 ELSE 0 END AS exit_code, coalesce(n_orders, 0) AS n_orders, {r('coalesce(notional, 0)', 4)} AS notional FROM r5 r LEFT JOIN ro o ON o.day = r.day"""))
def live_runs(spark, sf_dir):
    """Every week as a live run: action, reconciliation with what was submitted, orders and exit code."""
    found = _live(spark, sf_dir)
    orders = found.orders.groupBy("asof").agg(F.count("*").alias("n_orders"), F.sum("notional").alias("notional"))
    rows = found.runs.join(orders, "asof", "left").withColumns({"n_orders": F.coalesce("n_orders", F.lit(0).cast("long")), "notional": F.coalesce("notional", F.lit(0.0))})
    return out(rows, "asof", "period", "action", "reference", "anomaly", "exit_code", "n_orders", digits=6, other={"notional": 4}, **same("l1", "current_gross", "target_gross", "notional"))


@query(
    with_(W, WT, _RUNS, select="""SELECT CAST(day AS VARCHAR) AS "asof", gate, severity, reason FROM (
  SELECT day, 'data' AS gate, CASE WHEN is_real THEN 'ok' WHEN live THEN 'refuse' ELSE 'warn' END AS severity, CASE WHEN is_real THEN '' ELSE 'the source is synthetic' END AS reason FROM r5
  UNION ALL SELECT day, 'drift', CASE WHEN is_known THEN 'ok' WHEN live THEN 'refuse' ELSE 'warn' END, CASE WHEN is_known THEN '' ELSE 'the configuration is not the recorded one' END FROM r5
  UNION ALL SELECT day, 'cadence', CASE WHEN action = 'skip' THEN 'skip' ELSE 'ok' END, CASE WHEN action = 'skip' THEN 'already submitted for ' || period ELSE '' END FROM r5
  UNION ALL SELECT day, 'reconcile', CASE WHEN action = 'skip' AND anomaly THEN 'escalate' WHEN anomaly THEN 'warn' ELSE 'ok' END, '' FROM r5)""")
)
def live_gates(spark, sf_dir):
    """Every week's gates (the reconciliation's figures are in live_runs)."""
    g = _live(spark, sf_dir).gates
    return out(g.withColumn("reason", F.when(F.col("gate") == "reconcile", "").otherwise(F.col("reason"))), "asof", "gate", "severity", "reason")
