"""Oracle SQL of the panel queries, put together from shared common table expressions.

An independent statement of each query: relations and windows in plain SQL, no code in common with the operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from quantloom.sources.config import Strategy


def r(x: str, digits: int = 8) -> str:
    """Rounded, without negative zeros."""
    return f"CASE WHEN round({x}, {digits}) = 0 THEN CAST(0 AS DOUBLE) ELSE round({x}, {digits}) END"


def panel(weekly: bool) -> str:
    day = "CAST(date_trunc('week', l_shipdate) AS DATE)" if weekly else "CAST(l_shipdate AS DATE)"
    return f"""px AS (SELECT {day} AS dt, l_returnflag || l_linestatus AS asset, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / sum(l_quantity) AS px FROM lineitem GROUP BY 1, 2),
cal AS (SELECT dt, CAST(row_number() OVER (ORDER BY dt) - 1 AS INTEGER) AS bar FROM (SELECT DISTINCT dt FROM px)),
grid AS (SELECT c.dt, c.bar, a.asset, p.px FROM cal c CROSS JOIN (SELECT DISTINCT asset FROM px) a LEFT JOIN px p ON p.dt = c.dt AND p.asset = a.asset),
ret AS (SELECT *, px / lag(px) OVER (PARTITION BY asset ORDER BY bar) - 1 AS ret FROM grid)"""


def signal(cfg: Strategy) -> str:
    mean = " + ".join(f"CAST(sign(px / lag(px, {n}) OVER w - 1) AS DOUBLE)" for n in cfg.lookbacks)
    value = "CASE WHEN s < 0 THEN CAST(0 AS DOUBLE) ELSE s END" if cfg.direction == "long_only" else "s"
    return f"sig AS (SELECT dt, bar, asset, px, ret, {value} AS signal FROM (SELECT *, ({mean}) / {float(len(cfg.lookbacks))} AS s FROM ret WINDOW w AS (PARTITION BY asset ORDER BY bar)))"


def _cov(x: str, y: str, com: float, keys: str) -> tuple[str, str, str]:
    """Weight, running sums and the estimate from them."""
    d = com / (1 + com)
    weight = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN pow({d!r}, -bar) END AS wt"
    over = f"OVER (PARTITION BY {keys} ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    sums = f"count(wt) {over} AS c, sum(wt) {over} AS s0, sum(wt * wt) {over} AS s2, sum(wt * {x}) {over} AS sx, sum(wt * {y}) {over} AS sy, sum(wt * {x} * {y}) {over} AS sxy"
    value = "CASE WHEN c >= 2 THEN (sxy / s0 - (sx / s0) * (sy / s0)) * (s0 * s0 / (s0 * s0 - s2)) END"
    return weight, sums, value


def volatility(com: float, ppy: float) -> str:
    weight, sums, value = _cov("ret", "ret", com, "asset")
    return f"vol AS (SELECT *, sqrt(CASE WHEN v < 0 THEN 0 ELSE v END * {ppy}) AS sigma FROM (SELECT *, {value} AS v FROM (SELECT *, {sums} FROM (SELECT *, {weight} FROM sig))))"


def covariance(com: float, ppy: float) -> str:
    weight, sums, value = _cov("x", "y", com, "asset_i, asset_j")
    return f"""cov AS (SELECT dt, bar, asset_i, asset_j, {value} * {ppy} AS cov FROM (SELECT *, {sums} FROM (SELECT *, {weight} FROM (
  SELECT i.dt, i.bar, i.asset AS asset_i, j.asset AS asset_j, i.ret AS x, j.ret AS y FROM ret i JOIN ret j ON i.bar = j.bar AND i.asset <= j.asset))))"""


def weights(cfg: Strategy) -> str:
    com, ppy = float(cfg.vol_window), float(cfg.periods_per_year)
    return ",\n".join(
        [
            signal(cfg),
            volatility(com, ppy),
            covariance(com, ppy),
            f"raw AS (SELECT *, CASE WHEN signal IS NOT NULL AND signal <> 0 AND sigma > 0 THEN signal * ({cfg.asset_vol_target!r} / sigma) ELSE 0 END AS raw FROM vol)",
            """var AS (SELECT c.bar, CASE WHEN count(*) = count(c.cov) THEN sum(CASE WHEN c.asset_i = c.asset_j THEN 1 ELSE 2 END * i.raw * j.raw * c.cov) END AS variance
  FROM cov c JOIN raw i ON i.bar = c.bar AND i.asset = c.asset_i AND i.raw <> 0 JOIN raw j ON j.bar = c.bar AND j.asset = c.asset_j AND j.raw <> 0 GROUP BY c.bar)""",
            f"scaled AS (SELECT r.*, r.raw * CASE WHEN v.variance > 0 THEN {cfg.portfolio_vol_target!r} / sqrt(v.variance) ELSE 1 END * {cfg.kelly_fraction!r} AS sw FROM raw r LEFT JOIN var v ON v.bar = r.bar)",
            f"wt AS (SELECT dt, bar, asset, px, ret, signal, sigma, raw, sw * CASE WHEN g > {cfg.max_gross_leverage!r} THEN {cfg.max_gross_leverage!r} / g ELSE 1 END AS target_w FROM (SELECT *, sum(abs(sw)) OVER (PARTITION BY bar) AS g FROM scaled))",
        ]
    )


def mask(cadence: str) -> str:
    return "TRUE" if cadence == "daily" else f"coalesce(date_trunc('{cadence[:-2]}', dt) <> lag(date_trunc('{cadence[:-2]}', dt)) OVER (%s ORDER BY bar), TRUE)"


def backtest(source: str, cadence: str, bps: str, capital: float, by: Sequence[str] = (), p: str = "") -> str:
    """bars, held and trades of ``source`` (by..., dt, bar, asset, px, target_w), names led by ``p``. One recursion over bars.

    The recursion holds the book as a list in order of assets: a sequential statement of what the operators do in closed form.
    """
    keys = "".join(f"{k}, " for k in by)
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    join = "".join(f" AND a.{k} = b.{k}" for k in by)
    m = mask(cadence) if cadence == "daily" else mask(cadence) % part
    each = "list_zip(b.book, a.rets)"
    return f"""{p}mk AS (SELECT *, {m} AS reb FROM (SELECT DISTINCT {keys}dt, bar FROM {source})),
{p}rows AS (SELECT {keys}dt, bar, asset, coalesce(px / lag(px) OVER (PARTITION BY {keys}asset ORDER BY bar) - 1, 0) AS r,
  coalesce(lag(target_w) OVER (PARTITION BY {keys}asset ORDER BY bar), 0) AS want FROM {source}),
{p}wide AS (SELECT {", ".join(f"x.{k}" for k in by) + ", " if by else ""}x.dt, x.bar, any_value(m.reb) AS reb, list(x.r ORDER BY x.asset) AS rets, list(x.want ORDER BY x.asset) AS wants, list(x.asset ORDER BY x.asset) AS assets
  FROM {p}rows x JOIN {p}mk m ON m.bar = x.bar{"".join(f" AND m.{k} = x.{k}" for k in by)} GROUP BY {", ".join(f"x.{k}" for k in by) + ", " if by else ""}x.dt, x.bar),
{p}run AS (
  SELECT {keys}bar, dt, reb, assets, wants AS held, wants AS delta, list_sum([abs(w) FOR w IN wants]) AS turnover, CAST({capital!r} AS DOUBLE) AS eq0,
    CAST({capital!r} AS DOUBLE) * (1 - {bps} * 1e-4 * list_sum([abs(w) FOR w IN wants])) * (1 + list_dot_product(wants, rets)) AS equity,
    [w[1] * (1 + w[2]) / (1 + list_dot_product(wants, rets)) FOR w IN list_zip(wants, rets)] AS book
  FROM {p}wide WHERE bar = 0
  UNION ALL
  SELECT {"".join(f"a.{k}, " for k in by)}a.bar, a.dt, a.reb, a.assets, n.held, n.delta, n.turnover, b.equity AS eq0,
    b.equity * (1 - {bps.replace("bps", "a.bps") if "bps" in by else bps} * 1e-4 * n.turnover) * (1 + list_dot_product(n.held, a.rets)) AS equity,
    [w[1] * (1 + w[2]) / (1 + list_dot_product(n.held, a.rets)) FOR w IN list_zip(n.held, a.rets)] AS book
  FROM {p}wide a JOIN {p}run b ON a.bar = b.bar + 1{join},
  LATERAL (SELECT CASE WHEN a.reb THEN a.wants ELSE b.book END AS held, CASE WHEN a.reb THEN [w[1] - w[2] FOR w IN list_zip(a.wants, b.book)] ELSE [CAST(0 AS DOUBLE) FOR w IN b.book] END AS delta,
    CASE WHEN a.reb THEN list_sum([abs(w[1] - w[2]) FOR w IN list_zip(a.wants, b.book)]) ELSE 0 END AS turnover) n
),
{p}bars AS (SELECT {keys}dt, bar, reb, turnover, equity, eq0 FROM {p}run),
{p}held AS (SELECT {keys}dt, bar, unnest(assets) AS asset, unnest(held) AS w FROM {p}run),
{p}trades AS (SELECT {keys}dt, bar, asset, d AS delta_weight, {bps} * 1e-4 * abs(d) * eq0 AS cost FROM (SELECT {keys}dt, bar, eq0, unnest(assets) AS asset, unnest(delta) AS d FROM {p}run) WHERE abs(d) > 1e-12)"""


def returns_of(by: Sequence[str] = (), p: str = "") -> str:
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    keys = "".join(f"{k}, " for k in by)
    return f"""{p}er AS (SELECT *, equity / lag(equity) OVER ({part} ORDER BY bar) - 1 AS r,
  equity / max(equity) OVER ({part} ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM {p}bars),
{p}isl AS (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER ({part} ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM {p}er),
{p}runs AS (SELECT {keys}island, CAST(sum(CASE WHEN dd < 0 THEN 1 ELSE 0 END) AS BIGINT) AS below FROM {p}isl GROUP BY {keys}island)"""


def performance(ppy: float, by: Sequence[str] = (), p: str = "") -> str:
    """perf: the metrics of each run."""
    keys = "".join(f"{k}, " for k in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    on = " AND ".join(f"x.{k} = y.{k}" for k in by) or "TRUE"
    return f"""{returns_of(by, p)},
{p}agg AS (SELECT {keys}count(*) AS n_periods, arg_min(equity, bar) AS e0, arg_max(equity, bar) AS final_equity, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS sd,
  sqrt(avg(CASE WHEN r < 0 THEN r * r END)) AS down, coalesce(sum(CASE WHEN r > 0 THEN r END), 0) AS gains, coalesce(sum(CASE WHEN r < 0 THEN -r END), 0) AS losses,
  avg(CASE WHEN r > 0 THEN 1.0::DOUBLE WHEN r <= 0 THEN 0.0::DOUBLE END) AS hit_rate, min(dd) AS max_drawdown, avg(turnover) * {ppy} AS annual_turnover FROM {p}er {group}),
{p}dur AS (SELECT {keys}max(below) AS max_drawdown_duration FROM {p}runs {group}),
{p}exp AS (SELECT {keys}avg(g) AS avg_exposure FROM (SELECT {keys}bar, sum(abs(w)) AS g FROM {p}held GROUP BY {keys}bar) {group}),
{p}cost AS (SELECT {keys}sum(cost) AS total_cost FROM {p}trades {group}),
{p}perf0 AS (SELECT x.*, y.max_drawdown_duration FROM {p}agg x JOIN {p}dur y ON {on}),
{p}perf1 AS (SELECT x.*, y.avg_exposure FROM {p}perf0 x LEFT JOIN {p}exp y ON {on}),
{p}perf2 AS (SELECT x.*, coalesce(y.total_cost, 0) AS total_cost FROM {p}perf1 x LEFT JOIN {p}cost y ON {on}),
{p}perf AS (SELECT *, CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) WHEN cagr > 0 THEN 'Infinity'::DOUBLE END AS calmar FROM (SELECT *,
  CASE WHEN n_periods >= 2 AND e0 > 0 AND final_equity > 0 THEN pow(final_equity / e0, {ppy} / (n_periods - 1)) - 1 END AS cagr,
  CASE WHEN n >= 2 THEN sd * sqrt({ppy}) END AS annual_vol, CASE WHEN n >= 2 AND sd > 1e-14 THEN mean / sd * sqrt({ppy}) END AS sharpe,
  CASE WHEN n >= 2 AND down > 0 THEN mean / down * sqrt({ppy}) END AS sortino,
  CASE WHEN losses > 0 THEN gains / losses WHEN gains > 0 THEN 'Infinity'::DOUBLE END AS profit_factor FROM {p}perf2))"""


def with_(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{(',' + chr(10)).join(parts)}\n{select}"
