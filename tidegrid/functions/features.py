"""Feature columns over the session grid. All take and return columns of a frame keyed by (ticker, date)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.frames import w_t, positive, ratio, rolled, rows

#: Horizons, windows and levels of the feature panel.
HORIZONS = (1, 5, 21, 63, 126, 252)
MOMENTUM = {"mom_12_1": 252, "mom_6_1": 126}
SKIP = 21
VOLATILITY = (21, 63, 252)
DRAWDOWN = 252
AVERAGES = (20, 50, 200)
SLOPE = 5
YEAR = 252
MIN_ADV = 5_000_000.0
BETA, BETA_PAIRS = 252, 189


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def simple_return(p: str | Column, h: int) -> Column:
    p = _col(p)
    return ratio(p, F.lag(p, h).over(w_t())) - 1


def log_return(p: str | Column, h: int) -> Column:
    p = _col(p)
    return F.ln(p) - F.lag(F.ln(p), h).over(w_t())


def skip_return(p: str | Column, span: int, skip: int = SKIP) -> Column:
    p = _col(p)
    return ratio(F.lag(p, skip).over(w_t()), F.lag(p, span).over(w_t())) - 1


def returns(p: str) -> dict[str, Column]:
    return {f"ret_{h}d": simple_return(p, h) for h in HORIZONS} | {f"logret_{h}d": log_return(p, h) for h in HORIZONS}


def momentum(p: str) -> dict[str, Column]:
    return {k: skip_return(p, n) for k, n in MOMENTUM.items()} | {"rev_5d": -simple_return(p, 5)}


def realized_vol(logret: str, n: int) -> Column:
    r = F.col(logret)
    return rolled(F.stddev_samp(r), r, n, warm=n) * F.sqrt(F.lit(float(YEAR)))


def downside_deviation(logret: str, n: int = 63) -> Column:
    r = F.col(logret)
    low = F.when(r.isNotNull(), F.least(r, F.lit(0.0)))
    return F.sqrt(rolled(F.avg(low * low), r, n, warm=n)) * F.sqrt(F.lit(float(YEAR)))


def true_range(high: str, low: str, close: str) -> Column:
    """Largest of the bar's range and its reach from the close before; missing if any part is."""
    before = F.lag(close, 1).over(w_t())
    parts = [F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before)]
    return F.when(parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull(), F.greatest(*parts))


def max_drawdown(p: str, n: int = DRAWDOWN) -> Column:
    """Worst fall from the running peak inside the window of n + 1 prices; a fold over the frame's values."""
    frame = rows(n + 1)
    prices = F.collect_list(F.col(p)).over(frame)
    start = F.struct(F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("worst"))

    def step(acc: Column, x: Column) -> Column:
        peak = F.greatest(acc["peak"], x)
        return F.struct(peak.alias("peak"), F.least(acc["worst"], x / peak - 1).alias("worst"))

    least = -(-9 * (n + 1) // 10)
    return F.when(F.count(p).over(frame) >= least, F.aggregate(prices, start, step, lambda a: a["worst"]))


def sma(p: str, n: int) -> Column:
    return rolled(F.avg(p), F.col(p), n, warm=n - 1)


def distance(p: str, average: str) -> Column:
    return ratio(F.col(p), F.col(average)) - 1


def slope(average: str, n: int = SLOPE) -> Column:
    return ratio(F.col(average), F.lag(average, n).over(w_t())) - 1


def trend_state(fast: str = "sma_50", slow: str = "sma_200") -> Column:
    return F.when(F.col(fast).isNotNull() & F.col(slow).isNotNull(), F.when(F.col(fast) > F.col(slow), 1.0).otherwise(-1.0))


def crosses(state: str) -> dict[str, Column]:
    """Events against the last defined state, over stored bars only: put gaps aside before."""
    before = F.last(state, ignorenulls=True).over(w_t().rowsBetween(Window.unboundedPreceding, -1))
    s = F.col(state)
    known = s.isNotNull()
    return {
        "golden_cross": F.when(known, F.when((s > 0) & (before < 0), 1.0).otherwise(0.0)),
        "death_cross": F.when(known, F.when((s < 0) & (before > 0), 1.0).otherwise(0.0)),
    }


def stoch_k(high: str, low: str, close: str, n: int = 14) -> Column:
    frame = rows(n)
    top, bottom = F.max(high).over(frame), F.min(low).over(frame)
    full = (F.row_number().over(w_t()) >= n) & (F.count(F.col(high) + F.col(low)).over(frame) >= -(-9 * n // 10)) & F.col(close).isNotNull()
    k = F.when(top == bottom, 50.0).otherwise(100 * ratio(F.col(close) - bottom, top - bottom))
    return F.when(full, F.greatest(F.least(k, F.lit(100.0)), F.lit(0.0)))


def stoch_d(k: str, n: int = 3) -> Column:
    return F.when(F.count(k).over(rows(n)) == n, F.avg(k).over(rows(n)))


def percent_b(p: str, n: int = 20, width: float = 2.0) -> Column:
    mean = rolled(F.avg(p), F.col(p), n, warm=n - 1)
    spread = F.stddev_pop(p).over(rows(n))
    flat = F.max(p).over(rows(n)) == F.min(p).over(rows(n))
    x = F.when(flat, 0.5).otherwise(ratio(F.col(p) - (mean - width * spread), 2 * width * spread))
    return F.when(mean.isNotNull() & F.col(p).isNotNull(), x)


def eur_volume(volume: str = "volume", close_eur: str = "close_eur") -> Column:
    return F.when((F.col(volume) * F.col(close_eur)) >= 0, F.col(volume) * F.col(close_eur))


def average_daily_value(ev: str, n: int = 21) -> Column:
    return rolled(F.avg(ev), F.col(ev), n, warm=n - 1)


def volume_zscore(ev: str, n: int = 63) -> Column:
    """ln of the value traded against mean and deviation of the n rows before it; missing where these are flat."""
    x = F.when(F.col(ev) > 0, F.ln(ev))
    frame = rows(n, end=-1)
    flat = F.max(x).over(frame) == F.min(x).over(frame)
    z = ratio(x - F.avg(x).over(frame), F.stddev_samp(x).over(frame))
    return F.when((F.count(x).over(frame) >= -(-9 * n // 10)) & (F.row_number().over(w_t()) > n) & ~flat, z)


def signed_value(p: str, ev: str) -> Column:
    """Value traded with the sign of the price change; nothing known counts as 0."""
    return F.coalesce(F.signum(F.col(p) - F.lag(p, 1).over(w_t())) * F.col(ev), F.lit(0.0))


def on_balance_volume(signed: str, ev: str) -> Column:
    return F.when(F.col(ev).isNotNull(), F.sum(signed).over(w_t().rowsBetween(Window.unboundedPreceding, 0)))


def obv_flow(signed: str, ev: str, n: int = 21) -> Column:
    return ratio(rolled(F.sum(signed), F.col(ev), n, warm=n), F.sum(ev).over(rows(n)))


def tradable(adv: str, least: float = MIN_ADV) -> Column:
    return F.coalesce(F.col(adv) >= least, F.lit(False))


def with_rolling_beta(df: DataFrame, own: str, market: str, n: int = BETA, pairs: int = BETA_PAIRS) -> DataFrame:
    """df with beta_252, the slope on the market, and idio_vol_252, annualised residual volatility, over n rows:
    population moments of complete pairs. The moments are differences of running sums, so a row costs the same
    however long the window is."""
    both = F.col(own).isNotNull() & F.col(market).isNotNull()
    x, y = F.when(both, F.col(market)).otherwise(0.0), F.when(both, F.col(own)).otherwise(0.0)
    running = w_t().rowsBetween(Window.unboundedPreceding, 0)
    terms = {"_n": both.cast("double"), "_x": x, "_y": y, "_xx": x * x, "_xy": x * y, "_yy": y * y}
    sums = with_columns(df, {k: F.sum(t).over(running) for k, t in terms.items()} | {"_at": F.row_number().over(w_t())})
    part = {k: F.col(k) - F.coalesce(F.lag(k, n).over(w_t()), F.lit(0.0)) for k in terms}
    held = with_columns(sums, part)
    mean = lambda k: ratio(F.col(k), F.col("_n"))
    var_m, cov, var_i = mean("_xx") - mean("_x") * mean("_x"), mean("_xy") - mean("_x") * mean("_y"), mean("_yy") - mean("_y") * mean("_y")
    ok = (F.col("_at") > n) & (F.col("_n") >= pairs) & (var_m > 1e-16) & (var_m > 1e-12 * mean("_xx"))
    rest = F.greatest(var_i - ratio(cov * cov, var_m), F.lit(0.0))
    out = with_columns(held, {"beta_252": F.when(ok, ratio(cov, var_m)), "idio_vol_252": F.when(ok, F.sqrt(rest * YEAR))})
    return out.drop(*terms, "_at")


def residual_momentum(p: str, market: str, beta: str, span: int = 252, skip: int = SKIP) -> Column:
    own = F.lag(F.ln(p), skip).over(w_t()) - F.lag(F.ln(p), span).over(w_t())
    wide = F.lag(F.ln(market), skip).over(w_t()) - F.lag(F.ln(market), span).over(w_t())
    return own - F.col(beta) * wide


def adjusted(x: str, close: str = "close", adj_close: str = "adj_close") -> Column:
    """A listing price on the basis of an adjusted close."""
    return ratio(F.col(x) * F.col(adj_close), F.col(close))


def forward_return(p: str, n: int) -> Column:
    """The one column that looks ahead: the label."""
    return ratio(F.lead(p, n).over(w_t()), F.col(p)) - 1


def with_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in columns], *[c.alias(k) for k, c in columns.items()])
