"""Finite-frame indicators as columns over one window spec: rows of a symbol by time. Missing values are null, never NaN."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.quantiles import exact_quantiles
from tidemark.schema import SESSIONS, VOL_BUCKETS

#: A deviation below this counts as none.
TINY = 1e-9


#: What `framed` has put in the place of symbol and ts.
_spec: ContextVar[WindowSpec | None] = ContextVar("spec", default=None)


def by_time() -> WindowSpec:
    """Made when asked for: a spec needs a session, and this module is imported without one."""
    return _spec.get() or Window.partitionBy("symbol").orderBy("ts")


@contextmanager
def framed(spec: WindowSpec) -> Iterator[None]:
    """Within it, columns of this module are made over another spec, such as that of the blocks of a series."""
    token = _spec.set(spec)
    try:
        yield
    finally:
        _spec.reset(token)


def so_far() -> WindowSpec:
    return by_time().rowsBetween(Window.unboundedPreceding, 0)


def last_rows(n: int) -> WindowSpec:
    return by_time().rowsBetween(1 - n, 0)


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by_time())


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def ln(x: Column) -> Column:
    return F.ln(F.nullif(x, F.lit(0.0)))


def log_return(x: str = "close", p: int = 1) -> Column:
    return ln(ratio(F.col(x), lag(x, p)))


def pct_change(x: str = "close") -> Column:
    return _zero(ratio(F.col(x), lag(x)) - 1)


def sma(x: str | Column, n: int, least: int = 1) -> Column:
    """Mean of the last n rows; null with fewer than `least` values."""
    x = F.col(x) if isinstance(x, str) else x
    w = last_rows(n)
    return F.when(F.count(x).over(w) >= least, F.avg(x).over(w))


def deviation(x: str | Column, n: int, least: int = 2) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    w = last_rows(n)
    return F.when(F.count(x).over(w) >= least, F.stddev_samp(x).over(w))


def bollinger(n: int = 20, k: float = 2.0) -> dict[str, Column]:
    mean, sd = sma("close", n), deviation("close", n)
    return {"bb_mid": mean, "bb_upper": mean + k * sd, "bb_lower": mean - k * sd, "bb_width": ratio(2 * k * sd, mean)}


def true_range() -> Column:
    """The largest of three ranges; on the first row, high less low."""
    prev = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def zscore(x: str, n: int, least: int = 2) -> Column:
    sd = deviation(x, n, least)
    return F.when(sd >= TINY, (F.col(x) - sma(x, n, least)) / sd).otherwise(F.when(F.count(x).over(last_rows(n)) >= 1, 0.0))


def break_of_structure(n: int) -> dict[str, Column]:
    w = by_time().rowsBetween(-n, -1)
    return {f"bos_up_{n}": F.coalesce((F.col("high") > F.max("high").over(w)).cast("double"), F.lit(0.0)), f"bos_down_{n}": F.coalesce((F.col("low") < F.min("low").over(w)).cast("double"), F.lit(0.0))}


def fair_value_gaps() -> dict[str, Column]:
    """Gaps between neighbouring bars, and the share of each that the close has filled."""
    up = _zero(F.greatest(F.col("low") - lag("high"), F.lit(0.0)))
    down = _zero(F.greatest(lag("low") - F.col("high"), F.lit(0.0)))
    filled = lambda part, gap: F.when(gap > 0, F.least(F.greatest(1 - F.greatest(part, F.lit(0.0)) / F.nullif(gap, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return {"fvg_up_width": up, "fvg_down_width": down, "fvg_up_fill": filled(F.col("close") - lag("high"), up), "fvg_down_fill": filled(lag("low") - F.col("close"), down)}


def with_realized_vol(df: DataFrame, n: int) -> DataFrame:
    """Deviation of one-step log returns, of which the first counts as 0."""
    return df.withColumn("_r", _zero(log_return())).withColumn(f"realized_vol_{n}", _zero(deviation("_r", n))).drop("_r")


def with_rogers_satchell(df: DataFrame, n: int = 14) -> DataFrame:
    """Mean Rogers-Satchell term, in which the close before stands for the open."""
    o = F.coalesce(lag("close"), F.col("close"))
    term = ln(ratio(F.col("high"), F.col("close"))) * ln(ratio(F.col("high"), o)) + ln(ratio(F.col("low"), F.col("close"))) * ln(ratio(F.col("low"), o))
    return df.withColumn("_t", term).withColumn("rsj", sma("_t", n)).drop("_t")


def with_burst(df: DataFrame) -> DataFrame:
    """Size of the return (0 on the first row) against its deviation over 30 rows (5 at least), at most 10."""
    sd = deviation("_r", 30, 5)
    size = F.abs("_r") / F.when(sd >= TINY, sd)
    return df.withColumn("_r", pct_change()).withColumn("burst_score", _zero(F.when(size > 10, 10.0).otherwise(size))).drop("_r")


def with_range_acceleration(df: DataFrame) -> DataFrame:
    return df.withColumn("_a", sma(F.col("high") - F.col("low"), 14)).withColumn("atr_accel", _zero(F.col("_a") - lag("_a"))).drop("_a")


def liquidity_proxy(df: DataFrame) -> DataFrame:
    return df.withColumn("_v", sma("volume", 30, 5)).withColumn("liquidity_proxy", _zero(F.last("_v", ignorenulls=True).over(so_far()))).drop("_v")


def rolling_median(x: Column, n: int) -> Column:
    return F.percentile(x, F.lit(0.5)).over(last_rows(n))


def fee_buffer(fee_bp: float = 2.0, n: int = 50, median: bool = True) -> Column:
    spread = F.abs(F.col("high") - F.col("low"))
    return fee_bp / 10000 + ratio(rolling_median(spread, n) if median else F.avg(spread).over(last_rows(n)), F.col("close")) / 2


def drawdown(x: str) -> Column:
    top = F.max(x).over(so_far())
    return (F.col(x) - top) / F.nullif(top, F.lit(0.0))


def signed_quantity() -> Column:
    """What a trade adds to the cumulative volume delta."""
    return F.when(F.col("is_buyer_maker"), -F.col("quantity")).otherwise(F.col("quantity"))


def ofi_step() -> Column:
    """What a row adds to the order-flow imbalance: changes of size on the side whose price holds or improves."""
    d = lambda c: _zero(F.col(c) - lag(c))
    return F.when(d("bid_price") >= 0, d("bid_size")).otherwise(0.0) - F.when(d("ask_price") <= 0, d("ask_size")).otherwise(0.0)


def imbalance(level: int) -> Column:
    b, a = F.col(f"bid_size_{level}"), F.col(f"ask_size_{level}")
    return _zero((b - a) / F.nullif(b + a, F.lit(0.0)))


def raw_microprice() -> Column:
    """The price weighted by the other side's size; null without sizes."""
    return (F.col("bid_price") * F.col("ask_size") + F.col("ask_price") * F.col("bid_size")) / F.nullif(F.col("bid_size") + F.col("ask_size"), F.lit(0.0))


def with_roll_impact(df: DataFrame, n: int = 50) -> DataFrame:
    step = F.abs(F.col("price") - lag("price")) / F.nullif(F.col("quantity"), F.lit(0.0))
    return df.withColumn("_impact", step).withColumn("roll_impact", F.avg("_impact").over(last_rows(n))).drop("_impact")


def vpin(n: int = 50) -> Column:
    """Rolling share of one-sided volume; a trade has one side, so each counts whole."""
    buy, sell = F.when(~F.col("is_buyer_maker"), F.col("quantity")).otherwise(0.0), F.when(F.col("is_buyer_maker"), F.col("quantity")).otherwise(0.0)
    return F.sum(F.abs(buy - sell)).over(last_rows(n)) / F.nullif(F.sum("quantity").over(last_rows(n)), F.lit(0.0))


def target(h: int, buffer: Column | str = "fee_buffer") -> Column:
    """1, 0 or -1 as the log return over the next h rows leaves the cost buffer; 0 where there are no h rows."""
    ahead = ln(F.lead("close", h).over(by_time())) - ln(F.col("close"))
    b = F.col(buffer) if isinstance(buffer, str) else buffer
    return F.when(ahead > b, 1).when(ahead < -b, -1).otherwise(0)


def target_binary() -> Column:
    return F.coalesce((F.lead("close", 1).over(by_time()) > F.col("close")).cast("int"), F.lit(0))


def fill_limited(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """Nulls become the last value of up to n rows before, else the first of up to n rows after."""
    back, ahead = by_time().rowsBetween(-n, 0), by_time().rowsBetween(0, n)
    df = df.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in columns})
    return df.withColumns({c: F.coalesce(c, F.first(c, ignorenulls=True).over(ahead)) for c in columns})


def complete_rows(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """Infinite values become null, nulls are filled within n rows, rows that keep one go."""
    clean = df.withColumns({c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)) for c in columns})
    return fill_limited(clean, columns, n).dropna(subset=columns)


def cyclic_time() -> dict[str, Column]:
    minute = 2 * 3.141592653589793 * (F.hour("ts") * 60 + F.minute("ts")) / 1440
    day = 2 * 3.141592653589793 * F.weekday("ts") / 7
    return {"hour_sin": F.sin(minute), "hour_cos": F.cos(minute), "dow_sin": F.sin(day), "dow_cos": F.cos(day)}


def trading_session() -> Column:
    h = F.hour("ts")
    return F.when(h < 8, SESSIONS[0]).when(h < 16, SESSIONS[1]).otherwise(SESSIONS[2])


def quantiles(df: DataFrame, x: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The exact 0.33 and 0.66 quantiles of a whole series in _q: a row for each series that has values."""
    return exact_quantiles(df.select(*keys, x), x, (0.33, 0.66), keys)


def with_vol_bucket(df: DataFrame, x: str = "realized_vol_60", keys: tuple[str, ...] = ("symbol",), of: DataFrame | None = None) -> DataFrame:
    """low, med or high by the quantiles of the whole series (of `of`, a cheaper plan of the same rows, if given); high wins a tie."""
    out = df.join(quantiles(df if of is None else of, x, keys), list(keys), "left")
    return out.withColumn("vol_bucket", F.when(F.col(x) >= F.col("_q")[1], "high").when(F.col(x) <= F.col("_q")[0], "low").otherwise("med")).drop("_q")


def one_hot() -> dict[str, Column]:
    return {f"session_{s}": (F.col("session") == s).cast("double") for s in SESSIONS} | {f"vol_bucket_{b}": (F.col("vol_bucket") == b).cast("double") for b in VOL_BUCKETS}


def interactions(trends: list[str]) -> dict[str, Column]:
    return {f"{t}_x_{b}": _zero(F.col(t)) * F.col(f"vol_bucket_{b}") for t in trends for b in VOL_BUCKETS}
