"""Forward returns and technical indicators on price bars.

All windows share one partition/order specification, so Spark plans one shuffle and one sort
for the whole feature set. Bars hold one row per instrument and period, so a daily series is
bounded by the calendar (about 36,525 rows per century). For intraday or tick series pass
`block_rows`: the series is then cut into blocks that carry the few neighbouring rows their
windows need, and no task sees more than about `block_rows` rows of one instrument.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketlens import params
from marketlens.functions.labels import fill_zero
from marketlens.operators.running import running_last, running_rank

KEY, ORDER = "ticker", "date"


def _window(key: str, order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def _trailing(w: WindowSpec, rows: int) -> WindowSpec:
    return w.rowsBetween(1 - rows, 0)


def over_blocks(bars: DataFrame, step: Callable[[DataFrame, WindowSpec], DataFrame], *,
                key: str = KEY, order: str = ORDER, block_rows: int, back: int,
                ahead: int = 0) -> DataFrame:
    """Apply a window step that looks `back` rows back and `ahead` rows on, block by block.

    Rows get their position in the series from month counts (`running_rank`); a row near a
    block edge is copied to the neighbouring block as context and dropped after the step.
    """
    if block_rows < max(back, ahead):
        raise ValueError("block_rows must cover the longest window")
    month = bars.withColumn("_month", F.date_format(order, "yyyy-MM"))
    placed = running_rank(month, [key], "_month", [order], "_row")
    position = F.col("_row") - 1
    block, inside = F.floor(position / block_rows), position % block_rows
    homes = F.array_compact(F.array(
        block,
        F.when(inside >= block_rows - back, block + 1),
        F.when((inside < ahead) & (block > 0), block - 1)))
    spread = (placed.withColumn("_home", block).withColumn("_block", F.explode(homes)))
    done = step(spread, Window.partitionBy(key, "_block").orderBy("_row"))
    return (done.where(F.col("_block") == F.col("_home"))
            .drop("_month", "_row", "_home", "_block"))


def forward_return_column(w: WindowSpec, close: str = "close",
                          horizon: int = params.HORIZON_BARS) -> Column:
    return F.try_divide(F.lead(close, horizon).over(w), F.col(close)) - 1


def forward_return(bars: DataFrame, horizon: int = params.HORIZON_BARS, *, key: str = KEY,
                   order: str = ORDER, close: str = "close",
                   block_rows: int | None = None) -> DataFrame:
    """Add `forward_return`: the return `horizon` bars ahead, null at the end of a series."""
    def step(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("forward_return", forward_return_column(w, close, horizon))

    if block_rows:
        return over_blocks(bars, step, key=key, order=order, block_rows=block_rows, back=0,
                           ahead=horizon)
    return step(bars, _window(key, order))


def moving_averages(bars: DataFrame, windows: Sequence[int] = params.MA_WINDOWS, *,
                    key: str = KEY, order: str = ORDER, close: str = "close",
                    prefix: str = "ma_") -> DataFrame:
    w = _window(key, order)
    return bars.withColumns(
        {f"{prefix}{n}": F.avg(close).over(_trailing(w, n)) for n in windows})


def ma_ratios(bars: DataFrame, windows: Sequence[int] = params.MA_WINDOWS, *,
              key: str = KEY, order: str = ORDER, close: str = "close") -> DataFrame:
    w = _window(key, order)
    return bars.withColumns({
        f"ma_ratio_{n}": F.try_divide(F.col(close), F.avg(close).over(_trailing(w, n)))
        for n in windows})


def filled_close(w: WindowSpec, close: str) -> Column:
    """Close with gaps carried forward from the last known value."""
    return F.last(close, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def _change(filled: str, w: WindowSpec, lag: int) -> Column:
    return F.try_divide(F.col(filled), F.lag(filled, lag).over(w)) - 1


def pct_change(bars: DataFrame, lag: int = 1, *, key: str = KEY, order: str = ORDER,
               close: str = "close", name: str = "pct_change") -> DataFrame:
    w = _window(key, order)
    return (bars.withColumn("_filled", filled_close(w, close))
            .withColumn(name, _change("_filled", w, lag)).drop("_filled"))


def volatility(bars: DataFrame, rows: int = params.VOLATILITY_WINDOW, *, key: str = KEY,
               order: str = ORDER, close: str = "close") -> DataFrame:
    """Sample standard deviation of one-bar returns; fewer than two returns give 0."""
    w = _window(key, order)
    return (pct_change(bars, key=key, order=order, close=close, name="_ret")
            .withColumn("volatility",
                        fill_zero(F.stddev_samp("_ret").over(_trailing(w, rows))))
            .drop("_ret"))


def momentum(bars: DataFrame, lag: int = params.MOMENTUM_LAG, **names: str) -> DataFrame:
    return pct_change(bars, lag, name="momentum", **names)


def volume_features(bars: DataFrame, rows: int = params.VOLUME_WINDOW, *, key: str = KEY,
                    order: str = ORDER, volume: str = "volume") -> DataFrame:
    mean = F.avg(volume).over(_trailing(_window(key, order), rows))
    return bars.withColumns({
        "volume_ma": fill_zero(mean),
        "volume_ratio": fill_zero(F.try_divide(F.col(volume), mean))})


def _delta_parts(delta: str) -> dict[str, Column]:
    """Gain and loss parts; null stays null (Spark's greatest would skip it)."""
    known = F.col(delta).isNotNull()
    return {"gain": F.when(known, F.greatest(F.col(delta), F.lit(0))),
            "loss": F.when(known, -F.least(F.col(delta), F.lit(0)))}


def price_delta(bars: DataFrame, *, key: str = KEY, order: str = ORDER,
                close: str = "close") -> DataFrame:
    w = _window(key, order)
    return (bars.withColumn("delta", F.col(close) - F.lag(close).over(w))
            .withColumns(_delta_parts("delta")))


def _rsi(w: WindowSpec, rows: int, zero_loss: float, gain: str, loss: str) -> Column:
    frame = _trailing(w, rows)
    mean_gain, mean_loss = F.avg(gain).over(frame), F.avg(loss).over(frame)
    value = 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(mean_gain, mean_loss))
    return F.when(mean_loss == 0, F.lit(zero_loss)).otherwise(fill_zero(value))


def rsi(bars: DataFrame, rows: int = params.RSI_WINDOW, zero_loss: float = 0.0, *,
        key: str = KEY, order: str = ORDER, close: str = "close") -> DataFrame:
    """Relative strength from simple means; a window without losses gives `zero_loss`."""
    w = _window(key, order)
    return (price_delta(bars, key=key, order=order, close=close)
            .withColumn("rsi", _rsi(w, rows, zero_loss, "gain", "loss"))
            .drop("delta", "gain", "loss"))


MARKET_FEATURES = [
    *[name for n in params.MA_WINDOWS for name in (f"ma_{n}", f"ma_ratio_{n}")],
    "volatility", "momentum", "volume_ma", "volume_ratio", "rsi"]


def market_features(bars: DataFrame, *, key: str = KEY, order: str = ORDER,
                    close: str = "close", volume: str = "volume", zero_loss: float = 0.0,
                    block_rows: int | None = None) -> DataFrame:
    """All 13 indicator columns in one shuffle and one sort; nulls become 0."""
    def step(df: DataFrame, w: WindowSpec) -> DataFrame:
        base = df.withColumn("_delta", F.col(close) - F.lag(close).over(w))
        if block_rows is None:
            base = base.withColumn("_filled", filled_close(w, close))
        parts = _delta_parts("_delta")
        base = base.withColumns({
            "_ret": _change("_filled", w, 1), "_gain": parts["gain"], "_loss": parts["loss"]})
        mean_volume = F.avg(volume).over(_trailing(w, params.VOLUME_WINDOW))
        columns: dict[str, Column] = {}
        for n in params.MA_WINDOWS:
            mean = F.avg(close).over(_trailing(w, n))
            columns[f"ma_{n}"] = fill_zero(mean)
            columns[f"ma_ratio_{n}"] = fill_zero(F.try_divide(F.col(close), mean))
        columns["volatility"] = fill_zero(
            F.stddev_samp("_ret").over(_trailing(w, params.VOLATILITY_WINDOW)))
        columns["momentum"] = fill_zero(_change("_filled", w, params.MOMENTUM_LAG))
        columns["volume_ma"] = fill_zero(mean_volume)
        columns["volume_ratio"] = fill_zero(F.try_divide(F.col(volume), mean_volume))
        columns["rsi"] = _rsi(w, params.RSI_WINDOW, zero_loss, "_gain", "_loss")
        return base.withColumns(columns).drop("_filled", "_delta", "_ret", "_gain", "_loss")

    if block_rows is None:
        return step(bars, _window(key, order))
    # Deltas and returns reach one bar behind the rolling windows over them.
    back = max(*params.MA_WINDOWS, params.VOLATILITY_WINDOW + 1, params.MOMENTUM_LAG + 1,
               params.RSI_WINDOW + 1)
    # The last known close may be arbitrarily old, so it is carried across months first.
    filled = running_last(bars.withColumn("_month", F.date_format(order, "yyyy-MM")), [key],
                          "_month", [order], close, "_filled").drop("_month")
    return over_blocks(filled, step, key=key, order=order, block_rows=block_rows, back=back)


def chart_overlays(bars: DataFrame, *, key: str = KEY, order: str = ORDER,
                   close: str = "close") -> DataFrame:
    """Bars with the two chart averages."""
    return moving_averages(bars, params.CHART_WINDOWS, key=key, order=order, close=close)
