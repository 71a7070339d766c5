"""Labels, class choice and display helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens import params
from marketlens.functions.text import _col


def label_from_return(ret: Column | str, up: float = params.UP_THRESHOLD,
                      down: float = params.DOWN_THRESHOLD) -> Column:
    """-1 unknown, 2 above `up`, 0 below `down`, else 1; both comparisons are strict."""
    ret = _col(ret)
    return (F.when(ret.isNull() | F.isnan(ret), F.lit(params.UNLABELED))
            .when(ret > up, F.lit(params.UP)).when(ret < down, F.lit(params.DOWN))
            .otherwise(F.lit(params.NEUTRAL)))


def label_name(label: Column | str) -> Column:
    label = _col(label)
    chain = None
    for code, name in params.LABEL_NAMES.items():
        hit = label == code
        chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    return chain


def argmax_class(down: Column | str, neutral: Column | str, up: Column | str) -> Column:
    """Class of the largest probability; the first in DOWN, NEUTRAL, UP order wins a tie."""
    down, neutral, up = _col(down), _col(neutral), _col(up)
    return (F.when((down >= neutral) & (down >= up), F.lit(params.DOWN))
            .when(neutral >= up, F.lit(params.NEUTRAL)).otherwise(F.lit(params.UP)))


def confidence(down: Column | str, neutral: Column | str, up: Column | str) -> Column:
    return F.greatest(_col(down), _col(neutral), _col(up))


def round4(value: Column | str) -> Column:
    return F.round(_col(value), 4)


def percent(value: Column | str, digits: int = 1) -> Column:
    """`0.7312 -> 73.1%`; rounding happens first so that engines agree on exact halves."""
    return F.format_string(f"%.{digits}f%%", F.round(_col(value) * 100, digits))


def fill_zero(value: Column | str) -> Column:
    """Null and NaN to zero."""
    value = _col(value)
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
