"""Order-insensitive comparison of result frames."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import numpy as np
import pandas as pd


def canonical(value) -> str:
    if value is None or value is pd.NaT:
        return "null"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, np.integer)):
        return repr(float(value))
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, (float, np.floating)):
        if math.isnan(value):
            return "null"
        return repr(float(value) + 0.0)
    if isinstance(value, (pd.Timestamp, dt.datetime, dt.date)):
        return str(value)
    return str(value)


def canonical_rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    cols = sorted(frame.columns)
    return sorted(tuple(canonical(v) for v in row) for row in frame[cols].astype(object).itertuples(index=False, name=None))
