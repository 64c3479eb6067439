"""Scalar physics features of one child row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code groups and their category numbers.
PID_GROUPS = (
    ((11,), 4),
    ((13,), 5),
    ((22,), 3),
    ((130, 310, 2112), 2),
    ((211, 321, 2212), 1),
)
PID_VOCABULARY = {
    "unknown": 0,
    "charged_hadron": 1,
    "neutral_hadron": 2,
    "photon": 3,
    "electron": 4,
    "muon": 5,
}
TRACK_USABLE, TRACK_NEUTRAL, TRACK_MISSING = 1, 2, 3


def wrap_angle(x: Column) -> Column:
    """Angle in [-pi, pi)."""
    return F.pmod(x + F.lit(math.pi), F.lit(2.0 * math.pi)) - F.lit(math.pi)


def delta_r(eta1: Column, phi1: Column, eta2: Column, phi2: Column) -> Column:
    deta = eta1 - eta2
    dphi = wrap_angle(phi1 - phi2)
    return F.sqrt(deta * deta + dphi * dphi)


def pid_category(code: Column) -> Column:
    absolute = F.abs(code)
    result = F.lit(0)
    for codes, category in reversed(PID_GROUPS):
        result = F.when(absolute.isin(*codes), F.lit(category)).otherwise(result)
    return result.cast("tinyint")


def track_state(charge: Column, has_track: Column) -> Column:
    return (
        F.when(has_track, F.lit(TRACK_USABLE))
        .when(charge == 0.0, F.lit(TRACK_NEUTRAL))
        .otherwise(F.lit(TRACK_MISSING))
        .cast("tinyint")
    )


def not_finite(x: Column) -> Column:
    """True for null, NaN and both infinities."""
    return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))
