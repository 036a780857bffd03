"""Feature names as a temporal contract.

A feature's prefix says when its value is known. ``lag_of`` turns that into
sessions of delay, and ``known_by`` lists the columns a row may use.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

# Prefix -> (sessions of delay, grain).
CONTRACT = {
    "daily_prior_": (1, "day"), "prior_day_": (1, "day"), "intraday_": (0, "minute"), "spx_intraday_": (0, "minute"), "vix_intraday_": (0, "minute"),
}


@dataclass(frozen=True)
class Feature:
    name: str
    lag: int
    grain: str


def feature(name: str) -> Feature:
    for prefix, (lag, grain) in CONTRACT.items():
        if name.startswith(prefix):
            return Feature(name, lag, grain)
    return Feature(name, 0, "entry")


def describe(names: Iterable[str]) -> list[Feature]:
    return [feature(n) for n in names]


def prior_name(column: str) -> str:
    """daily_prior_ name of a source column: windows spelled in days."""
    return "daily_prior_" + re.sub(r"_(\d+)d$", r"_\1day", column)
