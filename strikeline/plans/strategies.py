"""Fixed strategy and level grids."""

from __future__ import annotations

# Nine condors by target short delta, 25-point wings, and nine take-profit shares.
STRATEGIES = [(f"IC_{d:02d}d_25w", d / 100.0, 25.0) for d in range(5, 50, 5)]
STRATEGY_NAMES = [name for name, _, _ in STRATEGIES]
TP_LEVELS = [i / 100.0 for i in range(10, 55, 5)]
STOP_MULTIPLE = 2.0
SHADOW = "IC_05d_25w"
