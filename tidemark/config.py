"""Settings from YAML with defaults, and overrides from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: The settings of data, policy, sizing, risk and backtests that hold where a file has none.
DEFAULTS: dict[str, Any] = {
    "data": {"symbol": "BTCUSDT", "interval": "1m", "horizon_min": 15, "fee_bp": 7, "slippage_bp": 5, "lookback_days": 30, "window": 300},
    "policy": {"conf_up": 0.6, "conf_down": 0.4, "allow_short": True, "prob_ema_alpha": 0.2, "min_hold_bars": 3, "abstain_margin": 0.03, "max_ci_width": 0.25, "eu_reward_atr": 1.5, "eu_risk_atr": 1.0, "min_expected_utility": 0.0},
    "sizing": {"kelly_clip": 0.5, "max_leverage": 1.0},
    "risk": {"risk_per_trade": 0.01, "daily_loss_limit": 0.03, "take_profit": 0.01, "stop_loss": 0.005},
    "backtest": {"symbols": ["BTCUSDT"], "intervals": ["1m"], "horizons": [5, 15, 60]},
}
OVERRIDES = {"SYMBOL": ("data", "symbol"), "INTERVAL": ("data", "interval")}


def parse(text: str) -> dict[str, Any]:
    """YAML (or JSON, where no YAML library is at hand) as a dictionary; an empty text is an empty one."""
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text or "{}")
    return yaml.safe_load(text) or {}


def settings(text: str = "", env: Mapping[str, str] | None = None) -> dict[str, Any]:
    """The defaults, what the text sets over them, and non-empty environment variables over both. Lists that are empty count as not set."""
    out = {k: dict(v) for k, v in DEFAULTS.items()}
    for section, values in parse(text).items():
        out.setdefault(section, {}).update({k: v for k, v in (values or {}).items() if v != []})
    for name, (section, key) in OVERRIDES.items():
        if (os.environ if env is None else env).get(name):
            out[section][key] = (os.environ if env is None else env)[name]
    return out


def settings_table(spark: SparkSession, values: dict[str, Any]) -> DataFrame:
    """(section, key, value as text) of every setting."""
    text = lambda v: ",".join(map(str, v)) if isinstance(v, list) else str(v).lower() if isinstance(v, bool) else str(v)
    return spark.createDataFrame([(s, k, text(v)) for s, entries in values.items() for k, v in entries.items()], "section string, key string, value string")
