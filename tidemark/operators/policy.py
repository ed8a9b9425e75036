"""Decision policy: rules compiled to columns, and the state machine that smooths, holds and sizes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import assignment, predicate
from tidemark.operators.blocks import BLOCK_ROWS, block_states, carried, placed, with_states
from tidemark.session import stored

#: Confidence bounds of abstention by regime (those of `low` are inverted, so nothing lies in them), steps of drawdown and their factors.
GREY = {"low": (0.52, 0.48), "med": (0.5, 0.5), "high": (0.48, 0.52)}
GREY_DEFAULT = (0.45, 0.55)
DELEVER = ((0.05, 0.75), (0.1, 0.5))
ACTIONS = ("block_entries", "allow_long_only", "allow_short_only", "pass")


@dataclass(frozen=True)
class Settings:
    risk_per_trade: float = 0.01
    smoothing: float = 0.2
    max_ci_width: float = 0.25
    min_edge: float = 0.03
    reward_atr: float = 1.5
    risk_atr: float = 1.0
    atr_share: float = 0.004
    commission_bp: float = 7.0
    spread_bp: float = 5.0
    min_utility: float = 0.0
    min_hold: int = 3
    kelly_clip: float = 0.5
    max_leverage: float = 1.0
    allow_short: bool = True


@dataclass(frozen=True)
class Rules:
    """Rules as text: guards must hold, filters are (condition, action), thresholds (long at, short at; either may be None) on the smoothed
    confidence, sizing assigns the size, exits are (take profit, stop loss)."""

    guards: tuple[str, ...] = ()
    filters: tuple[tuple[str, str], ...] = ()
    thresholds: tuple[tuple[float | None, float | None], ...] = ((0.62, 0.38),)
    sizing: tuple[str, ...] = ()
    exits: tuple[tuple[float | None, float | None], ...] = ()

    def __post_init__(self) -> None:
        bad = [a for _, a in self.filters if a not in ACTIONS]
        if bad:
            raise ValueError(f"unknown actions: {bad}")


def rules_of(config: dict) -> Rules:
    """Rules from a configuration as YAML or JSON gives it: lists filters, thresholds, position_sizing, risk_guards and exits of named entries.

    A filter has an `expr` (types metric and numeric) or a `query` (type text_rag_any). The latter holds where the column
    `hits_<name>`, which a search of the knowledge base adds, is above 0, and nowhere without that column.
    """
    filters = []
    for f in config.get("filters") or []:
        kind, text = f.get("type"), f.get("query") if f.get("type") == "text_rag_any" else f.get("expr")
        if kind not in ("metric", "numeric", "text_rag_any") or not text:
            raise ValueError(f"filter {f.get('name')}: type {kind} needs an expression or a query")
        filters.append((f"hits_{f['name']} > 0" if kind == "text_rag_any" else text, f.get("action", "pass")))
    pair = lambda x, a, b: tuple(None if x.get(k) is None else float(x[k]) for k in (a, b))
    return Rules(
        guards=tuple(g["expr"] for g in config.get("risk_guards") or []),
        filters=tuple(filters),
        thresholds=tuple(pair(t, "long_if_prob_gt", "short_if_prob_lt") for t in config.get("thresholds") or []),
        sizing=tuple(x["expr"] for x in config.get("position_sizing") or []),
        exits=tuple(pair(x, "take_profit", "stop_loss") for x in config.get("exits") or []),
    )


def compile_rules(rules: Rules, columns: list[str], allow_short: bool = True) -> dict[str, Column]:
    """Columns guards_ok, blocked, may_long and may_short (the last filter that restricts wins) and sized (0: no rule)."""
    ok = F.lit(True)
    for g in rules.guards:
        ok = ok & predicate(g, columns)
    blocked, may_long, may_short = F.lit(False), F.lit(True), F.lit(allow_short)
    for text, action in rules.filters:
        hit = predicate(text, columns)
        if action == "block_entries":
            blocked = blocked | hit
        elif action != "pass":
            may_long, may_short = (F.when(hit, action == f"allow_{side}_only").otherwise(x) for side, x in (("long", may_long), ("short", may_short)))
    sized = F.lit(0.0)
    for text in rules.sizing:
        value = assignment(text, columns)
        sized = F.when(value != 0, value).otherwise(sized)
    return {"guards_ok": ok, "blocked": blocked, "may_long": may_long, "may_short": may_short, "sized": sized}


def exit_prices(rules: Rules, side: Column, price: Column) -> dict[str, Column]:
    """take_profit and stop_loss prices of a position, by the nearest of the rules' shares; null where no rule sets one, and for flat."""
    way = F.when(side == "long", 1.0).when(side == "short", -1.0)
    near = [min((e[i] for e in rules.exits if e[i] is not None), default=None) for i in (0, 1)]
    return {n: F.lit(None).cast("double") if x is None else price * (1 + k * way * x) for n, x, k in zip(("take_profit", "stop_loss"), near, (1, -1))}


def expected_utility(s: Settings = Settings()) -> dict[str, Column]:
    """Utilities of both sides from prob_up, prob_down, close and (may be null) atr."""
    atr = F.coalesce(F.nullif(F.col("atr"), F.lit(0.0)), F.col("close") * s.atr_share)
    cost = (s.commission_bp + s.spread_bp) / 10000 * F.col("close")
    gain, loss = s.reward_atr * atr, s.risk_atr * atr
    return {"eu_long": F.col("prob_up") * gain - F.col("prob_down") * loss - cost, "eu_short": F.col("prob_down") * gain - F.col("prob_up") * loss - cost}


def kelly(p: Column, clip: float = 0.5) -> Column:
    return F.least(F.abs(p - 0.5) / F.greatest(p * (1 - p), F.lit(1e-6)), F.lit(clip))


def delever(drawdown: Column) -> Column:
    return F.least(F.lit(1.0), *[F.when(drawdown >= bound, factor).otherwise(1.0) for bound, factor in DELEVER])


def grey_zone(bucket: Column) -> tuple[Column, Column]:
    lo, hi = F.lit(GREY_DEFAULT[0]), F.lit(GREY_DEFAULT[1])
    for b, (x, y) in GREY.items():
        lo, hi = F.when(bucket == b, x).otherwise(lo), F.when(bucket == b, y).otherwise(hi)
    return lo, hi


#: Codes of what a row tells the state: nothing, go flat, long or short.
HOLD, FLAT, LONG, SHORT = -1, 0, 1, 2


def smoothing_map(pdf: pd.DataFrame, a: float) -> pd.DataFrame:
    """What a block's active rows do to the smoothed confidence: y -> keep * y + add, and the first of them, from which a series begins."""
    x = pdf.sort_values("_i")["_x"].dropna().to_numpy(np.float64)
    add = pd.Series(np.concatenate([[0.0], x])).ewm(alpha=a, adjust=False).mean().iat[-1]
    return pd.DataFrame({"block": [int(pdf["_b"].iat[0])], "first": [x[0] if len(x) else None], "keep": [(1 - a) ** len(x)], "add": [add]})


def smoothing_states(maps: pd.DataFrame) -> pd.DataFrame:
    """The smoothed confidence that each block but the first begins with; null as long as no row was active."""
    rows, y = [], np.nan
    for r in maps.sort_values("block").itertuples():
        if not np.isnan(r.first):
            y = r.keep * (r.first if np.isnan(y) else y) + r.add
        rows.append((r.block + 1, None if np.isnan(y) else y))
    return pd.DataFrame(rows, columns=["block", "y"])


def smoothed(pdf: pd.DataFrame, state: pd.DataFrame, a: float) -> pd.DataFrame:
    """A block's rows with the smoothed confidence so far."""
    pdf = pdf.sort_values("_i", kind="stable")
    x = pdf["_x"].to_numpy(np.float64)
    known = np.flatnonzero(~np.isnan(x))
    y = float(state["y"].iat[0]) if len(state) and pd.notna(state["y"].iat[0]) else np.nan
    out = np.full(len(x), y)
    if len(known):
        begin = x[known[0]] if np.isnan(y) else y
        run = pd.Series(np.concatenate([[begin], x[known]])).ewm(alpha=a, adjust=False).mean().to_numpy()
        at = np.searchsorted(known, np.arange(len(x)), side="right")
        out = np.where(at > 0, run[at], y)
    return pdf.assign(smoothed=np.where(np.isnan(out), None, out))


def transitions(signal: np.ndarray, hold: int) -> np.ndarray:
    """(rows, states): where each row takes each state. State 0 is flat, then long and short by age from 0 to `hold` (and beyond).

    A flat signal clears the position; one of its own side ages it; another one is held off until the age is `hold`, then it is followed.
    """
    ages, none = hold + 1, np.arange(2 * hold + 3)
    age = np.concatenate([[0], np.arange(ages), np.arange(ages)])
    side = np.concatenate([[0], np.full(ages, 1), np.full(ages, 2)])
    older = none + ((side > 0) & (age < hold))
    follow = {HOLD: none, FLAT: np.zeros_like(none)}
    for s in (LONG, SHORT):
        stays = (side == s) | (side > 0) & (age < hold)
        follow[s] = np.where(stays, older, 1 + (s - 1) * ages)
    table = np.stack([follow[c] for c in (HOLD, FLAT, LONG, SHORT)]).astype(np.int16)
    return table[signal + 1]


def composed(f: np.ndarray) -> np.ndarray:
    """Of each row, where it and all rows before it take each state: neighbours are composed at twice the distance each time."""
    f, k = f.copy(), 1
    while k < len(f):
        f[k:] = np.take_along_axis(f[k:], f[:-k].astype(np.int64), axis=1)
        k *= 2
    return f


def holding_map(pdf: pd.DataFrame, hold: int) -> pd.DataFrame:
    signal = pdf.sort_values("_i")["_signal"].to_numpy(np.int64)
    return pd.DataFrame({"block": [int(pdf["_b"].iat[0])], "to": [composed(transitions(signal, hold))[-1].astype(np.int64)]})


def holding_states(maps: pd.DataFrame) -> pd.DataFrame:
    rows, state = [], 0
    for r in maps.sort_values("block").itertuples():
        state = int(r.to[state])
        rows.append((r.block + 1, state))
    return pd.DataFrame(rows, columns=["block", "state"])


def held(pdf: pd.DataFrame, state: pd.DataFrame, hold: int) -> pd.DataFrame:
    """A block's rows with the side that each signal leaves: 0 flat, 1 long, 2 short; 0 where there is no signal."""
    pdf = pdf.sort_values("_i", kind="stable")
    signal = pdf["_signal"].to_numpy(np.int64)
    at = composed(transitions(signal, hold))[:, int(state["state"].iat[0]) if len(state) else 0]
    return pdf.assign(_held=np.where(signal == HOLD, 0, np.where(at == 0, 0, 1 + (at - 1) // (hold + 1))).astype(np.int32))


def apply_policy(rows: DataFrame, rules: Rules = Rules(), s: Settings = Settings(), block: int = BLOCK_ROWS) -> DataFrame:
    """Decisions for prediction rows: symbol, ts, close, prob_up, prob_down, pred_conf, and where present atr, ci_width, regime_bucket, balance.

    Guards, blocks and abstention decide before the state: they leave the position held, and its age, as they were. The age is 0 at entry
    and grows with each bar that the position is kept, so an opposite signal is held off for min_hold bars. Smoothed confidence is that
    of the likelier class, whichever it is. A regime without bounds of its own has GREY_DEFAULT.

    A series goes through in blocks: smoothing is a map y -> k y + b of each block, and the position and its age are a few states that a
    block maps to states. Signals between the two, the peak of the balance and the size are columns.
    """
    defaults = {"atr": F.lit(None).cast("double"), "ci_width": F.lit(0.0), "regime_bucket": F.lit("med"), "balance": F.lit(10000.0)}
    df = rows.withColumns({k: v for k, v in defaults.items() if k not in rows.columns})
    df = df.withColumn("base_risk", F.col("balance") * s.risk_per_trade)
    lo, hi = grey_zone(F.col("regime_bucket"))
    df = df.withColumns(compile_rules(rules, df.columns, s.allow_short) | expected_utility(s) | {"grey_lo": lo, "grey_hi": hi})
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    active = yes("guards_ok") & ~yes("blocked")
    df = df.select("symbol", "ts", "pred_conf", "ci_width", "guards_ok", "blocked", "may_long", "may_short", "sized", "eu_long", "eu_short", "grey_lo", "grey_hi", "balance", F.when(active, F.col("pred_conf").cast("double")).alias("_x"))
    keys, a, hold = ["symbol"], s.smoothing, s.min_hold
    lines = placed(df, keys, ["ts"], block)
    before = block_states(lines.select("symbol", "_i", "_b", "_last", "_x"), keys, lambda pdf: smoothing_map(pdf, a), "block bigint, first double, keep double, add double", smoothing_states, "block bigint, y double")
    smooth = with_states(lines, before, keys, lambda pdf, state: smoothed(pdf, state, a), "smoothed double")
    edge = (F.col("pred_conf") >= F.col("grey_lo")) & (F.col("pred_conf") <= F.col("grey_hi")) | (F.col("ci_width") > s.max_ci_width) | (F.abs(F.col("pred_conf") - 0.5) < s.min_edge)
    side = F.when((F.col("eu_long") > s.min_utility) & yes("may_long"), LONG).otherwise(FLAT)
    side = F.when((F.col("eu_short") > F.greatest("eu_long", F.lit(s.min_utility))) & yes("may_short"), SHORT).otherwise(side)
    for above, below in rules.thresholds:
        side = side if above is None else F.when((F.col("smoothed") >= above) & yes("may_long"), LONG).otherwise(side)
        side = side if below is None else F.when((F.col("smoothed") <= below) & yes("may_short"), SHORT).otherwise(side)
    useful = F.when(F.col("_side") == LONG, F.col("eu_long")).when(F.col("_side") == SHORT, F.col("eu_short")) > s.min_utility
    abstains = F.coalesce(edge, F.lit(False))
    signals = smooth.withColumn("_side", side).withColumn("_signal", F.when(~active | abstains, HOLD).when(F.coalesce(useful, F.lit(False)), F.col("_side")).otherwise(FLAT))
    told = stored(signals.drop("_side"), "signals")
    begin = block_states(told.select("symbol", "_i", "_b", "_last", "_signal"), keys, lambda pdf: holding_map(pdf, hold), "block bigint, to array<bigint>", holding_states, "block bigint, state bigint")
    sided = with_states(told, begin, keys, lambda pdf, state: held(pdf, state, hold), "_held int")
    entered = F.col("_held") > 0
    peaks = carried(sided.withColumn("_balance", F.when(entered, F.col("balance"))), keys, tops={"_peak": "_balance"})
    drawdown = F.when(F.col("_peak") > 0, 1 - F.col("balance") / F.col("_peak")).otherwise(0.0)
    c = F.col("smoothed")
    share = F.least(F.abs(c - 0.5) / F.greatest(c * (1 - c), F.lit(1e-6)), F.lit(s.kelly_clip)) * delever(drawdown)
    size = F.when(F.col("sized") != 0, F.col("sized")).otherwise(F.col("balance") * s.risk_per_trade * F.least(share, F.lit(s.max_leverage)))
    why = F.when(~yes("guards_ok"), "guard").when(yes("blocked"), "filter").when(abstains, "abstain").when(entered, "entry").otherwise("flat")
    name = F.when(F.col("_held") == LONG, "long").when(F.col("_held") == SHORT, "short").otherwise("flat")
    return peaks.select("symbol", "ts", name.alias("side"), F.when(entered, size).otherwise(0.0).cast("double").alias("size"), "smoothed", why.alias("why"))
