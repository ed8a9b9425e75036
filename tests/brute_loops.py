"""The policy's state machine and the backtests as loops over the rows of one series, which the blocks must equal."""

import numpy as np
import pandas as pd

from tidemark.operators.backtest import Costs
from tidemark.operators.policy import DELEVER, Rules, Settings


def decide(pdf: pd.DataFrame, s: Settings, thresholds: tuple = Rules.thresholds) -> pd.DataFrame:
    """The state machine over one series: side, size, smoothed confidence and the step that decided.

    Guards, blocks and abstention decide before the state: they leave the position held, and its age, as they were. The age is 0 at entry
    and grows with each bar that the position is kept, so an opposite signal is held off for min_hold bars. Smoothed confidence is that
    of the likelier class, whichever it is.
    """
    smooth, held, age, peak, out = None, "flat", 0, 0.0, []
    for r in pdf.sort_values("ts", kind="stable").itertuples():
        side, size, why = "flat", 0.0, "flat"
        if not r.guards_ok:
            why = "guard"
        elif r.blocked:
            why = "filter"
        else:
            smooth = r.pred_conf if smooth is None else smooth + s.smoothing * (r.pred_conf - smooth)
            if r.grey_lo <= r.pred_conf <= r.grey_hi or r.ci_width > s.max_ci_width or abs(r.pred_conf - 0.5) < s.min_edge:
                why = "abstain"
            else:
                if r.eu_long > s.min_utility and r.may_long:
                    side = "long"
                if r.eu_short > max(r.eu_long, s.min_utility) and r.may_short:
                    side = "short"
                for above, below in thresholds:
                    if above is not None and smooth >= above and r.may_long:
                        side = "long"
                    if below is not None and smooth <= below and r.may_short:
                        side = "short"
                if side != "flat" and (r.eu_long if side == "long" else r.eu_short) <= s.min_utility:
                    side = "flat"
                if side == "flat":
                    held, age = "flat", 0
                elif held == side or held != "flat" and age < s.min_hold:
                    side, age = held, age + 1
                else:
                    held, age = side, 0
                if side != "flat":
                    peak = max(peak, r.balance)
                    drawdown = 1 - r.balance / peak if peak > 0 else 0.0
                    factor = min([f for bound, f in DELEVER if drawdown >= bound], default=1.0)
                    share = min(abs(smooth - 0.5) / max(smooth * (1 - smooth), 1e-6), s.kelly_clip) * factor
                    size = r.sized or r.balance * s.risk_per_trade * min(share, s.max_leverage)
                    why = "entry"
        out.append((r.symbol, r.ts, side, float(size), smooth, why))
    return pd.DataFrame(out, columns=["symbol", "ts", "side", "size", "smoothed", "why"])


def run_series(pdf: pd.DataFrame, c: Costs) -> pd.DataFrame:
    """One series through the bar loop; rows of kind 'equity' (ts, equity) and 'trade' (entry, exit, side, size, prices, pnl)."""
    pdf = pdf.sort_values("ts", kind="stable")
    slip = dict(c.slip)
    queue, cash, side, size, entry, entry_ts = [], c.start, 0, 0.0, 0.0, None
    out: list[tuple] = []
    for r in pdf.itertuples():
        want = {"long": 1, "short": -1}.get(r.side, 0)
        queue.append([c.latency_bars, want, r.size])
        ready = [q for q in queue if q[0] <= 0]
        queue = [[q[0] - 1, q[1], q[2]] for q in queue if q[0] > 0]
        if ready:
            _, want, amount = ready[-1]
            fill = min(c.max_fill, 1.0, r.volume / r.avg_volume if r.avg_volume and r.avg_volume > 0 and r.volume else 1.0)
            slippage = r.spread * slip.get(r.bucket, slip["med"]) * min(1.0, abs(r.size) / max(r.volume or 1.0, 1e-6))
            taker = abs(r.pred_conf - 0.5) > 0.1
            price = lambda d, t=taker: r.close + d * (r.spread / 2 + slippage) + d * r.close * (c.taker_bp if t else -c.maker_bp) / 10000  # noqa: B023, E731
            if want == side:
                size = amount * fill if side else 0.0
            else:
                if side:
                    px = price(-side, True)
                    pnl = side * (px - entry) * size
                    cash += pnl
                    out.append((r.symbol, "trade", entry_ts, r.ts, "long" if side > 0 else "short", size, entry, px, pnl, None))
                side, size = want, amount * fill if want else 0.0
                entry, entry_ts = (price(want), r.ts) if want else (0.0, None)
            if side:
                cash -= abs(size) * r.close * c.funding_bp / 10000
        out.append((r.symbol, "equity", r.ts, r.ts, None, None, None, None, None, cash + side * (r.close - entry) * size))
    return pd.DataFrame(out, columns=["symbol", "kind", "entry_time", "exit_time", "side", "size", "entry_price", "exit_price", "pnl", "equity"])


def flip_pnl(pdf: pd.DataFrame) -> pd.DataFrame:
    """Running pnl of unit positions that flip with the side; flat closes."""
    pdf = pdf.sort_values("ts", kind="stable")
    side, entry, pnl, out = "flat", 0.0, 0.0, []
    for r in pdf.itertuples():
        if r.side != side:
            if side != "flat":
                pnl += (r.close - entry) if side == "long" else (entry - r.close)
            side, entry = r.side, r.close
        out.append(pnl)
    return pd.DataFrame({"symbol": pdf["symbol"], "ts": pdf["ts"], "pnl": np.asarray(out, float)})
