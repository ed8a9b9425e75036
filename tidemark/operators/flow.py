"""Order flow of a tape, row by row, over blocks: a symbol's tape spreads over tasks, and rows of one time follow each other by trade id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as X
from tidemark.operators.blocks import BLOCK_ROWS, carried, haloed, in_block, placed, plain

#: Rows of the longest frame, and so of the halo.
FRAME = 50
ORDER = ("ts", "trade_id")


def with_flow(tape: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",), order: Sequence[str] = ORDER, rows: int = BLOCK_ROWS, keep_place: bool = False) -> DataFrame:
    """The tape with the named columns of cvd, roll_impact, vpin, ofi and microprice; the last two need the top of the book in the rows.

    cvd and ofi are running sums and microprice is a fill, each carried from block to block; roll_impact and vpin look back 50 rows, which
    a block has in its halo. Rows that are equal in `order` stand in any order. A series' rows before its first microprice have that one.
    """
    names = tape.columns
    df = haloed(placed(tape, keys, order, rows), FRAME, rows=rows)
    with X.framed(in_block(keys)):
        if "roll_impact" in columns:
            df = X.with_roll_impact(df, FRAME)
        made = {"vpin": X.vpin(FRAME)} if "vpin" in columns else {}
        if "ofi" in columns:
            made["_step"] = X.ofi_step()
        if made:
            df = df.withColumns(made)
    own = df.where("_own").drop("_own")
    sums, lasts, firsts = {}, {}, {}
    if "cvd" in columns:
        own, sums["cvd"] = own.withColumn("_signed", X.signed_quantity()), "_signed"
    if "ofi" in columns:
        sums["ofi"] = "_step"
    if "microprice" in columns:
        own, lasts["microprice"], firsts["_next"] = own.withColumn("_raw", X.raw_microprice()), "_raw", "_raw"
    out = carried(own, keys, sums, lasts, firsts) if sums or lasts else own
    if "microprice" in columns:
        out = out.withColumn("microprice", F.coalesce("microprice", "_next"))
    return out.select(*names, *columns, *["_i"] * keep_place)


def filled_forward(df: DataFrame, column: str, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",), rows: int = BLOCK_ROWS) -> DataFrame:
    """df with `filled`, the last known value so far."""
    return plain(carried(placed(df, keys, order, rows), keys, lasts={"filled": column}))


def filled_backward(df: DataFrame, column: str, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",), rows: int = BLOCK_ROWS) -> DataFrame:
    """df with `filled`, the next known value from the row on: a running fill in the opposite order, without a frame to the series' end."""
    return plain(carried(placed(df, keys, order, rows), keys, firsts={"filled": column}))
