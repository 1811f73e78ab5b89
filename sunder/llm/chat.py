"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions.

Logs often store a conversation again after every turn. Each turn gets the rolling hash of all turns up to it: 128
bits, the exclusive-or of two salted hashes of place, role and text, so it depends on order and needs one running pass. A
conversation that is a proper prefix of another has its last rolling hash among the other's earlier ones, so an
anti-join of last hashes with the distinct earlier ones leaves the maximal conversations; of equal ones the smallest conv_id stays.
These are rendered.

The turns are shuffled once, by conversation; hashes are combined before they are shuffled, so a first turn that a third of all
conversations share is one row. Rendered text is put together within a conversation, which is one row of the result.

Defined cases: turns are ordered by turn, then role, then text, nulls first; a null role is "unknown" and a null text empty, for
hashes too; repeated rows are turns of their own; turns without a conv_id belong to one conversation; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunder.llm.common import written

BEGIN, END = "<|im_start|>", "<|im_end|>"


def rolling(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, n, role, text, h1, h2): the place of each turn from 1, the count of turns, and the hash of the turns up to it."""
    order = Window.partitionBy("conv_id").orderBy("_turn", "role", "text")
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"place": F.row_number().over(order), "_next": F.lead(F.lit(1)).over(order)})
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashes = {f"h{k}": F.bit_xor(F.xxhash64(F.lit(k), "place", "role", "text")).over(upto) for k in (1, 2)}
    return rows.withColumns(hashes).select("conv_id", "place", F.col("_next").isNull().alias("last"), "role", "text", "h1", "h2")


def maximal(turns: DataFrame, **columns) -> DataFrame:
    """(conv_id, turns, h1, h2) of the conversations that are no prefix of another, one of each."""
    hashes = written(rolling(turns, **columns).select("conv_id", "place", "last", "h1", "h2"), "turns")
    return _maximal(hashes)


def _maximal(hashes: DataFrame) -> DataFrame:
    whole = hashes.where("last").groupBy("h1", "h2", "place").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")).alias("first"), F.count("*").alias("copies"))
    earlier = hashes.where("not last").select("h1", "h2", "place").distinct()
    return whole.join(earlier, ["h1", "h2", "place"], "left_anti").select("first.conv_id", F.col("place").alias("turns"), "copies", "h1", "h2")


def rendered(turns: DataFrame, **columns) -> DataFrame:
    """(conv_id, turns, copies, text): the maximal conversations as chat markup, copies being how many conversations equal it."""
    rows = written(rolling(turns, **columns), "turns")
    kept = _maximal(rows.select("conv_id", "place", "last", "h1", "h2")).select(F.col("conv_id").alias("_id"), "turns", "copies")
    mine = rows.select("conv_id", "place", "role", "text").join(kept, F.col("conv_id").eqNullSafe(F.col("_id")))
    piece = F.concat(F.lit(BEGIN), "role", F.lit("\n"), "text", F.lit(END + "\n"))
    pieces = F.array_sort(F.collect_list(F.struct("place", piece.alias("piece"))))
    return mine.groupBy("conv_id", "turns", "copies").agg(F.array_join(F.transform(pieces, lambda p: p.piece), "").alias("text"))
