"""Tables of a page: columns by shared left edges, rows by cover, cells that span, heads and feet."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.boxes import CORNERS
from paperloom.operators.layout import _page_tables

#: How far left edges of one column drift, and the most columns of a table (fixed values).
SNAP, MOST = 4.0, 63


def _above(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a > b`` where what is no number is above all that are."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def _starts(group: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])


def _least_lefts(x0: np.ndarray, run: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least left edge of each (run, edge), in order, and the run of each."""
    order = np.lexsort((edge, run))
    x0, run, edge = x0[order], run[order], edge[order]
    at = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (edge[1:] != edge[:-1])])
    return np.minimum.reduceat(x0, at), run[at]


def _spanning(table: pa.Table, starts: np.ndarray, page: list[str], snap: float, most: int) -> pa.Table:
    """:func:`spanning_tables` of whole pages, each in order of x0."""
    n = table.num_rows
    x0, y0, x1, y1 = (table[c].to_numpy() for c in CORNERS)
    leaf = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
    with np.errstate(all="ignore"):
        fresh = ~(np.diff(x0, prepend=x0[:1]) <= snap)
        half = (y1 - y0) / 4
        high, low = y0 + half, y1 - half
    fresh[starts] = True
    edge = np.cumsum(fresh) - 1
    at = np.flatnonzero(np.bincount(edge, minlength=1)[edge] > 1)
    at = at[np.lexsort((low[at], x0[at], high[at], leaf[at]))]
    x0, x1, high, low, leaf, edge, m = x0[at], x1[at], high[at], low[at], leaf[at], edge[at], len(at)

    # A line begins where a block lies below all before it on the page: the running most of their places in order of ``low``.
    order = np.argsort(low, kind="stable")
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    begins = np.r_[True, leaf[1:] != leaf[:-1]][:m]
    if m > 1:
        lowest = low[order][np.maximum.accumulate(leaf * m + place)[:-1] % m]
        begins[1:] |= _above(high[1:], lowest)
    line, first_of = np.cumsum(begins) - 1, np.flatnonzero(begins)
    lines = len(first_of)
    until, on = np.r_[first_of, m], leaf[first_of]
    blocks = np.diff(until)
    edges = np.bincount(np.unique(line * (n + 1) + edge) // (n + 1), minlength=lines)

    # Runs of lines with two columns or more.
    wide = edges > 1
    goes_on = wide[1:] & wide[:-1] & (on[1:] == on[:-1])
    first, last = np.flatnonzero(wide & ~np.r_[False, goes_on][:lines]), np.flatnonzero(wide & ~np.r_[goes_on, False][:lines])
    run_of = np.cumsum(wide & ~np.r_[False, goes_on][:lines]) - 1
    inside = np.flatnonzero(wide[line])
    lefts, run = _least_lefts(x0[inside], run_of[line[inside]], edge[inside]) if len(inside) else (np.zeros(0), np.zeros(0, np.int64))
    columns = np.bincount(run, minlength=len(first))
    begin = np.cumsum(columns) - columns
    few = columns <= most
    first, last, columns, begin = first[few], last[few], columns[few], begin[few]

    def beside(at: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Whether the line ``at`` of each run is one block that spans two of its columns."""
        there = np.flatnonzero((at >= 0) & (at < lines))
        there = there[(on[at[there]] == on[by[there]]) & (blocks[at[there]] == 1)]
        box = first_of[at[there]]
        a, b, starts, covers = x0[box], x1[box], np.zeros(len(there), bool), np.zeros(len(there), bool)
        for k in range(int(columns[there].max(initial=0))):
            live = np.flatnonzero(columns[there] > k)
            e = lefts[begin[there[live]] + k]
            starts[live] |= np.abs(e - a[live]) <= snap
            covers[live] |= (e > a[live] + snap) & (e < b[live] - snap)
        out = np.zeros(len(at), bool)
        out[there] = starts & covers
        return out

    head, foot = beside(first - 1, first), beside(last + 1, last)
    height = last - first + 1 + head + foot
    whole = (height >= 2) & ((columns >= 3) | ((columns == 2) & (height >= 3)))
    top, bottom, columns, begin = (first - head)[whole], (last + foot)[whole], columns[whole], begin[whole]
    owner = on[first[whole]]
    number = np.arange(len(top)) - np.repeat(_starts(owner), np.diff(np.r_[_starts(owner), len(owner)]))

    # The cells of each table, those of a line that two tables share twice.
    count = until[bottom + 1] - until[top]
    tbl = np.repeat(np.arange(len(top)), count)
    cell = np.arange(int(count.sum())) + np.repeat(until[top] - (np.cumsum(count) - count), count)
    left, right, row = x0[cell] + snap, x1[cell] - snap, line[cell] - top[tbl]
    col, span = np.full(len(cell), -1), np.ones(len(cell), np.int64)
    live = np.arange(len(cell))
    for k in range(int(columns.max(initial=0))):
        live = live[columns[tbl[live]] > k]
        e = lefts[begin[tbl[live]] + k]
        col[live] += e <= left[live]
        span[live] += (e > left[live]) & (e < right[live])
    col = np.maximum(col, 0)
    span = np.minimum(span, columns[tbl] - col)

    order = np.lexsort((x0[cell], col, row, tbl))
    cell, tbl, row, col, span = cell[order], tbl[order], row[order], col[order], span[order]
    group = np.cumsum(np.r_[True, (tbl[1:] != tbl[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1])][: len(tbl)]) - 1
    begin = _starts(group)
    text = table["text"].combine_chunks()
    many = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1)
    if len(many):  # blocks of one cell that begin at one place are in order of their texts
        rank = pc.rank(text.take(pa.array(at[cell[many]])), tiebreaker="dense").to_numpy()
        cell[many] = cell[many][np.lexsort((rank, x0[cell[many]], group[many]))]
    listed = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(cell)], pa.int32()), text.take(pa.array(at[cell])))
    out = table.select(page).take(pa.array(at[cell[begin]]))
    for name, values in (("tbl", number[tbl[begin]]), ("row", row[begin]), ("col", col[begin]), ("span", np.maximum.reduceat(span, begin) if len(begin) else span)):
        out = out.append_column(name, pa.array(values, pa.int64()))
    return out.append_column("text", pc.binary_join(listed, " "))


def spanning_tables(blocks: DataFrame, page: list[str], snap: float = SNAP, most: int = MOST) -> DataFrame:
    """(page…, tbl, row, col, span, text) of blocks (page…, text, x0, y0, x1, y1).

    A column is a left edge that two blocks of the page share; blocks without one are no cells.  Rows
    are what the middle halves of blocks cover without a gap.  Rows with two columns or more that
    follow each other are a table, with the row before or behind them if that is one block from a
    column of theirs over the edge of another.  It has three columns, or two and three rows.  Blocks of
    one cell are joined by a space; a cell spans the columns whose edges it covers.  Blank blocks and
    blocks without four corners count for nothing.  Whole pages of a batch are told at once.
    """
    real = blocks.where("trim(text) <> '' and " + " and ".join(f"{c} is not null and not isnan({c})" for c in CORNERS)).select(*page, F.trim("text").alias("text"), *(F.col(c).cast("double").alias(c) for c in CORNERS))
    return _page_tables(real, page, ["x0"], lambda table, starts: _spanning(table, starts, page, snap, most), "tbl long, row long, col long, span long, text string")
