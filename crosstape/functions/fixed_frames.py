"""Frames of a fixed number of bars over whole symbols, for arrays of bars at once.

Spark's sliding frames add up every bar's frame anew, one value at a time, and the medians sort boxed lists: 72
microseconds a bar for the feature columns. These helpers take some symbols' bars as arrays and add in the frames' own
order, so their values are Spark's to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view

#: The longest frame, and so the blanks that keep the frames of neighbouring symbols apart.
LONGEST = 251

#: Bars whose frames are sorted at once: bounds the memory of a median.
BLOCK = 4096

#: Stands for the symbol of bars without one, which are a group of their own to Spark.
NO_NAME = "\0"

FRAMES = (
    "size_med double, size_n int, liq double, deliv_avg double, top126 double, avg200 double, vol_n long, vol_sd double, max_ret21 double"
)


class Layout:
    """Where the bars of several symbols stand when each symbol has LONGEST - 1 blanks before it."""

    def __init__(self, symbols: pa.ChunkedArray):
        codes = symbols.combine_chunks().fill_null(NO_NAME).dictionary_encode().indices.to_numpy()
        number = np.concatenate([[0], np.cumsum(np.diff(codes) != 0)])
        self.place = np.arange(len(codes)) + (LONGEST - 1) * (number + 1)
        self.size = int(self.place[-1]) + 1

    def spread(self, x: np.ndarray, blank) -> np.ndarray:
        out = np.full(self.size, blank, x.dtype)
        out[self.place] = x
        return out

    def steps(self, x: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """Of all frames of the last n places the oldest entries, then the next, up to the newest."""
        start = LONGEST - n
        for k in range(n):
            yield x[start + k : self.size - (n - 1) + k]

    def at(self, frames: np.ndarray) -> np.ndarray:
        """The bars' own rows of what was taken over all places from LONGEST - 1 on."""
        return frames[self.place - (LONGEST - 1)]

    def count(self, use: np.ndarray, n: int) -> np.ndarray:
        """How many of each bar's last n are used."""
        run = np.concatenate([[0], np.cumsum(self.spread(use, False))])
        return run[self.place + 1] - run[self.place + 1 - n]


def positive(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """What counts as positive to Spark, to which NaN is the largest value."""
    return known & ((x > 0) | np.isnan(x))


def median(lay: Layout, x: np.ndarray, use: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Median of the used values of the last n, and how many they are."""
    count = lay.count(use, n)
    out = np.empty(len(x))
    # Unused places are NaN and sort behind every number.
    frames = sliding_window_view(lay.spread(np.where(use, x, np.nan), np.nan), n)
    for at in range(0, len(x), BLOCK):
        rows = frames[lay.place[at : at + BLOCK] - (n - 1)]
        rows.sort(axis=1)
        k = count[at : at + BLOCK]
        i = np.arange(len(rows))
        upper, lower = rows[i, np.minimum(k // 2, n - 1)], rows[i, np.maximum(k // 2 - 1, 0)]
        out[at : at + BLOCK] = np.where(k % 2 == 1, upper, (lower + upper) / 2)
    return out, count


def mean(lay: Layout, x: np.ndarray, use: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the used values of the last n, added from the oldest on, and how many they are."""
    total = np.zeros(lay.size - (LONGEST - 1))
    for value in lay.steps(lay.spread(np.where(use, x, 0.0), 0.0), n):
        total += value
    count = lay.count(use, n)
    return lay.at(total) / np.maximum(count, 1), count


def highest(lay: Layout, x: np.ndarray, known: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    most = np.full(lay.size - (LONGEST - 1), -np.inf)
    for value in lay.steps(lay.spread(np.where(known, x, -np.inf), -np.inf), n):
        np.maximum(most, value, out=most)
    return lay.at(most), lay.count(known, n)


def deviation(lay: Layout, x: np.ndarray, known: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Population deviation of the known values of the last n by the running update, and their number."""
    count, avg, m2 = (np.zeros(lay.size - (LONGEST - 1)) for _ in range(3))
    for value, use in zip(lay.steps(lay.spread(np.where(known, x, 0.0), 0.0), n), lay.steps(lay.spread(known, False), n)):
        step = value - avg
        part = step / (count + 1.0)
        m2 = np.where(use, m2 + step * (step - part), m2)
        avg = np.where(use, avg + part, avg)
        count = count + use
    return lay.at(np.sqrt(m2 / np.maximum(count, 1))), lay.at(count).astype("int64")


def _column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = table.column(name)
    return column.fill_null(0.0).to_numpy(), column.is_valid().to_numpy()


def with_frames(table: pa.Table) -> pa.Table:
    """Bars of whole symbols, each in the order of its days, with the columns of FRAMES behind them."""
    lay = Layout(table.column("symbol"))
    turnover, traded = _column(table, "turnover")
    deliv, delivered = _column(table, "deliv_pct")
    ret1 = _column(table, "ret1")
    traded = positive(turnover, traded)
    with np.errstate(all="ignore"):
        size, size_n = median(lay, turnover, traded, 251)
        cells = [
            (size, size_n), (size_n.astype("int32"), None), median(lay, turnover, traded, 61), mean(lay, deliv, positive(deliv, delivered), 61),
            highest(lay, *_column(table, "high"), 126), mean(lay, *_column(table, "close"), 200),
        ]
        sd, n = deviation(lay, *ret1, 21)
        cells += [(n, None), (sd, n), highest(lay, *ret1, 21)]
    for field, (values, count) in zip(FRAMES.split(", "), cells):
        table = table.append_column(field.split()[0], pa.array(values, mask=None if count is None else count == 0))
    return table


def feature_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``with_frames``, for batches in the order of symbol and day: a symbol that may go on in the next one waits."""
    waiting = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        symbols = batch.column("symbol").fill_null(NO_NAME)
        first_of_last = pc.index(symbols, symbols[-1]).as_py()
        if waiting and (first_of_last > 0 or waiting[-1].column("symbol").fill_null(NO_NAME)[-1] != symbols[0]):
            if first_of_last > 0:
                waiting.append(batch.slice(0, first_of_last))
            yield from with_frames(pa.Table.from_batches(waiting)).combine_chunks().to_batches()
            waiting = []
        elif first_of_last > 0:
            yield from with_frames(pa.Table.from_batches([batch.slice(0, first_of_last)])).combine_chunks().to_batches()
        waiting.append(batch.slice(first_of_last))
    if waiting:
        yield from with_frames(pa.Table.from_batches(waiting)).combine_chunks().to_batches()
