"""Recurrences walked bar by bar, each step rounded as the recursive SQL rounds it.

Scans by blocks are the same numbers but for their last bits, and these decide a bar that stands on a threshold: a close
that stays at its mean, or gains that equal losses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .fixed_frames import NO_NAME


def steps(firsts: list[bool], ix: list, values: list, seeds: list, seed_ix: int, alpha: float, y: float | None) -> list:
    """y = (1-alpha) y + alpha value from the seed on; NULL before it, and from an unknown value on."""
    keep, out = 1.0 - alpha, []
    for first, at, x, seed in zip(firsts, ix, values, seeds):
        if at == seed_ix:
            y = seed
        elif first or at < seed_ix or x is None or y is None:
            y = None
        else:
            y = y * keep + x * alpha
        out.append(y)
    return out


def walker(means: list[tuple[str, str, int, float, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For (value, seed, seed_ix, alpha, out) of each mean: batches in the order of symbol and day get the columns ``out``.

    What is carried from batch to batch is one number for each mean.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last = None, [None] * len(means)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            symbols = batch.column("symbol").fill_null(NO_NAME)
            codes = symbols.dictionary_encode().indices.to_numpy()
            firsts = np.concatenate([[symbols[0].as_py() != name], np.diff(codes) != 0]).tolist()
            ix, table = batch.column("ix").to_pylist(), pa.Table.from_batches([batch])
            for k, (value, seed, seed_ix, alpha, out) in enumerate(means):
                ys = steps(firsts, ix, batch.column(value).to_pylist(), batch.column(seed).to_pylist(), seed_ix, alpha, last[k])
                last[k] = ys[-1]
                table = table.append_column(out, pa.array(ys, "double"))
            name = symbols[-1].as_py()
            yield from table.to_batches()

    return walk
