"""Look-backs over the days of many series in one pass over rows that stand in order.

Runs inside a task on Arrow batches: only the last days of a batch are kept for the next one, so memory does not grow with
the number or the length of the series, and nothing is sorted or buffered by a window for each output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Days that are filled up at once.
STEP = 16_384

#: What a row of a run says of the days after it; the days themselves don't have it.
RUN = ("empty", "wanted")

#: Share of rows with sales in a window beyond which all rows are worked out at once.
DENSE = 0.6

Moments = tuple[np.ndarray, np.ndarray]


def moments(past: Callable[[int], np.ndarray], known: Callable[[int], np.ndarray] | None, k: int) -> Moments:
    """Mean and population deviation of the k values before each row, 0 where none is known.

    Values are added oldest first, as Spark's aggregates add the rows of a frame: results are the same to the last bit.
    """
    total, mean, squares, n = 0.0, 0.0, 0.0, 0.0
    for j in range(k, 0, -1):
        x = past(j)
        there = True if known is None else known(j)
        n = n + 1.0 if known is None else n + there
        gap = x - mean if known is None else np.where(there, x - mean, 0.0)
        part = gap / np.maximum(n, 1.0)
        total, mean = total + (x if known is None else np.where(there, x, 0.0)), mean + part
        squares = squares + gap * (gap - part)
    n = np.maximum(n, 1.0)
    return total / n, np.sqrt(squares / n)


def looked_back(
    values: np.ndarray, there: np.ndarray, before: np.ndarray, memory: int, lags: tuple[int, ...], rolls: tuple[int, ...],
    wanted: np.ndarray | None = None,
) -> list[np.ndarray]:
    """Lags, then mean and deviation of each rolling window, for all rows but the first ``memory`` of ``values``, or for those ``wanted``.

    ``there`` tells values from gaps; ``before`` is how many rows of its own series a row has in front of it.
    """
    n = len(before)

    def careful(at: np.ndarray) -> list[np.ndarray]:
        def past(j: int) -> np.ndarray:
            return values[memory - j + at]

        def known(j: int) -> np.ndarray:
            return (before[at] >= j) & there[memory - j + at]

        found = [np.where(known(k), past(k), 0.0) for k in lags]
        for k in rolls:
            found += moments(past, known, k)
        return found

    if wanted is not None or not there.all():
        return careful(np.arange(n) if wanted is None else wanted)
    sold = np.concatenate([[0], np.cumsum(values != 0)])
    made = [values[memory - k : memory - k + n].copy() for k in lags]
    for k in rolls:
        made += _around_sales(values, sold, memory, n, k)
    early = np.flatnonzero(before < memory)
    if len(early):
        for whole, few in zip(made, careful(early)):
            whole[early] = few
    return made


def _around_sales(values: np.ndarray, sold: np.ndarray, memory: int, n: int, k: int) -> Moments:
    """Moments of the ``k`` known values before each row; only rows with one other than 0 among them are worked out.

    ``sold`` counts the values other than 0 in front of each place.
    """
    rows = np.flatnonzero(sold[memory : memory + n] != sold[memory - k : memory - k + n])
    if len(rows) > n * DENSE:
        return moments(lambda j: values[memory - j : memory - j + n], None, k)
    found = np.zeros(n), np.zeros(n)
    for whole, few in zip(found, moments(lambda j: values[memory - j + rows], None, k)):
        whole[rows] = few
    return found


def _differs(names: pa.Array) -> np.ndarray:
    """Whether a name is another than the one in front of it, for all but the first."""
    a, b = names.slice(1), names.slice(0, len(names) - 1)
    unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return unlike | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))


def filled(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray | None]]:
    """The days that runs stand for: each row, then ``empty`` days without sales after it, at most ``STEP`` rows at once.

    With a column ``wanted``, the places of the days wanted among them; it has, in order, how far they lie behind the row.
    """
    length = batch.column("empty").to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends, places = np.cumsum(length), None
    if "wanted" in batch.schema.names:
        offsets = batch.column("wanted")
        places = (ends - length)[pc.list_parent_indices(offsets).to_numpy()] + pc.list_flatten(offsets).to_numpy()
    kept = batch.drop_columns([c for c in RUN if c in batch.schema.names])
    there = batch.column("quantity").is_valid().to_numpy(zero_copy_only=False)
    for a in range(0, int(ends[-1]), STEP):
        b = min(a + STEP, int(ends[-1]))
        low, high = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b - 1, "right") + 1
        runs = np.arange(low, high)
        run = np.repeat(runs, np.minimum(ends[runs], b) - np.maximum(ends[runs] - length[runs], a))
        after = np.arange(a, b) - (ends[run] - length[run])
        made = dict(zip(kept.schema.names, kept.take(pa.array(run)).columns))
        day = made["day"].to_numpy(zero_copy_only=False) + after
        date = pc.cast(made["date"], pa.int32()).to_numpy(zero_copy_only=False) + after
        quantity = made["quantity"].to_numpy(zero_copy_only=False)
        made["day"], made["date"] = pa.array(day.astype(np.int32)), pc.cast(pa.array(date.astype(np.int32)), pa.date32())
        made["quantity"] = pa.array(np.where(after == 0, quantity, 0.0), mask=(after == 0) & ~there[run])
        wanted = None if places is None else places[slice(*np.searchsorted(places, [a, b]))] - a
        yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made)), wanted


def look_back(
    memory: int, lags: tuple[int, ...], rolls: tuple[int, ...], names: list[str], runs: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the columns ``names`` to batches of (series_id, date, quantity, day, ...) with the days of a series one after the other.

    ``runs`` are filled up first; ``day`` has to count every series from 0 without a gap then, rows in another order are refused.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, seen = None, 0, (np.zeros(memory), np.ones(memory, bool))
        for batch, wanted in (x for whole in batches if whole.num_rows for x in (filled(whole) if runs else [(whole, None)])):
            n = batch.num_rows
            series, quantity = batch.column("series_id"), pc.cast(batch.column("quantity"), pa.float64())
            new = np.concatenate([[last is None or not series[0].equals(last)], _differs(series)])
            at = np.arange(n)
            before = at - np.maximum.accumulate(np.where(new, at, -held))
            if runs and not (batch.column("day").to_numpy(zero_copy_only=False) == before).all():
                raise ValueError("The days of a series have to stand in order, from its first day on.")
            values = np.concatenate([seen[0], quantity.to_numpy(zero_copy_only=False)])
            there = np.concatenate([seen[1], quantity.is_valid().to_numpy(zero_copy_only=False)])
            made = looked_back(values, there, before, memory, lags, rolls, wanted)
            last, held, seen = series[n - 1], int(before[-1]) + 1, (values[-memory:], there[-memory:])
            out = batch if wanted is None else batch.take(pa.array(wanted))
            yield pa.RecordBatch.from_arrays(
                [*out.columns, *(pa.array(x) for x in made)], names=[*out.schema.names, *names])

    return run
