"""Per-group NumPy work without a DataFrame for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Columns = dict[str, np.ndarray]


def per_group(df: DataFrame, keys: list[str], order: list[str], run: Callable[[Columns], Columns], schema: str) -> DataFrame:
    """run on the columns of each group, its rows in the given order; what it returns are the group's result columns.

    Rows are dealt by the keys and sorted, so groups come one after the other; a task holds one Arrow batch and the group that is
    open. Rows with a null key are a group. Compared with applyInPandas this spares a pandas frame a group, which is most of the cost of small groups.
    """
    names = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the group that is open

        def begins(batch: pa.RecordBatch) -> np.ndarray:
            """Where a group begins. Null keys are alike."""
            n = batch.num_rows
            change = np.zeros(n, bool)
            for k in keys:
                new = pa.concat_arrays([held[-1].column(k).slice(held[-1].num_rows - 1), batch.column(k)]) if held else pa.concat_arrays([batch.column(k).slice(0, 1), batch.column(k)])
                codes = new.dictionary_encode(null_encoding="encode").indices.to_numpy()
                change |= codes[1:] != codes[:-1]
            return np.flatnonzero(change)

        def columns(batches: list[pa.RecordBatch]) -> Columns:
            table = pa.Table.from_batches(batches)
            return {c: table.column(c).to_numpy() for c in names}

        def arrow(found: list[Columns]) -> Iterator[pa.RecordBatch]:
            found = [f for f in found if f and len(next(iter(f.values())))]
            if found:
                yield pa.RecordBatch.from_pydict({c: np.concatenate([f[c] for f in found]) for c in found[0]})

        for batch in batches:
            if not batch.num_rows:
                continue
            starts = begins(batch).tolist()
            if not starts:
                held.append(batch)
                continue
            done = []
            if held or starts[0]:
                done.append(run(columns([*held, batch.slice(0, starts[0])])))
            whole = columns([batch.slice(starts[0], starts[-1] - starts[0])])
            for a, b in zip(starts, starts[1:], strict=False):
                done.append(run({c: v[a - starts[0] : b - starts[0]] for c, v in whole.items()}))
            held = [batch.slice(starts[-1])]
            yield from arrow(done)
        if held:
            yield from arrow([run(columns(held))])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, schema)
