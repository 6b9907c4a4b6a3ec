"""Ordered folds: rows of each key, in order, through a step that keeps a state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_fold(df: DataFrame, key: str, order: str, cols: list[str], begin, step: Callable, out: str, last: bool = False) -> DataFrame:
    """(key, order, *out) of every row, or with ``last`` (key, *out) of each key's last one.

    ``step(state, *values)`` gives the next state and the row's outputs. Rows stream through sorted partitions, so a
    key's state is all that is kept of it, however many rows it has. Of rows with equal key and order, those of less
    values in ``cols`` come first.
    """
    names = ["k", "o", *(f"v{i}" for i in range(len(cols)))]
    made = [c.split()[0] for c in out.split(", ")]
    keep = ["k", *([] if last else ["o"]), *made]
    kinds = [f"k {df.schema[key].dataType.simpleString()}", *([] if last else [f"o {df.schema[order].dataType.simpleString()}"]), out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, held = None, begin, None
        for pdf in batches:
            rows = []
            for k, o, *values in pdf.itertuples(index=False, name=None):
                if at is None or k != at[0]:
                    rows += [held] if last and held else []
                    at, state = (k,), begin
                state, got = step(state, *(None if v is None or v != v else v for v in values))
                held = (k, *got) if last else None
                rows += [] if last else [(k, o, *got)]
            yield pd.DataFrame(rows, columns=keep)
        if last and held:
            yield pd.DataFrame([held], columns=keep)

    d = df.select(*(F.col(c).alias(n) for c, n in zip([key, order, *cols], names, strict=True))).where("k is not null")
    done = d.repartition("k").sortWithinPartitions(*names).mapInPandas(run, ", ".join(kinds)).withColumnRenamed("k", key)
    return done if last else done.withColumnRenamed("o", order)


def appended(log: DataFrame, key: str, order: str, base: str) -> DataFrame:
    """(key, order, accepted, revision): an append goes in only if it was made on the newest revision, and makes the next."""
    return ordered_fold(log, key, order, [base], 0, lambda rev, on: (rev + (on == rev), (on == rev, rev + (on == rev))), "accepted boolean, revision long")


def batches(changes: DataFrame, key: str, order: str, size: str, most: int) -> DataFrame:
    """(key, order, batch): changes in order, as many in a batch as ``most`` bytes hold; a larger one is a batch alone."""

    def step(state, n):
        number, filled = state
        n = n or 0
        number, filled = (number + 1, n) if filled is None or filled + n > most else (number, filled + n)
        return (number, filled), (number,)

    return ordered_fold(changes, key, order, [size], (-1, None), step, "batch long")


def pulled(snapshot: DataFrame, floor: int, log: DataFrame, cursor: int, key: str, seq: str, cols: list[str]) -> DataFrame:
    """(key, seq, cols): what a reader at ``cursor`` gets: the newest entry of each key beyond it. A reader behind the
    floor, below which the log is cut, gets the snapshot (as of the floor) and the log on top."""
    later = log.where(F.col(seq) > (cursor if cursor >= floor else floor)).select(key, seq, *cols)
    both = later if cursor >= floor else snapshot.select(key, F.lit(floor).cast(log.schema[seq].dataType).alias(seq), *cols).unionByName(later)
    return both.groupBy(key).agg(F.max_by(F.struct(seq, *cols), seq).alias("x")).select(key, "x.*")
