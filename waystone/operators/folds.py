"""Folds over sorted rows of a key, for operators whose state runs from row to row (Z3)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Fold:
    """Per-key state: feed() takes the key's next rows and returns rows that are settled, end() the rest.

    For streams, settle and finish take sorted rows of many keys at once, first marking where a key begins. settle gives
    the rows that feed would give, and those few that bring a new fold to the same state when they are fed to it (what it
    gives of them then was given out before); finish what end would give of the latter. reach is the time in ms after the
    last of them beyond which none can matter.
    """

    reach = 0

    def feed(self, rows: pd.DataFrame) -> list[pd.DataFrame]:
        raise NotImplementedError

    def end(self) -> list[pd.DataFrame]:
        return []

    @classmethod
    def settle(cls, rows: pd.DataFrame, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    @classmethod
    def finish(cls, rows: pd.DataFrame, first: np.ndarray) -> np.ndarray:
        raise NotImplementedError


def fold_sorted(df: DataFrame, key: str, order: list[str], make: Callable[[], Fold], schema: str, part: str | None = None) -> DataFrame:
    """Runs a Fold over each key's rows in order, batch by batch: one shuffle and a spillable sort, and no task ever
    holds a key's rows, however many there are. With part, a column that isn't passed on, each part of a key is folded
    on its own, and so a hot key by many tasks: for folds that forget everything where a part begins."""
    columns = [c for c in df.columns if c != part]
    groups = [key, *([part] if part else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, current = None, None
        for b in batches:
            change = (b[groups] != b[groups].shift()).any(axis=1).cumsum()
            for _, rows in b.groupby(change, sort=False):
                k = tuple(rows[groups].iloc[0])
                if fold is None or k != current:
                    if fold is not None:
                        yield from fold.end()
                    fold, current = make(), k
                yield from fold.feed(rows[columns])
        if fold is not None:
            yield from fold.end()

    return df.where(f"{key} IS NOT NULL").repartition(*groups).sortWithinPartitions(*groups, *order).mapInPandas(run, schema)
