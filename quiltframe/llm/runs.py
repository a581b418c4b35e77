"""Sorted rows of a task, taken key by key."""

from collections.abc import Iterator

import numpy as np
import pandas as pd


def by_key(batches: Iterator[pd.DataFrame], whole: int) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Batches of rows sorted by `key`, cut between keys; a key of over `whole` rows comes in parts, marked True."""
    held: pd.DataFrame | None = None
    long_key = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        last = rows["key"].iloc[-1]
        cut = int(np.searchsorted(rows["key"].to_numpy(), last))
        head, held = rows.iloc[:cut], rows.iloc[cut:]
        if long_key is not None and len(head):
            mine = head["key"].to_numpy() == long_key
            if mine.any():
                yield head[mine], True
                head = head[~mine]
        if len(head):
            yield head, False
        if long_key is not None and last != long_key:
            long_key = None
        if len(held) > whole or long_key == last:
            long_key = last
            yield held, True
            held = held.iloc[:0]
    if held is not None and len(held):
        yield held, long_key is not None and held["key"].iloc[0] == long_key


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.diff(np.r_[starts, len(keys)])
