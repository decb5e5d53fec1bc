"""Session memory as a stream: the newest distinct items of each session, kept as bounded keyed state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEEP = 64


def remember(items: list[str], news: Iterable[str], keep: int = KEEP) -> list[str]:
    """Distinct items, each at its first place, the last ``keep`` of them."""
    return list(dict.fromkeys([*items, *news]))[-keep:]


def session_memory(events: DataFrame, key: str, item: str, order: str, keep: int = KEEP) -> DataFrame:
    """(key, items) after every batch for each session that got rows; use output mode update.

    Within a batch rows go by ``order``. State is ``keep`` strings a session, whatever its length. Null items are
    left out; a null key is a session of its own."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (items,) = state.get if state.exists else ([],)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        items = remember(list(items), rows[item].dropna().astype(str), keep)
        state.update((items,))
        yield pd.DataFrame({key: [name[0]], "items": [items]})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, item, order).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, items array<string>", "items array<string>", "update", GroupStateTimeout.NoTimeout)
