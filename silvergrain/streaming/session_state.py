"""Keyed state of streaming bursts: the sessions of one key and day."""
from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

BEST = ("hero_score", "final_dt", "sha1")
#: State is kept in RocksDB with changelogs below the query's checkpoint folder.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rank(best: tuple) -> tuple:
    """Order of best photos; a missing value comes before all others."""
    return tuple((v is not None, v) for v in best)


def merged(sessions: list[tuple], gap: int) -> list[tuple]:
    """Sessions (size, first, last, *best) that lie at most ``gap`` seconds apart become one."""
    out: list[tuple] = []
    for size, first, last, *best in sorted(sessions, key=lambda s: (s[1], s[2])):
        if out and first - out[-1][2] <= gap:
            size0, first0, last0, *best0 = out[-1]
            out[-1] = (size0 + size, first0, max(last0, last), *max(best0, best, key=rank))
        else:
            out.append((size, first, last, *best))
    return out


class Sessions(StatefulProcessor):
    """Merges the photos of a batch into the sessions of their key, and returns all of these."""

    def __init__(self, keys: list[str], gap: int, stored: StructType):
        self.keys, self.gap, self.stored = keys, gap, stored

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getListState("sessions", self.stored)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = [tuple(s) for s in self.sessions.get()]
        for part in rows:  # photos of one second first: a hot second is one session
            seconds: dict[int, list] = {}  # most groups hold a few photos, for which frames cost more than the work
            for ts, *best in zip(*(part[c].tolist() for c in ("ts", *BEST))):
                best = tuple(None if v is None or v != v else v for v in best)
                known = seconds.get(ts)
                if known is None:
                    seconds[ts] = [1, best]
                else:
                    known[0] += 1
                    known[1] = max(known[1], best, key=rank)
            found += [(size, int(ts), int(ts), *best) for ts, (size, best) in seconds.items()]
        found = merged(found, self.gap)
        self.sessions.put(found)
        columns = {f.name: [s[i] for s in found] for i, f in enumerate(self.stored.fields)}
        yield pd.DataFrame({**{k: [v] * len(found) for k, v in zip(self.keys, key)}, **columns})

    def close(self) -> None:
        pass
