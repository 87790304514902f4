"""The log of interactions as a stream: changes of viewports, windows, sessions and what late events still count."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.sources.annotations import PAYLOAD


def by_window(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n) by tumbling windows of created_at; events later than the watermark are left out."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", length).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def by_session(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(session_id, start, end, n) by sessions that a gap ends."""
    grouped = events.withWatermark("created_at", late).groupBy(F.session_window("created_at", gap).alias("w"), "session_id")
    return grouped.agg(F.count("*").alias("n")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


_STATE = "cx double, cy double, ds double, width int, height int"
_MOVES = "session_id long, id long, cx double, cy double, ds double, width int, height int"


def _moves(center_px: float, zoom: float) -> Callable:
    def rows(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        for pdf in batches:
            kept = []
            for row in pdf.sort_values(["created_at", "id"]).itertuples(index=False):
                new = (row.cx, row.cy, row.ds if row.ds > 0 else 1.0, row.width, row.height)
                if held is not None:
                    old_ds = held[2] if held[2] != 0 else 1.0
                    far = ((new[0] - held[0]) ** 2 + (new[1] - held[1]) ** 2) ** 0.5 / new[2] >= center_px
                    if not (far or abs(new[2] / old_ds - 1.0) >= zoom or new[3:] != tuple(held[3:])):
                        continue
                held = new
                kept.append((key[0], row.id, row.cx, row.cy, row.ds, row.width, row.height))
            yield pd.DataFrame(kept, columns=["session_id", "id", "cx", "cy", "ds", "width", "height"])
        if held is not None:
            state.update(tuple(held))

    return rows


def viewport_moves(reports: DataFrame, center_px: float = 0.5, zoom: float = 0.01) -> DataFrame:
    """Reports (session_id, id, created_at, cx, cy, ds, width, height) that differ from the last one let through in their session; state is one viewport a session."""
    return reports.groupBy("session_id").applyInPandasWithState(_moves(center_px, zoom), _MOVES, _STATE, "append", GroupStateTimeout.NoTimeout)


def payloads(lines: DataFrame) -> DataFrame:
    """Payloads of a stream of history lines; blank and torn lines are left out."""
    told = lines.select(F.from_json("value", PAYLOAD).alias("payload"), "value").where(F.try_parse_json("value").isNotNull() & F.col("payload.slide_name").isNotNull())
    return told.select("payload.*")


def fresh(results: DataFrame, current: DataFrame) -> DataFrame:
    """Results (slide_id, version, ...) that are of the slide's current version; those of an older one are stale and left out."""
    return results.join(current.select("slide_id", F.col("version").alias("_now")), "slide_id").where("version = _now").drop("_now")


class Progress:
    """Counts rows of finished batches and tells a listener (done, total); what the listener raises doesn't stop the stream."""

    def __init__(self, total: int, told: Callable[[int, int], None]):
        self.total, self.told, self.done = total, told, 0

    def batch(self, df: DataFrame, _: int) -> None:
        self.done += df.count()
        try:
            self.told(min(self.done, self.total), self.total)
        except Exception:  # noqa: BLE001 a listener is not the stream's business
            pass
