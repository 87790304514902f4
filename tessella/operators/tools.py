"""What agents may ask of a store: each tool gives a JSON text and never raises."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.store import Snapshots, partial_update

NO_SLIDE, NO_SELECTION = "NO_SLIDE", "NO_SELECTION"


def _told(f: Callable[..., str]) -> Callable[..., str]:
    def tool(*args, **kwargs) -> str:
        try:
            return f(*args, **kwargs)
        except Exception as e:  # noqa: BLE001 an agent gets a text in any case
            return json.dumps({"error": f"{type(e).__name__}: {e}"})

    return tool


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()]


class Tools:
    """Tools over the tables ``slides``, ``rois`` and ``interactions`` of a store."""

    def __init__(self, store: Snapshots, slide_id: int | None, selection: Callable[[], str | None] = lambda: None, capabilities: dict | None = None):
        self.store, self.slide_id, self.selection, self.capabilities = store, slide_id, selection, capabilities or {}
        self.get_current_selection = _told(lambda: self.selection() or NO_SELECTION)
        self.annotate_roi, self.query_annotations = _told(self._annotate), _told(self._query)
        self.get_slide_info, self.get_analysis_capabilities = _told(self._info), _told(lambda: json.dumps(self.capabilities))

    def _annotate(self, roi_id: int, label: str | None = None, notes: str | None = None) -> str:
        """Sets what is given of a region's label and notes and returns its row."""
        try:
            own = int(roi_id)
        except (TypeError, ValueError):
            return json.dumps({"error": f"invalid roi_id: {roi_id!r}"})
        rois = self.store.read("rois")
        if rois.where(F.col("id") == own).isEmpty():
            return json.dumps({"error": f"roi {own} not found"})
        changes = rois.sparkSession.createDataFrame([(own, label, notes)], "id long, label string, notes string")
        changed = partial_update(rois, changes)
        others = {n: self.store.read(n) for n in ("slides", "interactions")}
        trace = changes.select(F.lit("label_set").alias("kind"), F.to_json(F.struct("id", "label", "notes")).alias("payload"), F.col("id").alias("roi_id"))
        others["interactions"] = others["interactions"].unionByName(trace, allowMissingColumns=True)
        self.store.commit({"rois": changed, **others})
        return json.dumps(_rows(self.store.read("rois").where(F.col("id") == own))[0])

    def _query(self, label: str | None = None, limit: object = 50) -> str:
        """The slide's regions, of one label if given; the limit is part of the plan, at least 1 and 50 where it is no number."""
        if self.slide_id is None:
            return "[]"
        try:
            most = max(1, int(limit))
        except (TypeError, ValueError):
            most = 50
        rois = self.store.read("rois").where(F.col("slide_id") == self.slide_id)
        return json.dumps(_rows((rois if label is None else rois.where(F.col("label") == label)).orderBy("id").limit(most)))

    def _info(self) -> str:
        if self.slide_id is None:
            return NO_SLIDE
        found = _rows(self.store.read("slides").where(F.col("id") == self.slide_id))
        if not found:
            return NO_SLIDE
        n = self.store.read("rois").where(F.col("slide_id") == self.slide_id).count()
        own = found[0]
        return json.dumps({"name": own.get("name"), "dimensions": [own.get("width"), own.get("height")], "mpp": own.get("mpp"), "db_id": self.slide_id, "annotation_count": n})
