"""A stream of edits to findings, folded into one record for each finding: state by finding, the last edit of each field wins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.store import Store

#: What an edit may change, beside finding_id, at and edit_id; null leaves a field as it is, `cleared` names fields that become null.
FIELDS = {"status": "string", "klass": "int", "delta_t": "double", "module_fixed": "int", "anomaly": "string", "note": "string"}
EDIT = f"finding_id string, at timestamp_ntz, edit_id string, {', '.join(f'{k} {t}' for k, t in FIELDS.items())}, cleared array<string>"
RECORD = f"finding_id string, edited_at timestamp_ntz, {', '.join(f'{k} {t}' for k, t in FIELDS.items())}"
_PYTHON = {"string": str, "int": int, "double": float}


class LastEdit(StatefulProcessor):
    """For each finding and field the last edit by (at, edit_id). An edit that is not later changes nothing, so repeats and late ones pass by."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getMapState("fields", "name string", "at long, edit_id string, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple] = {k[0]: tuple(v) for k, v in self.fields.iterator()}
        changed: dict[str, tuple] = {}
        for pdf in rows:
            for edit in pdf.to_dict("records"):
                if pd.isna(edit["at"]):
                    continue
                order = (pd.Timestamp(edit["at"]).value // 1000, edit["edit_id"] or "")
                cleared = edit["cleared"] if edit["cleared"] is not None else ()
                for name, kind in FIELDS.items():
                    value = None if name in cleared else edit[name]
                    if name not in cleared and (value is None or value != value):
                        continue
                    if name not in held or order > held[name][:2]:
                        held[name] = changed[name] = (*order, None if value is None else str(_PYTHON[kind](value)))
        for name, state in changed.items():
            self.fields.updateValue((name,), state)
        if changed:
            record = {"finding_id": key[0], "edited_at": pd.Timestamp(max(v[0] for v in held.values()) * 1000)}
            for name, kind in FIELDS.items():
                value = held[name][2] if name in held else None
                record[name] = None if value is None else _PYTHON[kind](value)
            out = pd.DataFrame([record], columns=["finding_id", "edited_at", *FIELDS])
            yield out.astype({k: {"int": "Int32", "double": "Float64", "string": "object"}[t] for k, t in FIELDS.items()} | {"edited_at": "datetime64[us]"})

    def close(self) -> None:
        pass


def folded_edits(edits: DataFrame) -> DataFrame:
    """The stream of RECORD rows from a stream of EDIT rows: a finding's whole record whenever it changes. Needs the RocksDB state store."""
    return edits.where("finding_id IS NOT NULL").groupBy("finding_id").transformWithStateInPandas(LastEdit(), RECORD, "Update", "None")


def review_stream(edits: DataFrame, store: Store, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keeps `store` (of RECORD by finding_id) up to date with a stream of edits. A batch that runs again saves the same records again."""
    edits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def put(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            store.save(batch, order="edited_at")

    writer = folded_edits(edits).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
