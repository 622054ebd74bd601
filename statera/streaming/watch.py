"""Drift reports of a stream of passes: the same as :func:`statera.operators.drift.reports` gives for a batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import trust

REPORT = "source string, dedup_key string, opened long, kind string, score int, freeze boolean, detections long, last_pass long, resolved long"
COLUMNS = [c.split(" ")[0] for c in REPORT.split(", ")]


def kind_of(status, markers, entries, layout, base) -> str:
    """Kind of drift of one page against (layout, entries) of the baseline, or None before the first."""
    if pd.isna(status):
        return "probe_error"
    if status == 304:
        return "none"
    if not 200 <= status <= 299:
        return "status_error"
    if not markers:
        return "regime_change"
    if base is None:
        return "none"
    if entries == 0 < base[1]:
        return "count_zero"
    if layout != base[0]:
        return "layout_shift"
    return "count_delta" if entries < base[1] else "none"


class Watch(StatefulProcessor):
    """Per source: the baseline, and the open reports by their key.  Passes are taken in their order within a micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.base = handle.getValueState("base", "layout string, entries long")
        self.open = handle.getMapState("open", "dedup_key string", "opened long, kind string, score int, freeze boolean, detections long, last_pass long")

    def handleInputRows(self, key, rows, timerValues):
        (source,) = key
        base = self.base.get() if self.base.exists() else None
        held = {k[0]: list(v) for k, v in self.open.iterator()} if self.open.exists() else {}
        told = {}
        passes = pd.concat(list(rows)).sort_values("number")
        for p in passes.itertuples(index=False):
            number = int(p.number)
            kind = kind_of(p.status, p.markers, p.entries, p.layout, base)
            if kind == "none":
                if not pd.isna(p.status) and 200 <= p.status <= 299:
                    base = (p.layout, int(p.entries))
                for k in [k for k, r in held.items() if r[3]]:
                    r = held.pop(k)
                    told[k, r[0]] = [*r[:5], number, number]
                continue
            mark = {"status_error": lambda p: str(int(p.status)), "layout_shift": lambda p: str(p.layout), "probe_error": lambda p: "transport", "regime_change": lambda p: "markers", "count_zero": lambda p: "zero", "count_delta": lambda p: "shrink"}[kind](p)
            k = f"{source}:{kind}:{mark}"
            r = held.setdefault(k, [number, kind, trust.DRIFT_SCORES[kind], kind in trust.FREEZING, 0, number])
            r[4:6] = r[4] + 1, number
            told[k, r[0]] = [*r, None]
        if base is not None:
            self.base.update(tuple(base))
        for (k,) in [k for k in self.open.keys()] if self.open.exists() else []:
            if k not in held:
                self.open.removeKey((k,))
        for k, r in held.items():
            self.open.updateValue((k,), tuple(r))
        out = [(source, k, *r) for (k, _), r in told.items()]
        yield pd.DataFrame(out, columns=COLUMNS).astype({"opened": "Int64", "score": "Int32", "detections": "Int64", "last_pass": "Int64", "resolved": "Int64"})

    def close(self) -> None:
        pass


def drift_reports(passes: DataFrame) -> DataFrame:
    """Reports as they are opened, seen again and resolved: a row replaces the earlier one of its (source, dedup_key, opened).

    Needs the RocksDB state store.
    """
    rows = passes.withColumnRenamed("pass", "number")  # "pass" is no name that Python's rows can have
    return rows.groupBy("source").transformWithStateInPandas(statefulProcessor=Watch(), outputStructType=REPORT, outputMode="Update", timeMode="None")
