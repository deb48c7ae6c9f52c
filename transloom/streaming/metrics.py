"""Live counters of runs and streams (A1, S8): nothing is read a second time to be counted."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql.streaming import StreamingQueryListener


class StreamCounts(StreamingQueryListener):
    """Adds up what streaming queries report, batch by batch: rows read, rows that came behind the watermark and were
    dropped, and observed metrics (``DataFrame.observe``). Spark keeps the last hundred reports only; this keeps sums.

        counts = StreamCounts()
        spark.streams.addListener(counts)
        ...
        counts.of(query)   # {"input_rows": ..., "late_rows": ..., "<observation>.<metric>": ...}
    """

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._sums: dict[str, Counter] = {}
        self._last: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._sums.setdefault(str(event.runId), Counter())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        run = str(p.runId)
        with self._lock:
            if p.batchId <= self._last.get(run, -1):  # an idle query reports its last batch again
                return
            self._last[run] = p.batchId
            sums = self._sums.setdefault(run, Counter())
            sums["batches"] += 1
            sums["input_rows"] += p.numInputRows
            sums["late_rows"] += sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
            for name, row in p.observedMetrics.items():
                for metric, value in row.asDict().items():
                    sums[f"{name}.{metric}"] += value or 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query) -> dict[str, int]:
        """Sums of one run of a query so far."""
        with self._lock:
            return dict(self._sums.get(str(query.runId), Counter()))
