"""Throughput of running streams."""

from __future__ import annotations

from collections import deque

from pyspark.sql.streaming import StreamingQueryListener


class Throughput(StreamingQueryListener):
    """Rows and rows a second over the last `window` batches of each stream, by its id."""

    def __init__(self, window: int = 16):
        self.window = window
        self.batches: dict[str, deque[tuple[int, float]]] = {}
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802  the interface's name
        self.batches.setdefault(str(event.id), deque(maxlen=self.window))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.add(str(p.id), p.numInputRows, p.batchDuration / 1000)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def add(self, stream: str, rows: int, seconds: float) -> None:
        self.batches.setdefault(stream, deque(maxlen=self.window)).append((rows, seconds))
        self.rows[stream] = self.rows.get(stream, 0) + rows

    def rate(self, stream: str) -> float:
        """Rows a second; 0 while no time has passed."""
        held = self.batches.get(stream, ())
        seconds = sum(s for _, s in held)
        return sum(n for n, _ in held) / seconds if seconds > 0 else 0.0
