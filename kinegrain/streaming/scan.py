"""A scan in the background: started, watched and stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


class Scan:
    """A streaming query over the blocks of clips, and how far it has come.

    ``total`` is the number of rows that are to come, if it is known.
    """

    def __init__(self, rows: DataFrame, name: str, checkpoint: str, total: int | None = None, sink: str = "memory", **options: str) -> None:
        writer = rows.writeStream.format(sink).queryName(name).outputMode("append").option("checkpointLocation", checkpoint)
        for key, value in options.items():
            writer = writer.option(key, value)
        self.total = total
        self.query: StreamingQuery = writer.trigger(availableNow=True).start()

    @property
    def done(self) -> int:
        """Rows that finished micro-batches have read."""
        return sum(p.numInputRows for p in self.query.recentProgress)

    @property
    def percent(self) -> float | None:
        """Share of the rows read, null while their number is unknown; 100 when all are."""
        if self.total is None:
            return None
        return 100.0 if not self.total else min(100.0, 100.0 * self.done / self.total)

    def wait(self, seconds: float | None = None) -> bool:
        """Whether the scan has ended by itself within the time; a failure is raised here."""
        return bool(self.query.awaitTermination(seconds)) if seconds is not None else (self.query.awaitTermination() or True)

    def cancel(self) -> None:
        """Stop after what is being read; state and offsets stay, so a new scan with the same checkpoint goes on."""
        if self.query.isActive:
            self.query.stop()
