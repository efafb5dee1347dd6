"""What a tailing query has done so far: progress, ready (caught up) or failed, as an observer sees it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls tell(state, query name, records so far) for each trigger: `ready` after one without new records, `failed` at an error."""

    def __init__(self, tell: Callable[[str, str, int], None]):
        self.tell, self.records, self.names = tell, {}, {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or str(event.id)
        self.tell("started", self.names[str(event.id)], 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        key = str(p.id)
        self.records[key] = self.records.get(key, 0) + p.numInputRows
        self.tell("progress" if p.numInputRows else "ready", p.name or key, self.records[key])

    def onQueryIdle(self, event) -> None:
        key = str(event.id)
        self.tell("ready", self.names.get(key, key), self.records.get(key, 0))

    def onQueryTerminated(self, event) -> None:
        key = str(event.id)
        self.tell("failed" if event.exception else "ended", self.names.get(key, key), self.records.get(key, 0))
