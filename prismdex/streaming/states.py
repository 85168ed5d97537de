"""The states of files as a stream: each path keeps its row of the catalogue, events change it, timers try failures of the embedder again and give lost work back.

Events (path, at, kind, ...): ``listed`` with the facts of a listing, ``gone`` where a whole listing lacks a file, ``started`` by who takes it up, and ``outcome`` of
its analysis.  What the endings and kinds of errors mean is worked out by the expressions of ``operators.ingest`` before the state; the state only moves.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from prismdex.functions.media import media_type
from prismdex.operators import ingest
from prismdex.sources.decoders import PAUSE, TRIES

#: redo: null, "failed" (failures are tried again) or "all"; size and mtime_ns of an outcome: those of the content it is about; error_kind null: done.
EVENTS = "path string, at long, kind string, folder string, name string, ext string, size long, mtime_ns long, redo string, asset_id string, error_kind string, error string"
FILE = "folder string, name string, ext string, size long, mtime_ns long, asset_id string, state string, error string, attempts int, present boolean"
STATE = f"{FILE}, tries int, due long"
CHANGES = f"path string, {FILE}, change string"
COLUMNS = [c.split()[0] for c in FILE.split(", ")]
KINDS = ("gone", "listed", "started", "outcome")
#: Seconds after which work that has been taken up and not ended is pending again.
LEASE = 3600.0
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PathStates(StatefulProcessor):
    """One path: its row, how often it was tried, and the time (ms) of its timer, if any."""

    def __init__(self, pause: float, lease: float) -> None:
        self.pause, self.lease = pause, lease

    def init(self, handle) -> None:
        self.handle, self.row = handle, handle.getValueState("row", STATE)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A row of the catalogue; work that was under way is pending again."""
        row = {c: initialState[c] for c in COLUMNS}
        self._keep(row | {"state": "pending" if row["state"] == "processing" else row["state"], "tries": 0, "due": None})

    def _had(self) -> dict | None:
        return dict(zip([*COLUMNS, "tries", "due"], self.row.get(), strict=True)) if self.row.exists() else None

    def _keep(self, row: dict) -> None:
        self.row.update(tuple(row[c] for c in [*COLUMNS, "tries", "due"]))

    def _timed(self, row: dict, due: int | None) -> dict:
        """The row with another timer, or none."""
        if row["due"] is not None:
            self.handle.deleteTimer(row["due"])
        if due is not None:
            self.handle.registerTimer(due)
        return row | {"due": due}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """Applies the events of a path in the order of ``at``, those of a batch at once in memory; equal times by ``KINDS``."""
        row, now = self._had(), timerValues.getCurrentProcessingTimeInMs()
        for e in sorted(rows, key=lambda e: (e["at"], KINDS.index(e["kind"]))):
            moved = getattr(self, f"_{e['kind']}")(row, e, now)
            if moved:
                row, change = moved
                yield Row(path=key[0], **{c: row[c] for c in COLUMNS}, change=change)
        if row:
            self._keep(row)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        row = self._had()
        if row is None or row["due"] != expiredTimerInfo.getExpiryTimeInMs():
            return
        change = "recovered" if row["state"] == "processing" else "retry"
        row |= {"state": "pending", "due": None}
        self._keep(row)
        yield Row(path=key[0], **{c: row[c] for c in COLUMNS}, change=change)

    def _listed(self, row, e, now):
        facts = {c: e[c] for c in ("folder", "name", "ext", "size", "mtime_ns")}
        fresh = facts | {"state": "pending", "error": None, "attempts": 0, "present": True, "tries": 0}
        refused = {"state": "unsupported", "error": e["reason"], "present": True}
        if row is None:
            new = fresh | {"asset_id": None, "due": None}
            return (new, "new") if e["supported"] else (new | refused, "new_unsupported")
        same = (row["size"], row["mtime_ns"]) == (e["size"], e["mtime_ns"])
        undone = row["state"] in ("pending", "processing", "unsupported") or (row["state"] == "failed" and e["redo"] == "failed")
        if not e["supported"]:
            return self._timed(row, None) | facts | refused, "unsupported"
        if same and row["state"] in ("pending", "processing") and row["present"] and e["redo"] != "all":
            clear = row | {"error": None, "attempts": 0}  # it is on its way already, under its timer
            return None if clear == row else (clear, "redone")
        if not same or undone or e["redo"] == "all":
            return self._timed(row, None) | fresh, "redone" if same else "changed"
        return None if row["present"] else (row | {"present": True}, "unchanged")

    def _gone(self, row, e, now):
        return (self._timed(row, None) | {"present": False}, "unseen") if row and row["present"] else None

    def _started(self, row, e, now):
        if row is None or row["state"] != "pending":
            return None
        return self._timed(row, now + int(self.lease * 1000)) | {"state": "processing"}, "started"

    def _outcome(self, row, e, now):
        """Of content that has changed meanwhile it says nothing; of the embedder's failures only the last one counts."""
        if row is None or (row["size"], row["mtime_ns"]) != (e["size"], e["mtime_ns"]) or row["state"] not in ("pending", "processing"):
            return None
        tries = row["tries"] + 1
        if e["error_kind"] == "embedder" and tries < TRIES:
            return self._timed(row, now + int(self.pause * tries * 1000)) | {"state": "pending", "tries": tries}, "postponed"
        told = {"state": e["to_state"], "error": e["to_error"], "attempts": row["attempts"] + 1, "asset_id": e["asset_id"] or row["asset_id"], "tries": 0}
        return self._timed(row, None) | told, "outcome"


def path_changes(events: DataFrame, files: DataFrame | None = None, pause: float = PAUSE, lease: float = LEASE) -> DataFrame:
    """A stream of changed rows of the catalogue, with ``change``, from one of events; ``files``: the catalogue that it starts from.

    The last row of a path is its state.  change: those of ``ingest.classified``, and started, outcome, postponed, retry (a postponed one is to be taken up) and
    recovered.  The state of a path is about as large as its row, so it grows with the files; it is kept by RocksDB, which the session is set to.
    Events without a path or time, or of no known kind, are left out.  Such a stream has no end: with timers there is always another batch, so it wants a trigger by processing time.
    """
    events.sparkSession.conf.set(STORE, ROCKS)
    told = F.when(F.col("error_kind").isNotNull(), ingest.error_state(F.col("error_kind"), F.col("error")))
    known = events.where(F.col("path").isNotNull() & F.col("kind").isin(*KINDS) & F.col("at").isNotNull())
    rows = known.select("*", media_type(F.col("ext")).isNotNull().alias("supported"), ingest.unsupported_reason(F.col("ext")).alias("reason"), F.coalesce(told["state"], F.lit("done")).alias("to_state"), told["error"].alias("to_error"))
    start = files.select("path", *COLUMNS).groupBy("path") if files is not None else None
    return rows.groupBy("path").transformWithState(PathStates(pause, lease), CHANGES, "update", "processingTime", start)
