"""Tracks of labels in event time: begun, supported, and ended by a gap or by want of room.

A label's track goes on while its observations are no more than ``gap`` apart. If more
than ``capacity`` tracks of a key are live, the one that began first is ended, by its
number if several began at once. An observation gives a support row at once when its
turn comes; the end of a track gives a row with the reason.

Rows wait in state until the watermark has passed the end of their slot of event time; then
a timer takes the slots that are due one after the other, each in order of (t, label). So
tracks depend neither on how rows fell into batches nor on restarts. A key has one value
(waiting rows up to ``HELD``, live tracks, a counter) and one timer, so a key of few rows
costs a few calls of the state store, whatever number of slots they fall into. Beyond
``HELD`` waiting rows go to a map, in pieces of a slot that are written once; a task holds
the rows of one slot of one key, or one Arrow batch, whatever share of a batch a key has.
The timer also ends tracks of keys that fall silent.

Rows older than the watermark are left out, as Spark does. A row with a null label is a
tick: it moves the time on and observes nothing. Rows that are equal count each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RECORD = "gid bigint, track bigint, label string, kind string, t double, start double, n bigint, reason string"
COLUMNS = [c.split()[0] for c in RECORD.split(", ")]
HOUR_MS = 3_600_000
#: Waiting rows that a key keeps in its value, and rows of a frame of results.
HELD = 4_096
OWN = "next bigint, due bigint, t array<double>, label array<string>, slots array<bigint>, pieces array<bigint>, live array<string>, tracks array<bigint>, starts array<double>, lasts array<double>, counts array<bigint>"


class Tracker(StatefulProcessor):
    """Times are hours since ``zero_ms``."""

    def __init__(self, gap: float, capacity: int, slot: float, zero_ms: int):
        self.gap, self.capacity, self.slot, self.zero_ms = gap, capacity, slot, zero_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", OWN)
        self.waiting = handle.getMapState("waiting", "slot bigint, piece bigint", "t array<double>, label array<string>")

    def _due(self, slot: int) -> int:
        """When all rows of a slot have come, in milliseconds."""
        return self.zero_ms + math.ceil((slot + 1) * self.slot * HOUR_MS)

    def _read(self) -> tuple:
        """Number of the next track, the timer, waiting rows (t, label), pieces of a slot in the map, live tracks (number, start, last, n) by label."""
        following, due, times, labels, slots, pieces, live, *tracks = self.own.get() or (0, None, *[[]] * 9)
        return following, due, list(zip(times, labels, strict=True)), dict(zip(slots, pieces, strict=True)), {k: list(v) for k, *v in zip(live, *tracks, strict=True)}

    def _write(self, following: int, due: int | None, rows: list, pieces: dict, live: dict) -> None:
        tracks = [[v[i] for v in live.values()] for i in range(4)]
        self.own.update((following, due, [t for t, _ in rows], [label for _, label in rows], list(pieces), list(pieces.values()), list(live), *tracks))

    def _slots(self, rows: list) -> dict[int, list]:
        """Rows by their slots."""
        out: dict[int, list] = {}
        for row in rows:
            out.setdefault(int(row[0] // self.slot), []).append(row)
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        following, due, held, pieces, live = self._read()
        for part in rows:
            held += [(float(t), label) for t, label in zip(part["t"], part["label"], strict=True) if isinstance(label, str)]
            if len(held) > HELD:
                for slot, own in self._slots(held).items():
                    at = pieces.get(slot, 0)
                    self.waiting.updateValue((slot, at), ([t for t, _ in own], [label for _, label in own]))
                    pieces[slot] = at + 1
                held = []
        waiting = [int(t // self.slot) for t, _ in held] + list(pieces)
        first = self._due(min(waiting)) if waiting else None
        if first is not None and (due is None or first < due):
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)
            due = first
        self._write(following, due, held, pieces, live)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        following, _, held, pieces, live = self._read()
        few, out = self._slots(held), []

        def end(label: str, reason: str) -> None:
            track, start, last, n = live.pop(label)
            out.append((key[0], track, label, "end", last, start, n, reason))

        for slot in sorted(k for k in {*few, *pieces} if self._due(k) <= passed):
            own = few.pop(slot, [])
            for piece in range(pieces.pop(slot, 0)):
                own += zip(*self.waiting.getValue((slot, piece)), strict=True)
                self.waiting.removeKey((slot, piece))
            for t, label in sorted(own):
                for other in sorted((k for k, v in live.items() if t - v[2] > self.gap), key=lambda k: live[k][0]):
                    end(other, "gap")
                if label not in live:
                    live[label] = [following, t, t, 0]
                    following += 1
                live[label][2:] = [t, live[label][3] + 1]
                out.append((key[0], live[label][0], label, "support", t, live[label][1], live[label][3], None))
                if len(live) > self.capacity:
                    end(min(live, key=lambda k: (live[k][1], live[k][0])), "capacity")
                if len(out) >= HELD:
                    yield pd.DataFrame(out, columns=COLUMNS)
                    out.clear()
        # the slot that a track's gap ends in: past the watermark, all that could have gone on has come
        silent = {label: self._due(int((track[2] + self.gap) // self.slot)) for label, track in live.items()}
        for label in sorted((k for k, v in silent.items() if v <= passed), key=lambda k: live[k][0]):
            end(label, "gap")
        due = min([self._due(k) for k in {*few, *pieces}] + [silent[k] for k in live], default=None)
        if due is not None:
            self.handle.registerTimer(due)
        self._write(following, due, [row for own in few.values() for row in own], pieces, live)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def records(events: DataFrame, gap: float, capacity: int, slot: float, delay: str, zero_ms: int) -> DataFrame:
    """A stream of (gid, label, t, ts) to support and end records; the session's state store has to be RocksDB's."""
    return events.withWatermark("ts", delay).groupBy("gid").transformWithStateInPandas(Tracker(gap, capacity, slot, zero_ms), RECORD, "Append", "EventTime")
