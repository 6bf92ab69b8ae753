"""Live identities and tracks: a gallery of persons by appearance, tracks that end by silence, scene cuts that clear
tracks and not persons, and tracks that hand over to the one that goes on with their person."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.hazard import hold_events
from .ordered import Ordered, run_ordered


@dataclass(frozen=True)
class Gallery:
    """When a lost person is the one that comes, and after how long a person counts."""

    least_similar: float = 0.86
    least_gap_s: float = 0.3
    most_gap_s: float = 60.0
    most_distance: float = 0.45  # of the diagonal, for each second of absence and one
    new_share: float = 0.10  # of a new appearance in the kept one
    counts_after_s: float = 2.0


class Registry:
    """Persons by number, each with a kept appearance, and the person of each track.

    ``persons``: number to [appearance or None, first, last, x, y]; ``tracks``: track to person. A person is claimed once
    in a frame; a track whose person another one has claimed looks for a person anew.
    """

    def __init__(self, cfg: Gallery = Gallery(), persons: dict | None = None, tracks: dict | None = None, frame=None, claimed=()):
        self.cfg, self.persons, self.tracks = cfg, persons or {}, tracks or {}
        self.frame, self.claimed = frame, set(claimed)

    def person_of(self, frame, track: int, t: float, look: list[float] | None, x: float, y: float, diagonal: float) -> int:
        if frame != self.frame:
            self.frame, self.claimed = frame, set()
        number = self.tracks.get(track)
        if number is None or number in self.claimed:
            number = self._lost(t, look, x, y, diagonal) or max(self.persons, default=0) + 1
            self.tracks[track] = number
        self.claimed.add(number)
        kept, first, *_ = self.persons.get(number, (None, t))
        if look is not None:
            mixed = look if kept is None else [(1 - self.cfg.new_share) * a + self.cfg.new_share * b for a, b in zip(kept, look, strict=True)]
            norm = 1.0 if kept is None else math.sqrt(sum(v * v for v in mixed))
            kept = [v / norm for v in mixed] if norm > 0 else mixed
        self.persons[number] = [kept, first, t, x, y]
        return number

    def _lost(self, t: float, look, x: float, y: float, diagonal: float) -> int | None:
        """The most similar person who may have come back; of equal ones the first."""
        cfg, best = self.cfg, (self.cfg.least_similar, None)
        if look is None:
            return None
        for number in sorted(self.persons.keys() - self.claimed):
            kept, _, last, px, py = self.persons[number]
            gap = t - last
            near = math.hypot(x - px, y - py) <= cfg.most_distance * diagonal * (1 + gap)
            if kept is not None and cfg.least_gap_s <= gap <= cfg.most_gap_s and near:
                alike = sum(a * b for a, b in zip(look, kept, strict=True))
                if alike > best[0]:
                    best = (alike, number)
        return best[1]


class OnlineRegistry(Ordered):
    """Each detection with its person, and whether the person counts by then."""

    columns = ("ts_ms", "frame_no", "track_id", "look", "x", "y", "diagonal")
    order, key = ("frame_no", "track_id"), "run_id"
    output = StructType().add("run_id", "long").add("frame_no", "integer").add("track_id", "long").add("person", "integer").add("counts", "boolean")

    def __init__(self, cfg: Gallery = Gallery()):
        self.cfg = cfg

    def init(self, handle) -> None:
        super().init(handle)
        self.people = handle.getMapState("people", "person int", "look array<double>, first double, last double, x double, y double")
        self.owners = handle.getMapState("owners", "track long", "person int")
        self.claims = handle.getValueState("claims", "frame int, persons array<int>")

    def load(self) -> None:
        frame, claimed = self.claims.get() if self.claims.exists() else (None, ())
        people = {k[0]: [None if v[0] is None else list(v[0]), *v[1:]] for k, v in self.people.iterator()}
        self.registry = Registry(self.cfg, people, {k[0]: v[0] for k, v in self.owners.iterator()}, frame, claimed)
        self.changed: set = set()

    def take(self, row: dict) -> list[tuple]:
        t = row["ts_ms"] / 1000
        person = self.registry.person_of(row["frame_no"], row["track_id"], t, row["look"], row["x"], row["y"], row["diagonal"])
        self.changed.add((row["track_id"], person))
        return [(row["frame_no"], row["track_id"], person, t - self.registry.persons[person][1] >= self.cfg.counts_after_s)]

    def save(self) -> None:
        for track, person in self.changed:
            if self.registry.tracks.get(track) == person:
                self.owners.updateValue((track,), (person,))
        for person in {p for _, p in self.changed}:
            self.people.updateValue((person,), tuple(self.registry.persons[person]))
        if self.registry.frame is not None:
            self.claims.update((self.registry.frame, sorted(self.registry.claimed)))


def online_persons(detections: DataFrame, late: str, cfg: Gallery = Gallery()) -> DataFrame:
    """run_id, frame_no, track_id, person, counts of a stream of run_id, ts, ts_ms, frame_no, track_id, look, x, y, diagonal."""
    return run_ordered(detections, OnlineRegistry(cfg), late)


#: Points of a trail.
TRAIL = 24


class LiveTracks(Ordered):
    """Tracks on the picture. Rows of ``kind`` 1 are detections; a row of kind 0 is a scene cut, which clears all tracks before
    the detections of its frame (its track_id is -1).

    A track starts with its first detection. It ends when it was silent for ``grace_s`` (by a timer), at a cut, or when
    another track comes with its person: that one takes over its trail. Persons are the registry's and outlive all that.
    """

    columns = ("ts_ms", "frame_no", "kind", "track_id", "person", "x", "y")
    order, key = ("frame_no", "kind", "track_id"), "run_id"
    output = StructType().add("run_id", "long").add("track_id", "long").add("person", "integer").add("event", "string").add("at_ms", "long").add("points", "integer").add("other", "long")

    def __init__(self, grace_s: float):
        self.grace_ms = round(grace_s * 1000)

    def init(self, handle) -> None:
        super().init(handle)
        self.kept = handle.getMapState("tracks", "track long", "person int, last long, frame int, trail array<double>")

    def load(self) -> None:
        #: track: [person, time of its last detection, its frame, trail as x, y, x, y, ...]
        self.tracks = {k[0]: [v[0], v[1], v[2], list(v[3])] for k, v in self.kept.iterator()}
        self.before, self.touched = set(self.tracks), set()

    def take(self, row: dict) -> list[tuple]:
        at, track = row["ts_ms"], row["track_id"]
        if row["kind"] == 0:
            return [self._end(t, "cut", at) for t in sorted(self.tracks)]
        out, trail = [], []
        # A track of the same person that this frame has not seen hands over; the frame's later rows claim theirs themselves.
        for t in sorted(self.tracks):
            if t != track and self.tracks[t][0] == row["person"] and self.tracks[t][2] != row["frame_no"]:
                trail = self.tracks[t][3] + trail
                out.append(self._end(t, "handed over", at, track))
        if track in self.tracks:
            trail += self.tracks[track][3]
        else:
            out.append((track, row["person"], "start", at, len(trail) // 2 + 1, None))
        self.tracks[track] = [row["person"], at, row["frame_no"], (trail + [row["x"], row["y"]])[-2 * TRAIL :]]
        self.touched.add(track)
        return out

    def _end(self, track: int, why: str, at: int, other: int | None = None) -> tuple:
        person, _, _, trail = self.tracks.pop(track)
        return (track, person, why, at, len(trail) // 2, other)

    def deadline(self) -> int | None:
        return min((v[1] + self.grace_ms for v in self.tracks.values()), default=None)

    def due(self, at: int) -> list[tuple]:
        return [self._end(t, "silent", at) for t in sorted(self.tracks) if self.tracks[t][1] + self.grace_ms <= at]

    def save(self) -> None:
        for t in self.before - set(self.tracks):
            self.kept.removeKey((t,))
        for t in self.touched & set(self.tracks):
            self.kept.updateValue((t,), tuple(self.tracks[t]))


def live_tracks(rows: DataFrame, grace_s: float, late: str) -> DataFrame:
    """Starts and ends of tracks of a stream of run_id, ts, ts_ms, frame_no, kind, track_id, person, x, y."""
    return run_ordered(rows, LiveTracks(grace_s), late)


class Holds(Ordered):
    """A signal that must last before it is told, and that is kept for a while: onsets and ends.

    Rows say whether the signal is there. Once it has been there for ``hold_s``, an onset is told, with the time since
    when; it ends where the signal is away at ``keep_s`` after that time or later, by a timer if no row comes.
    """

    columns = ("signal", "ts_ms", "present")
    output = StructType().add("signal", "string").add("event", "string").add("since_ms", "long").add("at_ms", "long")

    def __init__(self, hold_s: float, keep_s: float, key: str = "signal"):
        """``key``: the column whose values share a state; each signal lies within one of them."""
        self.hold_ms, self.keep_ms, self.key = round(hold_s * 1000), round(keep_s * 1000), key

    def init(self, handle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "signals array<string>, seen array<long>, told array<long>, away array<long>")

    def load(self) -> None:
        #: signal: [seen, told, away]
        self.signals = {s: list(rest) for s, *rest in zip(*self.state.get(), strict=True)} if self.state.exists() else {}

    def save(self) -> None:
        columns = [list(c) for c in zip(*((s, *v) for s, v in self.signals.items()), strict=True)]
        self.state.update(tuple(columns or [[], [], [], []]))

    def named(self, key: tuple, out: tuple) -> tuple:
        return out

    def replay(self, ready: list[dict], now: int) -> list[tuple]:
        # Signals know nothing of each other, so one is told to its end after the other.
        rows: dict = {s: [] for s in self.signals}
        for r in ready:
            rows.setdefault(r["signal"], []).append(r)
        out = []
        for s, mine in rows.items():
            self.seen, self.told, self.away = self.signals.get(s, (None, None, None))
            events = super().replay(mine, now)
            out += [(s, *e) for e in events]
            self.signals[s] = [self.seen, self.told, self.away]
        return out

    def take(self, row: dict) -> list[tuple]:
        at = row["ts_ms"]
        if not row["present"]:
            self.seen, self.away = None, at if self.away is None else self.away
            return self.due(at) if self.told is not None and self._ends() <= at else []
        self.away, self.seen = None, at if self.seen is None else self.seen
        if at - self.seen < self.hold_ms or self.told == self.seen:
            return []
        self.told = self.seen
        return [("onset", self.told, at)]

    def _ends(self) -> int | None:
        return None if self.told is None or self.away is None else max(self.away, self.told + self.keep_ms)

    def _meet(self, until: int) -> list[tuple]:
        at = self._ends()
        return self.due(at) if at is not None and at <= until else []

    def deadline(self) -> int | None:
        """The first end of any of the key's signals."""
        return min((max(away, told + self.keep_ms) for _, told, away in self.signals.values() if told is not None and away is not None), default=None)

    def due(self, at: int) -> list[tuple]:
        told, at, self.told = self.told, self._ends(), None
        return [("end", told, at)]


def held_signals(rows: DataFrame, hold_s: float, keep_s: float, late: str, by: str = "signal") -> DataFrame:
    """signal, event, since_ms, at_ms of a stream of signal, ts, ts_ms, present.

    ``by``: a column that each signal has one value of; signals that share it share a state, so that many short signals don't
    cost a state and a timer each. Their rows wait together in one task.
    """
    return run_ordered(rows, Holds(hold_s, keep_s, by), late)


def held_spans(rows: DataFrame, hold_s: float, keep_s: float, keys: tuple[str, ...] = ("signal",)) -> DataFrame:
    """What ``held_signals`` tells, as a batch by windows. Where several ``keys`` name a signal, its text is made of the events only."""
    events = hold_events(rows, list(keys), "ts_ms", "present", round(hold_s * 1000), round(keep_s * 1000))
    return events.select(F.concat_ws("/", *keys).alias("signal") if len(keys) > 1 else keys[0], "event", F.col("since").alias("since_ms"), F.col("at").alias("at_ms"))
