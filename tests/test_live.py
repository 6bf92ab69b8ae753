"""Live identities, tracks and holds: streams against plain folds, for several orders of files."""

import itertools
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from sightline.plans import stream_queries as S
from sightline.streaming import live, persons
from sightline.streaming.persons import Registry

SF = "/root/testdata/sf0.001"


def stream_of(spark, root, parts, schema):
    """A stream that reads one file of rows after the other, in the order of ``parts``."""
    root = f"{root}/{uuid.uuid4().hex}"
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.parquet(f"{root}/{n:03}")
    schema = spark.read.parquet(f"{root}/000").schema
    return live.open_stream(spark, f"{root}/*", schema, 1), root


def ended(stream, root):
    return live.run_to_end(stream, f"{root}-out", f"{root}-state").collect()


def look(seed):
    r = random.Random(seed)
    v = [r.random() for _ in range(128)]
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


DIAGONAL = 1000.0


def resolve(rows):
    """Persons of rows (frame, track, t, look, x, y)."""
    reg = Registry()
    return [reg.person_of(f, k, t, v, x, y, DIAGONAL) for f, k, t, v, x, y in rows], reg


def counted(reg):
    return sum(last - first >= reg.cfg.counts_after_s for _, first, last, _, _ in reg.persons.values())


def test_one_track_is_one_person():
    got, reg = resolve([(0, 10, 0.0, look(1), 100, 100), (1, 10, 2.5, look(1), 110, 100)])
    assert got == [1, 1] and counted(reg) == 1


def test_two_tracks_are_two_persons():
    got, reg = resolve([(f, k, t, look(k), 100 * k, 100) for f, t in ((0, 0.0), (1, 2.5)) for k in (1, 5)])
    assert got == [1, 2, 1, 2] and counted(reg) == 2


def test_short_track_does_not_count():
    _, reg = resolve([(0, 10, 0.0, look(1), 100, 100)])
    assert counted(reg) == 0


def test_revived_track_does_not_share_its_person():
    got, _ = resolve([(0, 42, 0.0, look(1), 100, 100), (1, 78, 3.0, look(1), 120, 110), (1, 42, 3.0, look(1), 500, 500)])
    assert got == [1, 1, 2]


@pytest.mark.parametrize(("t", "seed", "x", "person"), [(3.0, 1, 150, 1), (3.0, 99, 150, 2), (0.5, 1, 9000, 2), (0.2, 1, 100, 2), (70.0, 1, 100, 2), (3.0, None, 150, 2)])
def test_who_comes_back(t, seed, x, person):
    got, _ = resolve([(0, 10, 0.0, look(1), 100, 100), (1, 20, t, seed and look(seed), x, 100)])
    assert got == [1, person]


def test_no_return_while_the_first_is_there():
    got, _ = resolve([(0, 10, 0.0, look(1), 100, 100), (0, 11, 0.0, look(1), 120, 100)])
    assert got == [1, 2]


DETECTIONS = "run_id bigint, ts_ms bigint, frame_no int, track_id bigint, look array<double>, x double, y double, diagonal double"


def test_online_persons_equal_a_fold_for_every_order_of_files(spark, tmp_path):
    r, rows = random.Random(3), []
    for run in (1, 2):
        for f in range(60):
            for p in range(4):
                if r.random() < 0.7:
                    track = p * 100 + f // r.choice((7, 9, 13))
                    rows.append((run, 86_400_000 + f * 400, f, track, None if r.random() < 0.2 else look(p), r.uniform(0, 900), r.uniform(0, 900), DIAGONAL))
    want = []
    for run in (1, 2):
        reg = Registry()
        for _, ms, f, k, v, x, y, d in sorted((x for x in rows if x[0] == run), key=lambda x: (x[1], x[2], x[3])):
            person = reg.person_of(f, k, ms / 1000, v, x, y, d)
            want.append((run, f, k, person, ms / 1000 - reg.persons[person][1] >= 2.0))
    assert len({w[3] for w in want}) > 4  # some return, some don't
    parts = [rows[0::3], rows[1::3], rows[2::3]]
    end = [(-1, 86_400_000 * 100, 0, 0, None, 0.0, 0.0, 1.0)]
    for order in list(itertools.permutations(range(3)))[::2]:
        stream, root = stream_of(spark, tmp_path, [*(parts[i] for i in order), end], DETECTIONS)
        assert sorted(tuple(x) for x in ended(persons.online_persons(stream, "2 days"), root)) == sorted(want)
    # In order of time the state is read and written batch by batch.
    rows.sort(key=lambda x: x[1])
    stream, root = stream_of(spark, tmp_path, [rows[:80], rows[80:160], rows[160:], end], DETECTIONS)
    assert sorted(tuple(x) for x in ended(persons.online_persons(stream, "5 seconds"), root)) == sorted(want)


TRACKS = "run_id bigint, ts_ms bigint, frame_no int, kind int, track_id bigint, person int, x double, y double"


def test_cut_clears_tracks_and_not_persons(spark, tmp_path):
    """Track 1 is handed over to 2, then a cut ends all tracks, and the person goes on under track 3, which falls silent."""
    at = lambda f: 86_400_000 + f * 500
    rows = [(1, at(f), f, 1, 1 if f < 3 else 2, 7, float(f), 0.0) for f in range(6)] + [(1, at(f), f, 1, 9, 8, 0.0, 0.0) for f in range(2)]
    rows += [(1, at(6), 6, 0, -1, 0, 0.0, 0.0), (1, at(6), 6, 1, 3, 7, 6.0, 0.0), (1, at(7), 7, 1, 3, 7, 7.0, 0.0)]
    want = [
        (1, 1, 7, "start", at(0), 1, None), (1, 9, 8, "start", at(0), 1, None), (1, 1, 7, "handed over", at(3), 3, 2), (1, 2, 7, "start", at(3), 4, None),
        (1, 9, 8, "silent", at(1) + 1500, 2, None), (1, 2, 7, "cut", at(6), 6, None), (1, 3, 7, "start", at(6), 1, None), (1, 3, 7, "silent", at(7) + 1500, 2, None),
    ]
    end = [(-1, 86_400_000 * 100, 0, 0, -1, 0, 0.0, 0.0)]
    for parts in ([rows], [rows[::2], rows[1::2]], [rows[1::2], rows[::2]]):
        stream, root = stream_of(spark, tmp_path, [*parts, end], TRACKS)
        assert sorted(map(tuple, ended(persons.live_tracks(stream, 1.5, "1 day"), root)), key=repr) == sorted(want, key=repr)


SIGNALS = "signal string, ts_ms bigint, present boolean"


def test_holds_equal_windows_for_every_order_of_files(spark, tmp_path):
    r, rows = random.Random(9), []
    for signal in "abc":
        t = 86_400_000
        for _ in range(40):
            there, n = r.random() < 0.6, r.randint(1, 9)
            for _ in range(n):
                rows.append((signal, t, there))
                t += r.choice((300, 500, 900))
    rows += [("d", 86_400_000, True), ("d", 86_403_000, True), ("d", 86_404_000, False)]  # ends by the timer alone
    batch = persons.held_spans(spark.createDataFrame(rows, SIGNALS), 2.0, 8.0)
    want = sorted(tuple(x) for x in batch.collect())
    assert [w for w in want if w[0] == "d"] == [("d", "end", 86_400_000, 86_408_000), ("d", "onset", 86_400_000, 86_403_000)]
    parts, end = [rows[0::3], rows[1::3], rows[2::3]], [("end", 86_400_000 * 100, False)]
    for order in list(itertools.permutations(range(3)))[:3]:
        stream, root = stream_of(spark, tmp_path, [*(parts[i] for i in order), end], SIGNALS)
        assert sorted(tuple(x) for x in ended(persons.held_signals(stream, 2.0, 8.0, "2 days"), root)) == want
    rows.sort(key=lambda x: x[1])
    stream, root = stream_of(spark, tmp_path, [rows[:100], rows[100:250], rows[250:], end], SIGNALS)
    assert sorted(tuple(x) for x in ended(persons.held_signals(stream, 2.0, 8.0, "10 seconds"), root)) == want


def test_stream_persons_equal_a_fold_over_the_sample(spark):
    rows = S.looks(spark, SF).collect()
    want = []
    regs = {}
    for x in sorted(rows, key=lambda x: (x.run_id, x.ts_ms, x.frame_no, x.track_id)):
        reg = regs.setdefault(x.run_id, Registry())
        want.append((x.run_id, x.frame_no, x.track_id, reg.person_of(x.frame_no, x.track_id, x.ts_ms / 1000, x.look, x.x, x.y, x.diagonal)))
    got = sorted((r.run_id, r.frame_no, r.track_id, r.person) for r in S.stream_persons(spark, SF).collect())
    assert got == sorted(want)
    assert len({(w[0], w[3]) for w in want}) < len({(w[0], w[2]) for w in want})  # some tracks are one person
