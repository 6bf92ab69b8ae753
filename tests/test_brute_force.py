"""Queries and operators without SQL, against plain Python."""

import itertools
import math
import random

from sightline.operators import identity as P
from sightline.plans.catalog import QUERIES
from sightline.sources import adapter as A

SF = "/root/testdata/sf0.001"
BAND, GAP, DIST, CONFIRM = P.BAND, P.GAP_MAX_S, P.DIST, P.CONFIRM_S


def unit(v):
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v]


def brute(tracks, diag, sim):
    """tracks: id -> (frames, first second, last second, start, end, vector, rows). Each round looks at all pairs of
    clusters anew. Gives the sets of ids, the merges and the noted pairs."""
    now = {i: ([i], unit(t[5]), t[6]) for i, t in tracks.items()}
    merges, noted = [], {}
    while True:
        best = []
        for a, b in itertools.combinations(sorted(now), 2):
            s = sum(x * y for x, y in zip(now[a][1], now[b][1], strict=True))
            if s < sim - BAND:
                continue
            pairs = list(itertools.product(now[a][0], now[b][0]))
            if any(tracks[x][0] & tracks[y][0] for x, y in pairs):
                noted.setdefault((a, b), "blocked:temporal_overlap")
                continue
            ways = []
            for x, y in pairs:
                early, late = (tracks[x], tracks[y]) if tracks[x][2] <= tracks[y][1] else (tracks[y], tracks[x])
                ways.append((late[1] - early[2], math.dist(late[3], early[4])))
            gap, far = min(ways, key=lambda w: w[0])
            if s < sim:
                noted.setdefault((a, b), "blocked:appearance")
            elif not 0 <= gap <= GAP:
                noted.setdefault((a, b), "blocked:gap")
            elif far > DIST * diag * (1 + gap):
                noted.setdefault((a, b), "blocked:spatial")
            else:
                best.append((-s, gap, a, b))
        if not best:
            return {tuple(sorted(ids)) for ids, _, _ in now.values()}, merges, noted
        _, _, a, b = min(best)
        merges.append((a, b))
        (ia, va, na), (ib, vb, nb) = now[a], now.pop(b)
        now[a] = (ia + ib, unit([x * na + y * nb for x, y in zip(va, vb, strict=True)]), na + nb)


def fixture(spark, seed):
    rng = random.Random(seed)
    colours = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(4)]
    rows, dets, tracks = [], [], {}
    for i in range(1, 19):
        first, n = rng.randrange(0, 400), rng.randrange(1, 40)
        x, v = rng.uniform(0, 600), [c + rng.gauss(0, 0.25) for c in colours[i % 4]]
        for f in range(first, first + n):
            rows.append((1, i, f, i * 1000 + f, x - 15.0, 0.0, x + 15.0, 80.0, 0))
            dets.append((i * 1000 + f, v, "osnet"))
        tracks[i] = (set(range(first, first + n)), first / 10, (first + n - 1) / 10, (x, 40.0), (x, 40.0), v, n)
    t = spark.createDataFrame(rows, "run_id bigint, tracklet_id bigint, frame_no int, det_id bigint, x0 double, y0 double, x1 double, y1 double, scene_segment int")
    d = spark.createDataFrame(dets, "det_id bigint, embedding array<double>, embedding_method string")
    return tracks, P.profiles(t, 10.0), P.centroids(t, d)


def test_persons_and_audit_equal_brute_force(spark):
    total = 0
    for seed in range(3):
        tracks, profile, centroid = fixture(spark, seed)
        sets, merges, noted = brute(tracks, 300.0, 0.9)
        people = P.persons(profile, centroid, 300.0, 0.9).collect()
        assert {tuple(p.tracklet_ids) for p in people} == sets
        assert {p.uncertain for p in people} == {len(noted)}
        order = sorted(people, key=lambda p: (p.first_seen, p.tracklet_ids[0]))
        assert [p.person_id for p in order] == list(range(1, len(people) + 1))
        assert all((p.state == "confirmed") == (p.last_seen - p.first_seen >= CONFIRM) for p in people)
        audit = P.association_audit(profile, centroid, 300.0, 0.9).collect()
        assert sorted((r.a, r.b) for r in audit if r.rule == "merged") == sorted(merges)
        assert {(r.a, r.b): r.rule for r in audit if r.rule != "merged"} == noted
        holds = {p.person_id: p.tracklet_ids for p in people}
        for who, rows in itertools.groupby(sorted(audit, key=lambda r: (r.person_id, r.place)), key=lambda r: r.person_id):
            rows = list(rows)
            assert [r.place for r in rows] == list(range(1, len(rows) + 1)) and all(r.a in holds[who] for r in rows)
            assert [(r.rule != "merged", -r.sim) for r in rows] == sorted((r.rule != "merged", -r.sim) for r in rows)
        total += len(merges)
    assert total > 3


def test_person_queries_fit_together(spark):
    people = QUERIES["persons"](spark, SF).collect()
    tracks = {(r.run_id, r.tracklet_id) for r in A.tracklets(spark, SF).select("run_id", "tracklet_id").distinct().collect()}
    held = [(p.run_id, t) for p in people for t in p.tracklet_ids]
    assert len(held) == len(set(held)) and set(held) == tracks
    counts = {r.run_id: (r.persons, r.unique_count) for r in QUERIES["person_counts"](spark, SF).collect()}
    runs = {p.run_id for p in people}
    assert counts == {run: (sum(p.run_id == run for p in people), sum(p.run_id == run and p.state == "confirmed" for p in people)) for run in runs}
    audit = QUERIES["association_audit"](spark, SF).collect()
    assert {run: sum(r.run_id == run and r.rule != "merged" for r in audit) for run in runs} == {p.run_id: p.uncertain for p in people}
    assert sum(r.rule == "merged" for r in audit) == len(tracks) - len(people)


def test_corrections_of_the_sample(spark):
    """Persons 1 and 2 of each run are merged, then the smallest tracklet of both is a person of its own."""
    before = {}
    for p in QUERIES["persons"](spark, SF).collect():
        before.setdefault(p.run_id, {})[p.person_id] = list(p.tracklet_ids)
    want = set()
    for run, sets in before.items():
        if len(sets) >= 2:
            both = sorted(sets.pop(1) + sets.pop(2))
            sets[1] = both[1:]
            sets[max(sets) + 1] = both[:1]
        want |= {(run, i, tuple(ids)) for i, ids in sets.items()}
    got = {(r.run_id, r.person_id, tuple(r.tracklet_ids)) for r in QUERIES["identity_corrections"](spark, SF).collect()}
    assert got == want
