"""Logs, matching, identities, notes and the store on small fixtures."""

from sightline.operators import annotations as L
from sightline.operators import identity as P
from sightline.operators import matching as M
from sightline.operators import notes as N
from sightline.sources import store as S

SIDE = "run_id bigint, {0}_id bigint, t{0} double"


def sides(spark, a, b):
    return spark.createDataFrame([(1, *r) for r in a], SIDE.format("a")), spark.createDataFrame([(1, *r) for r in b], SIDE.format("b"))


def report(spark, a, b, tol):
    return {(r.bucket, r.a_id, r.b_id) for r in M.match_report(*sides(spark, a, b), ["run_id"], tol).collect()}


def test_tolerance_is_inclusive(spark):
    assert report(spark, [(1, 10.0)], [(7, 70.0)], 60.0) == {("both", 1, 7)}
    assert report(spark, [(1, 10.0)], [(7, 70.01)], 60.0) == {("a_only", 1, None), ("b_only", None, 7)}


def test_smallest_delta_first(spark):
    # The first row alone would take the note that is the second's nearer one.
    assert report(spark, [(1, 0.0), (2, 5.0)], [(7, 6.0)], 60.0) == {("a_only", 1, None), ("both", 2, 7)}
    assert report(spark, [(1, 0.0), (2, 5.0)], [(7, 6.0), (8, 40.0)], 60.0) == {("both", 2, 7), ("both", 1, 8)}


def test_band_join_equals_brute_force(spark):
    a, b = sides(spark, [(i, i * 1.7) for i in range(60)], [(i, i * 2.3 - 5) for i in range(60)])
    got = {(r.a_id, r.b_id) for r in M.band_join(a, b, ["run_id"], "ta", "tb", 3.0).collect()}
    assert got == {(i, j) for i in range(60) for j in range(60) if abs(j * 2.3 - 5 - i * 1.7) <= 3.0}


LOG = "seq bigint, annotation_id string, event_key bigint, state string, note string, action string, target_id string"


def test_tombstones_latest_and_carry(spark):
    log = spark.createDataFrame(
        [(1, "a", 5, None, "seen", None, None), (2, "b", 5, "confirmed", None, None, None), (3, "c", 5, "rejected", None, None, None), (4, "d", None, None, None, "delete", "c"), (5, "e", None, None, None, "delete", "c")], LOG
    )
    live = L.live(log)
    assert {r.annotation_id for r in live.collect()} == {"a", "b"}
    last = L.latest_by(L.carried(live, "event_key", {"state": "unreviewed", "note": ""}), "event_key").collect()
    assert [(r.state, r.note) for r in last] == [("confirmed", "seen")]


def people(spark, tracks, sim=0.86):
    """tracks: (tracklet, first frame, last frame, x, colour)."""
    rows, dets = [], []
    for tid, first, last, x, colour in tracks:
        for f in range(first, last + 1):
            rows.append((1, tid, f, tid * 1000 + f, x - 15.0, 0.0, x + 15.0, 80.0, 0))
            dets.append((tid * 1000 + f, colour, "osnet"))
    t = spark.createDataFrame(rows, "run_id bigint, tracklet_id bigint, frame_no int, det_id bigint, x0 double, y0 double, x1 double, y1 double, scene_segment int")
    d = spark.createDataFrame(dets, "det_id bigint, embedding array<double>, embedding_method string")
    return P.persons(P.profiles(t, 10.0), P.centroids(t, d), 500.0, sim)


RED, BLUE = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]


def test_identity_gates(spark):
    same = people(spark, [(1, 0, 9, 100.0, RED), (2, 20, 29, 101.0, RED)]).collect()
    assert [(p.person_id, sorted(p.tracklet_ids), p.state) for p in same] == [(1, [1, 2], "confirmed")]
    assert people(spark, [(1, 0, 9, 100.0, RED), (2, 5, 14, 101.0, RED)]).count() == 2  # overlap
    assert people(spark, [(1, 0, 9, 100.0, RED), (2, 20, 29, 101.0, BLUE)]).count() == 2  # appearance
    assert people(spark, [(1, 0, 9, 100.0, RED), (2, 11, 19, 900.0, RED)]).count() == 2  # too far
    assert people(spark, [(1, 0, 9, 100.0, RED), (2, 900, 909, 101.0, RED)]).count() == 2  # gap


def test_corrections_merge_and_split(spark):
    p = people(spark, [(1, 0, 9, 100.0, RED), (2, 20, 29, 101.0, BLUE)])
    spans = spark.createDataFrame([(1, 1, 0.0, 0.9), (1, 2, 2.0, 2.9)], "run_id bigint, tracklet_id bigint, first_s double, last_s double")
    log = "run_id bigint, seq bigint, action string, keys string"
    one = P.apply_corrections(p, spark.createDataFrame([(1, 1, "merge", "[[1],[2]]")], log), spans).collect()
    assert [(r.person_id, list(r.tracklet_ids), r.state) for r in one] == [(1, [1, 2], "manual")]
    two = P.apply_corrections(p, spark.createDataFrame([(1, 1, "merge", "[[1],[2]]"), (1, 2, "split", "[[1,2],[2]]"), (1, 3, "merge", "[[9],[2]]")], log), spans).collect()
    assert [(r.person_id, list(r.tracklet_ids), r.first_seen) for r in two] == [(1, [1], 0.0), (2, [2], 2.0)]


def test_note_lines(spark):
    lines = ["2 persons by the car, 14:32", "14:32; smoke", "1:04:32, three", "872,5; four", "872,5, five", "# no", "", "nothing", "10:75, bad"]
    got = {r.line: (r.t, r.note) for r in N.parse_notes(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert got["2 persons by the car, 14:32"] == (872.0, "2 persons by the car")
    assert got["14:32; smoke"] == (872.0, "smoke")
    assert got["1:04:32, three"] == (3872.0, "three")
    assert got["872,5; four"] == got["872,5, five"][:1] + ("four",) == (872.5, "four")
    more = ["12:30;\tsmoke \t", "x\t;12:30", "\u00a0y \t,\t1:02:03", "\ufeff12:30;z"]
    tabs = {r.line: (r.t, r.note) for r in N.parse_notes(spark.createDataFrame([(x,) for x in more], "line string")).collect()}
    assert [tabs[x] for x in more] == [(750.0, "smoke"), (750.0, "x"), (3723.0, "y"), (None, None)]
    assert got["nothing"] == (None, None) and got["10:75, bad"] == (None, None)
    assert len(got) == 7


def test_only_the_first_line_of_a_file_may_have_a_mark(spark):
    rows = [(1, 1, "\ufefftid;text"), (1, 2, "0:30;\tsmoke"), (2, 5, "\ufeff"), (2, 6, "0:40;a"), (2, 7, "\ufeff0:50;b")]
    got = {(r.file, r.line_no): (r.line, r.t, r.note, r.reason) for r in N.import_notes(spark.createDataFrame(rows, "file int, line_no int, line string"), ["file"]).collect()}
    assert got == {(1, 2): ("0:30;\tsmoke", 30.0, "smoke", None), (2, 6): ("0:40;a", 40.0, "a", None), (2, 7): ("\ufeff0:50;b", None, None, "line")}


def test_nearest_frame_takes_the_earlier_of_two(spark):
    frames = spark.createDataFrame([(1, f, f * 1.0) for f in range(5)], "run_id bigint, frame_no int, t double")
    asked = spark.createDataFrame([(1, 1, 1.5), (1, 2, -3.0), (1, 3, 9.0)], "run_id bigint, ask_id bigint, t double")
    assert {r.ask_id: r.frame_no for r in M.nearest_frame(frames, asked, ["run_id"]).collect()} == {1: 1, 2: 0, 3: 4}


def test_store_rewrites_a_pass_and_resumes(spark, tmp_path):
    s = S.PassStore(spark, str(tmp_path))
    assert s.read("detections", "frame_no int").count() == 0
    s.write(spark.range(5).selectExpr("int(id) frame_no"), "detections", "r1", "p1")
    s.write(spark.range(3).selectExpr("int(id) frame_no"), "detections", "r2", "p1")
    s.write(spark.range(7).selectExpr("int(id) frame_no"), "detections", "r1", "p1")
    assert s.read("detections", "frame_no int", "r1", "p1").count() == 7 and s.read("detections", "frame_no int").count() == 10
    kept, gone = S.split_orphans(s.read("detections", "frame_no int", "r1"), 4)
    assert (kept.count(), gone.count()) == (5, 2)
    runs = spark.createDataFrame([("r1", "c1", None), ("r2", "c2", "w")], "run_id string, config_hash string, weights string")
    assert S.resume_refusals(runs, "r1", {"config_hash": "c1", "weights": None}).count() == 0
    assert [r.field for r in S.resume_refusals(runs, "r2", {"config_hash": "c1", "weights": "w"}).collect()] == ["config_hash"]
