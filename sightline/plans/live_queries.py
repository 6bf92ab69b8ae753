"""Queries over settings, manifests, note files, and what a running picture shows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import settings as T
from ..operators import hazard as H
from ..operators import identity as P
from ..operators import live as V
from ..operators import motion as K
from ..operators import notes as N
from ..operators import scene as SC
from ..sources import adapter as A
from ..sources import store as S
from ..sources.scratch import written
from .registry import query
from .trajectory_queries import FPS, HAZARD_EVENTS_SQL, IRRATIONAL_SQL, behavior, hazard_events, irrational_beside

# --- settings ------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_size * 4.0 - 9 BETWEEN 1 AND 120 THEN p_size * 4.0 - 9 ELSE 25.0 END::DOUBLE AS fps, greatest(30, trunc(CASE WHEN p_size * 4.0 - 9 BETWEEN 1 AND 120 THEN p_size * 4.0 - 9 ELSE 25.0 END * 8))::INT AS buffer FROM part")
def usable_fps(spark, sf_dir):
    p = A.table(spark, sf_dir, "part").select("p_partkey", T.usable_fps((F.col("p_size") * 4 - 9).cast("double")).alias("fps"))
    return p.withColumn("buffer", T.track_buffer(F.col("fps")))


@query("SELECT page_id, CASE WHEN strlen(html) <= 1000000 THEN sha256(html) END AS video_hash FROM pages")
def video_hashes(spark, sf_dir):
    """The hash of the first million bytes of each page, as of a file."""
    return A.table(spark, sf_dir, "pages").select("page_id", T.content_hash(F.encode("html", "UTF-8")).alias("video_hash"))


SWITCH_SQL = "CASE event_id % 7 WHEN 0 THEN ' ON' WHEN 1 THEN 'no' WHEN 2 THEN 'True ' WHEN 3 THEN '0' WHEN 4 THEN 'maybe' WHEN 5 THEN '' END"


@query(f"""WITH s AS (SELECT event_id, lower(trim({SWITCH_SQL})) AS s FROM events)
SELECT event_id, CASE WHEN s IN ('1', 'true', 'on', 'yes') THEN true WHEN s IN ('0', 'false', 'off', 'no') THEN false ELSE event_id % 2 = 0 END AS enabled FROM s""")
def feature_flags(spark, sf_dir):
    text = F.expr(SWITCH_SQL)
    on, off = T.flag(text, True), T.flag(text, False)
    return A.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, on).otherwise(off).alias("enabled"))


@query("SELECT event_id, regexp_full_match(props, '[A-Za-z0-9_-]{1,64}') AS by_props, regexp_full_match(event_type || '-' || event_id, '[A-Za-z0-9_-]{1,64}') AS by_name FROM events")
def valid_ids(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    return e.select("event_id", T.valid_id(F.col("props")).alias("by_props"), T.valid_id(F.concat_ws("-", "event_type", "event_id")).alias("by_name"))


@query("""WITH r AS (SELECT p_partkey, unnest([(p_partkey % 13) / 10.0, 0.25]) AS x, unnest([(p_partkey % 9) / 10.0, 0.5]) AS y, unnest([(p_size % 12) / 10.0, 0.5]) AS w, unnest([0.2, 0.5]) AS h, unnest([0, 1]) AS i FROM part)
SELECT p_partkey, count(*) FILTER (x < 1 AND y < 1 AND w BETWEEN 0.01 AND 1 AND x + w <= 1.0001 AND y + h <= 1.0001) AS n_rects, coalesce(min(x) FILTER (x < 1 AND y < 1 AND w BETWEEN 0.01 AND 1 AND x + w <= 1.0001 AND y + h <= 1.0001), -1)::DOUBLE AS least_x FROM r GROUP BY p_partkey""")
def ignore_rects(spark, sf_dir):
    """The valid rectangles of lists as they stand in a configuration."""
    number = lambda c: F.format_string("%.1f", c / F.lit(10.0))
    text = F.concat_ws(",", number(F.col("p_partkey") % 13), number(F.col("p_partkey") % 9), number(F.col("p_size") % 12), F.lit("0.2; 0.25,0.5,0.5,0.5;;nonsense,1"))
    p = A.table(spark, sf_dir, "part").select("p_partkey", T.rects(text).alias("r"))
    return p.select("p_partkey", F.size("r").cast("bigint").alias("n_rects"), F.coalesce(F.array_min(F.transform("r", lambda r: r["x"])), F.lit(-1.0)).alias("least_x"))


@query("""WITH c AS (SELECT p_partkey, p_size * 8 AS w, p_size * 5 AS h FROM part), d AS (SELECT *, trunc(0.25 * w)::INT AS x0, trunc(0.125 * h)::INT AS y0, least(w, trunc(0.75 * w))::INT AS x1, least(h, trunc(0.875 * h))::INT AS y1 FROM c)
SELECT p_partkey, CASE WHEN x1 - x0 < 32 OR y1 - y0 < 32 THEN w ELSE x1 - x0 END::INT AS width, CASE WHEN x1 - x0 < 32 OR y1 - y0 < 32 THEN h ELSE y1 - y0 END::INT AS height FROM d""")
def crop_sizes(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    c = p.select("p_partkey", T.crop((F.col("p_size") * 8).cast("int"), (F.col("p_size") * 5).cast("int"), 0.25, 0.125, 0.5, 0.75).alias("c"))
    return c.select("p_partkey", (F.col("c.x1") - F.col("c.x0")).alias("width"), (F.col("c.y1") - F.col("c.y0")).alias("height"))


@query("""WITH s AS (SELECT event_id, greatest(0, (event_id * 7) % 9001 - 100) + CASE WHEN (event_id * 7) % 9001 >= 100 THEN 0.25 ELSE 0 END AS t FROM events), r AS (SELECT event_id, floor(t)::BIGINT AS n FROM s)
SELECT event_id, CASE WHEN n >= 3600 THEN printf('%d:%02d:%02d', n // 3600, n % 3600 // 60, n % 60) ELSE printf('%d:%02d', n // 60, n % 60) END AS clock FROM r""")
def clock_texts(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_id", T.clock_text((F.col("event_id") * 7) % 9001 - 100 + F.lit(0.25)).alias("clock"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS safe FROM pages")
def escaped_pages(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", T.escaped(F.col("html")).alias("safe"))


@query(f"WITH {A.TRACKLETS_SQL} SELECT DISTINCT frame_no, ('0x' || left(sha256('42:p1_detect:' || frame_no), 16))::UBIGINT::VARCHAR AS seed FROM tracklets")
def seed_numbers(spark, sf_dir):
    t = A.tracklets(spark, sf_dir).select("frame_no").distinct()
    return t.select("frame_no", T.frame_seed(42, "p1_detect", F.col("frame_no")).cast("string").alias("seed"))


# --- manifests -----------------------------------------------------------------------------

STEPS_SQL = """
steps AS (
  SELECT user_id AS run_id, CASE event_type WHEN 'view' THEN 'p1_detect' WHEN 'click' THEN 'p2_track' ELSE 'p5_events' END AS pass, event_id AS seq,
         CASE event_id % 5 WHEN 0 THEN 'start' WHEN 1 THEN 'progress' WHEN 2 THEN 'progress' WHEN 3 THEN 'complete' ELSE 'error' END AS step, (event_id % 97)::INT AS frame_no
  FROM events
)"""


@query(f"""WITH {STEPS_SQL}, started AS (SELECT * FROM steps s WHERE seq >= (SELECT min(seq) FROM steps o WHERE o.run_id = s.run_id AND o.pass = s.pass AND o.step = 'start'))
SELECT run_id, pass, arg_max(CASE step WHEN 'start' THEN 'running' WHEN 'progress' THEN 'partial' WHEN 'complete' THEN 'complete' ELSE 'error' END, seq) AS status,
  coalesce(arg_max(frame_no, seq) FILTER (step = 'progress'), -1) AS last_frame, CASE WHEN arg_max(step, seq) = 'error' THEN 'stopped at ' || arg_max(frame_no, seq) END AS error FROM started GROUP BY run_id, pass""")
def pass_states(spark, sf_dir):
    """What a log of passes' steps leaves of each run."""
    e, i = A.table(spark, sf_dir, "events"), F.col("event_id")
    name = F.when(F.col("event_type") == "view", "p1_detect").when(F.col("event_type") == "click", "p2_track").otherwise("p5_events")
    step = F.element_at(F.array(*map(F.lit, ("start", "progress", "progress", "complete", "error"))), (i % 5 + 1).cast("int"))
    frame = (i % 97).cast("int")
    return S.pass_states(e.select(F.col("user_id").alias("run_id"), name.alias("pass"), i.alias("seq"), step.alias("step"), frame.alias("frame_no"), F.concat(F.lit("stopped at "), frame).alias("message")))


MANIFEST = "run_id bigint, created_at string, stats map<string,map<string,double>>"


def manifests(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    stats = F.create_map(F.lit("p1"), F.create_map(F.lit("frames"), F.col("o_custkey").cast("double")), F.lit("p5"), F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("events"), (F.col("o_orderkey") % 50).cast("double"))))
    text = F.to_json(F.struct(F.col("o_orderkey").cast("bigint").alias("run_id"), F.col("o_orderdate").cast("date").cast("string").alias("created_at"), stats.alias("stats")))
    # Each ninth text is cut short.
    return o.select(F.when(F.col("o_orderkey") % 9 == 0, F.substring(text, 1, 20)).otherwise(text).alias("manifest"))


@query("SELECT o_orderkey AS run_id, o_orderdate::DATE::VARCHAR AS created_at, row_number() OVER (PARTITION BY year(o_orderdate::DATE) ORDER BY o_orderdate::DATE DESC, o_orderkey) AS place FROM orders WHERE o_orderkey % 9 <> 0")
def run_list(spark, sf_dir):
    """Runs of each year from the newest, without those whose manifest can't be read."""
    r = S.run_list(manifests(spark, sf_dir), MANIFEST)
    w = Window.partitionBy(F.substring("created_at", 1, 4)).orderBy(F.desc("created_at"), "run_id")
    return r.select("run_id", "created_at", F.row_number().over(w).alias("place"))


@query("SELECT o_orderkey AS run_id, o_custkey::DOUBLE AS frames, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 50)::DOUBLE END AS events, NULL::DOUBLE AS persons FROM orders WHERE o_orderkey % 9 <> 0")
def pass_stats(spark, sf_dir):
    """Numbers out of the manifests' nested statistics."""
    return S.pass_stats(S.run_list(manifests(spark, sf_dir), MANIFEST), {"frames": "p1.frames", "events": "p5.events", "persons": "p3.persons"})


# --- notes ---------------------------------------------------------------------------------


@query("""WITH f AS (SELECT user_id AS file, event_id AS line_no, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)
SELECT file, line_no, CASE WHEN file % 2 = 0 THEN CASE line_no % 4 WHEN 0 THEN 65.5 WHEN 1 THEN (line_no % 900)::DOUBLE END ELSE CASE line_no % 4 WHEN 0 THEN 65.5 END END::DOUBLE AS t,
  CASE WHEN file % 2 = 0 THEN CASE line_no % 4 WHEN 0 THEN 'smoke; "far" away' WHEN 1 THEN 'two' END ELSE CASE line_no % 4 WHEN 0 THEN '"smoke; ""far"" away"' END END AS note,
  CASE WHEN file % 2 = 0 THEN CASE line_no % 4 WHEN 2 THEN 'time' WHEN 3 THEN 'fields' END ELSE CASE line_no % 4 WHEN 0 THEN NULL ELSE 'line' END END AS reason
FROM f WHERE r > 1""")
def imported_notes(spark, sf_dir):
    """Note files with and without a header: notes, and the reason for each line that gave none."""
    e = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("line_no"))
    first = F.row_number().over(Window.partitionBy("file").orderBy("line_no")) == 1
    headed = F.col("file") % 2 == 0
    texts = [F.lit('"smoke; ""far"" away";\t1:05,5'), F.concat(F.lit("two;"), F.col("line_no") % 900, F.lit(";more")), F.lit("x;1:75"), F.lit("one field")]
    bare = [texts[0], F.lit("neither ; of both"), F.lit("x;1:75"), F.lit("one field")]
    at = (F.col("line_no") % 4 + 1).cast("int")
    line = F.when(first, F.when(headed, "﻿Anteckning;Tid").otherwise("# field notes")).when(headed, F.element_at(F.array(*texts), at)).otherwise(F.element_at(F.array(*bare), at))
    return N.import_notes(e.withColumn("line", line), ["file"]).select("file", "line_no", "t", "note", "reason")


# --- events and persons ----------------------------------------------------------------------


@query(f"""{IRRATIONAL_SQL}, hz AS ({HAZARD_EVENTS_SQL})
SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY t_start, category, event_id) AS place, event_id, category, t_start FROM (
  SELECT tracklet_id AS log_id, event_id, category, t_start FROM behavior UNION ALL SELECT tracklet_id, event_id, category, t_start FROM irr UNION ALL SELECT stream_id, event_id, category, t_start FROM hz)""")
def event_log(spark, sf_dir):
    """Behaviour, irrational and hazard events of each stream in one log, in the order of time."""
    key = lambda df, c: df.select(F.col(c).alias("log_id"), "event_id", "category", "t_start")
    # Events of behaviour go into the log and rule out irrational ones; they are few beside their rows.
    events = written(behavior(spark, sf_dir), "behavior")
    log = key(events, "tracklet_id").unionByName(key(irrational_beside(spark, sf_dir, events), "tracklet_id")).unionByName(key(hazard_events(spark, sf_dir), "stream_id"))
    place = F.row_number().over(Window.partitionBy("log_id").orderBy("t_start", "category", "event_id"))
    return log.select("log_id", place.alias("place"), "event_id", "category", "t_start")


PERSON_SQL = "SELECT run_id, tracklet_id, max(person_id) AS person_id FROM (SELECT DISTINCT run_id, tracklet_id, unnest([tracklet_id // 3, CASE WHEN tracklet_id % 4 = 1 THEN tracklet_id // 5 END]) AS person_id FROM tracklets) WHERE person_id IS NOT NULL GROUP BY run_id, tracklet_id"


def people(spark, sf_dir):
    """Made-up persons: three neighbouring tracklets each, and some of a second kind that share tracklets with them."""
    t = A.tracklets(spark, sf_dir).select("run_id", "tracklet_id").distinct()
    sets = t.withColumn("person_id", F.explode(F.array(F.expr("tracklet_id div 3"), F.when(F.col("tracklet_id") % 4 == 1, F.expr("tracklet_id div 5"))))).filter("person_id IS NOT NULL")
    return sets.groupBy("run_id", "person_id").agg(F.collect_set("tracklet_id").alias("tracklet_ids"))


@query(f"WITH {A.TRACKLETS_SQL}, p AS ({PERSON_SQL}) SELECT t.run_id, frame_no, t.tracklet_id, lower(cls) IN ('click', 'purchase') AS is_human, person_id FROM tracklets t LEFT JOIN p USING (run_id, tracklet_id) WHERE frame_no = 20")
def frame_view(spark, sf_dir):
    """The tracklets of one frame of each video, with their persons."""
    t = A.tracklets(spark, sf_dir).filter("frame_no = 20")
    rows = t.join(P.person_of_tracklet(people(spark, sf_dir)), ["run_id", "tracklet_id"], "left")
    return rows.select("run_id", "frame_no", "tracklet_id", F.lower("cls").isin("click", "purchase").alias("is_human"), "person_id")


@query(f"WITH {A.TRACKLETS_SQL} SELECT run_id, frame_no, count(*) AS n, list(det_id ORDER BY det_id) AS det_ids FROM tracklets GROUP BY run_id, frame_no")
def detections_by_frame(spark, sf_dir):
    t = A.tracklets(spark, sf_dir)
    return t.groupBy("run_id", "frame_no").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("det_id")).alias("det_ids"))


@query(f"WITH {A.TRACKLETS_SQL}, f AS (SELECT tracklet_id AS stream_id, scene_segment, (x0 + x1) / 2 AS x, y1 AS y, det_id % 7 >= 3 AS present FROM tracklets) SELECT stream_id, scene_segment, avg(x) AS danger_x, avg(y) AS danger_y, count(*) AS frames FROM f WHERE present GROUP BY stream_id, scene_segment")
def danger_points(spark, sf_dir):
    """The mean danger point of each stream and scene segment."""
    t = A.tracklets(spark, sf_dir)
    return H.danger_by_segment(t.select(F.col("tracklet_id").alias("stream_id"), "scene_segment", ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("y1").alias("y"), (F.col("det_id") % 7 >= 3).alias("present")))


@query(f"WITH {A.TRACKLETS_SQL} SELECT tracklet_id AS stream_id, round(avg((x0 + x1) / 2), 6) AS danger_x, round(avg(y1), 6) AS danger_y FROM tracklets WHERE det_id % 7 >= 3 GROUP BY tracklet_id")
def mean_danger(spark, sf_dir):
    t = A.tracklets(spark, sf_dir)
    return H.mean_danger(t.select(F.col("tracklet_id").alias("stream_id"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("y1").alias("y"), (F.col("det_id") % 7 >= 3).alias("present")))


# --- live ------------------------------------------------------------------------------------


@query(f"WITH {A.TRACKLETS_SQL}, p AS (SELECT run_id, tracklet_id, frame_no, list({{'x': (x0 + x1) / 2, 'y': y1}}) OVER (PARTITION BY run_id, tracklet_id ORDER BY frame_no ROWS 23 PRECEDING) AS t FROM tracklets) SELECT run_id, tracklet_id, frame_no, len(t)::INT AS n, t[1].x AS first_x, t[-1].y AS last_y FROM p")
def trails(spark, sf_dir):
    t = A.tracklets(spark, sf_dir).select("run_id", "tracklet_id", "frame_no", ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("y1").alias("y"))
    out = V.trails(t, ["run_id", "tracklet_id"], "frame_no")
    return out.select("run_id", "tracklet_id", "frame_no", F.size("trail").alias("n"), F.col("trail")[0]["x"].alias("first_x"), F.element_at("trail", -1)["y"].alias("last_y"))


@query(f"WITH {A.TRACKLETS_SQL}, l AS (SELECT run_id, cls, tracklet_id, (max(frame_no) - min(frame_no)) / {FPS} AS life FROM tracklets GROUP BY ALL) SELECT run_id, cls, count(*) FILTER (life >= 2) AS unique_count, count(*) AS seen FROM l GROUP BY run_id, cls")
def unique_totals(spark, sf_dir):
    return V.unique_totals(A.tracklets(spark, sf_dir), ["run_id", "cls"], FPS)


@query(f"WITH {A.TRACKLETS_SQL}, f AS (SELECT DISTINCT run_id, tracklet_id, frame_no FROM tracklets WHERE conf > 0.8), firsts AS (SELECT run_id, tracklet_id, min(frame_no) AS a FROM f GROUP BY ALL) SELECT run_id, frame_no, count(*) AS now, (SELECT count(*) FROM firsts x WHERE x.run_id = f.run_id AND x.a <= f.frame_no) AS total FROM f GROUP BY run_id, frame_no")
def signal_totals(spark, sf_dir):
    """How many tracks signal at each frame, and how many different ones have so far."""
    return V.signal_totals(A.tracklets(spark, sf_dir).filter("conf > 0.8").select("run_id", "tracklet_id", "frame_no"), ["run_id"])


@query(f"""WITH {A.TRACKLETS_SQL}, s AS (SELECT run_id, tracklet_id, frame_no, (x0 + x1) / 2 AS x, y1 AS y, (det_id % 9 - 4)::DOUBLE AS dx, (det_id % 50 - 10)::DOUBLE AS dy FROM tracklets),
o AS (SELECT *, sum(CASE WHEN abs(dx) < 30 AND abs(dy) < 30 THEN dx ELSE 0 END) OVER w AS off_x, sum(CASE WHEN abs(dx) < 30 AND abs(dy) < 30 THEN dy ELSE 0 END) OVER w AS off_y FROM s WINDOW w AS (PARTITION BY run_id, tracklet_id ORDER BY frame_no))
SELECT run_id, tracklet_id, frame_no, x - off_x AS stable_x, y - off_y AS stable_y FROM o""")
def stable_positions(spark, sf_dir):
    """Positions without the camera's drift."""
    t = A.tracklets(spark, sf_dir)
    s = t.select("run_id", "tracklet_id", "frame_no", ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("y1").alias("y"), (F.col("det_id") % 9 - 4).cast("double").alias("shift_x"), (F.col("det_id") % 50 - 10).cast("double").alias("shift_y"))
    return V.to_stable(K.offsets(s, ["run_id", "tracklet_id"], "frame_no", K.MOST_SHIFT * 120.0)).select("run_id", "tracklet_id", "frame_no", "stable_x", "stable_y")


@query(f"""WITH {A.TRACKLETS_SQL} SELECT run_id, frame_no, '{{"v":1,"frame_no":' || frame_no || ',"persons":[' || string_agg('{{"id":' || tracklet_id || ',"cls":"' || cls || '"}}', ',' ORDER BY tracklet_id) || ']}}' AS record FROM tracklets GROUP BY run_id, frame_no""")
def live_records(spark, sf_dir):
    return V.records(A.tracklets(spark, sf_dir), ["run_id"])


@query(f"""WITH {A.TRACKLETS_SQL}, s AS (SELECT run_id, tracklet_id, frame_no, CASE WHEN frame_no > 0 AND det_id % 13 = 0 THEN 1 ELSE 0 END AS cut, CASE WHEN frame_no > 0 THEN (det_id % 5)::DOUBLE ELSE 0 END AS dx FROM tracklets),
g AS (SELECT *, sum(cut) OVER (PARTITION BY run_id, tracklet_id ORDER BY frame_no) AS segment FROM s)
SELECT run_id, tracklet_id, frame_no, segment::INT AS segment, sum(CASE WHEN cut = 1 THEN 0 ELSE dx END) OVER (PARTITION BY run_id, tracklet_id, segment ORDER BY frame_no) AS shift_x FROM g""")
def scene_transforms(spark, sf_dir):
    """Segments and cumulative transforms of pairwise shifts, some of them lost."""
    t = A.tracklets(spark, sf_dir)
    one, zero = F.lit(1.0), F.lit(0.0)
    pair = F.when(F.col("det_id") % 13 != 0, F.array(one, zero, (F.col("det_id") % 5).cast("double"), zero, one, zero, zero, zero, one))
    out = K.scene_transforms(t.select("run_id", "tracklet_id", "frame_no", pair.alias("pairwise")), ["run_id", "tracklet_id"], "frame_no")
    return out.select("run_id", "tracklet_id", "frame_no", "segment", F.col("to_scene")[2].alias("shift_x"))


# --- the picture's motion ------------------------------------------------------------------

_MISS = "sqrt(({s}r * px - {s}i * py + {t}x - cx) ** 2 + ({s}i * px + {s}r * py + {t}y - cy) ** 2)"


@query(f"""WITH {A.TRACKLETS_SQL}, m AS (
  SELECT run_id, frame_no, tracklet_id, det_id, (x0 + x1) / 2 AS px, y1 AS py FROM tracklets
), pts AS MATERIALIZED (
  SELECT run_id, frame_no, px, py, CASE WHEN det_id % 5 = 0 THEN px * 0.3 + 90 ELSE 1.02 * px - 0.05 * py + 4 END AS cx, CASE WHEN det_id % 5 = 0 THEN 60 - py * 0.3 ELSE 0.05 * px + 1.02 * py - 3 END AS cy,
         row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY run_id, frame_no) AS n FROM m WINDOW w AS (PARTITION BY run_id, frame_no ORDER BY tracklet_id)
), picks AS (
  SELECT run_id, frame_no, h, a, (a + 1 + (h * 30011 + frame_no * 7919) % (n - 1)) % n AS b
  FROM (SELECT run_id, frame_no, n, h, (h * 40503 + frame_no * 2531 + {SC.SEED}) % n AS a FROM (SELECT DISTINCT run_id, frame_no, n FROM pts WHERE n >= {SC.LEAST_POINTS}), (SELECT unnest(range({SC.TRIES})) AS h))
), hyp AS MATERIALIZED (
  SELECT *, ax - sr * pxa + si * pya AS tx, ay - si * pxa - sr * pya AS ty FROM (
    SELECT k.run_id, k.frame_no, k.h, a.px AS pxa, a.py AS pya, a.cx AS ax, a.cy AS ay, ((b.px - a.px) * (b.cx - a.cx) + (b.py - a.py) * (b.cy - a.cy)) / d AS sr, ((b.px - a.px) * (b.cy - a.cy) - (b.py - a.py) * (b.cx - a.cx)) / d AS si
    FROM picks k JOIN pts a ON a.run_id = k.run_id AND a.frame_no = k.frame_no AND a.i = k.a JOIN pts b ON b.run_id = k.run_id AND b.frame_no = k.frame_no AND b.i = k.b, LATERAL (SELECT (b.px - a.px) ** 2 + (b.py - a.py) ** 2 AS d) WHERE d > 0)
), hits AS MATERIALIZED (
  SELECT p.*, y.h FROM hyp y JOIN pts p ON p.run_id = y.run_id AND p.frame_no = y.frame_no WHERE {_MISS.format(s="s", t="t")} <= {SC.NEAR}
), won AS (
  SELECT run_id, frame_no, h FROM hits GROUP BY run_id, frame_no, h QUALIFY row_number() OVER (PARTITION BY run_id, frame_no ORDER BY count(*) DESC, h) = 1
), own AS (
  SELECT t.*, avg(px) OVER g AS mpx, avg(py) OVER g AS mpy, avg(cx) OVER g AS mcx, avg(cy) OVER g AS mcy FROM hits t SEMI JOIN won USING (run_id, frame_no, h) WINDOW g AS (PARTITION BY run_id, frame_no)
), fit AS (
  SELECT *, mcx - fr * mpx + fi * mpy AS gx, mcy - fi * mpx - fr * mpy AS gy FROM (
    SELECT run_id, frame_no, any_value(mpx) AS mpx, any_value(mpy) AS mpy, any_value(mcx) AS mcx, any_value(mcy) AS mcy,
           sum((px - mpx) * (cx - mcx) + (py - mpy) * (cy - mcy)) / sum((px - mpx) ** 2 + (py - mpy) ** 2) AS fr, sum((px - mpx) * (cy - mcy) - (py - mpy) * (cx - mcx)) / sum((px - mpx) ** 2 + (py - mpy) ** 2) AS fi FROM own GROUP BY run_id, frame_no)
), judged AS (
  SELECT run_id, frame_no, any_value(fr) AS fr, any_value(fi) AS fi, any_value(gx) AS gx, any_value(gy) AS gy, count(*) AS agreeing, median({_MISS.format(s="f", t="g")}) AS error FROM own JOIN fit USING (run_id, frame_no) GROUP BY run_id, frame_no
), ok AS (
  SELECT run_id, frame_no, n AS points, coalesce(agreeing, 0) AS agreeing, error, fr, fi, gx, gy, coalesce(agreeing >= {SC.LEAST_POINTS} AND agreeing / n >= {SC.LEAST_SHARE} AND fr * fr + fi * fi BETWEEN {SC.LEAST_AREA} AND {SC.MOST_AREA} AND abs(gx) <= 90 AND abs(gy) <= 75, false) AS fair
  FROM (SELECT DISTINCT run_id, frame_no, n FROM pts) LEFT JOIN judged USING (run_id, frame_no)
)
SELECT run_id, frame_no, points, agreeing, CASE WHEN fair THEN round(agreeing / points * greatest(0, 1 - error / {SC.NO_CONFIDENCE}), 6) ELSE 0.0 END AS confidence,
       CASE WHEN fair THEN round((fr * gx + fi * gy) / (fr * fr + fi * fi), 5) END AS back_x, CASE WHEN fair THEN round((fr * gy - fi * gx) / (fr * fr + fi * fi), 5) END AS back_y FROM ok""")
def scene_fits(spark, sf_dir):
    """The motion between frames from matched places of which a fifth are wrong, and the shift of its inverse."""
    t = A.tracklets(spark, sf_dir).select("run_id", "frame_no", F.col("tracklet_id").alias("match_id"), "det_id", ((F.col("x0") + F.col("x1")) / 2).alias("px"), F.col("y1").alias("py"))
    px, py, wrong = F.col("px"), F.col("py"), F.col("det_id") % 5 == 0
    m = t.withColumn("cx", F.when(wrong, px * 0.3 + 90).otherwise(1.02 * px - 0.05 * py + 4)).withColumn("cy", F.when(wrong, 60 - py * 0.3).otherwise(0.05 * px + 1.02 * py - 3))
    fits = SC.pairwise_transforms(m, ["run_id"], 120.0, 100.0).withColumn("back", SC.inverse(F.col("pairwise")))
    return fits.select("run_id", "frame_no", F.col("points").cast("bigint").alias("points"), "agreeing", F.round("confidence", 6).alias("confidence"), F.round(-F.col("back")[2], 5).alias("back_x"), F.round(-F.col("back")[5], 5).alias("back_y"))
