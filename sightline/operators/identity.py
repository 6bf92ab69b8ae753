"""Persons from tracklets: centroids, pair gates, constrained greedy merging, corrections."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Defaults of the merge gates and the confirmation.
SIM, GAP_MAX_S, DIST, CONFIRM_S, BAND = 0.86, 60.0, 0.45, 2.0, 0.04


def centroids(tracklets: DataFrame, detections: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """The normalised mean of each tracklet's unit vectors, one for each embedding method, and their number.

    ``detections``: det_id, embedding_method, embedding; or, with ``vectors`` (vec_id, embedding), their vec_id instead of the
    vector itself, so that rows without vectors move and each vector meets its tracklet's rows where they are summed. Each
    component is a sum of its own: no row is made of it.
    """
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
    source, keys = detections if vectors is None else vectors, ["run_id", "tracklet_id", "embedding_method"]
    sized = source.withColumn("size", norm("embedding")).filter("size > 0")
    units = sized.withColumn("unit", F.transform("embedding", lambda v: v / F.col("size"))).drop("embedding", "size")
    seen = tracklets.select("run_id", "tracklet_id", "det_id")
    if vectors is None:
        j = seen.join(units, "det_id")
    else:
        j = seen.join(detections.select("det_id", "embedding_method", "vec_id"), "det_id").select(*keys, "vec_id").repartition(*keys).join(units, "vec_id")
    width = source.agg(F.max(F.size("embedding"))).first()[0] or 0
    sums = [F.sum(F.get("unit", F.lit(i))).alias(f"s{i}") for i in range(max(width, 1))]
    vec = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    vec = vec.select(*keys, F.filter(F.array(*(f"s{i}" for i in range(len(sums)))), lambda v: v.isNotNull()).alias("sum"), "n")
    return vec.select(*keys, F.transform("sum", lambda v: v / F.greatest(norm("sum"), F.lit(1e-300))).alias("centroid"), "n")


def profiles(tracklets: DataFrame, fps: float) -> DataFrame:
    """Each tracklet's frames, ends, and box centres and scene segments at its ends."""
    at = F.struct("frame_no", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), "scene_segment")
    return tracklets.groupBy("run_id", "tracklet_id").agg(
        F.min(at).alias("start"), F.max(at).alias("end"), F.collect_set("frame_no").alias("frames"),
        (F.min("frame_no") / F.lit(fps)).alias("first_seen"), (F.max("frame_no") / F.lit(fps)).alias("last_seen"),
    )


def pair_gates(profile: DataFrame, centroid: DataFrame, diag: float, sim: float = SIM, gap_max: float = GAP_MAX_S, dist: float = DIST, scenes: bool = False) -> DataFrame:
    """Each pair of tracklets of a run with its similarity, gap, distance and the first gate that stops it.

    Gates in order: temporal_overlap, appearance, gap, scene_segment (with ``scenes``), spatial; else mergeable.
    """
    c = centroid.groupBy("run_id", "tracklet_id").agg(F.map_from_entries(F.collect_list(F.struct("embedding_method", "centroid"))).alias("by_method"))
    p = profile.join(c, ["run_id", "tracklet_id"], "left")
    a, b = (p.select("run_id", *(F.col(k).alias(f"{k}_{s}") for k in p.columns if k != "run_id")) for s in "ab")
    j = a.join(b, "run_id").filter("tracklet_id_a < tracklet_id_b")
    dot = lambda m: F.aggregate(F.zip_with(F.col("by_method_a")[m], F.col("by_method_b")[m], lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    shared = F.array_intersect(F.map_keys("by_method_a"), F.map_keys("by_method_b"))
    j = j.withColumn("sim", F.array_max(F.transform(shared, dot)))
    a_first = F.col("last_seen_a") <= F.col("first_seen_b")
    j = j.withColumn("gap_s", F.when(a_first, F.col("first_seen_b") - F.col("last_seen_a")).otherwise(F.col("first_seen_a") - F.col("last_seen_b")))
    end, start = F.when(a_first, F.col("end_a")).otherwise(F.col("end_b")), F.when(a_first, F.col("start_b")).otherwise(F.col("start_a"))
    j = j.withColumn("dist", G.distance(start["cx"] - end["cx"], start["cy"] - end["cy"])).withColumn("dist_limit", dist * diag * (1 + F.col("gap_s")))
    rule = (
        F.when(F.arrays_overlap("frames_a", "frames_b"), "blocked:temporal_overlap").when(F.col("sim").isNull() | (F.col("sim") < sim), "blocked:appearance")
        .when((F.col("gap_s") < 0) | (F.col("gap_s") > gap_max), "blocked:gap").when(F.lit(scenes) & (start["scene_segment"] != end["scene_segment"]), "blocked:scene_segment")
        .when(F.col("dist") > F.col("dist_limit"), "blocked:spatial").otherwise("mergeable")
    )
    return j.select("run_id", F.col("tracklet_id_a").alias("a"), F.col("tracklet_id_b").alias("b"), "sim", "gap_s", "dist", "dist_limit", rule.alias("rule"))


def _associated(profile: DataFrame, centroid: DataFrame, schema: str, rows_of, diag: float, sim: float, gap_max: float, dist: float, band: float, scenes: bool) -> DataFrame:
    """Greedy merging of tracklets, one run (video) in a task: runs are spread.

    In each round the most similar mergeable pair of clusters becomes one (smaller gap, then smaller
    ids first): its centroids are averaged by their counts, its frames united. Clusters that share
    a frame never merge. A blocked pair with a similarity of at least sim - band is an
    uncertain one, noted once. Similarities are kept in a matrix, so that a merge costs one row.
    ``rows_of(run_id, people, merged, blocked)`` makes the rows of ``schema``.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def merge(key, pdf):
        import numpy as np
        import pandas as pd

        clusters = {}
        for r in pdf.sort_values("tracklet_id").itertuples():
            vecs = {m: np.array(v) for m, v in zip(r.methods, r.vectors, strict=True)} if r.methods is not None else {}
            part = (r.first_seen, r.last_seen, tuple(r.start.values()) if isinstance(r.start, dict) else tuple(r.start), tuple(r.end.values()) if isinstance(r.end, dict) else tuple(r.end), frozenset(r.frames))
            clusters[int(r.tracklet_id)] = {"ids": [int(r.tracklet_id)], "parts": [part], "frames": set(r.frames), "vec": vecs, "n": dict(zip(vecs, r.counts if r.methods is not None else [], strict=True))}

        def likeness(a, b):
            return max((float(a["vec"][m] @ b["vec"][m]) for m in a["vec"].keys() & b["vec"].keys()), default=None)

        def bridge(a, b):
            best = None
            for pa in a["parts"]:
                for pb in b["parts"]:
                    if pa[4] & pb[4]:
                        continue
                    early, late = (pa, pb) if pa[1] <= pb[0] else (pb, pa)
                    gap = late[0] - early[1]
                    s, e = late[2], early[3]
                    if best is None or gap < best[0]:
                        best = (gap, float(np.hypot(s[1] - e[1], s[2] - e[2])), s[3] is None or e[3] is None or s[3] == e[3])
            return best

        ids = sorted(clusters)
        like = {(a, b): likeness(clusters[a], clusters[b]) for i, a in enumerate(ids) for b in ids[i + 1 :]}
        merged, blocked = [], {}

        def gate(a, b):
            s = like[a, b]
            if s is None or s < sim - band:
                return None
            ca, cb = clusters[a], clusters[b]
            if ca["frames"] & cb["frames"]:
                blocked.setdefault((a, b), ("blocked:temporal_overlap", a, b, s, 0.0, 0.0, 0.0))
                return None
            gap, far, near = bridge(ca, cb)
            limit = dist * diag * (1 + gap)
            tests = {"appearance": s >= sim, "gap": 0 <= gap <= gap_max, "scene_segment": near or not scenes, "spatial": far <= limit}
            stops = [name for name, passed in tests.items() if not passed]
            if stops:
                blocked.setdefault((a, b), (f"blocked:{stops[0]}", a, b, s, gap, far, limit))
                return None
            return (-s, gap, a, b, far, limit)

        rule = {p: g for p in like if (g := gate(*p))}
        while rule:
            s, gap, a, b, far, limit = min(rule.values())
            merged.append(("merged", a, b, -s, gap, far, limit))
            ca, cb = clusters[a], clusters.pop(b)
            for m, v in cb["vec"].items():
                na, nb = ca["n"].get(m, 0), cb["n"][m]
                w = v if m not in ca["vec"] else (ca["vec"][m] * na + v * nb) / max(na + nb, 1)
                size = np.linalg.norm(w)
                ca["vec"][m], ca["n"][m] = (w / size if size > 0 else w), na + nb
            ca["ids"] += cb["ids"]
            ca["parts"] += cb["parts"]
            ca["frames"] |= cb["frames"]
            for p in [p for p in like if a in p or b in p]:
                del like[p]
                rule.pop(p, None)
            for c in clusters:
                if c != a:
                    p = (min(a, c), max(a, c))
                    like[p] = likeness(clusters[p[0]], clusters[p[1]])
                    if g := gate(*p):
                        rule[p] = g
        people = sorted((min(x[0] for x in c["parts"]), min(c["ids"]), max(x[1] for x in c["parts"]), sorted(c["ids"])) for c in clusters.values())
        return pd.DataFrame(rows_of(key[0], people, merged, list(blocked.values())), columns=names)

    c = centroid.groupBy("run_id", "tracklet_id").agg(F.array_sort(F.collect_list(F.struct("embedding_method", "centroid", "n"))).alias("v"))
    c = c.select("run_id", "tracklet_id", F.col("v.embedding_method").alias("methods"), F.col("v.centroid").alias("vectors"), F.col("v.n").alias("counts"))
    j = profile.join(c, ["run_id", "tracklet_id"], "left")
    return j.groupBy("run_id").applyInPandas(merge, schema)


def persons(profile: DataFrame, centroid: DataFrame, diag: float, sim: float = SIM, gap_max: float = GAP_MAX_S, dist: float = DIST, confirm_s: float = CONFIRM_S, band: float = BAND, scenes: bool = False) -> DataFrame:
    """The persons of each run, numbered from 1 by first sight, then by their smallest tracklet; ``uncertain`` counts
    the run's uncertain pairs. One who is seen for ``confirm_s`` is confirmed."""

    def rows_of(run_id, people, merged, blocked):
        return [(run_id, i + 1, ids, first, last, "confirmed" if last - first >= confirm_s else "transient", len(blocked)) for i, (first, _, last, ids) in enumerate(people)]

    schema = "run_id bigint, person_id int, tracklet_ids array<bigint>, first_seen double, last_seen double, state string, uncertain int"
    return _associated(profile, centroid, schema, rows_of, diag, sim, gap_max, dist, band, scenes)


def association_audit(profile: DataFrame, centroid: DataFrame, diag: float, sim: float = SIM, gap_max: float = GAP_MAX_S, dist: float = DIST, band: float = BAND, scenes: bool = False) -> DataFrame:
    """Why clusters were merged or kept apart, one row for each merge and each uncertain pair, under the person that
    holds the first cluster. ``place`` orders a person's rows: merges first, falling similarity, ids."""

    def rows_of(run_id, people, merged, blocked):
        person = {t: i + 1 for i, p in enumerate(people) for t in p[3]}
        rows, places = sorted(merged + blocked, key=lambda r: (r[0] != "merged", -r[3], r[1], r[2])), {}
        out = []
        for r in rows:
            who = person[r[1]]
            places[who] = places.get(who, 0) + 1
            out.append((run_id, who, places[who], *r))
        return out

    schema = "run_id bigint, person_id int, place int, rule string, a bigint, b bigint, sim double, gap_s double, dist double, dist_limit double"
    return _associated(profile, centroid, schema, rows_of, diag, sim, gap_max, dist, band, scenes)


def person_of_tracklet(person: DataFrame) -> DataFrame:
    """(run_id, tracklet_id, person_id); of several persons the largest."""
    return person.select("run_id", "person_id", F.explode("tracklet_ids").alias("tracklet_id")).groupBy("run_id", "tracklet_id").agg(F.max("person_id").alias("person_id"))


def apply_corrections(person: DataFrame, corrections: DataFrame, spans: DataFrame) -> DataFrame:
    """Replay merges and splits, in log order, over the persons of each run.

    ``corrections``: run_id, seq, action ('merge' with ``keys``, lists of tracklet ids; 'split' with ``keys``
    holding the person's set and the part to detach). Persons are named by their set of tracklets, so
    renumbering does no harm. A correction that names no one person is skipped. ``spans``: first and
    last second of each tracklet.
    """

    def run(key, people, log, span):
        import pandas as pd

        seen = {int(r.tracklet_id): (r.first_s, r.last_s) for r in span.itertuples()}
        now = {int(r.person_id): {"ids": sorted(map(int, r.tracklet_ids)), "first": r.first_seen, "last": r.last_seen, "state": r.state} for r in people.itertuples()}

        def find(ids):
            hit = [p for p, x in now.items() if x["ids"] == sorted(set(ids))]
            return hit[0] if len(hit) == 1 else None

        def span_of(ids):
            known = [seen[i] for i in ids if i in seen]
            return (round(min(a for a, _ in known), 4), round(max(b for _, b in known), 4)) if known else (None, None)

        for r in log.sort_values("seq").itertuples():
            sets = [sorted({int(i) for i in k}) for k in json.loads(r.keys)]
            if r.action == "merge":
                found = [find(s) for s in sets]
                if len({tuple(s) for s in sets}) < 2 or None in found:
                    continue
                keep, rest = min(found), [p for p in set(found) if p != min(found)]
                group = [now[keep], *(now.pop(p) for p in rest)]
                now[keep] = {"ids": sorted({i for g in group for i in g["ids"]}), "first": min(g["first"] for g in group), "last": max(g["last"] for g in group), "state": "manual"}
            elif r.action == "split" and len(sets) == 2:
                who, part = find(sets[0]), set(sets[1])
                if who is None or not part or not part < set(now[who]["ids"]):
                    continue
                stay, new = sorted(set(now[who]["ids"]) - part), max(now) + 1
                for p, ids in ((who, stay), (new, sorted(part))):
                    first, last = span_of(ids)
                    now[p] = {"ids": ids, "first": now[who]["first"] if first is None else first, "last": now[who]["last"] if last is None else last, "state": "manual"}
        made = [(key[0], p, x["ids"], x["first"], x["last"], x["state"]) for p, x in sorted(now.items())]
        return pd.DataFrame(made, columns=["run_id", "person_id", "tracklet_ids", "first_seen", "last_seen", "state"])

    schema = "run_id bigint, person_id int, tracklet_ids array<bigint>, first_seen double, last_seen double, state string"
    # Persons and log rows of one run meet; both carry the spans along as rows of their own.
    people = person.select(F.col("run_id").alias("run"), "person_id", "tracklet_ids", "first_seen", "last_seen", "state")
    both = corrections.select("run_id", "seq", "action", "keys").unionByName(
        spans.select("run_id", F.col("tracklet_id").alias("seq"), F.lit("span").alias("action"), F.to_json(F.struct("first_s", "last_s")).alias("keys"))
    )

    def cogrouped(key, left, right):
        import pandas as pd

        s = right[right["action"] == "span"]
        ends = pd.DataFrame([(int(i), *json.loads(k).values()) for i, k in zip(s["seq"], s["keys"], strict=True)], columns=["tracklet_id", "first_s", "last_s"])
        return run(key, left, right[right["action"] != "span"], ends)

    # The log may be made of the persons: a new name keeps the two sides' columns apart.
    return people.groupBy("run").cogroup(both.select(F.col("run_id").alias("log_run"), "seq", "action", "keys").groupBy("log_run")).applyInPandas(cogrouped, schema)


def number_persons(person: DataFrame) -> DataFrame:
    """Persons numbered from 1 by first sight, then by their smallest tracklet."""
    return person.withColumn("number", F.row_number().over(Window.partitionBy("run_id").orderBy("first_seen", F.array_min("tracklet_ids"))))
