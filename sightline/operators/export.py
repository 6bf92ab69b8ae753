"""Events with their person and evidence, as rows of an export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an event nobody has looked at says of its review.
UNREVIEWED = '{"state": "unreviewed", "note": null, "reviewer": null, "reviewed_at": null}'


def with_persons(events: DataFrame, persons: DataFrame) -> DataFrame:
    """Events with ``person_id`` of their tracklet (run_id, tracklet_id, person_id), null where it has none."""
    return events.join(persons, ["run_id", "tracklet_id"], "left")


def evidence_json(fields: dict[str, Column]) -> Column:
    """A JSON object of the fields in their order, with a space behind each comma and colon."""
    parts = [F.concat(F.lit(f'"{name}": '), F.coalesce(value.cast("string"), F.lit("null"))) for name, value in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def behavior_evidence() -> Column:
    """What an event of stillness or of motion toward danger stands on."""
    whole = {c: F.col(c) for c in ("tracklet_id", "frame_start", "frame_end")}
    return evidence_json(whole | {"duration_s": F.round("duration_s", 3), "avg_speed": F.regexp_replace(F.format_string("%.4f", "avg_speed"), r"(\.\d+?)0+$", "$1"), "prone_majority": F.col("prone_majority"), "samples": F.col("samples")})


def csv_rows(events: DataFrame) -> DataFrame:
    """The eight columns of an export, with the run: a null person is an empty text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return events.select("run_id", "event_id", "category", text("person_id").alias("person_id"), text("t_start").alias("t_start"), text("t_end").alias("t_end"), F.round("confidence", 6).alias("confidence"), behavior_evidence().alias("evidence"), F.lit(UNREVIEWED).alias("review"))
