"""Times and texts of field notes, parsed line by line with SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How times are written.
_CLOCK = r"^(?:(\d+):)?(\d{1,2}):(\d{2}(?:[.,]\d+)?)$"
_SECONDS = r"^\d+(?:[.,]\d+)?$"
#: Names of the columns in a file's header.
TIME_NAMES = ("t", "tid", "time", "tidpunkt", "klockslag")
TEXT_NAMES = ("text", "anteckning", "note", "notering", "kommentar", "beskrivning")
_BLANK = " \t\r\n\f\u000b\u00a0"


def seconds_of(token: Column) -> Column:
    """Seconds of a [H:]MM:SS(.f) or plain number token, comma or point for decimals; null for anything else."""
    t = F.trim(token, F.lit(_BLANK))
    part = lambda i: F.regexp_extract(t, _CLOCK, i)
    minutes, secs = part(2).try_cast("double"), F.replace(part(3), F.lit(","), F.lit(".")).try_cast("double")
    clock = F.coalesce(part(1).try_cast("double"), F.lit(0.0)) * 3600 + minutes * 60 + secs
    return F.when(F.rlike(t, F.lit(_CLOCK)), F.when((minutes < 60) & (secs < 60), clock)).when(F.rlike(t, F.lit(_SECONDS)), F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))


def _around_last(line: Column, mark: str) -> tuple[Column, Column]:
    at = F.length(line) - F.locate(mark, F.reverse(line)) + 1
    return F.trim(F.substr(line, F.lit(1), at - 1), F.lit(_BLANK)), F.trim(F.substr(line, at + 1, F.length(line)), F.lit(_BLANK))


def parse_notes(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Add ``t`` and ``note`` to lines that have a time and a text on the two sides of their last semicolon,
    else of their last comma, in either order; blank lines and lines with # are left out, others keep nulls."""
    line = F.trim(F.col(line_col), F.lit(_BLANK))
    found = []
    for mark in ";", ",":
        left, right = _around_last(line, mark)
        has = F.contains(line, F.lit(mark))
        found += [F.when(has & seconds_of(right).isNotNull() & (left != ""), F.struct(seconds_of(right).alias("t"), left.alias("note")))]
        found += [F.when(has & seconds_of(left).isNotNull() & (right != ""), F.struct(seconds_of(left).alias("t"), right.alias("note")))]
    kept = lines.filter((line != "") & ~F.startswith(line, F.lit("#")))
    return kept.withColumn("__p", F.coalesce(*found)).withColumn("t", F.col("__p.t")).withColumn("note", F.col("__p.note")).drop("__p")


def _fields(line: Column, mark: Column) -> Column:
    """The fields of a line; a field in double quotes may hold the mark, and a doubled quote in it is one."""
    quoted = F.concat(F.lit('(?:"(?:[^"]|"")*"|[^'), mark, F.lit(']*)(?:'), mark, F.lit("|$)"))
    raw = F.regexp_extract_all(F.concat(line, mark), quoted, F.lit(0))
    bare = F.transform(F.filter(raw, lambda x: x != ""), lambda x: F.trim(F.substr(x, F.lit(1), F.length(x) - 1), F.lit(_BLANK)))
    return F.transform(bare, lambda x: F.when(F.rlike(x, F.lit('^".*"$')), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def import_notes(lines: DataFrame, file_cols: list[str], line_no: str = "line_no", line_col: str = "line") -> DataFrame:
    """Notes of whole files: ``t`` and ``note``, or the ``reason`` why a line gave none.

    A file whose first line that is neither blank nor a comment names a time and a text column has
    rows of these columns; other files have lines as parse_notes reads them. Blank lines, comments
    and headers are left out. A byte order mark before a file's first line is none of its text. Reasons: fields, time, text, line.
    """
    starts = lines.groupBy(*file_cols).agg(F.min(line_no).alias("__start"))
    bare = F.when(F.col(line_no) == F.col("__start"), F.regexp_replace(F.col(line_col), "^\ufeff+", "")).otherwise(F.col(line_col))
    lines = lines.join(starts, file_cols).withColumn("__raw", F.col(line_col)).withColumn(line_col, bare).drop("__start")
    kept = lines.withColumn("__line", F.trim(F.col(line_col), F.lit(_BLANK))).filter("__line <> '' AND NOT startswith(__line, '#')")
    first = kept.groupBy(*file_cols).agg(F.min(F.struct(F.col(line_no).alias("no"), F.col("__line").alias("line"))).alias("__first"))
    place = lambda mark, names: F.expr(f"get(filter(sequence(0, size(split(__first.line, '{mark}')) - 1), i -> array_contains(array({', '.join(repr(n) for n in names)}), lower(trim(split(__first.line, '{mark}')[i])))), 0)")
    heads = [F.when(place(m, TIME_NAMES).isNotNull() & place(m, TEXT_NAMES).isNotNull(), F.struct(F.lit(m).alias("mark"), place(m, TIME_NAMES).alias("t"), place(m, TEXT_NAMES).alias("text"))) for m in (";", ",")]
    known = first.select(*file_cols, F.col("__first.no").alias("__no"), F.coalesce(*heads).alias("__head"))
    rows = kept.join(known, file_cols).filter(F.col("__head").isNull() | (F.col(line_no) != F.col("__no")))
    rows = parse_notes(rows, line_col).withColumn("__f", F.when(F.col("__head").isNotNull(), _fields(F.col("__line"), F.col("__head.mark"))))
    short = F.size("__f") <= F.greatest("__head.t", "__head.text")
    time, text = seconds_of(F.get("__f", F.col("__head.t"))), F.get("__f", F.col("__head.text"))
    headed = F.col("__head").isNotNull()
    reason = F.when(headed, F.when(short, "fields").when(time.isNull(), "time").when(text == "", "text")).otherwise(F.when(F.col("t").isNull(), "line"))
    out = rows.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return out.withColumn("t", F.when(ok, F.when(headed, time).otherwise(F.col("t")))).withColumn("note", F.when(ok, F.when(headed, text).otherwise(F.col("note")))).withColumn(line_col, F.col("__raw")).drop("__line", "__no", "__head", "__f", "__raw")
