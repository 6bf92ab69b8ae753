"""Settings as JSON: one text for equal settings, its hash, and the places where two differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
_TOKEN = r'"(?:[^"\\]|\\.)*"|' + _NUMBER + r"|true|false|null|[{}\[\],:]"
_MARK = "\u0001"


def _number(token: Column) -> Column:
    """The shortest way to write a number: no zeros at the end of a fraction, exponents with a sign and two digits."""
    t = F.regexp_replace(token, r"^(-?\d+\.\d*?[1-9])0+(?=$|[eE])", "$1")
    t = F.regexp_replace(t, r"^(-?\d+\.0)0+(?=$|[eE])", "$1")
    t = F.regexp_replace(t, r"\.0(?=[eE])", "")
    t = F.regexp_replace(F.regexp_replace(t, "E", "e"), r"e(\d)", r"e+$1")
    return F.regexp_replace(t, r"e([+-])(\d)$", r"e$10$2")


def _ascii(text: Column) -> Column:
    """Characters beyond ASCII as escapes of four hexadecimal digits; those beyond 16 bits as two of them."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(c: Column) -> Column:
        n = F.ascii(c)
        pair = F.concat(unit((F.lit(0xD7C0) + F.shiftright(n, 10)).cast("bigint")), unit((F.lit(0xDC00) + n % 1024).cast("bigint")))
        return F.when(n < 128, c).when(n < 65536, unit(n.cast("bigint"))).otherwise(pair)

    return F.when(F.rlike(text, F.lit(r"^\p{ASCII}*$")), text).otherwise(F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), escaped), ""))


def canonical_json(text: Column) -> Column:
    """The JSON ``text`` without white space, its objects' keys in order at every depth, ASCII only; null if it is no JSON
    or an object has a key twice. Numbers keep the digits that they are written with, but for zeros at the end."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    # Numbers travel as marked texts, so that parsing doesn't write them in its own way.
    marked = F.transform(tokens, lambda t: F.when(F.rlike(t, F.lit(f"^{_NUMBER}$")), F.concat(F.lit('"\\u0001'), _number(t), F.lit('"'))).otherwise(t))
    valid = F.try_parse_json(text).isNotNull()
    # Parsed variants hold their keys in order.
    sorted_text = F.to_json(F.try_parse_json(F.array_join(marked, "")))
    return F.when(valid, _ascii(F.regexp_replace(sorted_text, r'"\\u0001([^"]*)"', "$1")))


def settings_hash(text: Column) -> Column:
    """16 hexadecimal digits of the SHA-256 of the canonical text."""
    return F.substring(F.sha2(canonical_json(text), 256), 1, 16)


#: Levels of nesting that settings may have.
DEEPEST = 64


def _depth(text: Column) -> Column:
    """How deep brackets are nested in a JSON text."""
    brackets = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', ""), r"[^{}\[\]]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, step, lambda s: s["most"])


def flattened(settings: DataFrame, keys: list[str], json_col: str) -> DataFrame:
    """The keys, path and value of each place in a JSON text: names joined by points, elements of lists by their number;
    values as JSON; the whole text has an empty path. Empty objects and lists are values. Texts are parsed once; each level of
    nesting that the deepest of them has unfolds the rows that are still nested, in the same pass."""
    rows = settings.select(*keys, F.lit("").alias("path"), F.col(json_col).alias("text"), F.try_parse_json(json_col).alias("value")).filter("value IS NOT NULL")
    depth = rows.agg(F.max(_depth(F.col("text")))).first()[0] or 0
    if depth > DEEPEST:
        raise ValueError(f"settings are nested more than {DEEPEST} deep")
    place = lambda part, value: F.struct(F.when(F.col("path") == "", part).otherwise(F.concat_ws(".", "path", part)).alias("path"), value.alias("value"))
    rows = rows.drop("text")
    for _ in range(depth):
        members = F.transform(F.map_entries(F.try_variant_get("value", "$", "map<string,variant>")), lambda e: place(e["key"], e["value"]))
        items = F.transform(F.try_variant_get("value", "$", "array<variant>"), lambda v, i: place(i.cast("string"), v))
        first = F.substring(F.to_json("value"), 1, 2)
        inner = F.when(first.isin("{}", "[]"), None).when(first.startswith("{"), members).when(first.startswith("["), items)
        rows = rows.select(*keys, F.inline(F.coalesce(inner, F.array(F.struct("path", "value")))))
    return rows.select(*keys, "path", F.to_json("value").alias("value"))


def differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The places (the keys and path) of two ``flattened`` tables whose values differ: value_a, value_b, null where one has none."""
    both = left.withColumnRenamed("value", "value_a").join(right.withColumnRenamed("value", "value_b"), [*keys, "path"], "full")
    return both.filter(~F.col("value_a").eqNullSafe(F.col("value_b")))
