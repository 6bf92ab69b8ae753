"""Exact duplicates by deterministic block naming.

Every text is cut into blocks of ``block_chars`` code points. Equal blocks get one integer
name: the blocks are sorted, and the name of a run of equal blocks is the smallest row number
in it. Then adjacent names of a document are paired and the pairs named in the same way, level
by level, until one name is left for each document. Texts are equal exactly if they have
as many blocks and the same last name; no hash decides anything.

The texts are shuffled once. A block that very many rows share is found by a count over
64-bit hashes (no text moves) and dealt over ``salts`` tasks; the names of its parts are then
made one. From the first level on only integers move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import pin

BLOCK_CHARS = 4096
SALTS = 64
HOT_ROWS = 256
HOT_KEYS = 4096


def _hot_keys(rows: DataFrame, code: str) -> DataFrame:
    """At most HOT_KEYS codes with over HOT_ROWS rows, the most frequent first."""
    return (
        rows.groupBy(F.col(code).alias("hot_code"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > HOT_ROWS)
        .orderBy(F.desc("n"), "hot_code")
        .limit(HOT_KEYS)
        .select("hot_code", F.lit(True).alias("hot"))
    )


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``name`` to rows with ``row_no``: the smallest row_no among rows of equal ``keys``.

    Frequent keys are dealt over SALTS parts first. Only a frequent key's part leaders meet
    again, at most SALTS of them for each key.
    """
    rows = rows.withColumn("code", F.xxhash64(*keys))
    hot = F.broadcast(_hot_keys(rows, "code"))  # at most HOT_KEYS rows of 9 bytes
    dealt = rows.join(hot, rows["code"] == hot["hot_code"], "left").drop("hot_code").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row_no"), F.lit(SALTS)).cast("int")).otherwise(F.lit(-1))
    )
    run = Window.partitionBy(*keys, "salt").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    led = dealt.withColumn("leader", F.first("row_no").over(run))
    kept = [c for c in rows.columns if c not in (*keys, "code")]
    # Keys leave here, except with the leaders of frequent keys.
    thin = pin(
        led.select(
            *kept, "salt", "leader", *(F.when((F.col("salt") >= 0) & (F.col("leader") == F.col("row_no")), F.col(k)).alias(k) for k in keys)
        ),
        "named",
    )
    lead = thin.filter((F.col("salt") >= 0) & (F.col("leader") == F.col("row_no")))
    same = lead.select(F.col("leader").alias("part"), F.min("leader").over(Window.partitionBy(*keys)).alias("whole"))
    # Rows of one part share a leader; a second, finer deal keeps this join even too.
    cold = thin.filter(F.col("salt") < 0).select(*kept, F.col("leader").alias("name"))
    warm = thin.filter(F.col("salt") >= 0).join(F.broadcast(same), F.col("leader") == F.col("part")).select(*kept, F.col("whole").alias("name"))
    return cold.unionByName(warm)


def name_documents(docs: DataFrame, text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Give each row of ``docs`` a collision-free identity of its text.

    Returns ``row_no`` (a number for each input row), the columns of ``docs`` except the text,
    ``n_blocks`` and ``name``; equal (n_blocks, name) means equal text. A null text counts as
    empty; the empty text has one empty block. The number of rounds is the logarithm of the
    largest number of blocks, and documents leave as soon as they have one name.
    """
    others = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    blocks = (
        docs.select(*(F.col(c).alias(f"of_{c}") for c in others), text.alias("block_text"))
        .withColumn("doc_row", F.monotonically_increasing_id())
        .withColumn("cut", F.when(F.col("block_text") == "", F.array(F.lit(""))).otherwise(F.expr(f"regexp_extract_all(block_text, '(?s).{{1,{int(block_chars)}}}', 0)")))
        .select("doc_row", F.struct(*(F.col(f"of_{c}") for c in others)).alias("of") if others else F.lit(None).cast("int").alias("of"), F.size("cut").alias("n_blocks"), F.posexplode("cut").alias("pos", "block"))
        # The other columns travel with the first block alone.
        .withColumn("of", F.when(F.col("pos") == 0, F.col("of")))
        .withColumn("row_no", F.monotonically_increasing_id())
    )
    level, left = _named(blocks, ["block"]), "n_blocks"
    level = level.withColumn("left", F.col(left))
    done, spark, rounds = None, docs.sparkSession, 0
    while True:
        level = pin(level.select("doc_row", "of", "n_blocks", "left", "pos", "name"), "level")
        ended = level.filter(F.col("left") <= 1)
        done = ended if done is None else done.unionByName(ended)
        level = level.filter(F.col("left") > 1)
        if level.isEmpty():
            break
        rounds += 1
        pairs = (
            level.groupBy("doc_row", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(
                F.first("of", ignorenulls=True).alias("of"),
                F.first("n_blocks").alias("n_blocks"),
                F.first("left").alias("left"),
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("name_a"),
                F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("name_b"),
            )
            .withColumn("left", F.expr("(left + 1) div 2").cast("int"))
            # No second name: -1, which no block has.
            .withColumn("name_b", F.coalesce("name_b", F.lit(-1)))
        )
        level = _named(pin(pairs, "pairs").withColumn("row_no", F.monotonically_increasing_id()), ["name_a", "name_b"])
    return done.select(F.col("doc_row").alias("row_no"), *(F.col("of")[f"of_{c}"].alias(c) for c in others), "n_blocks", "name")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of rows with equal text the one with the largest id stays; a null id is smaller than any
    other, and of rows that share text and id exactly one stays. A null text counts as empty,
    and empty texts are equal. Columns other than id and text are ignored. An empty table gives
    an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("sha", F.sha2(F.encode("text", "UTF-8"), 256))
    named = pin(name_documents(rows, "text", block_chars), "identities")
    best = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("id"), F.col("row_no"))
    groups = pin(
        named.groupBy("n_blocks", "name").agg(F.max(best).alias("best"), F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
        "groups",
    )
    # Both sides are read from files and exchanged, so that a group of very many copies can be split.
    return (
        named.join(groups, ["n_blocks", "name"])
        .select(F.col("doc_id").alias(id_col), "keep_id", "group_size", (F.col("best.row_no") == F.col("row_no")).alias("kept"), F.col("sha").alias("text_sha256"))
    )
