"""Exact deduplication by deterministic block naming.

A text is cut into fixed-size blocks. The distinct blocks are sorted and numbered, which names each
block by an integer that no other block has. Adjacent names are then paired, the distinct pairs
sorted and numbered in turn, and so on until one name is left of each document: equal names at the
same height mean equal texts, without any chance of a collision.

Texts cross the network once, as distinct blocks, combined before the shuffle. Blocks find their
names again by digest and length; should two different blocks ever share those, they are told
apart by their content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, packed, partitions, ready, table, unpacked

#: Code points in a block.
BLOCK = 8192


def _named_blocks(blocks: DataFrame) -> DataFrame:
    """(digest, size, block, name, shared): the distinct blocks in sorted order with their integer names."""
    n = partitions(blocks.sparkSession)
    # By ranges of the digest, which is in equal use everywhere, so that blocks are in sorted order from the first partition to the last.
    distinct = blocks.select("digest", "size", "block").distinct()
    first = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    dealt = distinct.withColumn("range", (first * n / F.lit(1 << 32)).cast("int")).repartitionById(n, "range")
    return dealt.sortWithinPartitions("digest", "size", "block").withColumn("name", F.monotonically_increasing_id())


def _block_names(blocks: DataFrame) -> DataFrame:
    """blocks with their content replaced by its name."""
    names = cut(_named_blocks(blocks).select("digest", "size", "name"))
    keep = ["doc_id", "sha", "idx", "nb"]
    clash = cut(names.groupBy("digest", "size").count().where("count > 1").select("digest", "size"))
    if clash.isEmpty():
        return blocks.select(*keep, "digest", "size").join(names, ["digest", "size"]).select(*keep, "name")
    told = cut(_named_blocks(blocks.join(clash, ["digest", "size"], "left_semi")).withColumn("name", -1 - F.col("name")))
    plain = blocks.join(clash, ["digest", "size"], "left_anti").select(*keep, "digest", "size").join(names, ["digest", "size"])
    return plain.select(*keep, "name").unionByName(
        blocks.join(clash, ["digest", "size"], "left_semi").join(told, ["digest", "size", "block"]).select(*keep, "name")
    )


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, sha, height, name): one identity for each distinct (doc_id, text); equal (height, name) means equal text."""
    spark = ready(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    pieces = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    blocks = (
        docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("sha"), pieces.alias("pieces"))
        .select("doc_id", "sha", F.size("pieces").alias("nb"), F.posexplode("pieces").alias("idx", "block"))
        .withColumn("digest", F.unhex(F.md5("block")))
        .withColumn("size", F.length("block"))
    )
    level = cut(_block_names(blocks))
    done, height = level.where("nb = 1").select("doc_id", "sha", F.lit(0).alias("height"), "name"), 0
    level = level.where("nb > 1")
    while not level.isEmpty():
        height += 1
        at = F.col("idx") % 2 == 0
        pairs = (
            level.groupBy("doc_id", "sha", F.expr("idx div 2").cast("int").alias("idx"), F.expr("(nb + 1) div 2").cast("int").alias("nb"))
            .agg(F.max(F.when(at, F.col("name"))).alias("left"), F.max(F.when(~at, F.col("name"))).alias("right"))
            .withColumn("odd", F.col("right").isNull())
            .fillna({"right": 0})
        )
        pairs = cut(pairs)
        names = (
            pairs.select("left", "right", "odd")
            .distinct()
            .repartitionByRange(partitions(spark), "left", "right", "odd")
            .sortWithinPartitions("left", "right", "odd")
            .withColumn("name", F.monotonically_increasing_id())
        )
        level = cut(pairs.join(cut(names), ["left", "right", "odd"]).select("doc_id", "sha", "idx", "nb", "name"))
        done = done.unionByName(level.where("nb = 1").select("doc_id", "sha", F.lit(height).alias("height"), "name"))
        level = level.where("nb > 1")
    return done.distinct()


def exact_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs.

    Null text counts as empty, and empty texts are equal to each other. Of equal texts the row with
    the largest doc_id is kept. Rows that repeat a doc_id and its text are counted in group_size and
    all called kept; a null doc_id is never kept unless its whole group has none. An empty table gives no rows.
    """
    rows = docs.select("doc_id", F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("sha"))
    ids = identities(docs, block).withColumnRenamed("doc_id", "id").withColumnRenamed("sha", "of")
    named = cut(rows.join(ids, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("of"))).select("doc_id", "sha", "height", "name"))
    groups = named.groupBy("height", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return named.join(cut(groups), ["height", "name"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs that exact_groups keeps, one of each text; all columns stay.

    Null and empty texts are one text. Of equal texts the largest doc_id stays, a null one only where there is no other; of rows
    that repeat doc_id and text, the one with the least hash of all its columns (those that differ in nothing are one). Texts of any
    length are compared whole. An empty table gives no rows.
    """
    kept = exact_groups(docs, block).where("kept").select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("of")).distinct()
    rows = packed(docs).withColumn("sha", F.unhex(F.sha2("text", 256))).drop("text")
    mine = rows["doc_id"].eqNullSafe(kept["id"]) & (rows["sha"] == kept["of"])
    one = cut(rows.select("doc_id", "sha", "mark").join(kept, mine, "left_semi").groupBy("sha").agg(F.min("mark").alias("mark")))
    return unpacked(rows.join(one, ["sha", "mark"], "left_semi").dropDuplicates(["sha"]), docs.columns)


def op4_exact_dedup(spark, sf_dir):
    """Each document's group of equal texts (null: empty) and whether it stays, the largest doc_id doing so. Repeated rows are each answered;
    very long texts are compared whole; an empty table gives no rows."""
    return exact_groups(table(ready(spark), sf_dir, "documents"))


OP4_SQL = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
    FROM d JOIN g USING (t)"""
