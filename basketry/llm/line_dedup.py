"""Line deduplication by a log-template tree, in DataFrame operations alone.

Lines are parsed to a fixed depth: a first level by the number of tokens, then one level for each of DEPTH
leading tokens, where a token with a digit counts as variable. As a field may lead the line, a line also
follows a second path, that of the next DEPTH tokens (the last ones, where fewer are left). Lines of no more than
DEPTH tokens aren't generalised: with so few tokens, the constants that a template must have are all of them.

The lines of a leaf are generalised: a line's tokens are ordered by how much of the leaf has them at their place,
and wherever that number falls, the tokens before are taken as constant and the others as variable. Lines with the same
constants at the same places have the same template. No number of occurrences makes a token constant, so a template
is found at every size of the leaf. A line is dropped if one of its templates recurs in at least min_docs documents and at
least the share `constant` of its tokens is constant. A line that recurs word for word in so many documents is the template
without variables, which every leaf it lies in would give; so it is known from its count alone. Numbers are tokens like any
others there: lines with different numbers are not alike for that.

Every count is combined before it is shuffled, leaves and templates that cannot recur are pruned before tokens are looked at
(once for each distinct line), leaves that hold the same lines are one, and the joins that bring counts back to lines are
plain sort-merge joins that can split a very common line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ready, small, table

#: Documents in which a dropped template is found at least, tokens of a path, the least share of constants, and
#: the most rows of leaves and wanted lines (some 10 and 30 MB) that are broadcast; beyond, they are joined by sorting.
DOCS, DEPTH, CONSTANT, SMALL = 10, 3, 0.7, 300_000
VARIABLE = "<*>"
PATHS = ["leaf", "later"]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, idx, h, leaf, later) of the lines that hold anything, no text; tk tells texts of a repeated doc_id apart."""
    split = docs.select("doc_id", F.xxhash64("text").alias("tk"), F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    rows = split.select("doc_id", "tk", "idx", F.trim("line").alias("line")).where("line <> ''")
    n = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    lead = F.substring_index("line", " ", 2 * DEPTH)
    lead = F.split(F.when(lead.rlike("[0-9]"), F.regexp_replace(lead, r"\S*[0-9]\S*", VARIABLE)).otherwise(lead), " ")
    rows = rows.select("doc_id", "tk", "idx", F.xxhash64("line").alias("h"), n.alias("n"), lead.alias("lead"))
    skips = (F.lit(0), F.least(F.lit(DEPTH), F.col("n") - DEPTH))
    paths = (F.when(F.col("n") > DEPTH, F.xxhash64("n", F.lit(i), *(F.get("lead", s + j) for j in range(DEPTH)))) for i, s in enumerate(skips))
    return rows.select("doc_id", "tk", "idx", "h", *(p.alias(c) for p, c in zip(paths, PATHS, strict=True)))


def _recurring(lines: DataFrame, key: str, docs: int) -> DataFrame:
    """The keys found in at least so many documents."""
    return cut(lines.select(key, "doc_id").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= docs).select(key))


def _in_leaves(held: DataFrame, docs: int) -> DataFrame:
    """(h, leaf, c) of the distinct lines of leaves where a template may recur that is not known already."""
    paths = held.select("h", "c", F.explode(F.array(*PATHS)).alias("leaf")).where("leaf IS NOT NULL")
    # Lines are counted once for each document that has them, which is never less than the leaf's documents.
    counted = paths.groupBy("leaf").agg(F.sum("c").alias("all"), F.min("c").alias("least"))
    some = cut(paths.join(small(cut(counted.where((F.col("all") >= docs) & (F.col("least") < docs)).select("leaf")), SMALL), "leaf"))
    alike = some.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines"), F.expr("bit_xor(h)").alias("one"), F.expr("bit_xor(xxhash64(h))").alias("two"))
    return cut(some.join(alike.groupBy("lines", "one", "two").agg(F.min("leaf").alias("leaf")).select("leaf"), "leaf").select("h", "leaf", "c"))


def dropped_lines(docs: DataFrame, min_docs: int = DOCS, constant: float = CONSTANT) -> DataFrame:
    """(doc_id, tk, idx) of the lines whose template recurs in at least min_docs documents.

    Texts are parsed once; only the lines of leaves that may hold a template are gone back to for their tokens.
    """
    lines = cut(_lines(docs))
    held = lines.groupBy("h", *PATHS, "doc_id").agg(F.min(F.struct("tk", "idx")).alias("at"))
    held = cut(held.groupBy("h", *PATHS).agg(F.min(F.struct("doc_id", "at.tk", "at.idx")).alias("at"), F.count(F.lit(1)).alias("c")))
    exact = held.where(F.col("c") >= min_docs).select("h")
    inner = _in_leaves(held, min_docs)
    wanted = held.join(small(cut(inner.select("h").distinct()), SMALL), "h", "left_semi").select("h", "at.*")
    wanted = cut(wanted.groupBy(F.col("doc_id").alias("id"), F.col("tk").alias("of")).agg(F.collect_list(F.struct("idx", "h")).alias("wanted")))
    texts = docs.select("doc_id", F.xxhash64("text").alias("tk"), "text")
    found = texts.join(small(wanted, SMALL), texts["doc_id"].eqNullSafe(wanted["id"]) & (texts["tk"] == wanted["of"]))
    found = found.select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w")).select("w.h", F.trim(F.get("lines", F.col("w.idx"))).alias("line"))
    found = found.dropDuplicates(["h"]).select("h", F.split("line", " ").alias("tokens"))
    hashes = F.transform("tokens", lambda t, i: F.xxhash64(i, t))
    tokens = cut(found.select("h", F.size("tokens").alias("n"), hashes.alias("tokens")))
    placed = cut(inner.join(tokens, "h").select("h", "leaf", "n", "c", F.explode("tokens").alias("token")))
    common = cut(placed.groupBy("leaf", "token").agg(F.sum("c").alias("weight")).where(F.col("weight") >= min_docs))
    by_weight = placed.join(common, ["leaf", "token"]).groupBy("h", "leaf", "n", "c").agg(F.sort_array(F.collect_list(F.struct("weight", "token")), False).alias("t"))
    least = F.greatest(F.ceil(constant * F.col("n") - 1e-9), F.lit(1)).cast("int")
    levels = F.array_distinct(F.transform(F.slice("t", least, F.size("t")), lambda x: x["weight"]))
    levels = by_weight.where(F.size("t") >= least).select("h", "leaf", "c", "t", F.explode(levels).alias("level"))
    levels = levels.select("h", "leaf", "c", F.filter("t", lambda x: x["weight"] >= F.col("level")).alias("t"))
    xor = F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x["token"]))
    templates = cut(levels.select("h", "c", F.xxhash64("leaf", xor, F.size("t")).alias("template")))
    # A template's documents are told apart only where their numbers by line leave open whether it recurs.
    sums = cut(templates.groupBy("template").agg(F.sum("c").alias("most"), F.max("c").alias("least")).where(F.col("most") >= min_docs))
    open_ = templates.join(sums.where(F.col("least") < min_docs), "template", "left_semi").select("h", "template")
    found = _recurring(lines.select("h", "doc_id").join(open_, "h"), "template", min_docs)
    found = found.union(sums.where(F.col("least") >= min_docs).select("template"))
    general = templates.join(found, "template", "left_semi").select("h")
    return lines.join(exact.union(general).distinct(), "h", "left_semi").select("doc_id", "tk", "idx")


def clean_lines(docs: DataFrame, min_docs: int = DOCS, constant: float = CONSTANT) -> DataFrame:
    """docs with text replaced by the lines that stay, and the columns n_lines and n_dropped (which replace columns of these names).

    Lines of nothing but spaces always stay and are not counted. A null text stays null, with no lines; an empty one stays
    empty. Rows that repeat a doc_id are told apart by their text, and a null doc_id is one like any other; a document counts once for
    a template however often it has it. Lines of a template fall in all of its documents alike, so there are no ties. Texts and lines of any
    length are read whole. An empty table gives no rows, and all other columns stay as they are.
    """
    ready(docs.sparkSession)
    gone = dropped_lines(docs.select("doc_id", "text"), min_docs, constant)
    # Flags by line number are laid out as an array first, since a search of gone for every line would be quadratic.
    at = F.array_sort("gone")
    gaps = F.transform(at, lambda x, i: x - F.when(i == 0, F.lit(-1)).otherwise(F.get(at, i - 1)) - 1)
    flags = F.flatten(F.transform(gaps, lambda g: F.concat(F.array_repeat(F.lit(False), g), F.array(F.lit(True)))))
    dropped = gone.groupBy("doc_id", "tk").agg(F.collect_set("idx").alias("gone"))
    dropped = cut(dropped.select(F.col("doc_id").alias("id"), "tk", F.size("gone").cast("long").alias("n"), flags.alias("flags")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("of"), F.xxhash64("text").alias("key"))
    joined = rows.join(dropped, F.col("of").eqNullSafe(F.col("id")) & (F.col("key") == F.col("tk")), "left")
    lines = F.split("row.text", "\n")
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.coalesce(F.get(F.col("flags"), i), F.lit(False))), "\n")
    size = F.size(F.filter(lines, lambda line: F.trim(line) != ""))
    known = F.col("row.text").isNotNull()
    counted = joined.select(
        "row",
        F.when(F.col("flags").isNull(), F.col("row.text")).otherwise(kept).alias("stays"),
        F.when(known, size).otherwise(0).cast("long").alias("lines"),
        F.coalesce("n", F.lit(0)).cast("long").alias("less"),
    )
    others = (F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped"))
    return counted.select(*others, F.col("stays").alias("text"), F.col("lines").alias("n_lines"), F.col("less").alias("n_dropped"))


def op7_line_dedup(spark, sf_dir):
    """Each document's lines, lines dropped and the SHA-256 of what stays (of the empty text for null). Repeated rows are each answered,
    very long texts read whole; an empty table gives no rows."""
    cleaned = clean_lines(table(ready(spark), sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
