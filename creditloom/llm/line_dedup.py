"""Line dedup (operator 3): a deletion-neighbourhood join, DataFrame functions only.

Every line with a word takes part, trimmed and in lower case. It is removed if an earlier line, by document id and
line number, is equal, or within the edit bound of its length: none below ``min_edit`` characters, where one letter
can be the whole difference between two lines ("page 1", "page 2"), one from there on. Verdicts look at the input, not
at what is left, so the earliest of a chain stays.

Equal lines are first counted as one. Two filters, of which neither loses a pair, tell which letters need be
deleted: two lines one edit apart share the front or the back half of the longer one's length, and, cut in blocks of
about the root of that length, everything around one block. The blocks that meet another line's emit their deletion
variants as hashed keys: with the place of the deletion, which lines of one length share exactly if one letter
differs, and without it, which a line shares with the longer line it comes from by a deletion. Each key's earliest
line is found by a combining aggregate, never by pairs, and the line and its earlier one are compared again by
edit distance.

Defined results: a null or empty text has no lines that take part. Ids are ordered with null last. Rows that repeat
an id are one document: of lines with one number, both stay or go. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.base import bound, packed, same, settled, table, text_key, unpacked
from creditloom.operators.joins import PART_OF_PARTITION, hot_share, lookup_join, partitions

MIN_EDIT = 20
TRIMMED = " \t\r\x0b\x0c"


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(line, F.lit(TRIMMED)))


def _raw_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, line, n for the lines that take part."""
    lines = docs.select("doc_id", text_key(F.col("text")).alias("text_key"),
                        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw"))
    lines = lines.select("doc_id", "text_key", "line_no", normal_line(F.col("raw")).alias("line"))
    return lines.withColumn("n", F.length("line")).where(F.col("n") > 0)


def _position() -> Column:
    """Orders lines: id, null last, then line number, then text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "text_key")


def _half_keys(line: Column, n: Column) -> Column:
    """Four keys; lines within one edit share one. ``longer`` is the length of the longer line of a pair."""
    keys = []
    for more in (0, 1):
        longer = n + more
        half = F.floor(longer / 2).cast("int")
        keys.append(F.xxhash64(F.lit("front"), longer, F.substring(line, F.lit(1), half)))
        back = longer - half
        keys.append(F.xxhash64(F.lit("back"), longer, F.substring(line, n - back + 1, back)))
    return F.array(*keys)


def hashed_lines(docs: DataFrame, min_edit: int = MIN_EDIT) -> DataFrame:
    """doc_id, text_key, line_no, key, n, halves (null for lines too short to be edited)."""
    halves = F.when(F.col("n") >= min_edit, _half_keys(F.col("line"), F.col("n")))
    return _raw_lines(docs).select("doc_id", "text_key", "line_no", F.xxhash64("line").alias("key"), "n", halves.alias("halves"))


def _block_size(longer: Column) -> Column:
    return F.ceil(F.sqrt(longer.cast("double"))).cast("int")


def _around(line: Column, longer: Column, own: Column, short: int, b: Column) -> tuple[Column, Column]:
    """Block ``b`` of the line in the class of lines up to ``longer``: a struct of what stands around and in it, and its width.

    ``short``: 1 for the line as one that lacks a letter of that block, else 0 (own = longer).
    """
    size = _block_size(longer)
    start = (b * size).cast("int")
    width = F.least(size, longer - start) - short
    parts = F.struct(
        F.xxhash64(longer, b, F.xxhash64(F.substring(line, F.lit(1), start)),
                   F.xxhash64(F.substring(line, start + width + 1, own))).alias("around"),
        F.substring(line, start + 1, width).alias("piece"), start.alias("start"),
    )
    return parts, width


def block_contexts(lines: DataFrame) -> DataFrame:
    """around, line_key, short, b: what stands around each block; lines one edit apart share it for one block."""
    def of(more: int) -> DataFrame:
        longer = F.col("n") + more
        blocks = F.sequence(F.lit(0), F.ceil(longer / _block_size(longer)).cast("int") - 1)
        each = F.transform(blocks, lambda b: F.struct(
            _around(F.col("line"), longer, F.col("n"), more, b)[0]["around"].alias("around"), F.lit(more).alias("short"), b.alias("b")))
        return lines.select("line_key", F.explode(each).alias("v")).select("v.around", "line_key", "v.short", "v.b")

    return of(0).unionByName(of(1))


def variants(lines: DataFrame) -> DataFrame:
    """key, role and the columns of ``lines``: 'change' (one letter replaced), 'long' or 'short' (one letter more or less).

    Of the blocks in ``whole`` every deletion of a letter, and of those in ``lacking`` the line as it is.
    """
    line, n = F.col("line"), F.col("n")
    role = lambda name, key: F.struct(F.lit(name).alias("role"), key.alias("key"))

    def deletions(b: Column) -> Column:
        parts, width = _around(line, n, n, 0, b)
        cut = lambda v, i: F.concat(F.substring(v["piece"], F.lit(1), i - 1), F.substring(v["piece"], i + 1, width))
        return bound(parts, lambda v: F.transform(F.sequence(F.lit(1), width), lambda i: F.struct(
            (v["start"] + i).alias("place"), F.xxhash64(v["around"], cut(v, i)).alias("key"))))

    def itself(b: Column) -> Column:
        return bound(_around(line, n + 1, n, 1, b)[0], lambda v: F.xxhash64(v["around"], v["piece"]))

    gone = lines.withColumn("v", F.explode(F.flatten(F.transform("whole", deletions)))).withColumn("r", F.explode(F.array(
        role("change", F.xxhash64(F.lit("change"), "v.place", "v.key")), role("long", F.col("v.key")))))
    short = lines.withColumn("v", F.explode(F.transform("lacking", itself))).withColumn("r", role("short", F.col("v")))
    keep = [c for c in lines.columns if c not in ("line", "whole", "lacking")]
    return gone.drop("v").unionByName(short.drop("v")).select("r.key", "r.role", *keep)


def near_lines(docs: DataFrame, lines: DataFrame, min_edit: int = MIN_EDIT) -> DataFrame:
    """line_key and earlier_key: distinct lines within one edit of a line that starts earlier."""
    distinct = settled(lines.where(F.col("halves").isNotNull()).groupBy("key").agg(
        F.min(_position()).alias("at"), F.first("n").alias("n"), F.first("halves").alias("halves")))
    each = distinct.select("key", F.explode("halves").alias("half"))
    shared = each.groupBy("half").agg(F.min("key").alias("low"), F.max("key").alias("high")).where(F.col("low") < F.col("high"))
    going = settled(each.join(shared.select("half"), "half").select("key").distinct().join(distinct.select("key", "at", "n"), "key"))
    del distinct, each, shared
    raw = _raw_lines(docs).where(F.col("n") >= min_edit).select(F.xxhash64("line").alias("key"), "line")
    texts = settled(raw.join(going.select("key"), "key").groupBy("key").agg(F.first("line").alias("line")).join(going, "key"))
    named_lines = texts.select(F.col("key").alias("line_key"), "line", "n", "at")
    contexts = block_contexts(named_lines)
    met = settled(contexts.groupBy("around").agg(F.min("line_key").alias("low"), F.max("line_key").alias("high")).where(
        F.col("low") < F.col("high")).select("around"))
    blocks = lambda short: F.collect_set(F.when(F.col("short") == short, F.col("b")))
    chosen = contexts.join(met, "around").groupBy("line_key").agg(blocks(0).alias("whole"), blocks(1).alias("lacking"))
    every = variants(settled(named_lines.join(chosen, "line_key")))
    named = F.struct("at", "line_key")
    earliest = every.groupBy("key").agg(
        F.min(F.when(F.col("role") == "change", named)).alias("change"),
        F.min(F.when(F.col("role") == "long", named)).alias("long"),
        F.min(F.when(F.col("role") == "short", named)).alias("short"),
        F.count(F.lit(1)).alias("members"),
    ).where(F.col("members") > 1)
    other = F.when(F.col("role") == "change", F.col("change")).when(F.col("role") == "long", F.col("short")).otherwise(F.col("long"))
    hit = every.join(earliest, "key").withColumn("other", other).where(F.col("other.at") < F.col("at"))
    pairs = hit.groupBy("line_key").agg(F.min("other").alias("other")).select("line_key", F.col("other.line_key").alias("earlier_key"))
    left = texts.select(F.col("key").alias("line_key"), F.col("line").alias("a"))
    right = texts.select(F.col("key").alias("earlier_key"), F.col("line").alias("b"))
    return pairs.join(left, "line_key").join(right, "earlier_key").where(
        F.levenshtein("a", "b", 1) >= 0).select("line_key", "earlier_key")


def _widely_shared(firsts: DataFrame) -> DataFrame:
    """key, salts__ of the lines that would fill a good part of a shuffle partition; at most 1 / hot_share of them."""
    share = F.col("times") / firsts.agg(F.sum("times")).scalar()
    salts = F.ceil(share * F.lit(partitions(firsts) / PART_OF_PARTITION)).cast("int") + 1
    return firsts.where(share > F.lit(hot_share(firsts))).select("key", salts.alias("salts__"))


def removed_lines(docs: DataFrame, min_edit: int = MIN_EDIT) -> DataFrame:
    """doc_id, text_key, line_no, near: the lines to remove; ``near`` if no earlier line is equal."""
    lines = settled(hashed_lines(docs, min_edit))
    near = near_lines(docs, lines, min_edit).select(F.col("line_key").alias("key"), F.lit(True).alias("near"))
    firsts = lines.groupBy("key").agg(F.min(_position()).alias("first"), F.count(F.lit(1)).alias("times")).join(near, "key", "left")
    firsts = settled(firsts.where((F.col("times") > 1) | F.col("near")))
    named = lines.select("doc_id", "text_key", "line_no", "key")
    hit = lookup_join(named, firsts.drop("times"), "key", hot=_widely_shared(firsts)).withColumn("later", F.col("first") < _position())
    # Rows that repeat an id and a text hold the same position, so none of them is later than itself.
    return hit.where(F.col("later") | F.col("near")).select(
        "doc_id", "text_key", "line_no", (~F.col("later")).alias("near")).distinct()


def line_report(docs: DataFrame, min_edit: int = MIN_EDIT) -> DataFrame:
    """doc_id, n_lines (that take part), n_equal, n_near and removed: the numbers of the lines to remove, rising."""
    gone = removed_lines(docs, min_edit).groupBy("doc_id", "text_key").agg(
        F.sum(F.when(F.col("near"), 0).otherwise(1)).alias("n_equal"), F.sum(F.when(F.col("near"), 1).otherwise(0)).alias("n_near"),
        F.sort_array(F.collect_list("line_no")).alias("removed"),
    ).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), "n_equal", "n_near", "removed")
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(normal_line(x)) > 0)
    base = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.size(parts).cast("long").alias("n_lines"))
    match = same(F.col("doc_id"), F.col("gone_id")) & (F.col("text_key") == F.col("gone_key"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return base.join(gone, match, "left").select(
        "doc_id", "n_lines", zero("n_equal"), zero("n_near"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_repeats(docs: DataFrame, min_edit: int = MIN_EDIT) -> DataFrame:
    """``docs`` with the lines removed from their texts, and without documents that had words and lose all of them.

    Columns are those of ``docs``; ``n_chars``, if there, follows the text.
    """
    gone = removed_lines(docs, min_edit).groupBy(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).agg(
        F.collect_set("line_no").alias("gone_lines"))
    rows = packed(docs)
    match = same(rows["doc_id"], gone["gone_id"]) & (text_key(rows["text"]) == gone["gone_key"])
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("i")))
    left = F.transform(F.filter(numbered, lambda x: ~F.array_contains("gone_lines", x["i"])), lambda x: x["line"])
    cut = F.when(F.col("gone_lines").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    joined = rows.join(gone, match, "left").withColumn("cut", cut)
    return unpacked(joined.where(F.col("gone_lines").isNull() | F.col("cut").rlike(r"[^ \t-\r]")), docs, F.col("cut"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    shown = F.array_join(F.transform("removed", lambda i: i.cast("string")), ",")
    return line_report(table(spark, folder, "documents")).withColumn("removed", shown)


def removed_ctes(source: str = "documents") -> str:
    """Common table expressions that end in ``l_gone`` (doc_id, line_no, near), for the SQL checks."""
    return rf"""
l_lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, lower(trim(parts[i], E' \t\r\x0b\x0c')) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM {source}), unnest(range(1, len(parts) + 1)) AS r(i)),
l_part AS (SELECT * FROM l_lines WHERE length(line) > 0),
l_first AS (SELECT line, min((doc_id, line_no)) AS pos, length(line) AS n FROM l_part GROUP BY line),
l_half AS (SELECT line, pos, n, n + m AS longer, unnest([left(line, (n + m) // 2), right(line, n + m - (n + m) // 2)]) AS half,
                  unnest(['f', 'b']) AS side FROM l_first, (VALUES (0), (1)) AS v(m) WHERE n >= {MIN_EDIT}),
l_pair AS (SELECT DISTINCT a.line AS line, b.line AS other, a.n AS n, b.n AS m FROM l_half a
           JOIN l_half b USING (longer, half, side) WHERE b.pos < a.pos AND abs(a.n - b.n) <= 1),
l_near AS (SELECT DISTINCT line FROM l_pair WHERE
    CASE WHEN n = m THEN len(list_filter(range(1, n + 1), lambda i: left(line, i - 1) = left(other, i - 1) AND substr(line, i + 1) = substr(other, i + 1))) > 0
         WHEN n > m THEN len(list_filter(range(1, n + 1), lambda i: left(line, i - 1) || substr(line, i + 1) = other)) > 0
         ELSE len(list_filter(range(1, m + 1), lambda i: left(other, i - 1) || substr(other, i + 1) = line)) > 0 END),
l_gone AS (SELECT doc_id, line_no, (doc_id, line_no) = pos AS near FROM l_part JOIN l_first USING (line)
           WHERE (doc_id, line_no) > pos OR line IN (SELECT line FROM l_near))"""


SQL = f"""WITH {removed_ctes()},
gone AS (SELECT doc_id, sum(CASE WHEN near THEN 0 ELSE 1 END) AS e, sum(CASE WHEN near THEN 1 ELSE 0 END) AS n,
                string_agg(line_no, ',' ORDER BY line_no) AS removed FROM l_gone GROUP BY 1),
base AS (SELECT doc_id, count(*) AS c FROM l_part GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(c, 0) AS BIGINT) AS n_lines, CAST(coalesce(e, 0) AS BIGINT) AS n_equal,
       CAST(coalesce(n, 0) AS BIGINT) AS n_near, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN base USING (doc_id) LEFT JOIN gone USING (doc_id)"""
