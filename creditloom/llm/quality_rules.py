"""Quality rules (operator 4): text rules and cross-document line frequency, DataFrame functions only.

Lines are normalised (lower case, digit runs as 0, white space collapsed) and counted by the distinct documents
(texts) of their host that hold them. A line held by more than ``max_docs`` is boilerplate everywhere but in the
host's document with the smallest id, so of a group that shares it one stays whole. A document that loses more than
``max_lost`` of its words with its boilerplate lines is depleted and rejected; ``without_frequent_lines`` takes the lines
out of texts, and ``keep_good`` does both if asked to.

Defined results: a null or empty text has no words and fails the base rules. A null id is an id of its own and a
null host a host of its own. Rows with one id and one text get one verdict; exact copies of a text count as one
document. Columns beyond doc_id, text and the host are neither read nor changed, whatever their names, save that
``n_chars``, if there, follows a text that loses lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.base import bound, packed, same, settled, table, text_key, unpacked
from creditloom.llm.words import SEPARATORS, word_array
from creditloom.operators.joins import BROADCAST_ROWS

SYMBOLS = "[#*$%&|<>]"
MAX_DOCS, MAX_LOST = 10, 0.5
MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8


def normalised_line(line: Column) -> Column:
    text = F.regexp_replace(F.lower(line), SEPARATORS, " ")
    return F.regexp_replace(F.trim(text), "[0-9]+", "0")


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))


def _covered(windows: Column) -> Column:
    """Number of words under the windows whose hash occurs again; linear but for two sorts."""
    pair = lambda a, b: F.coalesce(F.when(a["h"] == b["h"], F.array(a["i"], b["i"])), F.array().cast("array<int>"))
    gap = lambda a, b: F.least(F.coalesce(b, F.lit(1 << 30)) - a, F.lit(WINDOW))
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    spots = bound(placed, lambda p: F.array_sort(F.array_distinct(F.flatten(F.zip_with(p, F.slice(p, 2, F.size(p)), pair)))))
    total = lambda q: F.aggregate(F.zip_with(q, F.slice(q, 2, F.size(q)), gap), F.lit(0).cast("long"), lambda x, g: x + g)
    return bound(spots, total)


def _repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in the text, first included.

    A window's hash is the exclusive or of its words' hashes, each shifted by its place, made by doubling.
    """
    def joined(h: Column, width: int) -> Column:
        return F.zip_with(h, F.slice(h, width + 1, F.size(h)), lambda a, b: a.bitwiseXOR(F.shiftleft(b, width)))

    def of_hashes(h: Column) -> Column:
        windows = bound(bound(joined(h, 1), lambda x: joined(x, 2)), lambda x: joined(x, 4))
        return F.slice(windows, 1, F.size(h) - WINDOW + 1)

    none = F.lit(0).cast("long")
    again = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w)).otherwise(none)
    counted = bound(F.transform(words, lambda w: F.xxhash64(w)), lambda h: bound(of_hashes(h), again))
    return F.when(F.size(words) > WINDOW, counted).otherwise(none)


def text_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, key of its text, the base figures and ``base_failed``."""
    base = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
    base = base.withColumn("words", word_array(F.col("text"))).withColumn("lines", _lines(F.col("text")))
    base = base.select(
        "doc_id",
        text_key(F.col("text")).alias("text_key"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return base.withColumn("base_failed", failed)


def _frequent(lines: DataFrame, max_docs: int) -> DataFrame:
    """host, line_key, docs, owner: the boilerplate lines and the document of each host that keeps them."""
    holders = lines.groupBy("host", "line_key", "text_key").agg(F.min("doc_id").alias("doc_id"))
    return (
        holders.groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("owner"))
        .where(F.col("docs") > max_docs)
    )


def depleted(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_lost: float = MAX_LOST,
             id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Words and words lost of every document with a line: doc_id, text_key, line_words, lost_words, depleted."""
    lines = docs.select(
        F.col(id_column).alias("doc_id"), text_key(F.col(text_column)).alias("text_key"), F.col(host).alias("host"),
        F.explode(_lines(F.coalesce(text_column, F.lit("")))).alias("line"),
    ).select(
        "doc_id", "text_key", "host", F.xxhash64(normalised_line(F.col("line"))).alias("line_key"),
        F.size(word_array(F.col("line"))).alias("words"),
    )
    frequent = _frequent(lines, max_docs)
    hit = lines.alias("l").join(
        frequent.alias("f"), same(F.col("l.host"), F.col("f.host")) & (F.col("l.line_key") == F.col("f.line_key")), "left"
    )
    lost = F.col("f.line_key").isNotNull() & ~same(F.col("l.doc_id"), F.col("f.owner"))
    sums = hit.groupBy("l.doc_id", "l.text_key").agg(
        F.sum("words").alias("line_words"), F.sum(F.when(lost, F.col("words")).otherwise(0)).alias("lost_words")
    )
    return sums.withColumn("depleted", F.col("lost_words") > max_lost * F.col("line_words"))


def verdicts(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_lost: float = MAX_LOST) -> DataFrame:
    """The base figures of every document, ``lost_words`` and ``kept``."""
    rules, gone = text_rules(docs), depleted(docs, host, max_docs, max_lost).where(F.col("lost_words") > 0)
    match = same(F.col("r.doc_id"), F.col("g.doc_id")) & (F.col("r.text_key") == F.col("g.text_key"))
    joined = rules.alias("r").join(gone.alias("g"), match, "left")
    return joined.select(
        "r.*", F.coalesce("g.lost_words", F.lit(0)).cast("long").alias("lost_words"),
        (~F.col("base_failed") & ~F.coalesce("g.depleted", F.lit(False))).alias("kept"),
    )


def without_frequent_lines(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, among: DataFrame | None = None) -> DataFrame:
    """``docs`` with the boilerplate lines, other than their owner's, taken out of the texts.

    Lines are counted over the documents ``among``, by default ``docs``.
    """
    def lines_of(df: DataFrame) -> DataFrame:
        each = df.select("doc_id", text_key(F.col("text")).alias("text_key"), F.col(host).alias("host"),
                         F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
        return each.where(F.col("line").rlike(r"[^ \t-\r]")).select(
            "doc_id", "text_key", "host", "line_no", F.xxhash64(normalised_line(F.col("line"))).alias("line_key"))

    frequent = _frequent(lines_of(docs if among is None else among), max_docs).alias("f")
    hit = lines_of(docs).alias("l").join(
        frequent, same(F.col("l.host"), F.col("f.host")) & (F.col("l.line_key") == F.col("f.line_key"))
    ).where(~same(F.col("l.doc_id"), F.col("f.owner")))
    gone = hit.groupBy(F.col("l.doc_id").alias("gone_id"), F.col("l.text_key").alias("gone_key"), F.col("l.host").alias("gone_host")).agg(
        F.collect_set("line_no").alias("gone_lines"))
    rows = packed(docs)
    match = (same(rows["doc_id"], gone["gone_id"]) & (text_key(rows["text"]) == gone["gone_key"])
             & same(F.col(f"row.`{host}`"), gone["gone_host"]))
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("i")))
    left = F.transform(F.filter(numbered, lambda x: ~F.array_contains("gone_lines", x["i"])), lambda x: x["line"])
    cut = F.when(F.col("gone_lines").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return unpacked(rows.join(gone, match, "left").withColumn("cut", cut), docs, F.col("cut"))


def _base_failed(text: Column) -> Column:
    """The base rules' verdict from the text alone."""
    def failed(words: Column) -> Column:
        return (F.size(words) < MIN_WORDS) | (100 * _repeated_words(words) > MAX_REPEATED * F.size(words))

    return bound(word_array(text), failed)


def keep_good(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_lost: float = MAX_LOST,
              remove_lines: bool = False) -> DataFrame:
    """The rows of ``docs`` whose document is kept, with the columns they came with.

    The base rules are applied where a text is read, and of the others only ids and keys of depleted documents come back, so
    texts stay in their scan partitions as long as those fit a measured broadcast; beyond it they are exchanged.
    ``remove_lines``: without their boilerplate lines, as counted over all of ``docs``.
    """
    gone = settled(depleted(docs, host, max_docs, max_lost).where("depleted").select(
        F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    rows = packed(docs)
    match = same(rows["doc_id"], gone["gone_id"]) & (text_key(rows["text"]) == gone["gone_key"])
    kept = unpacked(rows.join(gone, match, "left_anti").where(~_base_failed(F.col("text"))), docs)
    return without_frequent_lines(kept, host, max_docs, docs) if remove_lines else kept


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words"
    )


WORDS_SQL = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LINES_SQL = r"list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"


def verdict_ctes(source: str = "documents") -> str:
    """Common table expressions that end in ``verdict``, for the SQL checks."""
    return rf"""
q_docs AS (SELECT doc_id, source, coalesce(text, '') AS t,
                  {WORDS_SQL.format(text="coalesce(text, '')")} AS w FROM {source}),
q_windows AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS win FROM q_docs, unnest(range(1, len(w) - 6)) AS r(i)
              WHERE len(w) >= 8),
q_repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM q_windows)
               WHERE c > 1),
q_covered AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
              FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM q_repeated) GROUP BY 1),
q_lines AS (SELECT doc_id, source, t, unnest({LINES_SQL}) AS line FROM q_docs),
q_keyed AS (SELECT doc_id, source, t, len({WORDS_SQL.format(text="line")}) AS n,
                   regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g') AS k
            FROM q_lines),
q_frequent AS (SELECT source, k, min(doc_id) AS owner FROM q_keyed GROUP BY source, k
               HAVING count(DISTINCT t) > {MAX_DOCS}),
q_lost AS (SELECT l.doc_id, sum(n) AS n, sum(CASE WHEN f.k IS NOT NULL AND l.doc_id <> f.owner THEN n ELSE 0 END) AS lost
           FROM q_keyed l LEFT JOIN q_frequent f ON l.k = f.k AND l.source IS NOT DISTINCT FROM f.source GROUP BY 1),
q_base AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
                  CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                  CAST(len({LINES_SQL}) - len(list_distinct({LINES_SQL})) AS BIGINT) AS n_dup_lines,
                  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
                  CAST(coalesce(l.lost, 0) AS BIGINT) AS lost_words, coalesce(l.lost > {MAX_LOST} * l.n, false) AS depleted
           FROM q_docs d LEFT JOIN q_covered c USING (doc_id) LEFT JOIN q_lost l USING (doc_id)),
verdict AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
                   n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
                   NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND NOT depleted AS kept,
                   lost_words FROM q_base)"""


SQL = "WITH " + verdict_ctes() + "\nSELECT * FROM verdict"
