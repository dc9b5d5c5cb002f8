"""Secret scans (operator 7): a trigram inverted index in front of the rules, DataFrame functions only.

``trigram_query`` derives from each rule's pattern the trigrams of lower-cased text that a match can't do without,
as alternatives of which one must hold whole. Postings (trigram, doc_id) are built for the trigrams that some rule
asks for, and intersecting them gives the candidate documents of each rule, on which alone its pattern runs. A rule
with no mandatory trigram, such as a plain run of hex digits, scans every text.

Defined results: a null or empty text has no spans. The postings of rows with one id are joined, which can only add
candidates; patterns run on each row's own text, so every row has its own result. A null id is an id of its own.
Positions are code points, end exclusive.
"""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.base import same, table

MAX_CLASS, MAX_ALTERNATIVES = 4, 256


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def any_case(word: str) -> str:
    """Pattern for ASCII letters in either case, with no other letters that fold to them."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(any_case(x) for x in ("password", "passwd", "secret", "token")) + "|" + any_case("api") + "_?" + any_case("key")
BASE_RULES = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}"),  # maximal runs, as those of one or more digits that are long enough
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of mandatory trigrams; None if a match may hold none.

    A state is the set of trigrams that are certain so far and the literal text that directly precedes.
    """

    def flush(states):
        return {(need | {tail[i:i + 3] for i in range(len(tail) - 2)}, "") for need, tail in states}

    def put(states, chars):
        if len(chars) > MAX_CLASS or len(states) * len(chars) > MAX_ALTERNATIVES:
            return flush(states)
        return {(need, tail + c) for need, tail in states for c in chars}

    def of_class(items):
        chars = set()
        for op, value in items:
            if op is ops.LITERAL:
                chars.add(chr(value).lower())
            elif op is ops.RANGE and value[1] - value[0] < 2 * MAX_CLASS:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return {""} | {str(i) for i in range(MAX_CLASS + 1)}  # too many
        return chars

    def walk(nodes, states):
        for op, value in nodes:
            if op is ops.LITERAL:
                states = put(states, {chr(value).lower()})
            elif op is ops.IN:
                states = put(states, of_class(value))
            elif op is ops.SUBPATTERN:
                states = walk(value[3], states)
            elif op is ops.BRANCH:
                states = set().union(*(walk(branch, states) for branch in value[1]))
            elif op is ops.MAX_REPEAT and value[:2] == (0, 1):
                states = states | walk(value[2], states)
            elif op is ops.MAX_REPEAT and value[0] > 0:
                states = flush(walk(value[2], states))
            else:
                states = flush(states)
            if len(states) > MAX_ALTERNATIVES:
                states = flush(states)
        return states

    found = {need for need, _ in flush(walk(parser.parse(pattern), {(frozenset(), "")}))}
    if frozenset() in found:
        return None
    return sorted((x for x in found if not any(y < x for y in found)), key=sorted)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id) for the given trigrams of the lower-cased texts."""
    low = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("low"), t))
    return low.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document that may match some indexed rule: doc_id, rules (array of kinds)."""
    spark = docs.sparkSession
    clauses = [
        (t, r.kind, i, len(clause)) for r in rules for i, clause in enumerate(trigram_query(r.pattern) or ()) for t in sorted(clause)
    ]
    if not clauses:
        return docs.select("doc_id", F.array().cast("array<string>").alias("rules")).limit(0)
    wanted = spark.createDataFrame(clauses, "trigram string, rule string, clause int, size int")  # a few rows per rule
    hits = postings(docs, sorted({c[0] for c in clauses})).join(F.broadcast(wanted), "trigram")
    whole = (
        hits.groupBy("doc_id", "rule", "clause", "size").agg(F.count_distinct("trigram").alias("held"))
        .where(F.col("held") == F.col("size"))
    )
    return whole.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's matches, leftmost and non-overlapping."""
    kind = "array<struct<start:int,end:int,ok:boolean>>"
    pattern = F.lit(rule.pattern)
    found, value = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    sized = F.zip_with(found, value, lambda f, v: F.struct(F.length(f).alias("n"), (F.length(v) >= rule.least).alias("ok")))
    placed = F.zip_with(
        F.slice(gaps, 1, F.size(found)), sized, lambda g, s: F.struct(F.length(g).alias("gap"), s["n"].alias("n"), s["ok"].alias("ok"))
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    step = lambda s, m: F.struct(
        (s["at"] + m["gap"] + m["n"]).alias("at"),
        F.concat(s["out"], F.array(F.struct(
            (s["at"] + m["gap"]).alias("start"), (s["at"] + m["gap"] + m["n"]).alias("end"), m["ok"].alias("ok")
        ))).alias("out"),
    )
    every = F.aggregate(placed, start, step, lambda s: s["out"])
    return F.when(text.rlike(rule.pattern), F.filter(every, lambda x: x["ok"])).otherwise(F.array().cast(kind))


def _marked(spans: Column, place: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), F.lit(place).alias("place"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text and ``found``: array of (start, place, end, kind), by start and then the order of the rules."""
    may = candidates(docs, rules).select(F.col("doc_id").alias("may_id"), "rules")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = texts.join(may, same(texts["doc_id"], F.col("may_id")), "left")
    parts = []
    for place, rule in enumerate(rules):
        spans = _marked(spans_of(F.col("text"), rule), place, rule.kind)
        if trigram_query(rule.pattern) is not None:
            listed = F.coalesce(F.array_contains("rules", rule.kind), F.lit(False))
            spans = F.when(listed, spans).otherwise(F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>"))
        parts.append(spans)
    return joined.select("doc_id", "text", F.array_sort(F.concat(*parts)).alias("found"))


def masked(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """doc_id and text with every span replaced; where spans overlap, the text under all of them is one gap."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")
    step = lambda s, m: F.struct(
        F.greatest(s["at"], m["end"]).alias("at"),
        F.when(m["start"] >= s["at"], F.concat(s["out"], F.substring(text, s["at"] + 1, m["start"] - s["at"]), F.lit(mask)))
        .otherwise(s["out"]).alias("out"),
    )
    done = F.aggregate("found", start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return scan(docs, rules).select("doc_id", done.alias("text"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    base = F.filter("found", lambda x: x["place"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return scan(table(spark, folder, "documents")).select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
    )


def check_sql() -> str:
    """Every pattern over every text, without an index."""
    lists = []
    for place, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        lists.append(f"""list_transform(list_filter(range(1, len(regexp_extract_all(t, '{p}')) + 1),
            lambda i: length(regexp_extract_all(t, '{p}', {r.group})[i]) >= {r.least}),
            lambda i: {{'s': CAST(list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda x: length(x))) AS BIGINT)
                + CAST(coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
                'p': {place}, 'n': length(regexp_extract_all(t, '{p}')[i]), 'k': '{r.kind}'}})""")
    def shown(x):
        return f"array_to_string(list_transform({x}, lambda x: x.k || ':' || x.s || ':' || (x.s + x.n)), ',')"

    base = f"list_filter(found, lambda x: x.p < {len(BASE_RULES)})"
    counts = ", ".join(f"CAST(len(list_filter(found, lambda x: x.k = '{r.kind}')) AS BIGINT) AS n_{r.kind}" for r in BASE_RULES)
    return f"""WITH scanned AS (SELECT doc_id, list_sort(list_concat({", ".join(lists)})) AS found
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
SELECT doc_id, {counts}, sha256(coalesce({shown(base)}, '')) AS base_sha256, coalesce({shown("found")}, '') AS spans FROM scanned"""


SQL = check_sql()
