"""URL filters (operator 11): a blocked Bloom filter before an exact hash join, DataFrame functions only.

A list of blocked URLs, of any length, is held as canonical keys. Its blocked Bloom filter is a table of blocks of
256 bits; a key sets eight bits of the one block that its hash names, so asking about a key reads one block.
``BITS_PER_KEY`` bits are kept for each key, up to ``MAX_BLOCKS`` blocks in all: that bounds what is broadcast (32 MB of
bits) whatever the list's length, and a list beyond it only lets more through to the exact join. Keys that
the filter lets through are made distinct, with partial aggregation, and joined with the list as
strings; that removes false positives, and a hot URL is one row there. Pages never leave their scan partition for the
filter; only those whose key passed it meet the confirmed keys, a hot key's pages spread over salts.

Rules decide before the list: a rule (action, host and path) fits its host and all subdomains if the path starts with the
rule's; the longest wins, then the one with the longer host, then block. They are a short list that the caller writes,
``MAX_RULES`` at most (more is an error), and are compared within the row.

Canonical key: host without user name, port 80 or 443, a closing dot and ``www.``, A-Z lower-cased; path with runs of
slashes as one and no closing slash; parameters other than utm_*, gclid, fbclid and ref, sorted; no scheme and
fragment.

Defined results: a URL that is null or has no ``://`` has an empty host and path, no key and is allowed. Repeated rows
have a verdict each. Null, empty and repeated entries of the list have no effect of their own; an empty list blocks
nothing. Columns beyond the URL are neither read nor changed; results are named by the caller's columns and
``host path rule verdict``, which replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.base import settled, table
from creditloom.operators.joins import sized_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LANES, LANE_BITS, BITS_OF_KEY = 4, 64, 8
BITS_PER_KEY, MAX_BLOCKS, MAX_RULES = 16, 1 << 20, 200
TRACKING = "^(utm_[^=]*|gclid|fbclid|ref)(=|$)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The key under which a URL is listed; null without ``://``."""
    host = F.regexp_replace(host_of(url), r"(?s)^.*@", "")
    for part in (r":(80|443)$", r"\.$", r"^www\."):
        host = F.regexp_replace(host, part, "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), "/+", "/"), "/$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    key = F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))
    return F.when(F.contains(url, F.lit("://")), key)


def _place(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """For each lane of the key's block the bits that it sets: six bits of a second hash choose each."""
    second = F.xxhash64(key, F.lit("bits"))
    spots = [F.shiftrightunsigned(second, 6 * j).bitwiseAND(F.lit(LANE_BITS - 1)).cast("int") for j in range(BITS_OF_KEY)]
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), spot) for spot in spots]
    per_lane = BITS_OF_KEY // LANES
    return [reduce(Column.bitwiseOR, bits[per_lane * i:per_lane * (i + 1)]) for i in range(LANES)]


def bloom_filter(keys: DataFrame, n_keys: int, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """The blocks that hold a bit (block, lane_0 ..) of the column ``key``, and how many blocks there are."""
    blocks = min(max_blocks, max(1, -(-n_keys * BITS_PER_KEY // (LANES * LANE_BITS))))
    lanes = [F.bit_or(mask).alias(f"lane_{i}") for i, mask in enumerate(_masks(F.col("key")))]
    return keys.groupBy(_place(F.col("key"), blocks).alias("block")).agg(*lanes), blocks


def _probed(rows: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """Adds maybe: whether the filter holds all bits of ``key``. The filter has at most MAX_BLOCKS rows of five numbers."""
    asked = rows.withColumn("block", F.when(F.col("key").isNotNull(), _place(F.col("key"), blocks)))
    found = asked.join(F.broadcast(bloom), "block", "left")
    has = [F.col(f"lane_{i}").bitwiseAND(mask) == mask for i, mask in enumerate(_masks(F.col("key")))]
    return found.withColumn("maybe", F.coalesce(reduce(Column.__and__, has), F.lit(False))).select(*rows.columns, "maybe")


def possible_hits(rows: DataFrame, listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``rows`` (with a column ``key``) and maybe; ``listed`` has distinct keys."""
    return _probed(rows, *bloom_filter(listed, listed.count(), max_blocks))


def with_listed(rows: DataFrame, listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``rows`` (with a column ``key``) and listed: whether the key is among those of ``listed``."""
    listed = settled(listed.select("key").where("key is not null").distinct())
    probed = possible_hits(rows, listed, max_blocks)
    passed = probed.where("maybe").drop("maybe")
    confirmed = settled(passed.select("key").distinct().join(listed, "key", "left_semi").withColumn("listed", F.lit(True)))
    exact = sized_join(passed, confirmed, "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return exact.unionByName(probed.where("not maybe").drop("maybe").withColumn("listed", F.lit(False)))


def _parts(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def ordered_rules(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """(action, rule), the one that wins first."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; more than {MAX_RULES} belong on the list")
    if bad := [a for a, _ in rules if a not in ("allow", "block")]:
        raise ValueError(f"unknown actions {bad}")
    return sorted(rules, key=lambda r: (-len(r[1]), -len(_parts(r[1])[0]), r[0] != "block", r[1]))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]], listed: DataFrame, url: str = "url",
           max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict; ``listed`` has the blocked canonical keys as ``key``."""
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    packed = F.struct(*[F.col(f"`{c}`") for c in names])
    base = pages.select(packed.alias("row"), canonical(F.col(f"`{url}`")).alias("key"),
                        host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in reversed(ordered_rules(rules)):
        host, path = _parts(text)
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    ruled = base.select("row", "host", "path", rule.alias("rule"), action.alias("action"),
                        F.when(action.isNull(), F.col("key")).alias("key"))  # a rule makes the list needless
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return with_listed(ruled, listed, max_blocks).select(
        *[F.col(f"row.`{c}`").alias(c) for c in names], "host", "path", "rule", F.coalesce("action", by_list).alias("verdict"))


# The query's rules and its list: canonical URLs of which some crawl holds JUNK marks or more.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
MARKS, JUNK = r"[*]{3}|#{3}|%{3}|[$]{3}|(&amp;){3}", 10


def junk_urls(pages: DataFrame) -> DataFrame:
    """key: the canonical URLs under which a page full of junk marks was crawled."""
    marks = F.regexp_count("html", F.lit(MARKS))
    return pages.where(marks >= JUNK).select(canonical(F.col("url")).alias("key"))


def op11_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return judged(pages.select("page_id", "url"), RULES, junk_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


def _rule_sql(column: int) -> str:
    cases = []
    for action, text in ordered_rules(RULES):
        host, path = _parts(text)
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{(action, text)[column]}'")
    return "CASE " + " ".join(cases) + " END"


SQL = rf"""WITH parts AS (SELECT page_id, url, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))) AS params FROM pages),
keyed AS (SELECT page_id, html, host, path, CASE WHEN contains(url, '://') THEN
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':(80|443)$', ''), '\.$', ''), '^www\.', '')
    || regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS key FROM parts),
listed AS (SELECT DISTINCT key FROM keyed WHERE len(regexp_extract_all(html, '{MARKS}')) >= {JUNK} AND key IS NOT NULL)
SELECT page_id, host, path, {_rule_sql(1)} AS rule,
       coalesce({_rule_sql(0)}, CASE WHEN listed.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed LEFT JOIN listed USING (key)"""
