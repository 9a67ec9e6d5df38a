"""URL filters: rules on host and path, and a list of URLs behind a blocked Bloom filter, in DataFrame functions only.

The filter is an array of 64-bit blocks; a URL sets or tests a few bits of one
block. Its size follows the list up to MOST_BLOCKS, so that what is broadcast
has a bound; beyond it more URLs pass as possible hits. A possible hit goes to
an exact hash join with the list, which removes false positives; any other URL
is surely not listed and takes no part in that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

#: Blocks of the filter at most: some 12 MB as a broadcast table.
MOST_BLOCKS = 1 << 18
#: Bits of a block that a URL sets.
BITS = 4
#: URLs that a block is meant for.
A_BLOCK = 6

#: (verdict, host and path); fixed by the contract of the query.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def rest(url: Column) -> Column:
    """What follows the first `://`; empty without."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower(F.coalesce(F.regexp_extract(rest(url), "^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host and path without a last `.html` or slashes: scheme, query and fragment don't count."""
    return F.concat(host, F.regexp_replace(path, "(\\.html|/)+$", ""))


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        own_host, _, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(f"/{own_path}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def bits_of(hashed: Column) -> Column:
    """The bits of a block that a hash stands for."""
    out = F.lit(0).cast("long")
    for i in range(BITS):
        place = F.shiftrightunsigned(hashed, 20 + 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return out


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Each page's (id, host, path, rule, verdict).

    `listed` has a column `canonical` of blocked canonical URLs, nulls ignored
    and repeats welcome. The longest rule that fits decides; else a listed URL
    is blocked and any other allowed. A null url and one without `://` have an
    empty host and path, fit no rule and are allowed unless the empty string is
    listed. Null ids and equal rows stay, row for row; other columns are
    ignored; an empty table gives an empty one.
    """
    # written, so that the list is made once, counted from the files, and read for the filter and the join
    names = settled(listed.select(F.col("canonical").alias("name")).where("name is not null").distinct(), "listed")
    wanted = -(-names.count() // A_BLOCK)
    blocks = min(MOST_BLOCKS, max(16, 1 << (wanted - 1).bit_length()))

    def hashed(d: DataFrame) -> DataFrame:
        d = d.withColumn("hash", F.xxhash64("name"))
        return d.withColumn("block", F.pmod("hash", F.lit(blocks)).cast("int")).withColumn("bits", bits_of(F.col("hash")))

    bloom = hashed(names).groupBy("block").agg(F.bit_or("bits").alias("word"))
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("name", canonical(F.col("host"), F.col("path")))
    # at most MOST_BLOCKS rows, however long the list
    tried = hashed(rows).join(F.broadcast(bloom), "block", "left").withColumn("possible", F.coalesce(F.col("word").bitwiseAND(F.col("bits")) == F.col("bits"), F.lit(False)))
    tried = tried.select("id", "host", "path", "name", "possible")
    sure = tried.where("not possible").withColumn("found", F.lit(False))
    hits = tried.where("possible").join(names.withColumn("found", F.lit(True)), "name", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    both = sure.select("id", "host", "path", "found").unionByName(hits.select("id", "host", "path", "found"))
    by_list = F.when(F.col("found"), F.lit("block")).otherwise(F.lit("allow"))
    return both.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"))


def fed(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The query's list: canonical URLs of pages that were reached through a syndication feed, whatever the other links to them look like."""
    url = F.col(url_col)
    return pages.where(url.rlike("[?&]utm_source=feed")).select(canonical(host_of(url), path_of(url)).alias("canonical"))


def oracle(rules=RULES) -> str:
    """judge_urls() with fed() in DuckDB's SQL."""

    def chain(value) -> str:
        cases = []
        for said, text in sorted(rules, key=lambda r: -len(r[1])):
            host, _, path = text.partition("/")
            cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{value(said, text)}'")
        return "CASE " + " ".join(cases) + " END"

    return f"""
WITH rests AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
named AS (SELECT *, host || regexp_replace(path, '(\\.html|/)+$', '') AS name FROM split),
listed AS (SELECT DISTINCT name FROM named WHERE regexp_matches(url, '[?&]utm_source=feed')),
judged AS (SELECT page_id, host, path, {chain(lambda v, t: t)} AS rule, {chain(lambda v, t: v)} AS said, CASE WHEN name IN (SELECT name FROM listed) THEN 'block' ELSE 'allow' END AS by_list FROM named)
SELECT page_id, host, path, rule, coalesce(said, by_list) AS verdict FROM judged"""
