"""URL filters, with DataFrame functions alone.

Listed URLs are kept in canonical form. A split-block Bloom filter of them (WORDS words of 32 bits a block, one bit in
each) is a table of blocks, BITS_PER_URL bits for each listed URL whatever the list's size: broadcast while it has at
most MAX_BLOCKS blocks, joined by block beyond. Rows whose block lacks one of their bits are on no list and have no key
in the exact join that follows; possible hits are joined with the list on the canonical URL, which removes false
positives. Pages are scanned once."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pollveil.llm.common import ascii_lower, cut, table

WORDS, BITS_PER_URL = 8, 16
#: Blocks (of 9 longs: under 10 MB) and URLs of a list (about 20 MB) that are broadcast at most.
MAX_BLOCKS, MAX_LISTED = 1 << 17, 200_000
#: Parameters of a query string that do not tell pages apart.
TRACKING = "^(utm_[a-z]+|ref|gclid|fbclid)="
#: Rules (verdict, host, path) of the contract.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: The production list is made by rule: every page number below LIST_PAGES of these hosts, in these languages.
LIST_NAMES, LIST_PREFIXES, LIST_DOMAINS, LIST_LANGUAGES, LIST_PAGES = ["ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"], ["", "blog."], ["com", "net", "org"], ["de", "en", "es", "fr"], 1000


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading www. or m., path without trailing slashes, and the query's parameters but those that
    track, in order. A null URL and one without :// are the empty string."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.coalesce(F.regexp_extract(url, r"://[^/?#]*[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones stand in front
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule, verdict = F.when(fits, of + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _place(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bits(url: Column) -> list[Column]:
    own = F.xxhash64(url, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(own, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, blocks: int, url: str = "listed_url") -> DataFrame:
    """The filter: block, w0.. of each block in use."""
    own = listed.select(_place(F.col(url), blocks).alias("block"), *(b.alias(f"b{i}") for i, b in enumerate(_bits(F.col(url)))))
    return own.groupBy("block").agg(*(F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url: str = "url", listed_url: str = "url", max_blocks: int = MAX_BLOCKS, max_listed: int = MAX_LISTED) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical_url, listed: a row for each row of pages.

    verdict: the longest rule's, else block for a listed URL, else allow. Null and empty URLs and URLs without :// have
    empty host and path and are allowed; URLs of any length are taken whole. Repeated pages are judged each. Lists may
    repeat URLs; null ones list nothing, and an empty list nothing either. An empty table gives no rows; other columns
    are not looked at."""
    urls = cut(listed.select(canonical(F.col(listed_url)).alias("listed_url")).where("listed_url <> ''").distinct())
    n = urls.count()
    blocks = max(1, -(-n * BITS_PER_URL // (32 * WORDS)))
    c, host, path, key = F.col("url"), F.col("host"), F.col("path"), F.col("canonical_url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).cast("string").alias("url"))
    rows = rows.select("page_id", host_of(c).alias("host"), path_of(c).alias("path"), canonical(c).alias("canonical_url")).withColumn("block", _place(key, blocks))
    bloom = bloom_blocks(urls, blocks)
    held = reduce(and_, (F.col(f"w{i}").bitwiseAND(b) == b for i, b in enumerate(_bits(key))))
    probed = rows.join(F.broadcast(bloom) if blocks <= max_blocks else bloom, "block", "left").withColumn("maybe", F.coalesce(held, F.lit(False)))
    # Where the list is shuffled, rows without a key are dealt by a text that no list has, so that they do not meet in one task.
    own = F.when(F.col("maybe"), key) if n <= max_listed else F.when(F.col("maybe"), key).otherwise(F.concat(F.lit("\x00"), F.xxhash64("page_id", key).cast("string")))
    probed = probed.select("page_id", "host", "path", "canonical_url", own.alias("key"))
    found = probed.join(F.broadcast(urls) if n <= max_listed else urls, F.col("key") == F.col("listed_url"), "left").withColumn("listed", F.col("listed_url").isNotNull())
    rule, verdict = rule_columns(host, path, rules)
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "canonical_url", "listed")


def listed_urls(spark: SparkSession) -> DataFrame:
    """The production list, by rule."""
    own = spark.range(LIST_PAGES).select(F.col("id").cast("string").alias("n"))
    for name, values in (("name", LIST_NAMES), ("prefix", LIST_PREFIXES), ("domain", LIST_DOMAINS), ("lang", LIST_LANGUAGES)):
        own = own.withColumn(name, F.explode(F.lit(values)))
    return own.select(F.concat(F.lit("http://"), "prefix", "name", F.lit(".example."), "domain", F.lit("/"), "lang", F.lit("/"), "n").alias("url"))


def op7_bloom_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), listed_urls(spark), RULES)


def oracle() -> str:
    values = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{(h + p, v)[k]}'" for v, h, p in longest) + " END"
    return f"""
WITH listed AS (
  SELECT DISTINCT prefix || name || '.example.' || domain || '/' || lang || '/' || n AS listed_url
  FROM (SELECT unnest({values(LIST_NAMES)}) AS name), (SELECT unnest({values(LIST_PREFIXES)}) AS prefix),
       (SELECT unnest({values(LIST_DOMAINS)}) AS domain), (SELECT unnest({values(LIST_LANGUAGES)}) AS lang), (SELECT unnest(range({LIST_PAGES})) AS n)
), parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         array_to_string(list_sort(list_filter(string_split(coalesce(regexp_extract(url, '://[^/?#]*[^?#]*\\?([^#]*)', 1), ''), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))), '&') AS query
  FROM pages
), rows AS (
  SELECT page_id, host, path, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url FROM parts
)
SELECT page_id, host, path, {case(0)} AS rule, coalesce({case(1)}, CASE WHEN listed_url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, canonical_url, listed_url IS NOT NULL AS listed
FROM rows LEFT JOIN listed ON canonical_url = listed_url
"""
