"""URL filter by hashed host and path expressions.

Every url is expanded into its host suffixes joined with its path prefixes, each expression is reduced to the
first bytes of its digest, and these short keys are joined with the keys of the rules. Full digests and the
rule's own path then confirm a match, and the longest rule gives the verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.rows import ascii_lower, table

# The rules of the contract as (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
PREFIX_DIGITS = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty when there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://")), "#", 1)).otherwise("")
    rest = F.substr(rest, F.lit(4))
    rest = F.coalesce(rest, F.lit(""))
    return (
        ascii_lower(F.regexp_extract(rest, r"^[^/?]*", 0)),
        F.regexp_extract(rest, r"^[^/?]*(/[^?]*)?", 1),
    )


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _key(host: Column, path: Column) -> Column:
    """A rule or url expression: host and the path up to its last slash."""
    return F.concat(host, F.lit("\n"), path)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as a table: a rule whose path ends inside a segment is filed under its last slash."""
    made = spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")
    cut = F.regexp_extract("rule_path", r"^(?s:.*/)?", 0)
    return made.dropDuplicates().select(
        "*",
        F.concat("rule_host", "rule_path").alias("rule"),
        _digest(_key(F.col("rule_host"), cut)).alias("digest"),
    ).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))


def expansions(pages: DataFrame, labels: int, slashes: int) -> DataFrame:
    """One row per url and expression with at most ``labels`` host labels and ``slashes`` slashes in the path.

    Longer expressions cannot equal a rule's, so an adversarial url does not blow up.
    """
    parts = F.split("host", "\\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.array_join(F.slice(parts, -n, n), "."),
    )
    steps = F.split("path", "/")
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(steps) - 1, F.lit(slashes))),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, 1, n), "/"), F.lit("/"))),
    )
    return (
        pages.withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("digest", _digest(_key(F.col("suffix"), F.col("prefix"))))
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
        .drop("suffix", "prefix")
    )


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) per page.

    A rule fits its host and all subdomains where the path starts with the rule's path. The longest rule wins;
    of equally long ones the blocking one, then the one that sorts last. Pages without a fitting rule get
    ``default``. A null url, or one without ``://``, has an empty host and path. Rows that repeat page_id and
    url are one page, different urls of a page_id are judged each; other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    slim = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    bounds = rules.agg(
        F.max(F.size(F.split("rule_host", "\\."))).alias("labels"),
        F.max(F.length("rule_path") - F.length(F.replace("rule_path", F.lit("/")))).alias("slashes"),
    ).first()
    spread = expansions(slim, bounds["labels"] or 1, bounds["slashes"] or 0)
    joined = spread.alias("u").join(rules.alias("r"), "short", "left")
    fits = (F.col("u.digest") == F.col("r.digest")) & F.startswith("path", "rule_path")
    rank = F.when(
        fits, F.struct(F.length("rule"), F.when(F.col("rule_verdict") == "block", 1).otherwise(0), "rule", "rule_verdict")
    )
    best = joined.groupBy("page_id", "url", "host", "path").agg(F.max(rank).alias("best"))
    return best.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark))


SQL = r"""
with rule(host, path, verdict) as (values
  ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest as (
  select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from (select distinct page_id, url from pages)),
part as (
  select page_id, url,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) as path from rest),
fit as (
  select p.page_id, p.host, p.path, r.host || r.path as rule, r.verdict,
    row_number() over (partition by page_id, url order by length(r.host || r.path) desc, r.verdict desc) as nth
  from part p left join rule r on (p.host = r.host or p.host like '%.' || r.host) and starts_with(p.path, r.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fit where nth = 1
"""
