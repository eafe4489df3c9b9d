"""Line deduplication by site-relative frequency.

Pages are grouped by host; the number of a host's pages that contain a line is divided by the host's number of
pages, and lines above a ratio are boilerplate of that site and are dropped from its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.rows import table
from tillcast.session import materialize

RATIO = 0.05
LEAST_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keys(lines: Column) -> Column:
    """Hashes of the lines that can be boilerplate: blank lines cannot."""
    return F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x, F.length(x)))


def boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES,
    copies_once: bool = False,
) -> DataFrame:
    """(host, drops): the line hashes that more than ``ratio`` of the host's pages contain.

    A page counts once for each of its distinct lines, so partial sums leave every task, and a line on a third
    of all pages is one row per task. ``drops`` cannot be long: its lines' shares of pages add up to at most
    the lines of the host's mean page, so there are fewer than that mean divided by ``ratio``. A line must be
    on ``least_pages`` pages, else every line of a host with few pages would count.

    With ``copies_once``, equal texts of a host are one page, both among the pages of a line and among those of
    the host: a text that is merely copied often has no boilerplate. Copies are reduced before their lines are
    taken apart, by partial sums too.
    """
    pages = docs.select(
        F.col(host).alias("host"), F.xxhash64(text).alias("same"), F.length(text).alias("size"),
        F.array_distinct(_keys(_lines(F.col(text)))).alias("keys"),
    )
    if copies_once:
        pages = pages.groupBy("host", "same", "size").agg(F.first("keys").alias("keys"))
    seen = pages.select("host", F.explode("keys").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    total = pages.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("pages"))
    common = seen.where(F.col("n") >= least_pages).join(total, F.col("host").eqNullSafe(F.col("of")))
    return common.where(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(
        F.array_sort(F.collect_list("line")).alias("drops")
    )


def drop_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES,
    copies_once: bool = False,
) -> DataFrame:
    """``docs`` with boilerplate lines cut from the text, and the counts ``lines_total`` and ``lines_dropped``.

    Every row is judged on its own and kept, repeated rows and rows without an id included; a text that was
    only boilerplate becomes empty. ``copies_once`` says how equal texts count, see ``boilerplate``. A null text
    stays null and has no lines; a null host is a host like any other. Columns already named like the two counts are replaced; all others are passed through.

    The table of boilerplate is stored first, so its size is known: Spark broadcasts it below the session's
    threshold and joins by key, splitting a busy host, above.
    """
    drops = materialize(boilerplate(docs, host, text, ratio, least_pages, copies_once), "boilerplate").select(
        F.col("host").alias("_host"), F.col("drops").alias("_drops")
    )
    rest = [F.col(c) for c in docs.columns if c not in ("lines_total", "lines_dropped", text)]
    lines = _lines(F.col(text))
    kept = F.when(
        F.col("_drops").isNotNull(),
        F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains("_drops", F.xxhash64(x, F.length(x)))),
    ).otherwise(lines)
    judged = docs.join(drops, F.col(host).eqNullSafe(F.col("_host")), "left").select(
        *rest, F.col(text).alias("_text"), F.size(F.coalesce(lines, F.array())).cast("long").alias("lines_total"),
        kept.alias("_kept"),
    )
    out = judged.withColumns({
        text: F.array_join("_kept", "\n"),
        "lines_dropped": F.col("lines_total") - F.size(F.coalesce("_kept", F.array())),
    })
    return out.select(*docs.drop("lines_total", "lines_dropped").columns, "lines_total", "lines_dropped")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_boilerplate(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", F.col("lines_total").alias("n_lines"), F.col("lines_dropped").alias("n_dropped"),
        F.length("text").cast("long").alias("n_chars_kept"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


SQL = rf"""
with line as (
  select doc_id, source, unnest(ls) as l, unnest(range(len(ls))) as i
  from (select doc_id, source, string_split(text, chr(10)) as ls from documents)),
pages as (select source, count(*) as pages from documents group by source),
seen as (
  select source, l, count(distinct doc_id) as n from line where trim(l, ' ') <> '' group by source, l),
busy as (
  select s.source, s.l from seen s join pages p on s.source is not distinct from p.source
  where n >= {LEAST_PAGES} and n > {RATIO} * pages),
judged as (
  select line.doc_id, line.l, line.i, busy.l is not null as out
  from line left join busy on line.l = busy.l and line.source is not distinct from busy.source)
select d.doc_id, count(l) as n_lines, count(*) filter (out) as n_dropped,
  case when count(l) > 0 then length(coalesce(string_agg(l, chr(10) order by i) filter (not out), '')) end as n_chars_kept,
  sha256(coalesce(string_agg(l, chr(10) order by i) filter (not out), '')) as kept_sha256
from (select distinct doc_id from documents) d left join judged on d.doc_id is not distinct from judged.doc_id
group by d.doc_id
"""
