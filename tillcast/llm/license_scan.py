"""License scan by diagonal voting.

Every word pair of every text is joined by its hash to the positions of the same pair in the license
templates. A hit votes for the diagonal ``text position - template position``; votes are gathered per diagonal,
neighbouring diagonals (words added or lost inside the passage) are merged, and a merged span counts when
enough different grams of the template voted for it. Short phrases allow no gap and need every gram.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillcast.llm.rows import folded_words, one_per_id, table


@dataclass(frozen=True)
class Template:
    """``slack``: words that may be added or lost inside a passage, in all. ``coverage``: share of the grams it needs."""

    label: str
    text: str
    base: bool = False
    slack: int = 0
    coverage: float = 1.0


# The phrases of the contract and their labels.
BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)
# Sentences of public license texts and notices.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
     "that the following conditions are met"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license "
     "at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
     "hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
)
TEMPLATES = (
    *BASE,
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("rights-reserved", "all rights reserved"),
    *(Template(label, text, slack=4, coverage=0.6) for label, text in NOTICES),
)


def template_grams(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(template, label, base, slack, coverage, n_grams, at, a, b, h): a constant of a few hundred rows."""
    rows = []
    for number, t in enumerate(templates):
        words = t.text.split()
        for at, (a, b) in enumerate(zip(words, words[1:])):
            rows.append((number, t.label, t.base, t.slack, t.coverage, len(words) - 1, at, a, b))
    schema = "template int, label string, base boolean, slack int, coverage double, n_grams int, at int, a string, b string"
    return spark.createDataFrame(rows, schema).withColumn("h", F.xxhash64("a", "b"))


def diagonal_votes(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Voting template places per (doc_id, n_words, template, diagonal). A document without a hit keeps a row without template.

    The templates are a constant of this module or of the caller, so broadcasting them is bounded; no text is
    shuffled, and all votes of a document are summed in the task that read it.
    """
    words = one_per_id(docs).select("doc_id", folded_words(F.col("text")).alias("words"))
    pairs = F.arrays_zip(F.col("words").alias("first"), F.slice("words", F.lit(2), F.size("words")).alias("second"))
    grams = words.select("doc_id", F.size("words").alias("n_words"), F.posexplode_outer(pairs).alias("pos", "g")).select(
        "doc_id", "n_words", "pos", "g.first", "g.second", F.xxhash64("g.first", "g.second").alias("h")
    )
    wanted = F.broadcast(template_grams(docs.sparkSession, templates))
    same = (F.col("first") == F.col("a")) & (F.col("second") == F.col("b"))
    hits = grams.join(wanted, "h", "left").where((F.col("template").isNotNull() & same) | (F.coalesce("pos", F.lit(0)) == 0))
    template = F.when(same, F.col("template")).alias("template")
    return hits.groupBy(
        "doc_id", "n_words", template, "label", "base", "slack", "coverage", "n_grams",
        (F.col("pos") - F.col("at")).alias("diagonal"),
    ).agg(F.collect_set(F.when(same, F.col("at"))).alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def license_spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Merged spans per (doc_id, template, diagonal): start and last gram, share of the template and whether it is verified.

    The span of a diagonal takes in those up to ``slack`` above it, so it is at most that much longer than the template.
    It is verified when the different template places that voted on it reach the coverage; a gram said twice counts once.
    Equal grams are compared as text, so no vote rests on a hash alone.
    """
    votes = diagonal_votes(docs, templates)
    line = Window.partitionBy("doc_id", "n_words", "template").orderBy("diagonal")
    places, last = F.col("places"), F.col("last")
    for slack in sorted({t.slack for t in templates} - {0}):
        near, mine = line.rangeBetween(0, slack), F.col("slack") == slack
        places = F.when(mine, F.array_distinct(F.flatten(F.collect_list("places").over(near)))).otherwise(places)
        last = F.when(mine, F.max("last").over(near)).otherwise(last)
    start = F.min("first").over(line.rangeBetween(0, max(t.slack for t in templates)))
    share = F.when(F.col("template").isNull(), 0.0).otherwise(F.size(places) / F.col("n_grams"))
    return votes.select(
        "doc_id", "n_words", "template", "label", "base", "coverage", "n_grams",
        F.when(F.col("slack") > 0, start).otherwise(F.col("first")).alias("start"), last.alias("last"), share.alias("share"),
    ).withColumn("verified", F.col("template").isNotNull() & (F.col("share") >= F.col("coverage")))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per document: n_words, the exact base phrases and their places, labels and a score.

    Empty and null texts have no words, no labels and score 0. Rows repeating a doc_id, or without one, are
    treated as in ``rows.one_per_id``; other columns of ``docs`` are ignored. The score is the largest share
    of a template's grams found on one span.
    """
    base = F.col("verified") & F.col("base")
    start = F.when(base, F.col("start")).cast("long")

    def names(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    return license_spans(docs, templates).groupBy("doc_id", F.col("n_words").cast("long").alias("n_words")).agg(
        F.count_if(F.coalesce(base, F.lit(False))).alias("n_base"),
        F.min(start).alias("first_word"),
        F.max(start).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("verified")).alias("labels"),
        F.max("share").alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _values() -> str:
    return ",\n".join(f"({i}, '{t.label}', {t.base}, {t.slack}, {t.coverage}, '{t.text}')" for i, t in enumerate(TEMPLATES))


SQL = rf"""
with template(id, label, base, slack, coverage, body) as (values {_values()}),
doc as (
  select doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from documents),
tg as (
  select id, label, base, slack, coverage, i as ofs, tw[i + 1] || ' ' || tw[i + 2] as gram, len(tw) - 1 as n_grams
  from (select *, string_split(body, ' ') as tw from template), unnest(range(len(tw) - 1)) as u(i)),
dg as (
  select doc_id, i as pos, w[i + 1] || ' ' || w[i + 2] as gram
  from doc, unnest(range(greatest(len(w) - 1, 0))) as u(i)),
vote as (select doc_id, tg.*, pos, pos - ofs as d from dg join tg using (gram)),
merged as (
  select doc_id, any_value(b.label) as label, any_value(b.base) as base, any_value(b.coverage) as coverage,
    count(distinct b.ofs)::double / any_value(b.n_grams) as share, min(b.pos) as start
  from (select distinct doc_id, id, d from vote) a join vote b using (doc_id, id)
  where b.d between a.d and a.d + b.slack group by doc_id, id, a.d)
select doc_id, len(w)::bigint as n_words, count(*) filter (base and share >= coverage) as n_base,
  (min(start) filter (base and share >= coverage))::bigint as first_word,
  (max(start) filter (base and share >= coverage))::bigint as last_word,
  coalesce(array_to_string(list_sort(list(distinct label) filter (base and share >= coverage)), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list(distinct label) filter (share >= coverage)), ','), '') as labels,
  coalesce(max(share), 0.0)::double as score
from doc left join merged using (doc_id) group by doc_id, w
"""
