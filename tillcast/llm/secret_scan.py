"""Secret scan over a trigram index.

Each rule's regular expression is reduced to a Boolean trigram query: alternatives of trigram sets of which one
must be present in any matching text. The postings of the queries' trigrams are intersected to find the
candidate documents of a rule, and only those are matched against the expression. A rule without mandatory
trigrams is matched against every text.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillcast.llm.rows import one_per_id, table

ANY = [frozenset()]
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``least`` characters of ``group`` are needed, else a match is dropped (its text stays used up)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules. The runs of the last two are greedy, so asking for their length inside the
# expression finds the same matches as dropping shorter ones afterwards.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Public formats of keys and tokens.
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def _grams(strings: frozenset[str]) -> list[frozenset[str]]:
    """One alternative per string: all its trigrams. A string under three characters asks for nothing."""
    return _tidy([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


def _tidy(clauses: list[frozenset[str]]) -> list[frozenset[str]]:
    """Drop alternatives that a weaker one contains."""
    return [c for c in set(clauses) if not any(d < c for d in clauses)]


def _both(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
    return _tidy([x | y for x, y in product(a, b)]) if len(a) * len(b) <= MOST_STRINGS else a


def _needs(nodes) -> tuple[frozenset[str] | None, list[frozenset[str]]]:
    """Of a parsed sequence: all strings it can match, if few, and what any match must contain."""
    known: frozenset[str] | None = frozenset([""])
    tail, need = known, ANY
    for kind, value in nodes:
        exact, inner = _one(kind, value)
        need = _both(need, inner)
        if exact is None:
            known, need, tail = None, _both(need, _grams(tail)), frozenset([""])
            continue
        if len(tail) * len(exact) > MOST_STRINGS:
            known, need, tail = None, _both(need, _grams(tail)), frozenset([""])
        tail = frozenset(a + b for a, b in product(tail, exact))
    need = _both(need, _grams(tail))
    return (tail if known is not None else None), need


def _one(kind, value) -> tuple[frozenset[str] | None, list[frozenset[str]]]:
    if kind is op.LITERAL:
        return frozenset([chr(value).lower()]), ANY
    if kind is op.IN and len(value) <= 4 and all(k is op.LITERAL for k, _ in value):
        return frozenset(chr(v).lower() for _, v in value), ANY
    if kind is op.SUBPATTERN:
        return _needs(value[-1])
    if kind is op.BRANCH:
        parts = [_needs(branch) for branch in value[1]]
        strings = [s for exact, _ in parts for s in exact or ()]
        exact = frozenset(strings) if all(e is not None for e, _ in parts) and len(strings) <= MOST_STRINGS else None
        return exact, _tidy([clause for _, need in parts for clause in need])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, item = value
        exact, need = _needs(item)
        if least == most == 1:
            return exact, need
        if (least, most) == (0, 1) and exact is not None:
            return exact | {""}, ANY
        if exact is not None and least == most and len(exact) == 1:
            return frozenset(s * least for s in exact), ANY
        return None, need if least else ANY
    return (frozenset([""]), ANY) if kind is op.AT else (None, ANY)


def trigram_query(pattern: str) -> list[list[str]] | None:
    """Alternatives of trigrams, ASCII letters in lower case; None when some match needs no trigram at all."""
    _, need = _needs(parser.parse(pattern))
    return None if frozenset() in need else sorted(sorted(clause) for clause in need)


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, kinds) of the documents whose postings satisfy the trigram query of at least one rule.

    Only trigrams of the queries are posted, once per document, letters in lower case. The queries are a constant of the rules, so
    broadcasting them is bounded, and a document's postings meet in the task that read it.
    """
    asked = [
        (r.kind, number, gram, len(clause))
        for r in rules
        for number, clause in enumerate(trigram_query(r.pattern) or [])
        for gram in clause
    ]
    grams = sorted({gram for _, _, gram, _ in asked})
    found = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(g)), F.lit(g)) for g in grams]))
    postings = docs.select("doc_id", F.lower("text").alias("folded")).select(
        "doc_id", F.explode(found.cast("array<string>")).alias("gram")
    )
    queries = docs.sparkSession.createDataFrame(asked, "kind string, clause int, gram string, n_grams long")
    met = (
        postings.join(F.broadcast(queries), "gram")
        .groupBy("doc_id", "kind", "clause", "n_grams")
        .agg(F.count("*").alias("n"))
        .where("n = n_grams")
    )
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _places(rule: Rule, text: Column) -> Column:
    """Per match, the characters before it since the last match, its own, and those of the rule's group."""
    pattern = F.lit(rule.pattern)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    measured = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else whole
    return F.arrays_zip(between.alias("before"), whole.alias("own"), measured.alias("measured"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) per document; spans are (start, nth, end, kind) in code points, end exclusive.

    Sorted by start, then by the rules' order. Null and empty texts have no spans. Rows repeating a doc_id, or
    without one, are treated as in ``rows.one_per_id``; other columns are ignored. Where a match starts is the
    running sum of the lengths of what lies between and of the matches, so no text leaves the join.
    """
    own = one_per_id(docs)
    may = candidates(own, rules).withColumnRenamed("doc_id", "of")
    known = own.join(may, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    picked = []
    for nth, rule in enumerate(rules):
        scan = F.lit(True) if trigram_query(rule.pattern) is None else F.array_contains("kinds", rule.kind)
        hit = F.when(scan & F.rlike("text", F.lit(rule.pattern)), _places(rule, F.col("text")))
        picked.append(F.struct(F.lit(nth).alias("nth"), hit.alias("places")))
    rows = known.select("doc_id", F.array(*picked).alias("all")).select("doc_id", F.explode("all").alias("r"))
    places = rows.select("doc_id", "r.nth", F.posexplode_outer("r.places").alias("at", "p")).where("nth = 0 or p is not null")
    run = Window.partitionBy("doc_id", "nth").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = places.select("doc_id", "nth", "p.own", "p.measured", F.sum(F.col("p.before") + F.coalesce("p.own", F.lit(0))).over(run).alias("end"))
    least = F.element_at(F.lit([r.least for r in rules]), F.col("nth") + 1)
    kind = F.element_at(F.lit([r.kind for r in rules]), F.col("nth") + 1)
    span = F.when(
        F.col("own").isNotNull() & (F.col("measured") >= least),
        F.struct((F.col("end") - F.col("own")).alias("start"), "nth", "end", kind.alias("kind")),
    )
    return ends.groupBy("doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["nth"] < len(BASE))
    return found.select(
        "doc_id", *[count(r.kind) for r in BASE], F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    def found(nth: int, r: Rule) -> str:
        pattern = r.pattern.replace("'", "''")
        return (
            f"select doc_id, {nth} as nth, '{r.kind}' as kind, {r.least} as least, "
            f"regexp_extract_all(text, '{pattern}') as m, regexp_extract_all(text, '{pattern}', {r.group}) as g, "
            f"string_split_regex(text, '{pattern}') as b from doc"
        )

    union = "\nunion all\n".join(found(i, r) for i, r in enumerate(RULES))
    return f"""
with doc as (select doc_id, coalesce(text, '') as text from documents),
found as ({union}),
place as (
  select doc_id, nth, kind, least, length(g[i]) as measured, length(m[i]) as own,
    list_sum(list_transform(b[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as start
  from found, unnest(range(1, len(m) + 1)) as u(i)),
span as (
  select doc_id, nth, kind, start, kind || ':' || start::bigint || ':' || (start + own)::bigint as said
  from place where measured >= least)
select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
  count(*) filter (kind = 'hex') as n_hex,
  sha256(coalesce(string_agg(said, ',' order by start, nth) filter (nth < {len(BASE)}), '')) as base_sha256,
  coalesce(string_agg(said, ',' order by start, nth), '') as spans
from doc left join span using (doc_id) group by doc_id
"""


SQL = _sql()
