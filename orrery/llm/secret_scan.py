"""Secret scan by a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived (driver side, by walking the parsed
regex): clauses that must all hold, each a choice of alternatives, each a set of trigrams that must all
occur.  Postings (trigram, document) are kept for the trigrams that occur in queries, intersected per
document by counting, and the candidates are verified by the regex itself.  A rule without mandatory
trigrams scans every text.  The index holds lower-cased trigrams, so it only ever admits too much.

Scale: postings and intersections are narrow rows keyed by document, so no trigram, however common, gathers in
a task.  The candidates that come of it are written; counted to at most BROADCAST_CANDIDATES they are broadcast and
no text moves, beyond that the texts are shuffled once to meet them.  The rule table is a constant of the code.

Defined results: null is the empty text, which has no spans.  Spans are code points, end exclusive,
leftmost and non-overlapping within a kind.  Documents that repeat an id are each verified by their own
text, whichever of them is a candidate; a null id is looked up like others.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.plans.scratch import Scratch


@dataclass(frozen=True)
class Rule:
    """A kind of secret: spans of pattern whose group is at least least code points long."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The base rules, in the order in which they are listed.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # Runs are maximal, so a bound in the pattern finds what a later test of the length would leave.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
]
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]
RULES = BASE + MORE
#: Documents that are candidates of any rule, and are broadcast.
BROADCAST_CANDIDATES = 500_000
LIMIT = 32  # strings that a part of a regex may expand to


def _strings(node) -> set[str] | None:
    """The strings a node can match if they are few, lower-cased; None if they are not."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN":
        out: set[str] = set()
        for kind, val in arg:
            if str(kind) == "LITERAL":
                out.add(chr(val).lower())
            elif str(kind) == "RANGE" and val[1] - val[0] < 8:
                out |= {chr(c).lower() for c in range(val[0], val[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op == "SUBPATTERN":
        return _sequence(arg[-1])
    if op == "BRANCH":
        parts = [_sequence(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] != regex_parser.MAXREPEAT and int(arg[1]) <= 3:
        inner = _sequence(arg[2])
        if inner is None:
            return None
        return {"".join(t) for n in range(int(arg[0]), int(arg[1]) + 1) for t in product(inner, repeat=n)}
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        got = _strings(node)
        if got is None or len(out) * len(got) > LIMIT:
            return None
        out = {a + b for a in out for b in got}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses (all must hold) of alternatives (one must) of trigrams (all must occur); [] if there are none."""
    clauses: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            clauses.append(sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}, key=sorted))

    def walk(nodes) -> None:
        run = {""}
        for node in nodes:
            got = _strings(node)
            if got is not None and len(run) * len(got) <= LIMIT:
                run = {a + b for a in run for b in got}
                continue
            close(run)
            run = got if got is not None and len(got) <= LIMIT else {""}
            if got is None and str(node[0]) == "SUBPATTERN":
                walk(node[1][-1])
            elif got is None and str(node[0]) in ("MAX_REPEAT", "MIN_REPEAT") and int(node[1][0]) >= 1:
                walk(node[1][2])
        close(run)

    walk(regex_parser.parse(pattern))
    return clauses


#: Matches whose places are added up together: appending to a list copies it, so one long list would take squared time.
MATCHES = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<start, k, end>> of a rule's matches in the text, by built-in functions.

    The pieces between the matches and the matches themselves give the positions.
    """
    kind = "array<struct<start:int,k:int,end:int>>"
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    pieces = F.split(text, rule.pattern, -1)
    rows = F.zip_with(F.zip_with(found, value, lambda m, v: F.struct(F.char_length(m).alias("m"), F.char_length(v).alias("v"))), F.slice(pieces, F.lit(1), F.size(found)), lambda m, p: F.struct(m["m"].alias("m"), m["v"].alias("v"), F.char_length(p).alias("p")))
    step = lambda a, r: F.struct((a["at"] + r["p"] + r["m"]).alias("at"), F.when(r["v"] >= rule.least, F.array_append(a["out"], F.struct((a["at"] + r["p"]).alias("start"), F.lit(number).alias("k"), (a["at"] + r["p"] + r["m"]).alias("end")))).otherwise(a["out"]).alias("out"))
    part = lambda some: F.aggregate(some, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step)
    moved = lambda out, by: F.transform(out, lambda x: F.struct((x["start"] + by).alias("start"), x["k"].alias("k"), (x["end"] + by).alias("end")))
    join = lambda a, some: _let(part(some), lambda e: F.struct((a["at"] + e["at"]).alias("at"), F.array_append(a["out"], moved(e["out"], a["at"])).alias("out")))
    parts = lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / MATCHES).cast("int")), lambda i: F.slice(r, i * MATCHES + 1, MATCHES))
    whole = F.aggregate(_let(rows, parts), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), join)["out"]
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), F.flatten(whole)).otherwise(F.array().cast(kind))


def postings(docs: DataFrame, trigrams: list[str], id_col: str, text_col: str) -> DataFrame:
    """The inverted index (trigram, id) over the trigrams that queries use."""
    low = docs.select(F.col(id_col).alias("_id"), F.lower(F.col(text_col)).alias("_t"))
    hits = F.filter(F.array(*[F.when(F.contains("_t", F.lit(t)), F.lit(t)) for t in trigrams]), lambda x: x.isNotNull())
    return low.select("_id", F.explode(hits).alias("trigram")).distinct()


def candidates(docs: DataFrame, rules: list[Rule], id_col: str, text_col: str) -> DataFrame:
    """(_id, _rules): the numbers of the rules whose trigram query holds for the document."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    terms = [(i, c, a, t, len(alt)) for i, q in queries.items() for c, clause in enumerate(q) for a, alt in enumerate(clause) for t in sorted(alt)]
    index = postings(docs, sorted({t[3] for t in terms}), id_col, text_col)
    rows = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("rule", "clause", "alt", "trigram", "need"), t, strict=True)]) for t in terms])).alias("x")
    table = docs.sparkSession.range(1).select(rows).select("x.*")
    met = index.join(F.broadcast(table), "trigram").groupBy("_id", "rule", "clause", "alt", "need").agg(F.count("*").alias("n")).filter("n = need")  # the table is a constant
    need = F.create_map(*[F.lit(x) for i, q in queries.items() for x in (i, len(q))])
    held = met.groupBy("_id", "rule").agg(F.count_distinct("clause").alias("c")).filter(F.col("c") == F.element_at(need, F.col("rule")))
    return held.groupBy("_id").agg(F.collect_set("rule").alias("_rules"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """(id, text, spans): spans is array<struct<start, k, end>>, k the number of the rule, sorted."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cand = Scratch(docs.sparkSession).keep(candidates(rows, rules, id_col, "text"))
    cand = F.broadcast(cand) if cand.count() <= BROADCAST_CANDIDATES else cand
    both = rows.join(cand, rows[id_col].eqNullSafe(cand["_id"]), "left")
    found = []
    for i, r in enumerate(rules):
        got = spans(F.col("text"), r, i)
        found.append(F.when(F.array_contains("_rules", i), got).otherwise(F.array().cast("array<struct<start:int,k:int,end:int>>")) if trigram_query(r.pattern) else got)
    return both.select(rows[id_col], "text", F.array_sort(F.concat(*found)).alias("spans"))


def digest(scanned: DataFrame, *, id_col: str = "doc_id", rules: list[Rule] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = [i for i, r in enumerate(rules) if r.base]
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", F.element_at(kinds, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda i: F.filter("spans", lambda s: s["k"] == i)
    counts = [F.size(of(i)).cast("bigint").alias(f"n_{rules[i].kind}") for i in base]
    return scanned.select(id_col, *counts, F.sha2(text(F.filter("spans", lambda s: s["k"].isin(base))), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def oracle() -> str:
    """DuckDB SQL for digest(scan(documents)): every rule scans every text, lengths tested afterwards."""
    cols, parts = [], []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''").replace(r"\x20", " ")
        cols.append(f"regexp_extract_all(t, '{pattern}') AS m{i}, regexp_extract_all(t, '{pattern}', {r.group}) AS v{i}, CASE WHEN regexp_matches(t, '{pattern}') THEN list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) END AS p{i}")
        parts.append(f"list_filter(list_transform(range(1, len(m{i}) + 1), lambda i: {{'s': list_sum(p{i}[1:i]) + coalesce(list_sum(list_transform(m{i}[1:i - 1], lambda x: length(x))), 0), 'k': {i}, 'n': length(m{i}[i]), 'v': length(v{i}[i])}}), lambda x: x.v >= {r.least})")
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    text = lambda xs: f"coalesce(array_to_string(list_transform({xs}, lambda x: {kinds}[x.k + 1] || ':' || x.s::BIGINT || ':' || (x.s + x.n)::BIGINT), ','), '')"
    base = f"list_filter(a, lambda x: x.k < {len(BASE)})"
    counts = ", ".join(f"len(list_filter(a, lambda x: x.k = {i})) AS n_{r.kind}" for i, r in enumerate(BASE))
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS MATERIALIZED (SELECT doc_id, {', '.join(cols)} FROM d), f AS (SELECT doc_id, list_sort(list_concat({', '.join(parts)})) AS a FROM c) SELECT doc_id, {counts}, sha256({text(base)}) AS base_sha256, {text('a')} AS spans FROM f"
