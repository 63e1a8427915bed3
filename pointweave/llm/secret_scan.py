"""Secret scan over a trigram inverted index, DataFrame operations only.

From each rule's regular expression a Boolean query over trigrams is derived: every match must contain one of some
strings, and so all trigrams of that string. The index holds, for the trigrams that occur in a query, the rows whose
lower-cased text has them. All posting lists are intersected at once by one aggregation over the rows' keys, and the
candidates are verified with the regular expression itself. A rule without mandatory trigrams reads every text.

The index is narrow (a trigram's number and a key), its lists are never gathered, and the frequent trigrams spread over
the keys. Candidates go back to the texts by a broadcast when their counted number allows it, else by a shuffle.

Defined results: a null text counts as empty; positions are code points, end exclusive; repeated rows each get their
result; an empty table gives an empty result; extra columns are ignored by `report` and carried by `redact`. The work of
one text grows with its length times its number of matches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_narrow, stored

_parser = re._parser


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # of which the length counts
    least: int = 1
    jvm: str | None = None  # the same matches, written for the JVM's engine


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = f"{_either('password')}|{_either('passwd')}|{_either('secret')}|{_either('token')}|{_either('api')}_?{_either('key')}"

_KEY = "[A-Z0-9 ]*PRIVATE KEY-----"


def _private(hold: str, end: str) -> str:
    """A private key: the BEGIN mark, lines of a header, runs of base64 and the END mark, with nothing else between.

    A run is a line of any length, or after a blank 20 characters at least; quotes, indents, comment signs and written-out
    line ends may part runs. Without an END mark the key ends with its runs and the short line after them, if that
    holds nothing else. Where neither fits, as in prose that speaks of the marks, the BEGIN mark alone is taken.
    `hold` makes the repeats possessive: what a repeat takes can never be of use to what follows, so the matches are the
    same, and an engine that backtracks needs neither stack nor second tries.
    """
    run, blank = "[A-Za-z0-9+/=]", r"""[\x20\t"',;#*>|]"""
    newline, gap = rf"(?:[\r\n]|\\[nr]?{hold})", rf"""(?:[\x20\t"',;#*>|\r\n]|\\[nr]?{hold})"""
    headers = rf"(?:{gap}+{hold}[A-Za-z][A-Za-z0-9-]*{hold}:(?:-{{0,4}}{hold}[^\r\n\\-])*{hold})"
    runs = rf"(?:{blank}*{hold}(?:{newline}{gap}*{hold}{run}+{hold}|{run}{{20,}}{hold}))*{hold}(?:{blank}+{hold}{run}+{hold})?"
    closed = rf"{headers}*{hold}{runs}{gap}*{hold}-----END {_KEY}"
    open_end = rf"(?:{headers}+{hold}{blank}*{hold}{newline})?{gap}*{hold}{run}{{20,}}{hold}(?:{gap}+{hold}{run}{{20,}}{hold})*{hold}(?:{newline}+{hold}{run}+{hold}[\x20\t\r]*{hold}(?:\n|{end}))?"
    return rf"-----BEGIN {_KEY}(?:{closed}|{open_end})?"


#: The base kinds first, in the order that the result lists them.
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private", _private("", "$"), jvm=_private("+", r"\z")),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s:@/]+:[^\s:@/]+@"),
)
BASE = ("assign", "access", "hex")


# --- Boolean trigram queries -------------------------------------------------------------------------------------

Query = list[list[frozenset[str]]]  # all of the clauses; of a clause one set; of a set all trigrams
MOST_STRINGS, MOST_OF_CLASS = 64, 8


def _strings(item) -> set[str] | None:
    """All strings that an item of a parsed pattern can match, lower-cased, or None if they are too many to list."""
    op, arg = str(item[0]), item[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
        found = {chr(a).lower() for _, a in arg}
        return found if len(found) <= MOST_OF_CLASS else None
    if op == "SUBPATTERN":
        return _all_strings(arg[3])
    if op == "BRANCH":
        parts = [_all_strings(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op == "MAX_REPEAT" and arg[1] == 1:
        inner = _all_strings(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _all_strings(items) -> set[str] | None:
    out = {""}
    for item in items:
        found = _strings(item)
        if found is None or len(out) * len(found) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, found)}
    return out


def _clause(strings: set[str]) -> list[frozenset[str]] | None:
    sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    if frozenset() in sets:
        return None  # a string too short says nothing
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def trigram_query(pattern: str) -> Query:
    """What every match of the pattern contains; an empty query holds for every text."""
    return _query(_parser.parse(pattern))


def _query(items) -> Query:
    """Neighbouring items that can be listed are joined to strings; each such run gives a clause."""
    clauses, run = [], {""}
    for item in items:
        found = _strings(item)
        if found is not None and len(run) * len(found) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, found)}
            continue
        clauses.append(_clause(run))
        run = found if found is not None else {""}
        if found is None and str(item[0]) == "SUBPATTERN":
            clauses += _query(item[1][3])
    return [c for c in [*clauses, _clause(run)] if c]


# --- Index, intersection, verification ---------------------------------------------------------------------------

def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index over `key` and `low` (the lower-cased text): trigram (its number), key."""
    present = F.array(*(F.when(F.col("low").contains(t), F.lit(i)) for i, t in enumerate(trigrams)))
    return rows.select("key", F.explode(F.array_compact(present)).alias("trigram"))


def candidates(index: DataFrame, queries: dict[int, Query], trigrams: list[str]) -> DataFrame:
    """key, rules (bit of each rule whose query the row's posting lists satisfy)."""
    number = {t: i for i, t in enumerate(trigrams)}
    words = (len(trigrams) + 61) // 62
    has = [F.bit_or(F.when(F.floor(F.col("trigram") / 62) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("trigram") % 62).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"has{w}") for w in range(words)]

    def all_of(trigram_set: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in range(words):
            bits = sum(1 << (number[t] % 62) for t in trigram_set if number[t] // 62 == w)
            if bits:
                out = out & (F.col(f"has{w}").bitwiseAND(F.lit(bits)) == F.lit(bits))
        return out

    rules = F.lit(0)
    for bit, query in queries.items():
        holds = F.lit(True)
        for clause in query:
            one = F.lit(False)
            for s in clause:
                one = one | all_of(s)
            holds = holds & one
        rules = rules.bitwiseOR(F.when(holds, F.lit(1 << bit)).otherwise(F.lit(0)))
    return index.groupBy("key").agg(*has).select("key", rules.alias("rules")).filter("rules != 0")


def _spans(body: Column, rule: Rule, order: int) -> Column:
    """The rule's spans: lengths of the matches and of what lies between them, summed up."""
    pattern = F.lit(rule.jvm or rule.pattern)
    found = F.arrays_zip(
        F.transform(F.split(body, rule.jvm or rule.pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(F.regexp_extract_all(body, pattern, F.lit(0)), lambda x: F.length(x)).alias("whole"),
        F.transform(F.regexp_extract_all(body, pattern, F.lit(rule.group)), lambda x: F.length(x)).alias("part"))
    empty = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    summed = F.aggregate(
        F.filter(found, lambda x: x["whole"].isNotNull()), F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.struct((a["at"] + x["gap"] + x["whole"]).alias("at"), F.when(x["part"] >= rule.least, F.concat(a["out"], F.array(F.struct(
            (a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["whole"]).alias("end"), F.lit(order).alias("kind"))))).otherwise(a["out"]).alias("out")))
    return summed["out"]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """row (all columns of the document), body, spans (sorted array of start, end, kind as the rule's place)."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    body = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = packed.select("row", body.alias("body"), F.xxhash64(F.col("row.doc_id"), body).alias("key"))
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for c in q for s in c for t in s})
    if trigrams:
        met = stored(candidates(postings(rows.select("key", F.lower("body").alias("low")), trigrams), queries, trigrams))
        rows = join_narrow(rows, met, "key", "left")
    else:
        rows = rows.withColumn("rules", F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    parts = [F.when((F.coalesce("rules", F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0) if i in queries else F.lit(True), F.when(F.col("body").rlike(r.jvm or r.pattern), _spans(F.col("body"), r, i))) for i, r in enumerate(rules)]
    return rows.select("row", "body", F.array_sort(F.concat(*(F.coalesce(p, none) for p in parts)), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(0)).alias("spans"))


def _named(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _equals(value: int):
    return lambda x: x == value


def report(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans."""
    found = scan(docs.select("doc_id", "text"))
    n = [F.size(F.filter(F.transform("spans", lambda x: x["kind"]), _equals(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    return found.select(F.col("row.doc_id").alias("doc_id"), *n, F.sha2(_named(base, RULES), 256).alias("base_sha256"), _named(F.col("spans"), RULES).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each stretch of secrets replaced by a mark, and n_chars counted anew where there is such a column."""
    found = scan(docs)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    folded = F.aggregate("spans", start, lambda a, x: F.when(x["start"] >= a["at"], F.struct(
        x["end"].alias("at"), F.concat(a["out"], F.substring("body", a["at"] + 1, x["start"] - a["at"]), F.lit(mark)).alias("out"))).otherwise(F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))))
    clean = found.select("row", "spans", "body", folded.alias("f")).select("row", "spans", F.concat(F.col("f.out"), F.substring("body", F.col("f.at") + 1, F.length("body"))).alias("clean"))
    hit = F.size("spans") > 0
    kinds = dict(docs.dtypes)
    new = {"text": F.when(hit, F.col("clean")).otherwise(F.col("row.text"))} | ({"n_chars": F.when(hit, F.length("clean").cast(kinds["n_chars"])).otherwise(F.col("row.n_chars"))} if "n_chars" in kinds else {})
    return clean.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def query(spark, sf_dir):
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """The same spans without an index: every rule on every text."""
    text = lambda s: s.replace("'", "''")
    parts = []
    for i, r in enumerate(RULES):
        parts.append(f"""
        SELECT rid, {i} AS k, '{r.kind}' AS kind, start_at AS s, start_at + length(m) AS e FROM (
          SELECT rid, m, p, sum(length(g) + coalesce(length(pm), 0)) OVER (PARTITION BY rid ORDER BY j) AS start_at FROM (
            SELECT rid, unnest(ms) AS m, unnest(ps) AS p, unnest(gs[:len(ms)]) AS g, unnest(list_prepend(NULL, ms[:len(ms) - 1])) AS pm, unnest(range(len(ms))) AS j FROM (
              SELECT rid, regexp_extract_all(body, '{text(r.pattern)}', 0) AS ms, regexp_extract_all(body, '{text(r.pattern)}', {r.group}) AS ps, regexp_split_to_array(body, '{text(r.pattern)}') AS gs FROM d)
            WHERE len(ms) > 0))
        WHERE length(p) >= {r.least}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents), spans AS ({' UNION ALL '.join(parts)}),
named AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3), '') AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans, count(*) AS n_spans FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN named USING (rid)
"""


SQL = _sql()
