"""Quality rules, line first, DataFrame operations only.

Every line is judged by itself: marks and symbols where prose should be, rows of menu entries, known boilerplate. Failing
lines are removed, and a document that loses too much of its text so is rejected. Before that stand the base rules over
the whole document: too few words, too many words in repeated five-word windows.

Everything is computed inside the row, so nothing is shuffled and no key can be hot. Windows are compared by 64-bit
hashes within one document.

Defined results: a null or empty text has no words and fails the base rules; lines without a word are neither judged nor
counted; white space of any kind at the ends of a line, a carriage return too, is no word and hides no end mark; repeated
rows get equal results; extra columns are ignored; an empty table gives an empty result. A very long text takes one task
time in proportion to its length, and memory for some copies of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, whole_text

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A document is rejected when more than this share of its word characters is lost with the lines.
MAX_LOST_PERCENT = 30
#: A line without an end mark passes as prose only from this many words.
MIN_WORDS_UNENDED = 8

WORD_IN_LINE = r"[^\x20\x09-\x0D]"
#: Rule name, and the pattern on which a line fails. Patterns hold for Java and for RE2.
LINE_RULES = (
    ("symbols", r"([#*$%&<>]{2,}[^#*$%&<>]*){4}"),
    ("shouting", r"(!!+[^!]*){3}"),
    ("navigation", r"(\|[^|]*){3}|( [>»›·•] [^>»›·•]*){3}"),
    ("boilerplate", r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie policy|we use cookies|accept (all )?cookies|javascript (is|must be)|enable javascript|lorem ipsum|subscribe to our newsletter|click here to|follow us on|share (this )?on (facebook|twitter))"),
)
END_MARK = r"""[.!?…:;,"'”’»)\]][\x20\x09-\x0D]*\z"""
ENOUGH_WORDS = rf"({WORD_IN_LINE}+{GAP}){{{MIN_WORDS_UNENDED - 1}}}{WORD_IN_LINE}"
SYMBOL = r"[^#*$%&|<>]+"


def line_fails(line: Column) -> Column:
    out = F.lit(False)
    for _, pattern in LINE_RULES:
        out = out | line.rlike(pattern)
    return out | (~line.rlike(END_MARK) & ~line.rlike(ENOUGH_WORDS))


def _covered(starts: Column) -> Column:
    """How many words the windows at these sorted starts cover."""
    return F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, i: F.struct(
        (i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n")))["n"]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the base figures, and `lines`: structs of a line and whether it fails."""
    rows = docs.select("doc_id", whole_text().alias("body"))
    rows = rows.select("doc_id", "body", F.filter(F.split("body", GAP), lambda w: w != "").alias("words"), F.filter(F.split("body", "\n"), lambda x: x.rlike(WORD_IN_LINE)).alias("lines"))
    at = lambda i, k: F.get(F.col("words"), i + k)
    windows = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW)))))
    rows = rows.select("doc_id", "lines", F.size("words").cast("long").alias("n_words"), F.length(F.regexp_replace("body", GAP, "")).cast("long").alias("word_chars"), F.length(F.regexp_replace("body", SYMBOL, "")).cast("long").alias("n_symbols"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("windows"))
    once = F.coalesce(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(True))
    rows = rows.withColumn("sorted", F.when(~once, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda x, j: (F.get(F.col("sorted"), j - 1)["h"] == x["h"]) | (F.get(F.col("sorted"), j + 1)["h"] == x["h"])
    starts = F.transform(F.filter("sorted", lambda x, j: F.coalesce(near(x, j), F.when(j == 0, F.get(F.col("sorted"), j + 1)["h"] == x["h"]).otherwise(F.get(F.col("sorted"), j - 1)["h"] == x["h"]))), lambda x: x["i"])
    rows = rows.withColumn("n_repeat_words", F.coalesce(_covered(F.sort_array(starts)), F.lit(0)).cast("long"))
    return rows.withColumn("lines", F.transform("lines", lambda x: F.struct(x.alias("line"), line_fails(x).alias("fails")))).drop("windows", "sorted")


def _size(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(F.regexp_replace(x["line"], GAP, ""))).cast("long")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, figures, verdicts, and `clean_text`: the lines that passed."""
    rows = measure(docs)
    rows = rows.withColumn("failing", F.filter("lines", lambda x: x["fails"]))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), F.size("lines").cast("long").alias("n_lines"), F.size("failing").cast("long").alias("n_lines_removed"), _size(F.col("failing")).alias("chars_removed"),
                       F.array_join(F.transform(F.filter("lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("clean_text"))
    return rows.withColumn("kept", ~F.col("base_failed") & (100 * F.col("chars_removed") <= MAX_LOST_PERCENT * F.col("word_chars")))


def query(spark, sf_dir):
    """The report; the clean text goes in as its digest."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("clean_sha256", F.sha2("clean_text", 256)).drop("clean_text")


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    fails = " OR ".join(f"regexp_matches(l, {q(p)})" for _, p in LINE_RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(body, {q(GAP)}), lambda x: x <> '') AS words, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, {q(WORD_IN_LINE)})) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range({WINDOW}) t(k) GROUP BY rid),
ln AS (SELECT rid, j, l, ({fails} OR (NOT regexp_matches(l, {q(END_MARK)}) AND len(list_filter(regexp_split_to_array(l, {q(GAP)}), lambda x: x <> '')) < {MIN_WORDS_UNENDED})) AS fails FROM (SELECT rid, unnest(lines) AS l, unnest(range(len(lines))) AS j FROM w)),
ls AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (fails) AS n_lines_removed, coalesce(sum(length(regexp_replace(l, {q(GAP)}, '', 'g'))) FILTER (fails), 0)::BIGINT AS chars_removed, coalesce(string_agg(l, chr(10) ORDER BY j) FILTER (NOT fails), '') AS clean FROM ln GROUP BY rid),
m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(body, {q(GAP)}, '', 'g')) AS word_chars, length(regexp_replace(body, {q(SYMBOL)}, '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(chars_removed, 0) AS chars_removed, sha256(coalesce(clean, '')) AS clean_sha256 FROM w LEFT JOIN cov USING (rid) LEFT JOIN ls USING (rid))
SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * chars_removed <= {MAX_LOST_PERCENT} * word_chars AS kept FROM m
"""


SQL = _sql()
