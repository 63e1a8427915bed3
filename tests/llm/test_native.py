"""The operators in DataFrame operations: against SQL on a whole small table, and on odd rows."""

import hashlib
import random
import re
import string
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointweave.llm import common, exact_dedup, quality_rules, secret_scan
from tools.check import compare, duck

from .conftest import odd_rows


@pytest.mark.parametrize("op", [quality_rules, secret_scan, exact_dedup], ids=lambda m: m.__name__.rpartition(".")[2])
def test_matches_sql(spark, sf, op):
    assert compare(op.query(spark, sf).toPandas(), duck(sf).execute(op.SQL).df()) is None


@pytest.mark.parametrize("op", [quality_rules.judge, secret_scan.report, secret_scan.redact, exact_dedup.report, exact_dedup.deduplicate], ids=lambda f: f.__module__.rpartition(".")[2] + "-" + f.__name__)
def test_empty_table(empty, op):
    assert op(empty).collect() == []


@pytest.mark.parametrize("op", [quality_rules.judge, secret_scan.report, exact_dedup.report], ids=lambda f: f.__module__.rpartition(".")[2])
def test_no_python_in_the_plan(odd, op, capsys):
    op(odd).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_rules_on_odd_rows(odd):
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(odd).collect()]
    want = []
    for i, text in odd_rows():
        w = words_of(text)
        lines = [x for x in (text or "").split("\n") if words_of(x)]
        windows = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k:k + 5])] > 1 for j in range(5)}
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)))
    assert Counter(got) == Counter(want)
    kept = {r.doc_id: r.kept for r in quality_rules.judge(odd).collect()}
    assert kept[1] and kept[4] and kept[7] and not any(kept[i] for i in (2, 3, 9, 15, 16, 18))


def test_line_ends_and_tabs_are_no_words(spark):
    ended, short = "These are nine words of a line, with an end.", "seven words that have no end mark"
    assert len(short.split()) == 7
    texts = {}
    for gap in ("\n", "\r\n", " \t\n", "\x0b\n\t", "\x0c \n"):
        texts |= {len(texts): gap.join([short, short + " x", ended, short, ended, ended]) + gap}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert {(r.n_lines, r.n_lines_removed, r.chars_removed) for r in got.values()} == {(6, 2, 2 * len(short.replace(" ", "")))}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": list(texts), "text": list(texts.values())}))
    assert compare(quality_rules.judge(df).withColumn("clean_sha256", F.sha2("clean_text", 256)).drop("clean_text").toPandas(), con.execute(quality_rules.SQL).df()) is None


def base_spans(text):
    out = []
    name = r"(?a:(?:password|passwd|secret|token|api_?key))"
    for m in re.finditer(rf"""(?ai:{name})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end())] if len(m[1]) >= 8 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secret_scan_on_odd_rows(odd, texts):
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_scan.report(odd).collect())
    want = Counter()
    for i, text in odd_rows():
        s = base_spans(text or "")
        named = ",".join(f"{secret_scan.BASE[k]}:{a}:{b}" for a, k, b in s)
        want[i, *(sum(k == x for _, k, _ in s) for x in range(3)), hashlib.sha256(named.encode()).hexdigest()] += 1
    assert got == want
    assert sum(n for (i, *_), n in got.items() if i == 13) == 1 and next(k for k in got if k[0] == 13)[1:4] == (1, 1, 1)


def test_trigram_queries_hold_for_every_match():
    examples = {"assign": ["PassWord:x", "api_key='y", "APIKEY = z", "secret=1"], "access": ["AKIA0000"], "github": ["ghp_" + "a" * 36], "slack": ["xoxb-0123456789"], "google": ["AIza" + "b" * 35],
                "jwt": ["eyJabcdefgh.eyJabcdefgh.abcdefgh"], "private": ["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"], "url": ["ftp://user:word@"]}
    for rule in secret_scan.RULES:
        query = secret_scan.trigram_query(rule.pattern)
        for x in examples.get(rule.kind, []):
            assert re.search(rule.pattern, x), (rule.kind, x)
            low = x.lower()
            assert query and all(any(all(t in low for t in s) for s in clause) for clause in query), (rule.kind, x)
    assert secret_scan.trigram_query("[0-9a-f]{32,}") == [] and secret_scan.trigram_query("ab") == []
    assert secret_scan.trigram_query("a(bcd|bce)f*") == [[frozenset({"abc", "bcd"}), frozenset({"abc", "bce"})]]


def test_redaction_leaves_no_secret_and_all_else(odd):
    out = {r.doc_id: r for r in secret_scan.redact(odd).collect()}
    assert secret_scan.redact(odd).columns == odd.columns
    assert out[14].text == "é😀 [SECRET]'" and out[14].n_chars == len(out[14].text) and out[14].row == "clash row"
    assert out[13].text.count("[SECRET]") == 3 and not base_spans(out[13].text)
    assert out[2].text is None and out[4].text == dict(odd_rows())[4]


def private_keys():
    rng = random.Random(8)
    line = lambda n: "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(n))
    for end in ("\n", "\r\n", "\\n", "\n    ", " "):
        for last in (1, 30, 63):
            lines = [line(64) for _ in range(25)] + [line(last) + "=="]
            yield end, lines, True
            if end in ("\n", "\r\n") or last > 20:
                yield end, lines, False
    yield "\n", ["Proc-Type: 4,ENCRYPTED", "DEK-Info: DES-EDE3-CBC,0A1B2C3D4E5F6071", "", *(line(64) for _ in range(12))], True
    yield "\n", ["Proc-Type: 4,ENCRYPTED", "DEK-Info: DES-EDE3-CBC,0A1B2C3D4E5F6071", "", *(line(64) for _ in range(12))], False
    yield "\n", [line(64) for _ in range(20_000)], True
    yield "\n", [line(64) for _ in range(20_000)], False


def test_redaction_takes_whole_keys_and_long_urls(spark):
    rows, bodies = [], {}
    for i, (end, lines, closed) in enumerate(private_keys()):
        key = end.join(["-----BEGIN RSA PRIVATE KEY-----", *lines, *(["-----END RSA PRIVATE KEY-----"] if closed else [])])
        rows.append((i, f"The key, of old:\n{key}\nAnd so, the text - as it was - goes on.\n"))
        bodies[i] = [x for x in lines if len(x) > 2]
    token = "0Ab_" * 500
    rows += [(1000, f"see https://{token}:{token}@host/x and ftp://u:{token}@h"), (1001, "-----BEGIN PRIVATE KEY-----"), (1002, "-----BEGIN PRIVATE KEY-----\nand then some words - no key")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    for i, lines in bodies.items():
        assert not any(x in out[i] for x in lines) and "[SECRET]" in out[i], (i, out[i][:300])
        assert out[i].startswith("The key, of old:\n[SECRET]") and out[i].endswith("so, the text - as it was - goes on.\n"), (i, out[i][:300])
    assert out[1000] == "see [SECRET]host/x and [SECRET]h" and out[1001] == "[SECRET]" and out[1002].endswith("and then some words - no key")
    assert {r.doc_id: r.n_spans for r in secret_scan.report(df).collect()}[1000] == 2


def test_only_keys_go_between_the_marks(spark):
    rng = random.Random(9)
    line = lambda n: "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(n))
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    comment = "Comment: " + " ".join(f"word-{i}-of-a-long--header" for i in range(200))
    body = [line(64) for _ in range(30)] + [line(11) + "="]
    whole = {}
    for newline in ("\n", "\r\n", "\\n"):
        whole |= {len(whole): newline.join([begin, comment, *[f"X-{i}: a-b" for i in range(50)], "", *body, end])}
        whole |= {len(whole): newline.join([begin, comment, "", *body])}
    whole |= {len(whole): "\n".join([begin, *[line(16) for _ in range(50)], end])}  # narrow lines
    whole |= {len(whole): f"{begin} Proc-Type: 4,ENCRYPTED DEK-Info: AES-128-CBC,0A {line(64)} {line(64)} {end}"}
    whole |= {len(whole): "\n".join(["-----BEGIN PGP PRIVATE KEY-----", "Version: 1", "", *body, "=abcd", "-----END PGP PRIVATE KEY-----"])}
    whole |= {len(whole): begin + "\n" + "\n".join(f"X{i}: {line(30)}" for i in range(20_000)) + "\n" + line(2_000_000) + "\n" + end}
    prose = " and with it starts a key, as all know. " + "It goes on for a while - on and on, without one. " * 1000 + "\nNote: it ends there.\nOne word\nper line\n"
    texts = {i: f"Here: {x}\nThe text goes on." for i, x in whole.items()}
    texts |= {100: f"A file begins with {begin}{prose}{end}, and so on.", 101: f"{begin}\nNote: nothing follows.\nSome words.\n{end}", 102: (begin + "\n") * 3000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    for i in whole:
        assert re.fullmatch(r"Here: \[SECRET\](\n|\\n)?\n?The text goes on\.", out[i]), (i, out[i][:300])
    assert out[100] == f"A file begins with [SECRET]{prose}{end}, and so on."
    assert out[101] == f"[SECRET]\nNote: nothing follows.\nSome words.\n{end}" and out[102] == "[SECRET]\n" * 3000
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": list(texts), "text": list(texts.values())}))
    assert compare(secret_scan.report(df).toPandas(), con.execute(secret_scan.SQL).df()) is None


@pytest.mark.parametrize("few", [500_000, 0])
def test_exact_dedup_on_odd_rows(odd, monkeypatch, few):
    monkeypatch.setattr(common, "BROADCAST_ROWS", few)
    rows = odd_rows()
    group = {}
    for i, text in rows:
        group.setdefault(text or "", []).append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in group.items()}
    got = exact_dedup.report(odd).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((i, top[t or ""], len(group[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in group)
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and Counter(r.text or "" for r in kept.collect()) == Counter(group.keys())


@pytest.mark.parametrize("few", [500_000, 1, 0])
def test_a_large_group_is_salted(spark, monkeypatch, few):
    monkeypatch.setattr(common, "BROADCAST_ROWS", few)
    many = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"))
    pairs = spark.range(10_000, 10_040).select(F.col("id").alias("doc_id"), F.concat(F.lit("pair "), F.expr("id div 2").cast("string")).alias("text"))
    kept = exact_dedup.report(many.union(pairs)).filter("kept").select("doc_id", "keep_id", "group_size").collect()
    assert sorted(kept) == [(8999, 8999, 9000), *((x, x, 2) for x in range(10_001, 10_040, 2))]
