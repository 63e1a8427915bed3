"""Quality classifier from weak labels: no hand-made label is used.

Several heuristic labellers each vote good, bad or nothing on every document. Expectation-maximisation over the counts of
vote patterns estimates how often each labeller votes what in good and in bad documents; there are at most 3 to the power
of their number of patterns, so all documents take part and only that bounded table reaches the driver. The posterior of
a document's pattern is its soft label. On a bounded sample of TRAIN_ROWS documents (those with the least hashes of id and
text) a logistic scorer over hashed features is trained on these labels; it then scores every document.

Features: the shapes of words and of word pairs (case, digits and marks, runs shortened), suffixes, repeats of the word
before, and the labellers' figures in steps; hashed to DIMENSIONS places.

Defined results: a null text counts as empty; a text without words has score 0 and is rejected; repeated rows get equal
results; an empty table gives an empty result; extra columns are ignored by `judge` and carried by `keep_good`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, kept, whole_text
from .textops import mixed, words_of

#: Bound of the sample on which the scorer is trained.
TRAIN_ROWS = 4000
DIMENSIONS = 1 << 14
HELD = 800_000
#: Leans to keeping: clean documents of a few words score low.
THRESHOLD = 0.3

_RUNS = re.compile(r"A{2,}|a+|0+|([^\w\s])\1+")
_SYMBOL = re.compile(r"[#*$%&|<>]{2,}|[#*$%&|<>]$|^[#*$%&|<>]")
_SHOUTED = re.compile(r"^[^\w]*A{2,}[^a]*$")
_PLAIN = re.compile(r"^[\"'(“‘«¿¡]*[Aa]+(['’-][Aa]+)*[.,;:!?…\"')”’»]{0,2}$")
_ENDED = re.compile(r"[.!?…:][\"'”’»)]*[ \t]*(?:\n|\Z)")
_LINE = re.compile(r"[^\n]*[^\s][^\n]*")


class _Kinds(dict):
    """Characters by kind: A capital, a other letter, 0 digit, all else itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return out


class Words:
    """Figures of words, remembered by word: code, shape, suffix, and whether it is a symbol, shouted, marked, a bar, plain.

    All but the code follow from a word's letter kinds and its end, of which there are few."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.space = np.zeros((1024, 8), np.uint64)
        self.kinds, self.shapes, self.ends = _Kinds(), {}, {}

    def _shape(self, kinds: str) -> tuple:
        shape = _RUNS.sub(lambda m: {"A": "W", "a": "a", "0": "0"}.get(m[0][0], m[0][:2]), kinds)
        return _hash("s" + shape[:12]), bool(_SYMBOL.search(kinds)) and kinds != "|", bool(_SHOUTED.match(kinds)), kinds.endswith("!!"), kinds == "|", bool(_PLAIN.match(kinds))

    def _figures(self, word: str) -> tuple:
        kinds, end = word.translate(self.kinds), word[-3:]
        shape = self.shapes.get(kinds)
        if shape is None:
            shape = self.shapes[kinds] = self._shape(kinds)
        tail = self.ends.get(end)
        if tail is None:
            tail = self.ends[end] = _hash("e" + end)
        return (_hash(word), shape[0], tail, *shape[1:])

    def of(self, words: list[str]) -> np.ndarray:
        if max(len(self.place), len(self.shapes), len(self.ends)) > HELD:
            self.__init__()
        place, held = self.place, len(self.place)
        at = list(map(place.get, words))
        if None in at:
            new = list(dict.fromkeys(w for w, k in zip(words, at, strict=True) if k is None))
            place.update(zip(new, range(held, held + len(new)), strict=True))
            if len(place) > len(self.space):
                self.space = np.concatenate([self.space, np.zeros((len(place), 8), np.uint64)])
            self.space[held:len(place)] = np.array([self._figures(w) for w in new], np.uint64)
            at = list(map(place.get, words))
        return self.space[np.array(at, np.int64)]


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode())


def figures(text: str, words: np.ndarray) -> np.ndarray:
    """What the labellers look at: shares of symbols, shouted, marked, bars, plain words, repeats, distinct pairs, ended lines."""
    n = len(words)
    shares = words[:, 3:].astype(np.float64).mean(0)
    code = words[:, 0]
    again = float((code[1:] == code[:-1]).mean()) if n > 1 else 0.0
    both = np.sort(code[1:] * np.uint64(3) + code[:-1])
    pairs = (1 + int((both[1:] != both[:-1]).sum())) / (n - 1) if n > 1 else 1.0
    lines = len(_LINE.findall(text))
    return np.array([*shares, again, pairs, min(1.0, len(_ENDED.findall(text)) / max(1, lines))])


@dataclass(frozen=True)
class Labeller:
    name: str
    figure: int
    good: float  # votes good at or beyond this, away from `bad`
    bad: float
    words: int = 1  # votes nothing on fewer words


LABELLERS = (
    Labeller("few symbols", 0, 0.05, 0.30),
    Labeller("not shouted", 1, 0.20, 0.60),
    Labeller("few exclamations", 2, 0.05, 0.30),
    Labeller("no bars", 3, 0.05, 0.15),
    Labeller("plain words", 4, 0.85, 0.50),
    Labeller("few repeats", 5, 0.10, 0.30),
    Labeller("new pairs", 6, 0.80, 0.40, 20),
    Labeller("ended lines", 7, 0.60, 0.20),
)


def votes(figure: np.ndarray, n: int) -> int:
    """The pattern: a digit to base 3 per labeller, 0 nothing, 1 bad, 2 good."""
    out = 0
    for lab in LABELLERS:
        x, up = figure[lab.figure], lab.good > lab.bad
        good, bad = (x >= lab.good, x <= lab.bad) if up else (x <= lab.good, x >= lab.bad)
        out = 3 * out + (0 if n < lab.words else 2 if good else 1 if bad else 0)
    return out


def digits(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3 ** (len(LABELLERS) - 1 - k) % 3 for k in range(len(LABELLERS))], 1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each pattern, and the chances of votes: [good or bad, labeller, vote]. Starts from the
    view that one bad vote in three makes a document bad."""
    vote = digits(patterns)
    bad, good = (vote == 1).sum(1), (vote == 2).sum(1)
    post = np.where(bad + good == 0, 0.5, np.clip(1 - 3 * bad / np.maximum(1, bad + good), 0.02, 0.98))
    chance = np.zeros((2, len(LABELLERS), 3))
    for _ in range(rounds):
        prior = (post @ counts + 1) / (counts.sum() + 2)
        for c, w in enumerate((post * counts, (1 - post) * counts)):
            for v in range(3):
                chance[c, :, v] = ((vote == v) * w[:, None]).sum(0) + 0.5
        chance /= chance.sum(2, keepdims=True)
        log = [np.log(chance[c][np.arange(len(LABELLERS)), vote]).sum(1) for c in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(log[1] + np.log(1 - prior) - log[0] - np.log(prior), -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, chance


def features(words: np.ndarray, figure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's hashed features."""
    shape, n = words[:, 1], len(words)
    tokens = np.concatenate([shape, words[:, 2], mixed(shape[1:] * np.uint64(5) + shape[:-1])])
    counts = np.bincount((tokens % np.uint64(DIMENSIONS)).astype(np.int64), minlength=DIMENSIONS)
    place = np.flatnonzero(counts)
    steps = mixed(97 + 31 * np.arange(len(figure), dtype=np.uint64) + np.uint64(1009) * (10 * figure).astype(np.uint64)) % np.uint64(DIMENSIONS)
    return np.concatenate([place, steps.astype(np.int64)]).astype(np.int32), np.concatenate([np.sqrt(counts[place] / n), np.ones(len(steps))]).astype(np.float32)


def train(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 300, step: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer on soft labels, by Adam on the whole sample."""
    weights = np.zeros(DIMENSIONS + 1)
    if not samples:
        return weights
    row = np.repeat(np.arange(len(samples)), [len(p) for p, _ in samples])
    place, value = np.concatenate([p for p, _ in samples]), np.concatenate([v for _, v in samples]).astype(np.float64)
    m, s = np.zeros_like(weights), np.zeros_like(weights)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[place] * value, len(samples)) + weights[-1], -30, 30)))
        d = (p - labels) / len(samples)
        g = np.append(np.bincount(place, d[row] * value, DIMENSIONS), d.sum()) + decay * weights
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        weights -= step * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
    return weights


def _patterns(memo):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = kept(memo, "words", Words), Counter()
        for b in batches:
            for text in b.column("body").to_pylist():
                if words := words_of(text):
                    found[votes(figures(text, known.of(words)), len(words))] += 1
        yield pa.record_batch([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["pattern", "n"])
    return run


def _samples(memo):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept(memo, "words", Words)
        for b in batches:
            rows = []
            for key, text in zip(b.column("key").to_pylist(), b.column("body").to_pylist(), strict=True):
                if words := words_of(text):
                    table = known.of(words)
                    figure = figures(text, table)
                    rows.append((key, votes(figure, len(words)), *(x.tolist() for x in features(table, figure))))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32())), strict=True)], names=["key", "pattern", "place", "value"])
    return run


@dataclass
class Model:
    weights: np.ndarray
    patterns: np.ndarray
    posterior: np.ndarray
    chance: np.ndarray
    memo: object  # the workers' words, a broadcast


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Votes of all documents, the labellers' estimated chances, and the scorer trained on a bounded sample."""
    arrow_rows(docs.sparkSession, 2000)
    memo = docs.sparkSession.sparkContext.broadcast({})
    rows = docs.select(F.col("doc_id"), whole_text().alias("body"))
    table = rows.select("body").mapInArrow(_patterns(memo), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # at most 3 ** len(LABELLERS)
    patterns, counts = (np.array([r[k] for r in table], np.int64) for k in (0, 1))
    posterior, chance = estimate(patterns, counts) if len(table) else (np.array([]), np.zeros((2, len(LABELLERS), 3)))
    keyed = rows.select(F.xxhash64("doc_id", "body").alias("key"), "body")
    least = keyed.select("key").orderBy("key").limit(train_rows).groupBy("key").count().collect()  # at most train_rows
    times = {r.key: r["count"] for r in least}
    # Equal rows have one key: they are read once and count as often as they stand among the least.
    sample = keyed.filter(F.col("key") <= F.lit(max(times, default=-(2**63)))).groupBy("key").agg(F.min("body").alias("body")).mapInArrow(_samples(memo), "key long, pattern long, place array<int>, value array<float>")
    got = sorted((r.pattern, r.place, r.value) for r in sample.toLocalIterator() for _ in range(times.get(r.key, 0))) if times else []
    of = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))
    weights = train([(np.array(p), np.array(v)) for _, p, v in got], np.array([of[p] for p, _, _ in got]))
    return Model(weights, patterns, posterior, chance, memo)


def _scorer(weights, memo):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, known = weights.value, kept(memo, "words", Words)
        for texts in batches:
            out = []
            for text in texts.to_pylist():
                words = words_of(text)
                if not words:
                    out.append(0.0)
                    continue
                table = known.of(words)
                place, value = features(table, figures(text, table))
                out.append(round(float(1 / (1 + np.exp(-np.clip(w[place] @ value + w[-1], -30, 30)))), 6))
            yield pa.array(out, pa.float64())
    return run


def scores(docs: DataFrame, model: Model):
    """The score of a text as a column: takes the column of texts."""
    from pyspark.sql.functions import arrow_udf

    arrow_rows(docs.sparkSession, 2000)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)

    run = _scorer(docs.sparkSession.sparkContext.broadcast(model.weights), model.memo)
    return arrow_udf(score, "double")


def judge(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, score, kept."""
    model = model or fit(docs)
    out = docs.select("doc_id", whole_text().alias("body"))
    return out.select("doc_id", scores(docs, model)(F.col("body")).alias("score")).select("doc_id", "score", (F.col("score") >= THRESHOLD).alias("kept"))


def keep_good(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    model = model or fit(docs)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    body = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    return row.withColumn("score", scores(docs, model)(body)).filter(F.col("score") >= THRESHOLD).select("row.*")


def query(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
