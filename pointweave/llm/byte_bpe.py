"""Byte-level BPE encoding and decoding on padded numpy matrices.

The distinct pre-tokens of a batch are laid out by length: pre-tokens of similar length form a matrix of single-byte ids,
padded on the right. In every round each row merges its leftmost pair of minimum rank; the row's other ids close up, so
the matrix gets one column narrower, and finished rows leave it. Ranks of pairs come from a hash table in numpy arrays.

A worker remembers the ids of chunks between spaces and line breaks: the pattern never matches across a single space or
line break between two other characters, save that the space begins the next match. Texts with other white space are
matched as a whole.

Defined results: a null text counts as empty and has no ids; repeated rows each get their result; an empty table gives an
empty result; extra columns are ignored. Any text decodes to its own bytes. The rounds of one pre-token are at most its
bytes, so the work of a single very long run of letters grows with the square of its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, tokenizer_path, whole_text

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Chunks of which a worker remembers the ids.
HELD = 300_000
#: Upper ends of the length buckets, in bytes; longer pre-tokens go by powers of two.
WIDTHS = (2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64)
CELLS = 1 << 20
NONE = np.iinfo(np.int32).max
#: White space as the pattern means it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}


class PairTable:
    """Open addressing: the rank of the token that two tokens make together."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slots, left = self._slots(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.keys[slots[left]] < 0]
            _, one = np.unique(slots[free], return_index=True)
            put = free[one]
            self.keys[slots[put]], self.ranks[slots[put]] = keys[put], ranks[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where there is no such token; a padded id (-1) makes no pair."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        keys[(a < 0) | (b < 0)] = -2
        slots = self._slots(keys)
        out = np.where(self.keys[slots] == keys, self.ranks[slots], NONE)
        open_ = (self.keys[slots] != keys) & (self.keys[slots] >= 0) & (keys >= 0)
        at = np.nonzero(open_)
        for _ in range(self.probes):
            if not len(at[0]):
                break
            slots[at] = (slots[at] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[slots[at]] == keys[at]
            out[tuple(x[hit] for x in at)] = self.ranks[slots[tuple(x[hit] for x in at)]]
            on = ~hit & (self.keys[slots[at]] >= 0)
            at = tuple(x[on] for x in at)
        return out


class ByteBPE:
    """Encoder and decoder over a file of ranks."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        table = np.array(pairs, np.int64).reshape(-1, 3)
        self.pairs = PairTable((table[:, 0] << 32) | table[:, 1], table[:, 2].astype(np.int32))
        pattern = pattern or public_tokenizers.PATTERN
        self.match = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        self.first: dict[str, bytes | None] = {}
        self.after: dict[str, bytes | None] = {}
        self.known: dict[str, bytes] = {}
        self.text = [str(i) for i in range(len(self.tokens))]

    # --- merges ---

    def _matrix(self, raw: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pre-tokens of at most `width` bytes."""
        n = np.array([len(x) for x in raw])
        data = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raw), np.uint8).reshape(len(raw), width)
        ids = np.where(np.arange(width) < n[:, None], self.single[data], -1).astype(np.int32)
        row, out = np.arange(len(raw)), [None] * len(raw)
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(ids):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(ids), np.int64)  # the leftmost of the least
            best = rank[np.arange(len(ids)), at] if rank.shape[1] else np.full(len(ids), NONE)
            done = best == NONE
            if done.any():
                for r, x in zip(row[done], ids[done], strict=True):
                    out[r] = x[x >= 0]
                live = ~done
                ids, rank, row, at, best = ids[live], rank[live], row[live], at[live], best[live]
                if not len(ids):
                    break
            each = np.arange(len(ids))
            ids[each, at] = best
            keep = np.ones(ids.shape, bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(len(ids), -1)
            keep = np.ones(rank.shape, bool)
            keep[each, at] = False
            rank = rank[keep].reshape(len(ids), -1)
            if rank.shape[1]:  # only the pairs beside the merged id are new
                left, right = at > 0, at < rank.shape[1]
                rank[each[left], at[left] - 1] = self.pairs.find(ids[each[left], at[left] - 1], best[left])
                rank[each[right], at[right]] = self.pairs.find(best[right], ids[each[right], at[right] + 1])
        return out

    def _merge(self, tokens: list[str]) -> None:
        """Learns the ids of pre-tokens."""
        raw = [t.encode() for t in tokens]
        buckets: dict[int, list[int]] = {}
        for i, x in enumerate(raw):
            whole = self.ranks.get(x)
            if whole is not None:
                self.known[tokens[i]] = whole.to_bytes(4, "little")
            else:
                buckets.setdefault(next((w for w in WIDTHS if len(x) <= w), 1 << (len(x) - 1).bit_length()), []).append(i)
        for width, members in buckets.items():
            step = max(1, CELLS // width)
            for k in range(0, len(members), step):
                part = members[k:k + step]
                for i, ids in zip(part, self._matrix([raw[i] for i in part], width), strict=True):
                    self.known[tokens[i]] = ids.astype("<u4").tobytes()

    def _learn(self, texts: list[str]) -> list[list[str]]:
        """The texts' pre-tokens, of which the ids are known afterwards."""
        found = [self.match.findall(t) for t in texts]
        new = list(set().union(*found) - self.known.keys())
        if new:
            self._merge(new)
        return found

    # --- texts ---

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit numbers."""
        if len(self.first) + len(self.after) > HELD:
            self.first, self.after = {}, {}
        if len(self.known) > HELD:
            self.known = {}
        lines = [[x.split(" ") for x in t.split("\n")] for t in texts]
        for known, lead, chunks in ((self.first, "", {x[0] for t in lines for x in t}), (self.after, " ", set().union(*(x[1:] for t in lines for x in t)))):
            new = list(chunks - known.keys())
            plain = [c for c in new if c and c[0] not in _SPACES and c[-1] not in _SPACES]
            for c in new:
                known[c] = None  # beside other white space: the whole text is matched
            for c, parts in zip(plain, self._learn([lead + c for c in plain]), strict=True):
                known[c] = b"".join(map(self.known.__getitem__, parts))
        first, after, out, odd = self.first, self.after, [], []
        end = self.single[10].astype("<u4").tobytes()
        for i, text in enumerate(lines):
            try:
                parts = []
                for x in text:
                    parts.append(end)
                    parts.append(first[x[0]])
                    parts += map(after.__getitem__, x[1:])
                out.append(b"".join(parts)[4:])
            except TypeError:
                out.append(b"")
                if texts[i]:
                    odd.append(i)
        for i, parts in zip(odd, self._learn([texts[i] for i in odd]), strict=True):
            out[i] = b"".join(map(self.known.__getitem__, parts))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def round_trip(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and whether the decoded bytes are the text's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(tokenizer_path(ranks))
        for b in batches:
            names, texts = b.column("doc_id").to_pylist(), b.column("body").to_pylist()
            for k in range(0, len(texts), 200):
                rows = []
                for name, text, data in zip(names[k:k + 200], texts[k:k + 200], bpe.encode(texts[k:k + 200]), strict=True):
                    ids = np.frombuffer(data, "<u4").tolist()
                    back = bpe.decode(ids)
                    rows.append((name, len(ids), hashlib.sha256(",".join(map(bpe.text.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(back).hexdigest(), back == text.encode()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same"])

    arrow_rows(docs.sparkSession, 2000)
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("body")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")


def encode(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, ids (array of int)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(tokenizer_path(ranks))
        for b in batches:
            names, texts = b.column("doc_id").to_pylist(), b.column("body").to_pylist()
            for k in range(0, len(texts), 200):
                ids = [np.frombuffer(x, "<i4") for x in bpe.encode(texts[k:k + 200])]
                yield pa.record_batch([pa.array(names[k:k + 200], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    arrow_rows(docs.sparkSession, 2000)
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("body")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, bytes: the inverse of `encode`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(tokenizer_path(ranks))
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array([None if x is None else bpe.decode(x) for x in b.column("ids").to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    arrow_rows(encoded.sparkSession, 2000)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def query(spark, sf_dir):
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
