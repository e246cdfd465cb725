"""Byte-level BPE encoding and decoding in numpy.

A text is cut at single spaces where the pattern is known to allow it; the distinct cuts of a batch are split by the
pattern, and the distinct pieces, of whatever length, are put in byte matrices by length, one padded row a piece. Each
round, every row merges its leftmost pair of minimum rank; pair ranks come from an open-addressing hash table held in
arrays. Finished rows leave the matrix, and columns that no row needs are cut.

A row whose minimum rank stands in several places takes them in one round, from the left, up to the first merge that makes
a pair of a lower rank with a neighbour: just those that one merge after another would take, as no other pair can come
first. So the rounds of a row that repeats itself don't grow with its length.

Defined results: a null text is encoded as the empty text, which has no tokens. Texts are never cut. Special tokens
are plain text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import fresh, frugal, read_table, remembered, small_batches

NONE = np.int32(2**31 - 1)
#: Distinct cuts that a worker remembers between batches, at most, and the longest of them in characters.
CACHE, CACHED_CHARS = 300_000, 64
#: Cells of one matrix, at most, unless a single piece has more bytes.
CELLS = 1 << 19
#: Fixed value: patterns in which nothing matches over a single space between two other characters, and a space goes with what
#: follows it. Texts are split whole by any other pattern.
SPACES_LEAD = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)
#: White space on both sides of a space, or at one side and the text's end at the other.
JOINED = regex.compile(r"[\s\x1c-\x1f] (?=[\s\x1c-\x1f]|$)|^ [\s\x1c-\x1f]|  ")


class PairTable:
    """(left id, right id) -> merged id, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.ids = np.full(1 << self.bits, NONE, np.int32)
        at, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = self.ids[at[todo]] == NONE
            slot, first = np.unique(at[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[slot], self.ids[slot] = keys[put], merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            taken = self.keys[at[todo]] != keys[todo]
            at[todo[taken]] = (at[todo[taken]] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair is no token; ids under 0 (padding) never match."""
        shape = left.shape
        key = ((left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))).ravel()
        at = self._slot(key)
        found, out = self.keys[at], self.ids[at]
        miss = np.flatnonzero((found != key) & (out != NONE))
        out = np.where(found == key, out, NONE)
        for _ in range(self.probes):
            if not len(miss):
                break
            at[miss] = (at[miss] + 1) & ((1 << self.bits) - 1)
            found, ids = self.keys[at[miss]], self.ids[at[miss]]
            out[miss[found == key[miss]]] = ids[found == key[miss]]
            miss = miss[(found != key[miss]) & (ids != NONE)]
        return out.reshape(shape)


class ByteBPE:
    """ranks: lines of base64 token and rank; an id is a rank."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.split = regex.compile(pattern).findall
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], i) for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, merged.astype(np.int32))
        self.spaces_lead = pattern in SPACES_LEAD
        self.cache: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_batch([text])[0]

    def cuts(self, text: str) -> list[str]:
        """text in parts which the pattern splits as it splits the whole. Under a pattern of SPACES_LEAD a space between two other
        characters belongs to what follows; only next to more white space does it matter what stands on its other side."""
        if not self.spaces_lead or JOINED.search(text):
            return self.split(text)
        parts = text.split(" ")
        return [parts[0], *map(" ".__add__, parts[1:])] if parts[0] else list(map(" ".__add__, parts[1:]))

    def encode_batch(self, texts: Iterable[str]) -> list[bytes]:
        cut, cache = [self.cuts(t) for t in texts], self.cache
        new = list(set().union(*cut).difference(cache))
        split = list(map(self.split, new))
        pieces = list(set().union(*split))
        merged = dict(zip(pieces, self.merge([x.encode() for x in pieces])))
        cache.update(zip(new, [merged[x[0]] if len(x) == 1 else b"".join([merged[y] for y in x]) for x in split]))
        out = [b"".join(map(cache.__getitem__, x)) for x in cut]
        if len(cache) > CACHE:
            cache.clear()
        else:
            for x in new:
                if len(x) > CACHED_CHARS:
                    del cache[x]
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(size, kind="stable")
        start = int(np.searchsorted(size[order], 1))  # empty pieces have no ids
        while start < len(order):
            # lengths up to a power of two share a matrix, of so many rows that its cells are bounded
            top = 1 << (int(size[order[start]]) - 1).bit_length()
            end = min(start + max(1, CELLS // top), int(np.searchsorted(size[order], top, side="right")))
            rows = order[start:end]
            wide = int(size[rows[-1]])
            flat = np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)
            ids = np.full((len(rows), wide), -1, np.int32)
            ids[np.arange(wide) < size[rows][:, None]] = self.byte_ids[flat]
            self._merge_matrix(ids, size[rows], rows, out)
            start = end
        return out

    def _merge_matrix(self, ids: np.ndarray, size: np.ndarray, rows: np.ndarray, out: list[bytes]) -> None:
        """size: how many ids each row has. A round ends the rows that are through and merges in all others."""
        rank = self._rank(ids)
        while len(rows):
            best = rank.min(axis=1) if rank.shape[1] else np.full(len(rows), NONE)
            done = best == NONE
            if done.any():
                flat = ids[done].astype("<u4")
                for i, row, n in zip(rows[done].tolist(), flat, size[done].tolist()):
                    out[i] = row[:n].tobytes()
                ids, rank, rows, best, size = ids[~done], rank[~done], rows[~done], best[~done], size[~done]
                if not len(rows):
                    return
                wide = int(size.max())
                ids, rank = ids[:, :wide], rank[:, : wide - 1]
            row, at = np.nonzero(rank == best[:, None])
            if len(row) > len(rows):
                row, at = self._in_turn(ids, best, row, at)
            merges = np.bincount(row, minlength=len(rows))
            ids[row, at] = best[row]
            size = size - merges
            wide = ids.shape[1] - int(merges.min())
            ids, rank = self._compacted(ids, row, at + 1, merges, wide, -1), self._compacted(rank, row, at, merges, wide - 1, NONE)
            at = at - (np.arange(len(row)) - np.searchsorted(row, row))  # where they are now
            for p in (at - 1, at):  # only the two pairs beside a merge are new
                ok = (p >= 0) & (p < rank.shape[1])
                r, p = row[ok], p[ok]
                rank[r, p] = self._rank(np.stack([ids[r, p], ids[r, p + 1]], axis=1))[:, 0]

    def _in_turn(self, ids: np.ndarray, best: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all places of the minimum rank, those that one leftmost merge after another takes before a merge makes a pair
        of a lower rank; a row's first place is always among them."""
        n = np.arange(len(row))
        run = np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]
        free = (n - np.maximum.accumulate(np.where(run, n, 0))) % 2 == 0  # of overlapping pairs every other one, from the left
        row, at = row[free], at[free]
        new = best[row]
        beside = np.r_[False, (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 2)]  # the token before is the one just made
        left = np.where(beside, new, ids[row, at - 1])
        right = ids[row, np.minimum(at + 2, ids.shape[1] - 1)]
        lower = (at > 0) & (self.pairs(left, new) < new)
        lower |= (at + 2 < ids.shape[1]) & (right >= 0) & (self.pairs(new, right) < new)
        before = np.cumsum(lower) - lower
        taken = before == before[np.searchsorted(row, row)]
        return row[taken], at[taken]

    @staticmethod
    def _compacted(x: np.ndarray, row: np.ndarray, at: np.ndarray, gone: np.ndarray, wide: int, fill: int) -> np.ndarray:
        """x without the cells (row, at), gone of each row, as wide columns."""
        stay = np.ones(x.shape, bool)
        stay[row, at] = False
        if (gone == gone[0]).all():
            return x[stay].reshape(len(x), -1)
        out = np.full((len(x), wide), fill, np.int32)
        out[np.arange(wide) < (x.shape[1] - gone)[:, None]] = x[stay]
        return out

    def _rank(self, ids: np.ndarray) -> np.ndarray:
        rank = self.pairs(ids[:, :-1], ids[:, 1:])
        return np.where(ids[:, 1:] < 0, NONE, rank)

    def decode(self, ids: bytes) -> bytes:
        tokens, n = self.tokens, 1 << 18
        return b"".join(b"".join(map(tokens.__getitem__, np.frombuffer(ids[k : k + n], "<u4").tolist())) for k in range(0, len(ids), n))


@remembered(2)
def _codec(ranks: bytes, pattern: str) -> ByteBPE:
    return ByteBPE(ranks, pattern)


#: Characters of text that are encoded at once.
PART = 2_000_000


def bpe_round_trip(text: Column, ranks: bytes, pattern: str) -> Column:
    """struct<ids binary, decoded binary>: each whole text's ids as little-endian unsigned 32-bit integers, and those
    ids decoded. ranks: the content of the rank file, which travels with the tasks."""

    @F.pandas_udf("ids binary, decoded binary")
    @frugal
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(ranks, pattern)
        for texts in batches:
            ids: list[bytes] = []
            part: list[str] = []
            room = PART
            for t in texts:
                part.append(t or "")
                room -= len(part[-1])
                if room < 0:
                    ids += codec.encode_batch(part)
                    part, room = [], PART
            ids += codec.encode_batch(part)
            yield pd.DataFrame({"ids": ids, "decoded": [codec.decode(x) for x in ids]})

    return run(text)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with ids and decoded (binary, as bpe_round_trip has them) in place of columns of those names. vocabulary: the
    rank file's path on the driver."""
    small_batches(docs.sparkSession)
    (bpe,) = fresh(docs, "bpe")
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    both = docs.withColumn(bpe, bpe_round_trip(F.col(text_col), ranks, pattern))
    rest = [c for c in docs.columns if c not in ("ids", "decoded")]
    return both.select(*rest, F.col(f"{bpe}.ids").alias("ids"), F.col(f"{bpe}.decoded").alias("decoded"))


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def public_vocabulary() -> tuple[str, str]:
    """Path and pattern of the rank file that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(encode_documents(docs, *public_vocabulary()).drop("text"))
