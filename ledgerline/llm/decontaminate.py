"""Benchmark decontamination by q-gram lemma filtering and banded alignment, all in characters.

Texts are case-folded, every run of characters that are neither letters nor digits becomes one space, and a space goes
before and after. An item of up to WHOLE characters is one window. A longer one is covered by windows of LONG characters
that start STEP apart, and is held by a document if the windows met in it cover `needed` of its characters: LONG, or the
share SHARE of the item if that is more. So a run of LONG + STEP - 1 characters of an item of up to LONG / SHARE is found
wherever it starts, with up to budget(LONG) edits, while a template that makes up less than that of its items reports
none of them.

A window of m characters may be met with k = budget(m) edits. By the q-gram lemma an occurrence keeps at least
m + 1 - Q * (k + 1) of the window's q-grams, all on at most k + 1 neighbouring diagonals (place in the text less place in
the window), so within one of the bands of 2 * (k + 1) diagonals that overlap by half. The window's q-grams that each band
shares are counted, and all bands of a batch that reach the bound are aligned together, a row a band, in one matrix.
Items under MIN_EDITS characters may have no edits: they must stand there as they are, as whole words.

Equal windows of whatever items are one entry of the index. Texts are searched in slabs; equal slabs of a batch, such as
those of copies or of a text that repeats itself, are searched once. The q-grams' finds are expanded in portions of a
bounded size. Each document is judged where it lies, without a shuffle; what travels is an index of the benchmark in
blocks of about BLOCK_CHARS characters, one pass over the documents and one block on the driver at a time.

Defined results: null and empty texts hold no item; items that are null or have no letter or digit identify nothing and
are passed over; an item that repeats another matches as well; a document that repeats another is found too; with no
documents or no items nothing is found. A one-word item is met by every document with that word.
"""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import discard, frugal, materialize, read_table, remembered

Q, EDITS, MIN_EDITS = 8, 0.10, 20
WHOLE, LONG, STEP, SHARE = 128, 96, 32, 0.3
BLOCK_CHARS = 1_000_000
#: Characters searched at once, place where slabs start, and what they reach beyond: the longest window and its edits.
PART, SLAB, REACH = 50_000, 1_024, 192
#: Finds of q-grams held at once, and bands aligned at once.
FINDS, TOGETHER = 400_000, 4_096
_COUNT_BITS = 17
_MIX, _STEP_MUL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_SPACE = np.uint32(32)


@functools.lru_cache(maxsize=1)
def _plain() -> np.ndarray:
    """Whether each code point is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def _fold(text: str) -> np.ndarray:
    """Code points, case-folded, with a space for what is neither letter nor digit; runs of spaces stay."""
    codes = np.frombuffer(text.casefold().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_plain()[codes], codes, _SPACE)


def normalise(text: str) -> np.ndarray:
    """The code points that are compared: ` words of the text `, or nothing if it has none."""
    folded = _fold(text)
    codes = np.full(len(folded) + 2, _SPACE)
    codes[1:-1] = folded
    some = codes != 32
    some[0] = True
    some[1:] |= codes[:-1] != 32
    kept = codes[some]
    return kept if len(kept) > 1 else kept[:0]


def budget(m: int) -> int:
    """Edits that a window of m characters may differ by: a tenth, and no more than leave a bound of 4 shared q-grams."""
    return max(0, min(int(EDITS * m), (m + 1 - 4) // Q - 1)) if m >= MIN_EDITS else 0


def needed(m: int) -> int:
    """How many of an item's m characters the windows met must cover."""
    return m if m <= WHOLE else max(LONG, math.ceil(SHARE * m))


def window_starts(m: int) -> list[int]:
    return [0] if m <= WHOLE else [*range(0, m - LONG, STEP), m - LONG]


def hashed(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q characters."""
    out = codes[: len(codes) - q + 1].astype(np.uint64) + np.uint64(q)
    for k in range(1, q):
        out = out * _STEP_MUL + codes[k : len(codes) - q + 1 + k]
    return (out ^ (out >> np.uint64(29))) * _MIX


def aligned(windows: np.ndarray, sizes: np.ndarray, texts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the best occurrence of each row's window in its text, on width diagonals from the one through
    the text's first character. Rows are filled up beyond sizes and beyond sizes + width. Of equal costs the later start,
    that is the shorter occurrence, wins."""
    order = np.argsort(-sizes, kind="stable")
    windows, texts, sizes = windows[order], texts[order], sizes[order]
    unit = np.int32(1 << 16)
    steps = np.arange(width, dtype=np.int32)
    cost = np.repeat(-steps[None, :], len(sizes), axis=0)  # costs and starts in one number
    alive = np.searchsorted(-sizes, -np.arange(1, int(sizes.max()) + 1), side="right")
    for i, n in enumerate(alive.tolist()):  # rows that are through keep their costs
        now = cost[:n]
        best = now + unit * (texts[:n, i : i + width] != windows[:n, i, None])
        np.minimum(best[:, :-1], now[:, 1:] + unit, out=best[:, :-1])
        cost[:n] = np.minimum.accumulate(best - unit * steps, axis=1) + unit * steps
    at = cost.argmin(axis=1)
    found = cost[np.arange(len(at)), at]
    edits = -(-found // unit)
    back = np.argsort(order, kind="stable")
    return edits[back], (edits * unit - found)[back], (at + sizes)[back]


class Index:
    """The distinct windows of some items. items: (id, text)."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.items: list[object] = []
        lengths, names, starts = [], [], []
        known: dict[bytes, int] = {}
        self.windows: list[np.ndarray] = []
        for item, text in items:
            codes = normalise(text or "")
            if not len(codes):
                continue
            for s in window_starts(len(codes)):
                w = codes[s : s + (LONG if len(codes) > WHOLE else WHOLE)]
                name = known.setdefault(w.tobytes(), len(self.windows))
                if name == len(self.windows):
                    self.windows.append(w)
                names.append(name)
                starts.append((len(self.items), s))
            self.items.append(item)
            lengths.append(len(codes))
        n = len(self.windows)
        self.length = np.array(lengths, np.int64)
        self.needed = np.array([needed(m) for m in lengths], np.int64)
        self.size = np.array([len(w) for w in self.windows], np.int64)
        self.edits = np.array([budget(m) for m in self.size], np.int64)
        self.bound = self.size + 1 - Q * (self.edits + 1)
        # the items of each window: owner[at[w] : at[w + 1]] are rows of (item, start)
        by = np.argsort(names, kind="stable") if names else np.zeros(0, np.int64)
        self.owner = np.array(starts, np.int64).reshape(-1, 2)[by]
        self.at = np.searchsorted(np.array(names, np.int64)[by], np.arange(n + 1))
        self.codes = np.zeros((n, int(self.size.max(initial=1))), np.uint32)
        for row, w in zip(self.codes, self.windows):
            row[: len(w)] = w
        grams = [hashed(w, Q) if len(w) >= Q else np.zeros(0, np.uint64) for w in self.windows]
        counts = np.array([len(g) for g in grams], np.int64)
        key = np.concatenate(grams) if n else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")  # of equal q-grams the earlier window first
        self.distinct, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.window = np.repeat(np.arange(n, dtype=np.int32), counts)[order]
        self.place = (np.arange(len(key)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int16)[order]
        self.bits = min(26, max(16, 8 * len(self.distinct)).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._slot(self.distinct)] = True
        #: Windows under Q characters, by their number of characters.
        self.tiny: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in sorted({int(m) for m in self.size if m < Q}):
            rows = np.flatnonzero(self.size == m)
            keys = hashed(self.codes[rows, :m].ravel(), m)[::m]
            by = np.argsort(keys, kind="stable")
            self.tiny[m] = keys[by], rows[by]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def _hits(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text whose q-gram the index has, and its number."""
        at = np.flatnonzero(self.table[self._slot(gram)])
        found = np.minimum(np.searchsorted(self.distinct, gram[at]), max(0, len(self.distinct) - 1))
        exact = self.distinct[found] == gram[at] if len(self.distinct) else np.zeros(0, bool)
        return at[exact], found[exact]

    def _bands(self, gram: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, slab, band) of the bands that reach their bounds; begin: where slabs begin."""
        at, found = self._hits(gram)
        if not len(at):
            return
        slab = np.searchsorted(begin, at, side="right") - 1
        # whole slabs and all windows in one portion, unless its finds are too many
        total = np.bincount(slab, self.count[found], len(begin)).cumsum()
        first = 0
        while first < len(begin):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + FINDS, side="right")))
            a, z = np.searchsorted(slab, [first, last])
            for windows in self._portions(found[a:z]) if total[last - 1] - (total[first - 1] if first else 0) > FINDS else (None,):
                yield self._counted(at[a:z], found[a:z], slab[a:z], begin, windows)
            first = last

    def _portions(self, found: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of windows that have about FINDS finds of these q-grams each."""
        gram, times = np.unique(found, return_counts=True)
        row = np.repeat(np.arange(len(gram)), self.count[gram])
        entry = self.first[gram][row] + np.arange(len(row)) - np.repeat(np.cumsum(self.count[gram]) - self.count[gram], self.count[gram])
        total = np.bincount(self.window[entry], times[row], len(self.windows)).cumsum()
        cuts = np.unique(np.r_[0, np.searchsorted(total, np.arange(FINDS, total[-1], FINDS)), len(self.windows)])
        return [(int(a), int(z)) for a, z in zip(cuts[:-1], cuts[1:])]

    def _counted(self, at, found, slab, begin, windows: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, times = self.first[found], self.count[found]
        if windows:  # only entries of these windows
            key = self._by_window
            first = np.searchsorted(key, found * len(self.windows) + windows[0])
            times = np.searchsorted(key, found * len(self.windows) + windows[1]) - first
        row = np.repeat(np.arange(len(at)), times)
        entry = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        w, place = self.window[entry].astype(np.int64), self.place[entry].astype(np.int64)
        local = (at - begin[slab])[row]
        # a band is named by its lower half; a diagonal lies in the upper half of the one before
        half = (local - place + WHOLE) // (self.edits[w] + 1) + 1
        span = SLAB + REACH + 2 * WHOLE
        key = (w * len(begin) + slab[row]) * span + half
        # most q-grams stand alone: counts of hashed halves, never too low, pass over bands that can't reach the bound
        slot = (key + (key // span) * 40_503) & ((1 << _COUNT_BITS) - 1)
        counted = np.bincount(slot, minlength=1 << _COUNT_BITS)
        counted += np.roll(counted, -1)
        some = np.maximum(counted[slot], counted[slot - 1]) >= self.bound[w]
        key, place = key[some], place[some]
        both = np.concatenate([key, key - 1]) * WHOLE + np.concatenate([place, place])
        both = np.unique(both) // WHOLE  # each place of the window counts once
        start = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
        shared, key = np.diff(np.r_[start, len(both)]), both[start]
        w = key // span // len(begin)
        enough = shared >= np.maximum(1, self.bound[w])
        return w[enough], (key[enough] // span) % len(begin), key[enough] % span - 1

    @functools.cached_property
    def _by_window(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.distinct)), self.count) * len(self.windows) + self.window

    def search(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """int64 rows (slab, window, edits, start, end), one for each window met in a slab, at its best place there. codes:
        slabs side by side, from begin to end; start and end count from the slab's begin."""
        out = []
        for m, (keys, rows) in self.tiny.items():
            if len(codes) >= m:
                gram = hashed(codes, m)
                k = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
                at = np.flatnonzero(keys[k] == gram)
                slab = np.searchsorted(begin, at, side="right") - 1
                w, start = rows[k[at]], at - begin[slab]
                good = (at + m <= end[slab]) & (codes[at[:, None] + np.arange(m)] == self.codes[w, :m]).all(axis=1)
                out.append(np.stack([slab, w, np.zeros_like(w), start, start + m], axis=1)[good])
        if len(codes) >= Q:
            for w, slab, band in self._bands(hashed(codes, Q), begin):
                for k in range(0, len(w), TOGETHER):
                    out.append(self._verified(codes, begin, end, w[k : k + TOGETHER], slab[k : k + TOGETHER], band[k : k + TOGETHER]))
        found = np.concatenate(out) if out else np.zeros((0, 5), np.int64)
        found = found[np.lexsort(found.T[::-1])]
        return found[np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)]] if len(found) else found

    def _verified(self, codes, begin, end, w, slab, band) -> np.ndarray:
        """The bands that hold their windows; all of one width are aligned at once."""
        out = []
        for k in np.unique(self.edits[w]).tolist():
            use = self.edits[w] == k
            x, d, low, width = w[use], slab[use], band[use] * (k + 1) - WHOLE, 2 * (k + 1)
            size, long = self.size[x], (end - begin)[d]
            at = low[:, None] + np.arange(int(size.max()) + width)
            inside = (at >= 0) & (at < long[:, None])
            texts = np.where(inside, codes[np.where(inside, begin[d][:, None] + at, 0)], np.uint32(0xFFFFFFFF))
            edits, start, stop = aligned(self.codes[x], size, texts, width)
            rows = np.stack([d, x, edits, np.maximum(0, low + start), np.minimum(low + stop, long)], axis=1)
            out.append(rows[edits <= k].astype(np.int64))
        return np.concatenate(out)

    def search_texts(self, texts: list[str | None]) -> list[dict[object, tuple[int, int, int, int]]]:
        """For each text: item -> (edits, start, end, covered) of its closest, then first window, in normalised
        characters, and how many of the item's characters the windows met cover."""
        out: list[dict[object, tuple[int, int, int, int]]] = [{} for _ in texts]
        if not self.windows:
            return out
        slabs: dict[bytes, int] = {}
        where: list[dict[int, int]] = []  # of each slab: its first place in each text
        held, room = [], PART

        def look() -> None:
            nonlocal slabs, where, held, room
            size = np.array([len(x) for x in held], np.int64)
            found = self.search(np.concatenate(held), np.cumsum(size) - size, np.cumsum(size))
            for slab, w, edits, start, end in found.tolist():
                for d, base in where[slab].items():
                    new = (edits, start + base, end + base)
                    met[d][w] = min(new, met[d].get(w, new))
            slabs, where, held, room = {}, [], [], PART

        met: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        for d, t in enumerate(texts):
            codes = normalise(t or "")
            for base in range(0, max(1, len(codes) - REACH), SLAB) if len(codes) else ():
                slab = codes[base : base + SLAB + REACH]
                name = slabs.setdefault(slab.tobytes(), len(held))
                if name == len(held):
                    held.append(slab)
                    where.append({})
                    room -= len(slab)
                where[name].setdefault(d, base)
                if room < 0:
                    look()
        if held:
            look()
        for d, windows in enumerate(met):
            if windows:
                out[d] = self._held(windows)
        return out

    def _held(self, windows: dict[int, tuple[int, int, int]]) -> dict[object, tuple[int, int, int, int]]:
        """The items of whose characters enough are covered."""
        names = np.fromiter(windows, np.int64, len(windows))
        rows = np.concatenate([np.c_[self.owner[self.at[w] : self.at[w + 1]], np.full(self.at[w + 1] - self.at[w], w)] for w in names.tolist()])
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        last = np.r_[rows[1:, 0] != rows[:-1, 0], True]
        size = self.size[rows[:, 2]]
        own = np.where(last, size, np.minimum(size, np.r_[np.diff(rows[:, 1]), 0]))
        first = np.flatnonzero(np.r_[True, last[:-1]])
        covered = np.add.reduceat(own, first)
        out: dict[object, tuple[int, int, int, int]] = {}
        for a, z, n in zip(first.tolist(), np.r_[first[1:], len(rows)].tolist(), covered.tolist()):
            k = int(rows[a, 0])
            if n >= self.needed[k]:
                new = (*min(windows[w] for w in rows[a:z, 2].tolist()), n)
                out[self.items[k]] = min(new, out.get(self.items[k], new))
        return out


def original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """The characters of text that the normalised ones from start to end come from."""
    folded = _fold(text)
    source = np.arange(len(text)) if len(folded) == len(text) else np.repeat(np.arange(len(text)), [len(c.casefold()) for c in text])
    kept = np.flatnonzero((folded != 32) | (np.r_[_SPACE, folded[:-1]] != 32))  # of the normalised ones, those after the first
    return int(source[kept[max(0, start - 1)]]), int(source[kept[min(max(1, end - 1), len(kept)) - 1]]) + 1


@remembered()
def _index(items: bytes) -> Index:
    return Index(pickle.loads(items))


_MATCH = "array<struct<item_id:string,distance:int,start:int,end:int,covered:int>>"


def _matches(text: Column, items: list[tuple[object, str | None]]) -> Column:
    """The items that each whole text holds: edits and place of the closest window, in characters of the text, and the item's characters covered."""
    packed = pickle.dumps([(None if i is None else str(i), t) for i, t in items])

    @F.pandas_udf(_MATCH)
    @frugal
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _index(packed)
        names = ("item_id", "distance", "start", "end", "covered")
        for texts in batches:
            held = texts.tolist()
            found = index.search_texts(held)
            yield pd.Series(
                [[dict(zip(names, (i, e, *original_span(t, a, z), n))) for i, (e, a, z, n) in sorted(f.items(), key=str)] for t, f in zip(held, found)],
                dtype=object,
            )

    return run(text)


def _parts(benchmark: DataFrame) -> int:
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, math.ceil(chars / BLOCK_CHARS))


def _block(benchmark: DataFrame, b: int, n: int) -> list[tuple[object, str | None]]:
    """The items of block b of n, about BLOCK_CHARS characters."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else items
    return [(r[0], r[1]) for r in part.orderBy("item_id", "text").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance (edits), start, end (characters of the document's text) of each item found in a document,
    at its closest window, and covered, the item's normalised characters that the windows met cover."""
    kind, n = benchmark.schema["item_id"].dataType, _parts(benchmark)
    out = None
    for b in range(n):
        found = docs.select("doc_id", F.explode(_matches(F.col("text"), _block(benchmark, b, n))).alias("m"))
        found = found.select("doc_id", F.col("m.item_id").cast(kind).alias("item_id"), "m.distance", "m.start", "m.end", "m.covered")
        found = materialize(found) if n > 1 else found  # then the block can go
        out = found if out is None else out.union(found)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item."""
    n, left = _parts(benchmark), docs
    for b in range(n):
        rest = left.where(F.size(_matches(F.col(text_col), _block(benchmark, b, n))) == 0)
        if n > 1:
            before, left = left, materialize(rest)
            discard(before)
        else:
            left = rest
    return left


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
