"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders. Windows of five such tokens
of the benchmark's items are hash-joined with those of every text; the items'
side is small and goes to the tasks in blocks of bounded size. A region of a
text that holds at least ``threshold`` of an item's windows is a hit if each
slot is filled alike wherever the item repeats it, so that a question with
other numbers or names is caught, and chance likeness isn't.

A capital at a sentence's start may be a name or not. Windows that hold one are
looked up with it as a word, and as a name for the items that give no hit so;
then only windows count in which its fillers agree with all others.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _power_tables, by_place, mix64, raw_texts, slices

WINDOW = 5
NUM, NAME, UNIT = (np.uint64(0x4E554D0000000001), np.uint64(0x4E414D4500000002), np.uint64(0x554E495400000003))
#: Words that count as numbers, and as units after a number.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion".split()
UNIT_WORDS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg lb lbs pound pounds ounce ounces l ml liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degrees mph kmh watts volts bytes kb mb gb".split()
_MULT = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(64)]
_CHUNK = 4 << 20

_word = np.zeros(256, bool)
_word[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


class Tokens:
    """Hashes of a text's words, their typed forms, and which are placeholders."""

    def __init__(self, text: bytes):
        a = np.frombuffer(text, np.uint8)
        low = _lower[a]
        latin = np.flatnonzero((a[:-1] == 0xC3) & (a[1:] >= 0x80) & (a[1:] <= 0x9E) & (a[1:] != 0x97)) if len(a) else np.empty(0, np.int64)
        low[latin + 1] += 0x20
        word = _word[a]
        digit = (a >= 48) & (a <= 57)
        if len(a) > 2:  # 3.5 and 1,200 are one word
            inner = np.flatnonzero((a[1:-1] == 46) | (a[1:-1] == 44)) + 1
            word[inner[digit[inner - 1] & digit[inner + 1]]] = True
        edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.n = len(self.starts)
        if not self.n:
            self.plain = self.typed = np.empty(0, np.uint64)
            self.slot = self.maybe = np.empty(0, bool)
            return
        pw, inv = _power_tables(len(a) + 1)
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * pw[: len(a)], out=sums[1:])
        self.plain = mix64((sums[self.ends] - sums[self.starts]) * inv[self.starts])
        first = a[self.starts]
        capital = (first >= 65) & (first <= 90)
        capital |= np.isin(self.starts, latin)
        # a capital tells nothing behind a sentence's end, a line's end or a bullet
        stop = np.zeros(len(a) + 1, np.int64)
        np.cumsum(np.isin(a, np.frombuffer(b".!?:;\n|\"", np.uint8)) & ~word, out=stop[1:])
        fresh = np.ones(self.n, bool)
        fresh[1:] = stop[self.starts[1:]] > stop[self.ends[:-1]]
        number = digit[self.starts] | np.isin(self.plain, _NUMBERS)
        unit = np.zeros(self.n, bool)
        unit[1:] = np.isin(self.plain[1:], _UNITS) & number[:-1]
        name = capital & ~fresh & ~number & ~unit
        self.typed = self.plain.copy()
        self.typed[number], self.typed[unit], self.typed[name] = NUM, UNIT, NAME
        self.slot = number | unit | name
        self.maybe = capital & fresh & ~number & ~unit

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the typed windows, and whether each has more words than slots."""
        n = self.n - WINDOW + 1
        if n < 1:
            return np.empty(0, np.uint64), np.empty(0, bool)
        h = self.typed[:n] * _MULT[0]
        slots = self.slot[:n].astype(np.int8)
        for k in range(1, WINDOW):
            h = h + self.typed[k : k + n] * _MULT[k]
            slots = slots + self.slot[k : k + n]
        return mix64(h), slots * 2 < WINDOW

    def named_windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows that hold a capital at a sentence's start, with it as a name."""
        n = self.n - WINDOW + 1
        if n < 1:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        before = np.concatenate(([0], np.cumsum(self.maybe)))
        at = np.flatnonzero(before[WINDOW:] > before[:n])
        typed = np.where(self.maybe, NAME, self.typed)
        h = typed[at] * _MULT[0]
        for k in range(1, WINDOW):
            h = h + typed[at + k] * _MULT[k]
        return at, mix64(h)


_NUMBERS = _UNITS = np.empty(0, np.uint64)
_NUMBERS = Tokens(" ".join(NUMBER_WORDS).encode()).plain
_UNITS = Tokens(" ".join(UNIT_WORDS).encode()).plain


class ItemIndex:
    """Postings of the windows of some items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        self.tokens = [Tokens(t) for _, t in items]
        self.usable, hashes, where = [], [], []
        for k, t in enumerate(self.tokens):
            h, ok = t.windows()
            if 2 * ok.sum() < len(ok):  # mostly slots: all windows then
                ok = np.ones(len(h), bool)
            at = np.flatnonzero(ok)
            self.usable.append(len(at))
            named, g = t.named_windows()
            ok = np.isin(named, at)
            hashes += [h[at], g[ok]]
            where.append(np.stack([np.full(len(at), k), at, np.zeros(len(at), np.int64)], 1))
            where.append(np.stack([np.full(ok.sum(), k), named[ok], np.ones(ok.sum(), np.int64)], 1))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        w = np.concatenate(where) if where else np.empty((0, 3), np.int64)
        order = np.argsort(h, kind="stable")
        self.where = w[order]
        self.keys, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.bits = max(16, int(len(h)).bit_length() + 4)
        self.there = np.zeros(1 << self.bits, bool)
        self.there[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.longest = max((len(t.starts) and int(t.ends[-1]) for t in self.tokens), default=0)

    def hits(self, text: bytes, threshold: float):
        """(item, share, first word, last word, exact) of the items found."""
        t = Tokens(text)
        if not len(self.keys):
            return
        h, _ = t.windows()
        named, g = t.named_windows()
        found: dict[int, list[tuple[int, int]]] = {}
        either: dict[int, set[tuple[int, int]]] = {}
        for pos, j in self._met(np.arange(len(h)), h):
            for item, i, other in self.where[self.first[j] : self.first[j + 1]].tolist():
                if not other:
                    found.setdefault(item, []).append((pos, i))
                either.setdefault(item, set()).add((pos, i))
        for pos, j in self._met(named, g):
            for item, i, _ in self.where[self.first[j] : self.first[j + 1]].tolist():
                either.setdefault(item, set()).add((pos, i))
        for item, both in either.items():
            need = max(1, int(np.ceil(threshold * self.usable[item] - 1e-9)))
            if len({i for _, i in both}) < need:
                continue
            pairs = found.get(item, [])
            best = self._region(t, item, pairs, need) if len({i for _, i in pairs}) >= need else None
            if best is None and len(both) > len(pairs):
                best = self._region(t, item, self._consistent(t, self.tokens[item], sorted(both), set(pairs)), need)
            if best:
                yield (item, *best)

    def _met(self, at: np.ndarray, h: np.ndarray):
        """(place, number of the key) of the hashes that items have."""
        ok = np.flatnonzero(self.there[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        at, h = at[ok], h[ok]
        k = np.searchsorted(self.keys, h)
        k[k == len(self.keys)] = 0
        ok = self.keys[k] == h
        return zip(at[ok].tolist(), k[ok].tolist(), strict=True)

    @staticmethod
    def _consistent(t: Tokens, own: Tokens, both, sure: set):
        """The pairs without those where a sentence's first word isn't filled as most do on nearby diagonals.

        Fillers of surely typed slots count first; a word that only stands at sentences' starts
        is filled as it is most often.
        """
        votes: dict[tuple[int, int], Counter] = {}
        spots = []
        for pos, i in both:
            block = (pos - i) // max(WINDOW, own.n // 4)
            fill = [(int(own.plain[i + k]), int(t.plain[pos + k]), bool(own.slot[i + k] and t.slot[pos + k])) for k in range(WINDOW) if own.slot[i + k] or own.maybe[i + k]]
            spots.append((block, fill))
            for a, b, certain in fill:
                for near in (block - 1, block, block + 1):
                    votes.setdefault((near, a), Counter())[b] += 1000 if certain else 1
        chosen = {x: c.most_common(1)[0][0] for x, c in votes.items()}
        return [p for p, (block, fill) in zip(both, spots, strict=True) if p in sure or all(certain or chosen[block, a] == b for a, b, certain in fill)]

    def _region(self, t: Tokens, item: int, pairs, need: int):
        """The region with most of the item's windows whose slots agree."""
        own = self.tokens[item]
        reach = own.n + max(WINDOW, own.n // 4)
        left, count, distinct, best = 0, Counter(), 0, None
        for right, (pos, i) in enumerate(pairs):
            count[i] += 1
            distinct += count[i] == 1
            while pairs[left][0] + reach < pos + WINDOW:
                count[pairs[left][1]] -= 1
                distinct -= count[pairs[left][1]] == 0
                left += 1
            if distinct >= need and (best is None or distinct > best[0]) and self._agrees(t, own, pairs[left : right + 1]) is not None:
                best = (distinct, left, right)
        if best is None:
            return None
        region = pairs[best[1] : best[2] + 1]
        return best[0] / self.usable[item], region[0][0], region[-1][0] + WINDOW, self._agrees(t, own, region)

    @staticmethod
    def _agrees(t: Tokens, own: Tokens, region):
        """None if one filler of the item stands for two; else whether all fillers are the item's own."""
        fill: dict[int, int] = {}
        same = True
        # a window that stands twice in the item pairs its slots with both; the nearest diagonal counts
        diagonal = Counter(pos - i for pos, i in region).most_common(1)[0][0]
        nearest: dict[int, tuple[int, int]] = {}
        for pos, i in region:
            off = abs(pos - i - diagonal)
            if pos not in nearest or off < nearest[pos][0]:
                nearest[pos] = (off, i)
        for pos, (_, i) in nearest.items():
            for k in range(WINDOW):
                if own.slot[i + k]:
                    a, b = int(own.plain[i + k]), int(t.plain[pos + k])
                    if fill.setdefault(a, b) != b:
                        return None
                elif own.maybe[i + k]:
                    same &= bool(own.plain[i + k] == t.plain[pos + k])
        return same and all(a == b for a, b in fill.items())


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, block_mb: int = 32) -> DataFrame:
    """Hits: id, item_id, share of the item's windows, first_word, end_word, exact.

    Null and empty texts and items have no windows, nor have items of fewer than
    five words; they give no hits. Repeated items are each reported, repeated
    rows each give theirs. Very long texts are searched in overlapping parts and
    the best region counts. The benchmark goes to the tasks in blocks of about
    ``block_mb``; a larger one takes more passes over the texts, with the same
    result. Only ids and texts are read.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, item_id long, share double, first_word long, end_word long, exact boolean"
    out = None
    for index in _indexes(benchmark, item_id, item_text, block_mb):
        found = docs.select(id_col, text_col).mapInArrow(_search(index, threshold, id_col), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _indexes(benchmark: DataFrame, item_id: str, item_text: str, block_mb: int):
    """An index of each block of the benchmark, one at least."""
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("_i"), F.col(item_text).alias("_t"))
    mb = (items.agg(F.sum(F.octet_length("_t"))).first()[0] or 0) / 1e6
    blocks = max(1, int(np.ceil(mb / block_mb)))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("_t"), F.lit(blocks)) == k) if blocks > 1 else items
        yield ItemIndex([(r[0], r[1].encode()) for r in part.collect()])


def _parts(text: bytes, longest: int):
    """(part, its place) of a text; parts overlap by more than twice the longest item."""
    lap, at = 2 * longest + 1000, 0
    while True:
        end = at + _CHUNK + lap
        yield text[at:end], at
        if end >= len(text):
            return
        nxt = text.find(b" ", at + _CHUNK)
        at = nxt if 0 <= nxt < at + _CHUNK + lap // 2 else at + _CHUNK


def _best(index: ItemIndex, text: bytes | None, threshold: float) -> dict[int, tuple]:
    best: dict[int, tuple] = {}
    for part, at in _parts(text or b"", index.longest):
        before = None
        for item, share, s, e, exact in index.hits(part, threshold):
            if item not in best or share > best[item][1]:
                before = (Tokens(text[:at]).n if at else 0) if before is None else before
                best[item] = (index.ids[item], share, s + before, e + before, exact)
    return best


def _search(index: ItemIndex, threshold: float, id_col: str):
    def run(batches):
        for b in slices(batches):
            rows, got = [], []
            for r, text in enumerate(raw_texts(b.column(1))):
                best = _best(index, text, threshold)
                rows += [r] * len(best)
                got += best.values()
            cols = list(zip(*got, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[id_col, "item_id", "share", "first_word", "end_word", "exact"])

    return run


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, block_mb: int = 32) -> DataFrame:
    """The documents without a hit, all columns kept; null and empty texts stay. No shuffle."""
    at, names = docs.columns.index(text_col), docs.columns

    def keeper(index):
        def run(batches):
            for b in slices(batches):
                kept = b.filter(pa.array([not _best(index, t, threshold) for t in raw_texts(b.column(at))], pa.bool_()))
                yield pa.RecordBatch.from_arrays(kept.columns, names=names)

        return run

    for index in _indexes(benchmark, item_id, item_text, block_mb):
        docs = by_place(docs).mapInArrow(keeper(index), docs.schema)
    return docs
