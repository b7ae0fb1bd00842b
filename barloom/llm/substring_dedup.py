"""Near-duplicate passages by compact windows.

Tokens are five-word shingles. For each of several hash functions, a Cartesian
tree over the hashed tokens of a text gives its compact windows: all subsequences
within (l, r) that hold c have the hash of c as their minimum. Only windows wide
enough for a passage are made. Windows with the same minimum meet and are joined
by their intervals: each with the first that has the same token ten places before,
and the first that has the same ten places after. What meets is verified by the
texts themselves.

A window need not find its passage in the first holder of its context, which may
hold a fragment only. So where a text and that holder part, the windows meet
again by the place and the token they part at, which all that share more with
each other than with the holder have in common, and the first of those is the
next holder; and so on until no two part alike. Each round is linear in the
windows left, and holders' ids rise from round to round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, cut, mix64, own_column, raw_texts, release, slices, word_hashes

SHINGLE = 5
_SEEDS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377, 0xBE5466CF34E90C6C, 0xC0AC29B7C97C50DD, 0x3F84D5B5B5470917)]
_MULT = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(SHINGLE)]
#: Shingles to either side of a minimum that tell contexts apart.
_ASIDE = 10
#: Shingles that may shift between two runs of a passage.
_SHIFT = 10


def shingles_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all five-word shingles of whole texts, A-Z lower-cased, in one array, and where each text's begin (and the end)."""
    joined = [b" ".join(t.lower().split()) for t in texts]
    size = np.array([t.count(b" ") + 1 if t else 0 for t in joined], np.int64)
    w = word_hashes(b" ".join(t for t in joined if t))[0]
    n = len(w) - SHINGLE + 1
    keep = np.maximum(size - SHINGLE + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(keep)))
    if n < 1:
        return np.empty(0, np.uint64), bounds * 0
    h = w[:n] * _MULT[0]
    for k in range(1, SHINGLE):
        h = h + w[k : k + n] * _MULT[k]
    if len(texts) > 1:  # without those that reach into the next text
        h = h[np.arange(bounds[-1]) + np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])) - bounds[:-1], keep)]
    return mix64(h), bounds


def shingle_hashes(text: bytes) -> np.ndarray:
    """``shingles_of`` one text."""
    return shingles_of([text])[0]


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def compact_windows(x: np.ndarray, width: int, bounds=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows of at least ``width`` tokens; the leftmost of equal minima counts.

    ``bounds``: where the texts in x begin, and the end; windows stay within theirs.
    A token is the minimum of such a window only if it is that of some run of
    exactly ``width`` tokens; the next smaller tokens to its left and right are
    of that kind too. So the Cartesian trees are built over these few alone.
    """
    n = len(x)
    none = np.empty(0, np.int64)
    if n < width:
        return none, none, none
    bounds = np.array([0, n]) if bounds is None else bounds
    low = _sliding(x, width, np.minimum)
    for back in range(1, width):  # a run that reaches into the next text has no minimum
        at = bounds[1:-1] - back
        low[at[(at >= 0) & (at < len(low))]] = 0
    pad = np.zeros(width - 1, x.dtype)
    cs = np.flatnonzero(_sliding(np.concatenate((pad, low, pad)), width, np.maximum) == x)
    # places count twice, so that a text's beginning, smaller than all, stands between two
    starts = np.unique(bounds[:-1])
    where = np.concatenate((2 * cs, 2 * starts - 1))
    order = np.argsort(where, kind="stable")
    at, xs = where[order].tolist(), np.concatenate((x[cs], np.zeros(len(starts), x.dtype)))[order].tolist()
    for k in np.flatnonzero(order >= len(cs)).tolist():
        xs[k] = -1
    left, right, stack = [0] * len(at), [n - 1] * len(at), []
    for k, v in enumerate(xs):
        while stack and xs[stack[-1]] > v:
            right[stack.pop()] = (at[k] - 1) // 2
        left[k] = at[stack[-1]] // 2 + 1 if stack else 0
        stack.append(k)
    left, right, at = np.array(left, np.int64), np.array(right, np.int64), np.array(at, np.int64)
    keep = (at % 2 == 0) & (right - left + 1 >= width)
    return left[keep], at[keep] // 2, right[keep]


def _windows(docs: DataFrame, width: int, hashes: int) -> DataFrame:
    """key, doc, at (c, hash function, tokens to the left and right up to width), ctx of the rows (n, text)."""

    def run(batches):
        for b in slices(batches, 8192):
            ids = b.column(0).to_pylist()
            keys, doc, at, ctx, around = [], [], [], [], []
            held, some, size = [], [], 0

            def flush():
                s, bounds = shingles_of(held)
                n = np.diff(bounds)
                if len(s) < width or not (n >= width).any():
                    return
                d_of, end = np.repeat(np.array(some, np.int64), n), np.repeat(bounds[1:], n)
                begin = np.repeat(bounds[:-1], n)
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(s, dtype=np.uint64)))
                for k in range(hashes):
                    x = mix64(s ^ _SEEDS[k])
                    left, c, right = compact_windows(x, width, bounds)
                    own, a, e = d_of[c], begin[c], end[c]
                    keys.append(x[c])
                    doc.append(own)
                    at.append(((c - a) << 24) | (k << 20) | (np.minimum(c - left, width) << 10) | np.minimum(right - c, width))
                    lone = own.astype(np.uint64) & np.uint64(0xFFFFFFFF)
                    before = np.where(c - _ASIDE >= a, s[np.maximum(c - _ASIDE, 0)] >> np.uint64(32), lone)
                    after = np.where(c + _ASIDE < e, s[np.minimum(c + _ASIDE, len(s) - 1)] >> np.uint64(32), lone)
                    ctx.append((before << np.uint64(32)) | after)
                    around.append(mix64(sums[np.minimum(c + width, e)] - sums[c]) - (sums[c] - sums[np.maximum(c - width + 1, a)]))

            for d, text in zip(ids, raw_texts(b.column(1)), strict=True):
                if d is None or not text:
                    continue
                if held and size + len(text) > 1 << 20:
                    flush()
                    held, some, size = [], [], 0
                held.append(text)
                some.append(d)
                size += len(text)
            if held:
                flush()
            if keys:
                cols = _met_here(*(np.concatenate(v) for v in (keys, doc, at, ctx, around)), width)
                for i in range(0, len(cols[0]), 50_000):
                    part = [v[i : i + 50_000] for v in cols]
                    yield pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1]), pa.array(part[2]), pa.array(part[3].view(np.int64))], names=["key", "doc", "at", "ctx"])

    return docs.mapInArrow(run, "key long, doc long, at long, ctx long")


def _seed(c, r, k, alike):
    """Places in both texts, whether a context agrees, and the hash function, in one number."""
    return (c << 33) | (r << 4) | (alike << 3) | k


def _met_here(key, doc, at, ctx, around, width: int) -> list[np.ndarray]:
    """Windows that are alike as far as a passage can reach to both sides meet within a batch.

    What one of them shares with any other text the first does too, so that only
    the first goes on. One link (at below 0, its source in ctx) goes in the place of
    all others that follow each other on a diagonal, as they are in one passage.
    """
    order = np.lexsort((at, doc, around, key))
    key, doc, at, ctx, around = (v[order] for v in (key, doc, at, ctx, around))
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (around[1:] != around[:-1])))
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    gone = doc != doc[first]
    if gone.any():
        i, r = np.flatnonzero(gone), first[gone]
        c, place = at[i] >> 24, at[r] >> 24
        order = np.lexsort((c, c - place, doc[r], doc[i]))
        i, r, c, place = i[order], r[order], c[order], place[order]
        apart = np.concatenate(([True], (doc[i[1:]] != doc[i[:-1]]) | (doc[r[1:]] != doc[r[:-1]]) | (c[1:] - place[1:] != c[:-1] - place[:-1]) | (c[1:] - c[:-1] > width)))
        i, r, c, place = i[apart], r[apart], c[apart], place[apart]
        spread = mix64(doc[i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + doc[r].astype(np.uint64))
        key, doc, at, ctx = np.concatenate((key[~gone], spread)), np.concatenate((doc[~gone], doc[i])), np.concatenate((at[~gone], -1 - _seed(c, place, at[i] >> 20 & 15, 1))), np.concatenate((ctx[~gone], doc[r].astype(np.uint64)))
    return [key, doc, at, ctx]


class _Meeting:
    """Windows of one key, by document: each goes with the first that has the same shingle ten places before, and after.

    Only if none has, it goes with the key's first, and then one hash function
    alone makes no pair. So a phrase that stands in many passages doesn't hide the
    repeated ones. Held are the first window and one of each context.
    """

    def __init__(self, width: int):
        self.width, self.seen, self.first = width, {}, None

    def add(self, docs: list[int], ats: list[int], ctxs: list[int], out: list) -> None:
        """Appends links (doc, src, seed)."""
        seen, width = self.seen, self.width
        for d, a, x in zip(docs, ats, ctxs, strict=True):
            x &= 0xFFFFFFFFFFFFFFFF
            me = (d, a)
            r, s = seen.setdefault(x >> 32, me), seen.setdefault((x & 0xFFFFFFFF) | 1 << 32, me)
            alike = 1
            if r is me and s is me:
                r = s = self.first = self.first or me
                alike = 0
            for o, ra in (r,) if r is s else (r, s):
                if o != d and min(a >> 10 & 1023, ra >> 10 & 1023) + min(a & 1023, ra & 1023) + 1 >= width:
                    out.append((d, o, _seed(a >> 24, ra >> 24, a >> 20 & 7, alike)))


def _links(windows: DataFrame, width: int) -> DataFrame:
    """doc, src, seed of windows that meet, within a batch or here, by key and document."""

    def run(batches):
        last, group = None, None
        for b in batches:
            k, d, a, x = (b.column(i).to_numpy() for i in range(4))
            done = a < 0
            out: list = []
            if done.any():
                yield pa.RecordBatch.from_arrays([pa.array(d[done]), pa.array(x[done]), pa.array(-1 - a[done])], names=["doc", "src", "seed"])
                k, d, a, x = (v[~done] for v in (k, d, a, x))
            if not len(k):
                continue
            bounds = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]))
            for i in range(len(bounds) - 1) if len(bounds) == 2 else (0, *np.flatnonzero(np.diff(bounds[1:-1]) > 1) + 1, len(bounds) - 2):
                s = slice(bounds[i], bounds[i + 1])
                if group is None or k[s.start] != last:
                    last, group = k[s.start], _Meeting(width)
                group.add(d[s].tolist(), a[s].tolist(), x[s].tolist(), out)
            if out:
                yield _batch(out)

    def _batch(out):
        v = np.array(out, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(v[:, i]) for i in range(3)], names=["doc", "src", "seed"])

    sorted_windows = windows.repartition("key").sortWithinPartitions("key", "doc", "at")
    return sorted_windows.mapInArrow(run, "doc long, src long, seed long")


def _next_run(x: np.ndarray, y: np.ndarray, p: int, q: int, step: int, reach: int) -> tuple[int, int] | None:
    """The nearest place behind a mismatch at x[p], y[q] where a token agrees, shifted by at most ``_SHIFT``."""
    n = reach
    a, b = (x[p : p + n], y[q : q + n]) if step > 0 else (x[max(p - n + 1, 0) : p + 1][::-1], y[max(q - n + 1, 0) : q + 1][::-1])
    i, j = np.nonzero(a[:, None] == b[None, :])
    if not len(i):
        return None
    cost = np.where(np.abs(i - j) <= _SHIFT, np.maximum(i, j) * 64 + np.abs(i - j), 1 << 30)
    k = int(cost.argmin())
    return None if cost[k] == 1 << 30 else (p + step * int(i[k]), q + step * int(j[k]))


def _runs_on(x: np.ndarray, y: np.ndarray, c: int, r: int, reach: int, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends in x of the runs of equal tokens on a seed's diagonal, each within reach of the next, between left and right."""
    low, high = max(left, c - r), min(right, len(y) + c - r)
    size = 256
    while True:
        a, e = max(low, c - size), min(high, c + size)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], x[a:e] == y[a - c + r : e - c + r], [False]))))
        starts, ends = edge[::2] + a, edge[1::2] + a
        own = int(np.searchsorted(starts, c, "right")) - 1
        if own < 0 or ends[own] <= c:
            return starts[:0], ends[:0]
        breaks = np.flatnonzero(starts[1:] - ends[:-1] > reach) + 1
        k = int(np.searchsorted(breaks, own, "right"))
        first, last = (int(breaks[k - 1]) if k else 0), (int(breaks[k]) if k < len(breaks) else len(starts))
        if (a == low or starts[first] - a > reach) and (e == high or e - ends[last - 1] > reach):
            return starts[first:last], ends[first:last]
        size *= 4


def _runs_around(x: np.ndarray, y: np.ndarray, c: int, r: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and starts in y of the runs of equal tokens around a seed, each within reach of the next, shifted or not."""
    starts, ends = _runs_on(x, y, c, r, reach, 0, len(x))
    if not len(starts):
        return starts, ends, starts
    parts = [(starts, ends, starts - c + r)]
    while (e := int(parts[-1][1][-1])) < len(x) and (hit := _next_run(x, y, e, int(parts[-1][2][-1] + e - parts[-1][0][-1]), 1, reach)):
        starts, ends = _runs_on(x, y, *hit, reach, hit[0], len(x))
        parts.append((starts, ends, starts - hit[0] + hit[1]))
    parts.reverse()
    while (s := int(parts[-1][0][0])) > 0 and (q := int(parts[-1][2][0])) > 0 and (hit := _next_run(x, y, s - 1, q - 1, -1, reach)):
        starts, ends = _runs_on(x, y, *hit, reach, 0, hit[0] + 1)
        parts.append((starts, ends, starts - hit[0] + hit[1]))
    parts.reverse()
    return tuple(np.concatenate(v) for v in zip(*parts, strict=True))


def _passages_of(x: np.ndarray, y: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, width: int, similarity: float) -> list[tuple[int, int, int, float]]:
    """The runs joined, from the left, as far as the joined span keeps the similarity and what it gains outweighs its gaps."""
    if not len(starts) or ends[-1] - starts[0] < width:
        return []
    size, y_ends = ends - starts, at + ends - starts
    matched = np.concatenate(([0], np.cumsum(size)))
    # of the tokens m, n of both sides and their common ones c, c >= similarity * (m + n - c)
    gain = (1 + similarity) * matched[1:] - similarity * (ends + y_ends)
    start = (1 + similarity) * matched[:-1] - similarity * (starts + at)
    gaps = np.concatenate(([0], np.cumsum(np.maximum(starts[1:] - ends[:-1], at[1:] - y_ends[:-1]))))
    worth = matched[1:] - gaps
    out, i = [], 0
    while i < len(starts):
        last = int(np.flatnonzero((gain[i:] >= start[i] - 1e-9) & (worth[i:] >= np.maximum.accumulate(worth[i:])))[-1]) + i
        s, e, rs, re = int(starts[i]), int(ends[last]), int(at[i]), int(y_ends[last])
        found = None
        if e - s >= width:
            a, b = np.unique(x[s:e]), np.unique(y[rs:re])
            common = len(np.intersect1d(a, b, assume_unique=True))
            if (j := common / (len(a) + len(b) - common)) >= similarity:
                found = [(s, e, rs, j)]
        out += found if found else [(int(starts[k]), int(ends[k]), int(at[k]), 1.0) for k in range(i, last + 1) if size[k] >= width]
        i = last + 1
    return out


def verified_passages(x: np.ndarray, y: np.ndarray, seeds: list[tuple[int, int]], width: int, similarity: float):
    """Passages of x, (start, end, start in y, Jaccard) in shingles, that y repeats; and where x and y part around the seeds.

    seeds: places in x and in y. A passage is runs of equal tokens that are joined as
    long as the span's Jaccard similarity suffices. Its cost is in proportion to its
    length; seeds within a passage found aren't followed again. A seed that stands in
    no run of the length that the longer part of the least passage with an edit has,
    and hasn't as many equal tokens around it as that passage, isn't followed.
    Parting places: (c, side, tokens from c, token of x, whether c is in a passage) on
    each side where x goes on and agrees with y, or is in the passage, for less than
    a passage's width from the seed; but not of a token that stands beside itself, as
    one word over and over has no place of its own.
    """
    c, r = (np.array(v, np.int64) for v in zip(*sorted(set(seeds)), strict=True))
    offsets, mid = np.arange(-(width - 1), width), width - 1
    out, parts, left, followed = [], [], np.ones(len(c), bool), np.zeros(len(c), bool)
    while left.any():
        some = np.flatnonzero(left)[:32]
        left[some] = False
        i, j = c[some, None] + offsets, r[some, None] + offsets
        real = (i >= 0) & (i < len(x)) & (j >= 0) & (j < len(y))
        same = real & (x[np.clip(i, 0, len(x) - 1)] == y[np.clip(j, 0, len(y) - 1)])
        covered = np.zeros(len(some), bool)
        sides = [(side, ~eq.all(1), np.where(eq.all(1), width, eq.argmin(1))) for side, eq in ((0, same[:, mid::-1]), (1, same[:, mid:]))]
        run = np.where(same[:, mid], sides[0][2] + sides[1][2] - 1, 0)
        for k in np.flatnonzero((run >= (width - SHINGLE) // 2) | (same.sum(1) >= width - SHINGLE)):
            if covered[k] or followed[some[k]]:
                continue
            runs = _runs_around(x, y, int(c[some[k]]), int(r[some[k]]), width // 2)
            followed |= (c >= runs[0][0]) & (c < runs[1][-1]) & (c - r == c[some[k]] - r[some[k]])
            for s, e, rs, jac in _passages_of(x, y, *runs, width, similarity):
                out.append((s, e, rs, jac))
                left &= (c < s) | (c >= e)
                covered |= (c[some] >= s) & (c[some] < e)
        for side, ends, n in sides:
            place = c[some] - n if side == 0 else c[some] + n
            ok = ends & ~covered & (n > 0) & (place >= 0) & (place < len(x))
            parts += zip(c[some[ok]].tolist(), [side] * int(ok.sum()), n[ok].tolist(), x[place[ok]].tolist(), [False] * int(ok.sum()), strict=True)
    out = sorted(set(out))
    alone = np.concatenate((x[1:] != x[:-1], [True]))
    alone[1:] &= alone[:-1].copy()
    parts = [v for v in parts if alone[v[0]]]
    c = c[alone[c]]
    for s, e, *_ in out:
        inside = c[(c >= s) & (c < e)]
        if s > 0:
            parts += ((k, 0, k - s + 1, int(x[s - 1]), True) for k in sorted(set(inside[inside < s + width - 1].tolist())))
        if e < len(x):
            parts += ((k, 1, e - k, int(x[e]), True) for k in sorted(set(inside[inside > e - width].tolist())))
    return out, parts


def _texts_of(pairs: DataFrame, texts: DataFrame, most: int = 1_000_000) -> tuple[DataFrame, int]:
    """The texts (n, text) of the documents in pairs, and how many pairs there are. Up to ``most`` numbers are broadcast, so that only these texts move; more are joined."""
    rows = pairs.count()
    used = pairs.select(F.explode(F.array(*pairs.columns[:2])).alias("n")).distinct()
    return texts.join(F.broadcast(used) if 2 * rows <= most else used, "n", "left_semi"), rows


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """doc, src, seeds and both texts. A source that many documents repeat is salted: its text goes once to each salt in use."""
    salts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    mine = texts.select(F.col("n").alias("doc"), F.col("text").alias("x"))
    copies = pairs.select("src", "salt").distinct().join(texts.select(F.col("n").alias("src"), F.col("text").alias("y")), "src")
    return pairs.join(mine, "doc").join(copies, ["src", "salt"]).select("doc", "src", "seeds", "x", "y")


def _verify(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc, src; and a passage (first, end, src_first, similarity), or a parting place (similarity null, the key in end, c in first; src_first is 1 in a passage)."""
    schema = pa.schema([("doc", pa.int64()), ("src", pa.int64()), ("first", pa.int64()), ("end", pa.int64()), ("src_first", pa.int64()), ("similarity", pa.float64())])

    def run(batches):
        src, y = None, None
        for b in slices(batches, 64):
            found, parted = [], []
            ids, srcs, seeds = (b.column(i).to_pylist() for i in range(3))
            for i, (d, s, own) in enumerate(zip(ids, srcs, seeds, strict=True)):
                if s != src:
                    src, y = s, shingle_hashes(raw_texts(b.column(4).slice(i, 1))[0])
                x = shingle_hashes(raw_texts(b.column(3).slice(i, 1))[0])
                passages, parts = verified_passages(x, y, [(v >> 33, v >> 4 & 0x1FFFFFFF) for v in own], width, similarity)
                found += [(d, s, a, e + SHINGLE - 1, r, j) for a, e, r, j in passages]
                parted += [(d, s, c, int(x[c]), side << 32 | n, token, known) for c, side, n, token, known in parts]
            cols = list(zip(*found, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
            if parted:
                d, s, c, known = (np.array([v[i] for v in parted], np.int64) for i in (0, 1, 2, 6))
                key, where, token = (np.array([v[i] for v in parted], np.uint64) for i in (3, 4, 5))
                key = mix64(mix64(mix64(key ^ (s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) + where) ^ token)
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(c), pa.array(key.view(np.int64)), pa.array(known), pa.nulls(len(d), pa.float64())], schema=schema)

    return _with_texts(pairs, texts).mapInArrow(run, "doc long, src long, first long, end long, src_first long, similarity double")


def _again(parted: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of windows that parted alike, inside a passage near its end or outside all: each goes with the first document of its key."""
    spans = found.select(F.col("doc").alias("d"), F.col("first").alias("s"), F.col("end").alias("e"))
    inside = parted.where("src_first = 0").select("doc", "first").distinct().join(spans, F.col("doc") == F.col("d")).where("s <= first and first < e").select("doc", "first").distinct()
    some = parted.where("src_first = 1").select("doc", "first", "end").unionByName(parted.where("src_first = 0").select("doc", "first", "end").join(inside, ["doc", "first"], "left_anti"))
    first = some.groupBy("end").agg(F.min(F.struct(F.col("doc").alias("d"), F.col("first").alias("c"))).alias("rep"), F.max("doc").alias("last")).where("rep.d < last")
    seed = F.shiftleft("first", 33).bitwiseOR(F.shiftleft("rep.c", 4))
    return some.join(first, "end").where("doc > rep.d").groupBy("doc", F.col("rep.d").alias("src")).agg(F.collect_set(seed).alias("seeds"))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(n, text) of the rows with a text, n a long in the order of the ids; and n, id, digest of the text where n isn't the id.

    Integer ids that don't repeat are their own numbers. Else each distinct id and
    text gets a number: null ids behind all others, texts of one id in any order.
    """
    text, number = own_column(text_col).alias("text"), own_column(id_col)
    if docs.select(number).dtypes[0][1] in ("tinyint", "smallint", "int", "bigint") and not docs.where(number.isNotNull()).groupBy(number).count().where("count > 1").take(1):
        return docs.where(number.isNotNull()).select(number.cast("long").alias("n"), text), None
    own = docs.where(own_column(text_col).isNotNull()).select(number.alias("id"), F.xxhash64(own_column(text_col)).alias("digest"), text)
    keys = own.select("id", "digest").distinct().orderBy(F.col("id").asc_nulls_last(), "digest")
    keys = cut(keys.select(F.monotonically_increasing_id().alias("n"), "id", "digest"))
    k = keys.alias("k")
    return own.alias("o").join(k, F.col("o.id").eqNullSafe(F.col("k.id")) & (F.col("o.digest") == F.col("k.digest"))).select("n", "text").dropDuplicates(["n"]), keys


def _fewer(df: DataFrame, rows: int) -> DataFrame:
    """A materialised table in as many partitions as its rows need, if it has more."""
    return df.coalesce(df.count() // rows + 1)


def _copies(numbered: DataFrame, words: int) -> DataFrame:
    """Documents that repeat an earlier text whole (by two hashes of 64 bits), as passages; nothing else is looked for in them."""
    prints = numbered.select("n", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("b"), "text").alias("b"))
    first = prints.groupBy("a", "b").agg(F.min("n").alias("src"), F.max("n").alias("last")).where("src < last").drop("last")
    pairs = cut(prints.join(first, ["a", "b"]).where("n > src").select(F.col("n").alias("doc"), "src"))
    sources = pairs.select("src").distinct()
    texts, _ = _texts_of(sources, numbered)
    size = texts.select(F.col("n").alias("src"), F.regexp_count("text", F.lit(r"[^\x09-\x0D\x20]+")).cast("long").alias("end")).where(F.col("end") >= words)
    return cut(pairs.join(size, "src").select("doc", "src", F.lit(0).cast("long").alias("first"), "end", F.lit(0).cast("long").alias("src_first"), F.lit(1.0).alias("similarity")))


def _found(numbered: DataFrame, words: int, similarity: float, hashes: int, need: int) -> DataFrame:
    """doc, src, first, end, src_first, similarity of the passages, in words; documents by number."""
    width = words - SHINGLE + 1
    if not 0 < width < 1000 or hashes > len(_SEEDS):
        raise ValueError("words or hashes out of range")
    links = _links(_windows(numbered, width, hashes), width)
    met = links.groupBy("doc", "src").agg(F.collect_list("seed").alias("seeds"), F.bit_or(F.expr("shiftleft(1, cast(seed & 7 as int))")).alias("k"), F.bit_or(F.expr("seed & 8")).alias("alike"))
    whole = _copies(numbered, words)
    pairs = cut(met.where((F.bit_count("k") >= need) | (F.col("alike") > 0)).select("doc", "src", "seeds").join(whole.select("doc"), "doc", "left_anti"))
    out, (texts, _) = None, _texts_of(pairs, numbered)
    release(numbered.sparkSession)  # the windows
    while True:
        done = cut(_verify(pairs, texts, width, similarity))
        passages = done.where("similarity is not null")
        out = cut(_fewer((whole if out is None else out).unionByName(passages), 1_000_000))
        pairs = cut(_again(done.where("similarity is null"), out))
        # all later pairs are of documents in these, far fewer ones
        texts, rows = _texts_of(pairs, texts)
        if not rows:
            return out.distinct()
        texts = cut(texts.coalesce(rows // 1000 + 1))
        release(numbered.sparkSession)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50, similarity: float = 0.8, hashes: int = 4, need: int = 2) -> DataFrame:
    """Passages of at least ``words`` words that an earlier document (by id) holds too.

    One row each: id, first_word, end_word, src_doc_id, src_first_word, similarity.
    The document that stays without a row keeps the passage. Windows meet by a
    context that agrees too, or by at least ``need`` of ``hashes`` minima; the
    texts' tokens verify. Null and empty texts and texts of fewer words give no
    rows. Ids may be of any type that sorts, and null, which is behind all others;
    rows with the same id and text are one document, those with the same id and
    different texts are documents of their own. Very long texts are taken whole,
    with time and memory in proportion. Only the id and the text are read.
    """
    numbered, keys = _numbered(docs, id_col, text_col)
    found = _found(numbered, words, similarity, hashes, need)
    kind = docs.select(own_column(id_col)).dtypes[0][1]
    if keys is None:
        return found.select(F.col("doc").cast(kind).alias(id_col), F.col("first").alias("first_word"), F.col("end").alias("end_word"), F.col("src").cast(kind).alias("src_doc_id"), F.col("src_first").alias("src_first_word"), "similarity")
    named = found.join(keys.select(F.col("n").alias("doc"), F.col("id").alias("own")), "doc").join(keys.select(F.col("n").alias("src"), F.col("id").alias("other")), "src")
    return named.select(F.col("own").alias(id_col), F.col("first").alias("first_word"), F.col("end").alias("end_word"), F.col("other").alias("src_doc_id"), F.col("src_first").alias("src_first_word"), "similarity")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words [start, end) of the spans; white space before a removed word goes with it."""
    raw = text.encode("utf-8", "surrogatepass")
    a = np.frombuffer(raw, np.uint8)
    solid = ~((a == 32) | ((a >= 9) & (a <= 13)))
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for s, e in sorted(spans):
        if e <= s or s >= len(starts):
            continue
        begin, stop = (int(ends[s - 1]) if s else 0), int(ends[min(e, len(ends)) - 1])
        if begin > at:
            out.append(raw[at:begin])
        at = max(at, stop)
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50, similarity: float = 0.8, hashes: int = 4, need: int = 2) -> DataFrame:
    """The documents without the passages that an earlier one holds; one left without a word is dropped.

    All columns are kept, whatever their names. Documents without such a passage
    stay as they are, null and empty texts too, and repeated rows as often as they stand.
    """
    numbered, keys = _numbered(docs, id_col, text_col)
    per_doc = _found(numbered, words, similarity, hashes, need).groupBy("doc").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    columns = docs.columns
    row = docs.select(F.struct(*(own_column(c) for c in columns)).alias("row"), own_column(id_col).alias("id"), F.xxhash64(own_column(text_col)).alias("digest"))
    if keys is None:
        joined = row.join(per_doc, F.col("id").cast("long") == F.col("doc"), "left")
    else:
        p = per_doc.join(keys.withColumnRenamed("n", "doc"), "doc").alias("p")
        joined = row.alias("r").join(p, F.col("r.id").eqNullSafe(F.col("p.id")) & (F.col("r.digest") == F.col("p.digest")), "left")
    at = columns.index(text_col)

    def run(batches):
        for b in slices(batches):
            spans_of, texts = b.column(len(columns)).to_pylist(), b.column(at)
            hit = [i for i, s in enumerate(spans_of) if s]
            keep = np.ones(b.num_rows, bool)
            if hit:
                new = texts.to_pylist()
                for i in hit:
                    new[i] = without_words(new[i], [(s["first"], s["end"]) for s in spans_of[i]])
                    keep[i] = bool(new[i].strip())
                texts = pa.array(new, texts.type)
            cols = [texts if i == at else b.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(cols, names=columns).filter(pa.array(keep))

    return by_place(joined.select(*[F.col("row")[c] for c in columns], "spans")).mapInArrow(run, docs.schema)
