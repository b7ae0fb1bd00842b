"""SimHash near-duplicates with BK-trees.

Equal fingerprints meet first. Distinct ones are dealt to shards so that any
two within the radius share one: 64 bits in 5 blocks, a shard for the values of
every 2 of them; 3 differing bits leave 2 blocks alike. Each shard has its
BK-tree, whose children hang at their integer Hamming distance from the parent;
a search follows only edges within the radius. Trees go where their shard's
fingerprints are, as all trees together would grow with the corpus and couldn't
be broadcast within a bound.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, own_column, raw_texts, slices
from .graph import connected_components

RADIUS = 3
_BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Bits set in over half the XXH64 of word shingles of a whole text; without words 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(joined, seed)]
        counts, n = None, 1
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(words) - shingle + 1
        counts = np.zeros(64, np.int64)
        for at in range(0, n, _CHUNK):
            s, e = starts[at : min(at + _CHUNK, n)].tolist(), ends[at + shingle - 1 : min(at + _CHUNK, n) + shingle - 1].tolist()
            h = np.array([digest(joined[i:j], seed) for i, j in zip(s, e, strict=True)], "<u8")
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    if counts is None:
        return hashes[0]
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest of the text and fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for b in slices(batches):
            fp = np.fromiter((fingerprint(t) for t in raw_texts(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], names=["id", "digest", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(own_column(id_col).alias("id"), own_column(text_col).alias("text"), F.xxhash64(own_column(text_col)).alias("digest")).mapInArrow(run, f"id {kind}, digest long, fp long")


class BKTree:
    """Nodes in lists; each has a dict of children by distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, x: int, radius: int):
        """Indices of nodes within the radius."""
        if not self.values:
            return
        stack = [0]
        while stack:
            k = stack.pop()
            d = (self.values[k] ^ x).bit_count()
            if d <= radius:
                yield k
            for edge, child in self.children[k].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)

    def add(self, x: int) -> int:
        """The node's index; a value that is there already stays alone."""
        if not self.values:
            self.values.append(x)
            self.children.append({})
            return 0
        k = 0
        while d := (self.values[k] ^ x).bit_count():
            if (child := self.children[k].get(d)) is None:
                self.children[k][d] = len(self.values)
                self.values.append(x)
                self.children.append({})
                return len(self.values) - 1
            k = child
        return k


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(value, its shard component's first value): at most one link a value.

    A search ends early only when all values before are one component already,
    as further links can't join anything then.
    """
    tree, parent, parts = BKTree(), [], 0

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for x in values:
        hits = set()
        for k in tree.near(x, radius):
            hits.add(find(k))
            if len(hits) == parts:
                break
        own = tree.add(x)
        if own < len(parent):
            continue
        parent.append(own)
        for r in hits:
            low, high = sorted((find(own), r))
            parent[high] = low
        parts += 1 - len(hits)
    return [(tree.values[k], tree.values[r]) for k in range(len(parent)) if (r := find(k)) != k]


def _route(fp):
    keys = []
    for i, pair in enumerate(combinations(_BLOCKS, 2)):
        key = F.lit(i).cast("long")
        for at, width in pair:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        keys.append(key)
    return F.array(*keys)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links a, b that connect all fingerprints within the radius. ``distinct``: one column fp without repeats."""

    def run(batches):
        key, held = None, []

        def links(group):
            return shard_links([v & 0xFFFFFFFFFFFFFFFF for v in group]) if len(group) > 1 else []

        for b in batches:
            k, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(k):
                continue
            out = []
            cut_at = np.flatnonzero(k[1:] != k[:-1]) + 1
            bounds = np.concatenate(([0], cut_at, [len(k)]))
            if key is not None and k[0] == key:
                held.extend(v[: bounds[1]].tolist())
                bounds = bounds[1:]
            if len(bounds) > 1:  # the held group is over
                out += links(held)
                wide = np.flatnonzero(np.diff(bounds[:-1]) > 1)
                for i in wide:
                    out += links(v[bounds[i] : bounds[i + 1]].tolist())
                key, held = k[-1], v[bounds[-2] :].tolist()
            if out:
                yield pairs(out)
        if rest := links(held):
            yield pairs(rest)

    def pairs(out):
        a = np.array(out, np.uint64).view(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

    dealt = distinct.select(F.explode(_route(F.col("fp"))).alias("key"), "fp")
    return dealt.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, fingerprint (hex), component_id (smallest id reachable).

    Null and wordless texts have fingerprint zero and link like others. Repeated
    rows give repeated results. A null id is kept, but is never the smallest
    while its component has another. Only the id and the text are read. An empty
    table gives an empty result.
    """
    prints = cut(fingerprints(df, id_col, text_col))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("_least")))
    placed = _placed(distinct)
    least = placed.groupBy("root").agg(F.min("_least").alias("component_id"))
    known = placed.join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(known, "fp", "left").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def _placed(distinct: DataFrame) -> DataFrame:
    """The distinct fingerprints with the root of their component."""
    roots = connected_components(fingerprint_links(distinct.select("fp")), "a", "b").withColumnRenamed("root", "_root")
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select(*distinct.columns, F.coalesce("_root", "fp").alias("root"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each component, all columns kept, once if its row is repeated.

    Of different texts with that id, the one whose digest is smallest. Rows with a
    null id have no place in that order and stay.
    """
    from .near_copies import first_of_each

    prints = cut(fingerprints(df, id_col, text_col))
    rooted = prints.join(_placed(cut(prints.select("fp").distinct())), "fp").select("id", "digest", "root")
    return first_of_each(df, rooted, id_col, text_col)
