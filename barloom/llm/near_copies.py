"""Near-duplicate documents: SimHash fingerprints in BK-trees, verified by exact Jaccard similarity.

A bit of a fingerprint differs between two sets with a probability given by the
angle between them: 0.151 at most at Jaccard 0.8, ten bits of 64, beyond what one
fingerprint and a small radius find. So a set has several fingerprints of 64 bits.
Those that agree in a block of bits share a shard, whose BK-tree over 128 bits
links what lies within a radius that 98 % of pairs at the threshold keep, as it
isn't to link much less similar ones; so many fingerprints are taken that one in
2000 such pairs, fewer above it, is linked in no shard. What the trees link, the
shingles themselves decide. A text of fewer words than a shingle is one token;
texts without words are alike.
"""

from __future__ import annotations

from math import acos, ceil, erf, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, mix64, own_column, raw_texts, release, slices
from .graph import connected_components
from .simhash import BKTree
from .substring_dedup import shingle_hashes

#: Of pairs at the threshold, those that no shard links; and standard deviations within the radius.
_MISS, _DEVIATIONS = 5e-4, 2.0
#: Fingerprints a shard holds on average, from which blocks of more bits are taken; the least bits of a block.
_SHARD, _LEAST_BITS = 64, 12
#: Rows of which a byte holds the sum of weights up to 3.
_LANES = 85
#: Shingles whose fingerprints are made at once, but for longer texts.
_AT_ONCE = 1 << 18
#: Sets, and their bytes, of a block of a band.
_BLOCK_SETS, _BLOCK_BYTES = 2000, 16 << 20
#: Numbers that are broadcast; more are joined.
_SENT = 1_000_000


def plan_of(rows: int, similarity: float) -> tuple[int, int, int]:
    """Bits of a block, fingerprints a set, and the radius over 128 bits, for so many sets."""
    differ = acos(2 * similarity / (1 + similarity)) / pi
    bits = max(_LEAST_BITS, ceil(log2(max(rows, 1) / _SHARD)))
    found = (1 - differ) ** bits * (1 + erf(_DEVIATIONS / sqrt(2))) / 2
    words = max(2, ceil(log(_MISS) / log(1 - found) / (64 // bits)))
    rest = 128 - bits
    return bits, words, ceil(rest * differ + _DEVIATIONS * sqrt(rest * differ * (1 - differ)))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's five-word shingles; never empty."""
    h = shingle_hashes(text or b"")
    if not len(h):
        h = np.array([xxhash.xxh64_intdigest(b" ".join((text or b"").lower().split()))], np.uint64)
    return np.unique(h)


def fingerprints_of(sets: list[np.ndarray], words: int) -> np.ndarray:
    """The SimHash of each set, a row of so many words of 64 bits.

    A token weighs -3, -1, 1 or 3 at a bit, as two bits of its hashes say, so that
    the sums of few tokens seldom tie. Eight bits a pass, a byte for each.
    """
    out = np.empty((len(sets), words), np.uint64)
    if not len(sets):
        return out
    sizes = np.array([len(s) for s in sets], np.int64)
    h, first = np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)[:-1]))
    parts = -(-sizes // _LANES)
    of = np.concatenate(([0], np.cumsum(parts)[:-1]))
    begin = np.repeat(first - of * _LANES, parts) + np.arange(parts.sum()) * _LANES
    one, lanes = np.uint64(1), np.uint64(0x0101010101010101)
    for w in range(words):
        high = mix64(h ^ np.uint64((w + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        low, found = mix64(high + np.uint64(0xD1B54A32D192ED03)), np.zeros(len(sets), np.uint64)
        for k in range(8):
            weights = np.add.reduceat((((high >> np.uint64(k)) & lanes) << one) + ((low >> np.uint64(k)) & lanes), begin)
            sums = np.add.reduceat(weights.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), of)
            found |= np.ascontiguousarray((2 * sums > 3 * sizes[:, None]).astype(np.uint8)).view("<u8")[:, 0] << np.uint64(k)
        out[:, w] = found
    return out


def clusters(values: list[int], radius: int) -> list[int]:
    """For each value the first place of its cluster: what is reachable over values within the radius.

    A search in the tree passes over a subtree that is of one cluster, once that is
    hit, as it can't join anything then; so many values near to each other cost
    little more than the paths to them.
    """
    tree, parent, whole, place, first = BKTree(), [], [], [], []

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    known, children = tree.values, tree.children
    for x in values:
        hits, stack = set(), [0] if known else []
        while stack:
            k = stack.pop()
            if hits and whole[k] and find(k) in hits:
                continue
            d = (known[k] ^ x).bit_count()
            if d <= radius:
                hits.add(find(k))
            if children[k]:
                stack += [c for edge, c in children[k].items() if d - radius <= edge <= d + radius]
        own = tree.add(x)
        place.append(own)
        if own < len(parent):
            continue
        parent.append(own)
        whole.append(True)
        first.append(len(place) - 1)
        for r in hits:
            low, high = sorted((find(own), r))
            parent[high] = low
        path, k = [], 0
        while k != own:
            path.append(k)
            k = children[k][(known[k] ^ x).bit_count()]
        for k in reversed(path):
            whole[k] = bool(hits) and all(whole[c] and find(c) == find(k) for c in children[k].values())
    return [first[find(k)] for k in place]


def _prints(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, digest of the text, node (digest of the set), size of the set and its fingerprints."""

    def run(batches):
        for b in slices(batches):
            sets = [shingle_set(t) for t in raw_texts(b.column(1))]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
            sizes = np.array([len(s) for s in sets], np.int64)
            group = (np.cumsum(sizes) - 1) // _AT_ONCE
            bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sets)]
            flat = np.concatenate([fingerprints_of(sets[i:j], words) for i, j in zip(bounds, bounds[1:], strict=False)]).reshape(-1)
            prints = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * words), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(nodes.view(np.int64)), pa.array(sizes), prints], names=["id", "digest", "node", "size", "words"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(own_column(id_col).alias("id"), own_column(text_col).alias("text"), F.xxhash64(own_column(text_col)).alias("digest")).mapInArrow(run, f"id {kind}, digest long, node long, size long, words array<long>")


def _clustered(nodes: DataFrame, bits: int, words: int, radius: int) -> DataFrame:
    """low, node, size: the members of the clusters of each shard's BK-tree, of two or more, with their least node."""
    blocks = 64 // bits
    routes = nodes.select("node", "size", "words", F.explode(F.sequence(F.lit(0), F.lit(words * blocks - 1))).alias("r"))
    block = F.expr(f"shiftrightunsigned(words[cast(r div {blocks} as int)], r % {blocks} * {bits}) & {(1 << bits) - 1}L")
    dealt = routes.select((F.shiftleft(F.col("r").cast("long"), 32).bitwiseOR(block)).alias("shard"), "node", F.col("size").cast("int").alias("size"), F.expr(f"words[cast(r div {blocks} as int)]").alias("x"), F.expr(f"words[cast((r div {blocks} + 1) % {words} as int)]").alias("y"))
    schema = pa.schema([("low", pa.int64()), ("node", pa.int64()), ("size", pa.int64())])

    def members(node, size, x, y, bounds):
        own, low = [], []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if j - i < 2:
                continue
            first = np.array(clusters([a << 64 | b for a, b in zip(x[i:j].tolist(), y[i:j].tolist(), strict=True)], radius))
            held = np.flatnonzero(np.bincount(first, minlength=j - i)[first] > 1)
            if len(held):
                least = np.full(j - i, np.iinfo(np.int64).max)
                np.minimum.at(least, first, node[i:j])
                own.append(held + i)
                low.append(least[first[held]])
        if own:
            at = np.concatenate(own)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.concatenate(low), node[at], size[at].astype(np.int64))], schema=schema)

    def run(batches):
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(i).to_numpy() for i in range(5)]
            if held and now[0][-1] == held[0][0][0]:  # all of the shard that is held
                held.append(now)
                continue
            cols = [np.concatenate(c) for c in zip(*held, now, strict=True)]
            cut_at = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
            last = int(cut_at[-1]) if len(cut_at) else 0
            if last:
                _, node, size, x, y = (c[:last] for c in cols)
                yield from members(node, size, x.view(np.uint64), y.view(np.uint64), np.concatenate(([0], cut_at)))
            held = [[c[last:] for c in cols]]
        if held:
            _, node, size, x, y = (np.concatenate(c) for c in zip(*held, strict=True))
            yield from members(node, size, x.view(np.uint64), y.view(np.uint64), np.array([0, len(node)]))

    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "low long, node long, size long")


def _sets(df: DataFrame, text_col: str) -> DataFrame:
    """node and its set, 32 bits a shingle."""

    def run(batches):
        for b in slices(batches):
            nodes, sets = [], []
            for t in raw_texts(b.column(0)):
                s = shingle_set(t)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes()))
                sets.append((s >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sets, pa.binary())], names=["node", "set"])

    return df.select(own_column(text_col).alias("text")).mapInArrow(run, "node long, set binary")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b and the Jaccard similarity of their sets. b, which many may share, is salted by a."""
    salts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)).cast("int"))
    copies = pairs.select("b", "salt").distinct().join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(copies, ["b", "salt"]).select("a", "b", "x", "y")

    def run(batches):
        for b in slices(batches):
            out = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                both = np.sort(np.concatenate((x, y)), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                out.append(common / (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["a", "b", "j"])

    return both.mapInArrow(run, "a long, b long, j double")


def _used_sets(df: DataFrame, text_col: str, prints: DataFrame, members: DataFrame) -> DataFrame:
    """node and set of the members. Up to a million are broadcast, so that only their texts are read into sets; else all sets are, and joined."""
    used = members.select("node").distinct()
    if used.count() > _SENT:
        return _sets(df, text_col).dropDuplicates(["node"]).join(used, "node", "left_semi")
    digest, text = F.xxhash64(own_column(text_col)), own_column(text_col).alias("t")
    holders = prints.join(F.broadcast(used), "node", "left_semi").groupBy("node").agg(F.min("digest").alias("d")).select("d").distinct()
    texts = df.select(text, digest.alias("own")).join(F.broadcast(holders), F.col("own") == F.col("d"), "left_semi")
    return _sets(texts.select("t"), "t").dropDuplicates(["node"])


def _rooted(df: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """id, digest and root, the same for all rows of a component."""
    spark = df.sparkSession
    bits, words, radius = plan_of(df.count(), similarity)
    prints = cut(_prints(df, id_col, text_col, words))
    nodes = prints.groupBy("node").agg(F.first("size").alias("size"), F.first("words").alias("words"))
    # clusters with the same least node are one band
    members = cut(_clustered(nodes, bits, words, radius).dropDuplicates(["low", "node"]).select(F.col("low").alias("key"), "node", "size", "low"))
    release(spark)  # the shards' rows
    sets = cut(_used_sets(df, text_col, prints, members))

    alike = F.col("j") >= similarity - 1e-9
    stars = cut(_compared(members.where("node > low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), sets))
    links = stars.where(alike).select("a", "b")
    to_low = stars.select(F.col("a").alias("node"), F.col("b").alias("low"), F.col("j"))
    members = cut(members.join(to_low, ["node", "low"], "left").withColumn("j", F.coalesce("j", F.lit(1.0))))
    release(spark)
    # what is left in several components is compared within its band
    links = cut(links.unionByName(_within_bands(_unjoined(members, links), sets, similarity)))
    release(spark)

    roots = connected_components(links, "a", "b")
    return prints.select("id", "digest", "node").join(roots, "node", "left").select("id", "digest", F.coalesce("root", "node").alias("root"))


def _unjoined(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members of bands that the links don't make one component, with their roots, but for each band's least, which all were compared with."""
    roots = cut(connected_components(links, "a", "b"))
    placed = members.join(roots, "node", "left").select("key", "node", "size", "low", "j", F.coalesce("root", "node").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("_r"), F.max("root").alias("_s")).where("_r < _s").select("key")
    return placed.join(split, "key").where("node != low").select("key", "node", "size", "j", "root")


def _within_bands(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links a, b that join the components of each band's members, as all pairs of them would.

    A large band is cut into blocks of bounded bytes, and a task holds two of them
    (or one); a member goes to as many tasks as its band has blocks. Pairs aren't
    made: members of one component by then, and those whose sizes or distances to
    the band's least (Jaccard distance is a metric) rule them out, aren't compared.
    """
    left = cut(left)
    blocks = left.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / _BLOCK_SETS, F.sum("size") * 4 / _BLOCK_BYTES)).cast("int").alias("g"))
    mine = F.pmod(F.xxhash64("node"), F.col("g").cast("long")).cast("int")
    dealt = left.join(blocks, "key").withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.join(sets, "node").select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "root", "size", "j", "set")

    def links(rows):
        own, node, comp, size, j = (np.array([r[i] for r in rows], t) for i, t in ((0, np.int64), (1, np.int64), (2, np.int64), (3, np.int64), (4, np.float64)))
        held = [np.frombuffer(r[5], "<u4") for r in rows]
        single, out = own[0] == own[-1] and (own == own[0]).all(), []
        for i in range(len(rows) - 1):
            ok = (comp[i + 1 :] != comp[i]) & (np.minimum(size[i + 1 :], size[i]) >= similarity * np.maximum(size[i + 1 :], size[i]) - 1e-9) & (np.abs(j[i + 1 :] - j[i]) <= 1 - similarity + 1e-6)
            if not single:
                ok &= own[i + 1 :] != own[i]
            cand = np.flatnonzero(ok) + i + 1
            for at in range(0, len(cand), 256):
                some = cand[at : at + 256]
                some = some[comp[some] != comp[i]]
                if not len(some):
                    continue
                flat = np.concatenate([held[k] for k in some])
                place = np.minimum(np.searchsorted(held[i], flat), len(held[i]) - 1)
                common = np.add.reduceat((held[i][place] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(size[some])[:-1])))
                for k in some[common >= similarity * (size[some] + size[i] - common) - 1e-9]:
                    if comp[k] != comp[i]:
                        out.append((int(node[i]), int(node[k])))
                        comp[comp == comp[k]] = comp[i]
        return out

    def run(batches):
        last, rows, done = None, [], []
        for b in batches:
            for key, lo, hi, *row in zip(*(b.column(i).to_pylist() for i in range(1, 10)), strict=True):
                if (key, lo, hi) != last:
                    done += links(rows) if len(rows) > 1 else []
                    last, rows = (key, lo, hi), []
                rows.append(row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in done], pa.int64()) for i in range(2)], names=["a", "b"])
                done = []
        done = links(rows) if len(rows) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in done], pa.int64()) for i in range(2)], names=["a", "b"])

    return dealt.repartition("task").sortWithinPartitions("task", "key", "lo", "hi").mapInArrow(run, "a long, b long").distinct()


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row a document: id and component_id, the smallest id reachable over pairs of at least the similarity.

    Equal sets meet first. Bands are the clusters of the shards' BK-trees, those with the same
    least set taken together. Each set is
    compared with the least of each of its bands; and what isn't one component by then, with each other, in blocks and
    without making the pairs, but for those of one component by then and those whose
    sizes or distances to the band's least rule them out. So a large group of copies
    makes few pairs, and no pair of a band is left out that could join components; a
    large band of sets that are alike but not enough costs its square in comparisons,
    not in rows. Repeated
    rows give repeated results; a null id is the smallest only of a component
    without others. An empty table gives an empty result.
    """
    rooted = cut(_rooted(df, id_col, text_col, similarity))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(least, "root").select(F.col("id").alias(id_col), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """The document with the smallest id of each component, all columns kept, once if its row is repeated.

    Of different texts with that id, the one whose digest is smallest. Rows with a
    null id have no place in that order and stay, each as often as it stands.
    """
    return first_of_each(df, _rooted(df, id_col, text_col, similarity), id_col, text_col)


def first_of_each(df: DataFrame, rooted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df with the least id and digest of each root, one a root; rows without an id stay.

    Texts move only in the join with what is kept, where that is too large to be
    broadcast, and where kept rows are repeated.
    """
    first = rooted.where("id is not null").groupBy("root").agg(F.min(F.struct("id", "digest")).alias("f"))
    rows = rooted.where("id is not null").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("times"))
    a, d, t = (free_name(df, x) for x in ("kept_id", "kept_digest", "times"))
    keep = cut(first.select("f.*").join(rows, ["id", "digest"]).select(F.col("id").alias(a), F.col("digest").alias(d), F.col("times").alias(t)))
    same = (own_column(id_col) == F.col(a)) & (F.xxhash64(own_column(text_col)) == F.col(d))
    once = df.join(keep.where(F.col(t) == 1), same, "left_semi")
    if keep.where(F.col(t) > 1).take(1):
        more = df.join(keep.where(F.col(t) > 1), same, "inner")
        more = more.groupBy(F.col(a), F.col(d)).agg(F.first(F.struct(*(own_column(c) for c in df.columns))).alias(t)).select(*(F.col(t)[c].alias(c) for c in df.columns))
        once = once.unionByName(more)
    return once.unionByName(df.where(own_column(id_col).isNull()))
