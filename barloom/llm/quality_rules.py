"""Quality rules with adaptive thresholds.

Counts are taken once per document. Mergeable quantile sketches
(``percentile_approx``, partial aggregates merged over the cluster) per language
and source, per language and over all documents give each group its own fences
from its own tails, with no fixed cutoff or floor; a small group's fences are
drawn towards its language's, and those towards the fences of all documents. A
join brings them back to the documents, which are then filtered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, slices

#: The symbols counted.
SYMBOLS = b"#*$%&|<>"
_DROP_SYMBOLS = bytes(c for c in range(256) if c not in SYMBOLS)
#: Reason, ratio, tail level of its sketch, and by how many distances of tail and median the fence lies beyond the tail.
#: Repeats are rare and have long tails, so that their fence is the far tail itself.
RULES = (
    ("symbol_ratio", "symbol_ratio", 0.90, 3.0),
    ("dup_line_ratio", "dup_line_ratio", 0.995, 0.0),
    ("repeat_ratio", "repeat_ratio", 0.995, 0.0),
    ("word_chars_high", "word_chars_mean", 0.90, 1.5),
    ("word_chars_low", "word_chars_mean", 0.10, 1.5),
)


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that stand in a window found twice or more, the first place included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    key = ids[:n]
    for k in range(1, window):
        if int(key.max()) >= (1 << 62) // len(known):
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(known) + ids[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts_of(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = sum(map(len, words))
    if not text.isascii():
        # bytes that continue a character don't count
        chars -= int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, len(text.translate(None, _DROP_SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Counts of every whole text (null: none), with the grouping columns."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def run(batches):
        for b in slices(batches):
            got = []
            for text in raw_texts(b.column(1)):
                text = text or b""
                got.append((*counts_of(text), text.count(b"\n") + 1))
            cols = list(zip(*got, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(2 + i) for i in range(len(keys))), *(pa.array(c, pa.int64()) for c in cols)], names=[id_col, *keys, *names])

    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_col, *keys))
    return df.select(id_col, text_col, *keys).mapInArrow(run, f"{head}, " + ", ".join(f"{n} long" for n in names))


def base_failed(min_words: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratios(df: DataFrame) -> DataFrame:
    """The ratios; symbols are counted from one, as a short text's single symbol tells less than a long one's many."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return df.withColumns({
        "symbol_ratio": (F.col("n_symbols") + 1) / (F.col("n_words") + 1).cast("double"),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "word_chars_mean": F.col("word_chars") / words,
    })


def fences(rows: DataFrame, by: list[str], accuracy: int = 10_000, rules=RULES) -> DataFrame:
    """Rows and a fence of each rule for every group, from one sketch a rule: the tail, and beyond it in proportion to its distance from the median."""
    q = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(r, F.array(F.lit(0.5), F.lit(level)), accuracy).alias(name) for name, r, level, _ in rules))
    beyond = [(F.col(name)[1] + F.lit(reach) * (F.col(name)[1] - F.col(name)[0])).alias(name) for name, _, _, reach in rules]
    return q.select(*by, "n", F.struct(*beyond).alias("fence"))


def judge(measured: DataFrame, lang: str = "lang", source: str = "source", weight: float = 100.0, accuracy: int = 10_000, rules=RULES) -> DataFrame:
    """Adds base_failed, kept and reasons to ``measured``'s rows.

    A group's fence is its own, weighed by its rows, and its language's, weighed
    as ``weight`` rows; the language's is drawn to that of all documents in the
    same way. Rows that fail the base rules make no fences. Null languages and
    sources are groups of their own; a group without a fence of its own takes its
    language's, a language without one that of all. A value on the fence passes.
    Repeated rows count as often as they stand. ``measured`` is read several
    times; pass a materialised one. An empty table gives an empty result.
    """
    rows = _ratios(measured)
    ok = rows.where(~base_failed())
    fine, coarse = fences(ok, [lang, source], accuracy, rules), fences(ok, [lang], accuracy, rules)
    # of all documents: one row, which goes on as literals
    whole = fences(ok, [], accuracy, rules).select("fence.*").first()
    # all fences of the groups first: a small table, one row a group
    groups = measured.groupBy(lang, source).agg(F.count(F.lit(1)).alias("_n"))
    f, c = fine.alias("f"), coarse.alias("c")

    def drawn(n, own, parent):
        return F.coalesce((n * own + F.lit(weight) * parent) / (n + F.lit(weight)), parent)

    every = {name: F.lit(whole[name]).cast("double") for name, *_ in rules}
    by_lang = {name: drawn(F.col("c.n"), F.col(f"c.fence.{name}"), every[name]) for name in every}
    wide = (
        groups.alias("g")
        .join(f, F.col(f"g.{lang}").eqNullSafe(F.col(f"f.{lang}")) & F.col(f"g.{source}").eqNullSafe(F.col(f"f.{source}")), "left")
        .join(c, F.col(f"g.{lang}").eqNullSafe(F.col(f"c.{lang}")), "left")
        .select(F.col(f"g.{lang}").alias("_lang"), F.col(f"g.{source}").alias("_source"), F.struct(*(drawn(F.col("f.n"), F.col(f"f.fence.{name}"), by_lang[name]).alias(name) for name in every)).alias("_fence"))
    )
    out = rows.join(wide, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left")
    hits = []
    for name, r, level, _ in rules:
        fence = F.col(f"_fence.{name}")
        # tails that differ by rounding alone are alike
        hits.append(F.when(F.col(r) > fence + 1e-12 if level > 0.5 else F.col(r) < fence - 1e-12, F.lit(name)))
    reasons = F.array_compact(F.array(*hits))
    return out.withColumn("base_failed", base_failed()).withColumn("reasons", reasons).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0)).drop("_lang", "_source", "_fence")
