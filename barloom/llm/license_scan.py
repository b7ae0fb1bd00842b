"""License scans by an exact set-similarity join of text blocks and templates.

Tokens are ordered by their frequency over the whole corpus, rarest first. A
template meets a block if the block has at least ``ceil(threshold * |template|)``
of its tokens. Then the first ``|template| - need + 1`` tokens of the template's
order hold one of the block's (prefix filter), the block has at least ``need``
tokens (length filter), and what stands behind the first shared token in both
orders suffices (positional filter). What passes is verified by its exact overlap.

Blocks are lines, and runs of lines for notices that are wrapped: from each line
on, as many lines up to a blank one as hold at most twice the template's words.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, slices

#: Phrases whose consecutive words give a base label.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices in common use, by label; a parameter of ``scan``.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("all-rights-reserved", "Copyright. All rights reserved."),
)
#: A-Z to a-z; digits, a-z and all bytes of non-ASCII characters stay; the rest is space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 10 if c == 10 else 32 for c in range(256))


def folded(text: bytes) -> bytes:
    """Words apart by spaces; line ends stay."""
    return text.translate(_TABLE)


def corpus_frequencies(df: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> Counter:
    """How often the templates' tokens stand in all texts: counted per task, summed, at most one row a token to the driver."""

    def count(batches):
        total: Counter = Counter()
        for b in slices(batches):
            for text in raw_texts(b.column(0)):
                if text:
                    total.update(vocabulary.intersection(set(w := folded(text).split())) and [x for x in w if x in vocabulary])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k.decode() for k in total]), pa.array(list(total.values()), pa.int64())], names=["token", "n"])

    rows = df.select(text_col).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return Counter({r["token"].encode(): r["n"] for r in rows})


class TemplateIndex:
    """Prefix postings of templates over a global token order."""

    def __init__(self, templates, frequencies: Counter, threshold: float):
        self.order, self.sets, self.labels, self.need, self.most_words = {}, [], [], [], []
        tokens = {w for _, text in templates for w in folded(text.encode()).split()}
        for k, w in enumerate(sorted(tokens, key=lambda w: (frequencies[w], w))):
            self.order[w] = k
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for label, text in templates:
            own = sorted({self.order[w] for w in folded(text.encode()).split()})
            if not own:
                continue
            t = len(self.sets)
            need = math.ceil(threshold * len(own) - 1e-9)
            self.sets.append(own)
            self.labels.append(label)
            self.need.append(need)
            self.most_words.append(2 * len(folded(text.encode()).split()))
            for i, k in enumerate(own[: len(own) - need + 1]):
                self.postings.setdefault(k, []).append((t, i))
        self.rare = frozenset(w for w, k in self.order.items() if k in self.postings)

    def match(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of all templates that the block's words meet."""
        return self._meet(sorted({self.order[w] for w in words if w in self.order}))

    def runs(self, lines: list[list[bytes]]) -> list[tuple[int, int, int, float]]:
        """(first line, last line, template, containment) of the runs of two lines or more that meet a template.

        A run is as long as its template's limit of words lets it be, without the lines at
        either end that add no token. Cost: lines times the limit, for templates a prefix token of which is there.
        """
        tokens = [{self.order[w] for w in words if w in self.order} for words in lines]
        there = set().union(*tokens)
        out = []
        for t in sorted({t for k in there for t, _ in self.postings.get(k, ())}):
            own, need, most = set(self.sets[t]), self.need[t], self.most_words[t]
            if len(own & there) < need:
                continue
            shared = [own & x for x in tokens]
            for first, at_first in enumerate(shared):
                if not at_first:
                    continue
                held, n, last = set(), 0, first
                for k in range(first, len(lines)):
                    n += len(lines[k])
                    if n > most or not lines[k]:
                        break
                    if not shared[k] <= held:
                        held |= shared[k]
                        last = k
                if last > first and len(held) >= need and not at_first <= set().union(*shared[first + 1 : last + 1]):
                    out.append((first, last, t, len(held) / len(own)))
        return out

    def _meet(self, block: list[int]) -> list[tuple[int, float]]:
        size, found, seen = len(block), [], set()
        for j, k in enumerate(block):
            for t, i in self.postings.get(k, ()):
                if t in seen:
                    continue
                seen.add(t)  # the first shared token of the prefix decides
                own, need = self.sets[t], self.need[t]
                if size < need or 1 + min(len(own) - i - 1, size - j - 1) < need:
                    continue
                overlap = 0
                at = j
                for x in own[i:]:
                    at = bisect_left(block, x, at)
                    if at == size:
                        break
                    overlap += block[at] == x
                if overlap >= need:
                    found.append((t, overlap / len(own)))
        return found


def phrase_places(text: bytes, phrases) -> tuple[int, int, int | None, int | None, set[str]]:
    """Words, places, first and last word of the places, labels."""
    words = text.split()
    n, first, last, labels = 0, None, None, set()
    if any(p in text for p, _ in phrases):  # a phrase of one word, or its first
        joined = b" " + b" ".join(words) + b" "
        for _, (phrase, label) in phrases:
            at, k, before = joined.find(phrase), 0, 0
            while at >= 0:
                k += joined.count(b" ", before, at)
                before = at
                n += 1
                labels.add(label)
                first = k if first is None else min(first, k)
                last = k if last is None else max(last, k)
                at = joined.find(phrase, at + 1)
    return len(words), n, first, last, labels


def scan(
    df: DataFrame,
    frequencies: Counter | None = None,
    templates=TEMPLATES,
    phrases=PHRASES,
    threshold: float = 0.9,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_mb: float = 16.0,
) -> DataFrame:
    """One row a document: word count, phrase places, labels, and the blocks (lines and runs of lines) that meet a template.

    ``blocks`` holds first line, label, containment and last line of every match.
    ``score`` is 1 with a phrase, else the best containment, else 0. A null text
    is empty: no words, no labels, score 0. Lines are whole however long, and a
    long text takes time in proportion to its length; repeated rows give repeated
    results; ties between templates are all reported. Only the id and the text
    are read. Templates go to the tasks as a whole; those of more than
    ``max_mb`` in all are refused.
    """
    if sum(len(t) for _, t in templates) > max_mb * 1e6:
        raise ValueError(f"the templates have more than {max_mb} MB; give them in parts")
    vocabulary = frozenset(w for _, t in templates for w in folded(t.encode()).split())
    index = TemplateIndex(templates, corpus_frequencies(df, vocabulary, text_col) if frequencies is None else frequencies, threshold)
    ready = [(p.encode().split()[0], (b" " + b" ".join(p.encode().split()) + b" ", label)) for p, label in phrases]
    block = pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64()), ("last_line", pa.int64())]))
    schema = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("blocks", block)])

    def run(batches):
        for b in slices(batches):
            out = []
            for text in raw_texts(b.column(1)):
                low = folded(text or b"")
                n, places, first, last, base = phrase_places(low, ready)
                blocks = []
                if not index.rare.isdisjoint(low.split()):
                    lines = [line.split() for line in low.split(b"\n")]
                    for k, words in enumerate(lines):
                        if words and not index.rare.isdisjoint(words):
                            blocks += [{"line": k, "label": index.labels[t], "containment": c, "last_line": k} for t, c in index.match(words)]
                    blocks += [{"line": a, "label": index.labels[t], "containment": c, "last_line": e} for a, e, t, c in index.runs(lines)]
                score = 1.0 if places else max((x["containment"] for x in blocks), default=0.0)
                out.append((n, places, first, last, ",".join(sorted(base)), ",".join(sorted(base | {x["label"] for x in blocks})), score, blocks))
            cols = list(zip(*out, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(cols, schema, strict=True))], names=[id_col, *schema.names])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<line:long,label:string,containment:double,last_line:long>>"
    )
