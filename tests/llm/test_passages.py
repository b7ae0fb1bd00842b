"""Repeated passages against brute force, on fragments, chains, edits, long texts and odd ids."""

import random
import time
import tracemalloc

import numpy as np
import pytest

from barloom.llm import substring_dedup as sd


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


def exact(texts, least=50):
    """For each document, the words in runs of ``least`` that an earlier one holds."""
    seen, out = {}, {}
    for k, t in enumerate(texts):
        w = (t or "").lower().split()
        grams = [tuple(w[i : i + least]) for i in range(len(w) - least + 1)]
        hit = set()
        for i, g in enumerate(grams):
            if g in seen:
                hit |= set(range(i, i + least))
        for g in grams:
            seen.setdefault(g, k)
        if hit:
            out[k] = hit
    return out


def found(spark, texts, **options):
    out = {}
    for r in sd.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **options).collect():
        assert r.src_doc_id < r.doc_id and r.similarity >= 0.8 and r.end_word - r.first_word >= 50
        out.setdefault(r.doc_id, set()).update(range(r.first_word, r.end_word))
    return out


def test_a_fragment_in_an_earlier_text_hides_nothing(spark):
    texts, whole = [], []
    for k in range(60):
        p = words(55 + k % 30, 1000 + k).split()
        cut = k % 40
        fragment = " ".join(p[cut : cut + 28])  # under 50 words
        texts += [f"{words(40, 4 * k)} {fragment} {words(40, 4 * k + 1)}", f"{words(30, 4 * k + 2)} {' '.join(p)}", f"{' '.join(p)} {words(30, 4 * k + 3)}"]
        whole.append(3 * k + 2)
    got, want = found(spark, texts), exact(texts)
    assert sorted(want) == whole and all(want[k] <= got.get(k, set()) for k in want)
    assert all(got[k] == want[k] for k in got)  # nothing beyond


def test_nested_fragments_in_many_texts(spark):
    p = words(90, 5).split()
    texts = [f"{words(60, 50 + n)} {' '.join(p[20 : 20 + n])} {words(60, 150 + n)}" for n in range(8, 48, 2)]
    texts += [" ".join(p), words(60, 300) + " " + " ".join(p[:80]), " ".join(p[10:]) + " " + words(60, 301)]
    got, want = found(spark, texts), exact(texts)
    assert want and all(want[k] <= got.get(k, set()) for k in want)


def test_chains_of_passages_match_brute_force(spark):
    p = words(2000, 6).split()
    r = random.Random(3)
    texts = [f"{words(r.randint(5, 60), 400 + k)} {' '.join(p[a : a + r.randint(50, 130)])} {words(r.randint(5, 60), 600 + k)}" for k, a in enumerate(r.randrange(1850) for _ in range(120))]
    got, want = found(spark, texts), exact(texts)
    assert len(want) > 50 and all(want[k] <= got.get(k, set()) for k in want)


def test_edited_passages_are_found_whole(spark):
    r, texts, near = random.Random(4), [], []
    for k in range(150):
        p = words(r.randint(80, 200), 2000 + k).split()
        q = list(p)
        for at in r.sample(range(5, len(p) - 5), max(1, len(p) // 60)):
            q[at] = "other" if r.random() < 0.6 else "two words"
        texts += [" ".join(p), words(20, 3000 + k) + " " + " ".join(q)]
        a, b = (set(zip(*(v[i:] for i in range(5)), strict=False)) for v in (p, " ".join(q).split()))
        if len(a & b) >= 0.8 * len(a | b):
            near.append(2 * k + 1)
    got = found(spark, texts)
    caught = [k for k in near if len(got.get(k, ())) >= 0.9 * (len(texts[k].split()) - 20)]
    assert len(near) > 100 and len(caught) >= 0.98 * len(near)


def test_two_edits_close_together(spark):
    p = words(106, 7).split()
    q = [*p[:49], "other", *p[50:56], "words", *p[57:]]
    assert found(spark, [" ".join(p), " ".join(q)]) == {1: set(range(106))}


def test_large_texts_that_share_little_do_not_agree_by_chance():
    rng = np.random.default_rng(0)
    x, y = (rng.integers(0, 1 << 63, 400_000).astype(np.uint64) for _ in range(2))
    y[1000:53_000] = x[301_000:353_000]
    out, _ = sd.verified_passages(x, y, [(301_500, 1500), (5, 5), (200_000, 200_000)], 46, 0.8)
    assert [(s, e, r) for s, e, r, _ in out] == [(301_000, 353_000, 1000)]


def test_long_texts_take_time_and_memory_in_proportion(spark):
    text = words(400_000, 8)
    long = " ".join([text] * 8)  # 20 MB
    began = time.perf_counter()
    tracemalloc.start()
    s = sd.shingle_hashes(long.encode())
    out, _ = sd.verified_passages(s, s.copy(), [(k, k) for k in range(0, len(s), 50)], 46, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(a, e, r) for a, e, r, _ in out] == [(0, len(s), 0)]
    assert peak < 60 * len(long) and time.perf_counter() - began < 120
    half = words(30_000, 9)
    got = found(spark, [half + " " + words(3000, 10), words(2000, 11) + " " + half])
    assert got == {1: set(range(2000, 32_000))}


@pytest.mark.parametrize("kind", ["string", "double", "date"])
def test_ids_of_any_type_null_and_repeated(spark, kind):
    p = words(60, 12)
    ids = {"string": "cast(id as string)", "double": "cast(id as double)", "date": "date_add(date'2020-01-01', cast(id as int))"}[kind]
    rows = [(1, p), (2, words(20, 13) + " " + p), (2, words(70, 14)), (2, words(70, 14)), (None, p), (3, None), (4, ""), (5, words(70, 14) + " x")]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr(f"{ids} as doc_id", "text", "1 as _doc", "2 as _spans", "3 as doc", "4 as src", "5 as `n`", "6 as first", "7 as `a.b`")
    got = sorted((str(r[0]), r.first_word, r.end_word) for r in sd.repeated_passages(df).collect())
    own = {str(r.doc_id): r.doc_id for r in df.collect()}
    two, five = (next(k for k in own if k.startswith(v) or k.endswith(v)) for v in ({"string": "2", "double": "2.0", "date": "2020-01-03"}[kind], {"string": "5", "double": "5.0", "date": "2020-01-06"}[kind]))
    assert got == sorted([(two, 20, 80), ("None", 0, 60), (five, 0, 70)])
    left = [r.text for r in sd.remove_repeats(df).collect()]
    assert sorted(map(str, left)) == sorted(map(str, [p, words(20, 13), words(70, 14), words(70, 14), None, "", " x"]))
    assert sd.remove_repeats(df).columns == df.columns
