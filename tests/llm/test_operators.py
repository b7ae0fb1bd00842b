"""Results, edge cases and brute-force comparisons of the training-data operators."""

import collections
import math
import random
import re
import textwrap
import time
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from barloom.llm import chat_format, decontamination, language_id, license_scan, quality_classifier, quality_rules, queries, sentencepiece_codec, sharding, simhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string, ids string, size string"
DATA = "/root/testdata/sf0.001"


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


def docs(spark, texts, ids=None):
    """Documents with columns whose names clash with results."""
    rows = [(i, t, "en" if k % 2 else None, "src", 1, "x", "x", "x", "x") for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


LONG = words(30_000, 9)
ODD = [None, "", "   \n", "a", "日本語 テキスト", "$$$ 123 !!", LONG, words(80, 1), words(80, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD, [*range(len(ODD) - 2), 7, 7]).cache()  # the last row twice, with its id


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def shards(df):
    return sharding.shard(df, 4)


def language(df):
    return language_id.detect(df, language_id.fit(df))


def quality(df):
    lab = df.sparkSession.createDataFrame([(6, 1), (7, 0), (None, 1), (5, None), (5, 3)], "doc_id long, quality int")
    return quality_classifier.score(df, quality_classifier.fit(df, lab))


def rules(df):
    return quality_rules.judge(quality_rules.measure(df))


def codec(df):
    return sentencepiece_codec.encode(df, sentencepiece_codec.load(sentencepiece_codec.default_model_path()), check=True)


def items(spark):
    return spark.createDataFrame([(1, words(30, 5)), (2, None), (3, "too short"), (1, words(30, 5))], "item_id long, text string")


PER_ROW = [language, quality, license_scan.scan, simhash.near_duplicates, shards, rules, codec]


@pytest.mark.parametrize("op", PER_ROW)
def test_odd_rows_give_one_row_each(op, odd):
    assert sorted(r.doc_id for r in op(odd).collect()) == sorted(r.doc_id for r in odd.collect())


@pytest.mark.parametrize("op", PER_ROW)
def test_empty_tables(op, spark):
    assert op(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_operators_with_odd_and_empty_tables(spark, odd):
    none = spark.createDataFrame([], SCHEMA)
    assert decontamination.find(odd, items(spark)).count() == 0
    assert decontamination.find(none, items(spark)).count() == 0
    assert decontamination.find(odd, items(spark).limit(0)).count() == 0
    assert decontamination.remove(odd, items(spark)).count() == len(ODD)
    assert substring_dedup.repeated_passages(odd).count() == 0  # rows of one id and text are one document
    assert substring_dedup.repeated_passages(none).count() == 0
    assert substring_dedup.remove_repeats(odd).count() == len(ODD)
    assert simhash.one_of_each(odd).count() == 6 and simhash.one_of_each(none).count() == 0  # the three wordless link
    assert quality_classifier.keep(none, quality_classifier.fit(none, none.selectExpr("doc_id", "1 as quality"))).count() == 0


def test_language_held_out(spark):
    got = queries.op1_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) > 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)


def test_language_undetermined(odd):
    got = {r.doc_id: r for r in language(odd).collect()}
    assert [got[i].nearest for i in (0, 1, 2, 5)] == ["und"] * 4 and got[6].nearest == "en"


def test_quality_held_out(spark):
    got = queries.op3_quality_classifier(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good = [r for r in got if r.quality == 1]
    assert sum(r.predicted == 1 for r in good) >= 0.97 * len(good)
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def test_blocks_of_long_texts_count_alike(monkeypatch):
    t = words(500, 3)
    whole = language_id.ngram_counts(t, 4096)
    total = np.sort(np.concatenate(list(quality_classifier.features(t.encode(), 1 << 15))))
    monkeypatch.setattr(language_id, "_BLOCK", 100)
    monkeypatch.setattr(quality_classifier, "_BLOCK", 100)
    assert (language_id.ngram_counts(t, 4096) == whole).all()
    assert (np.sort(np.concatenate(list(quality_classifier.features(t.encode(), 1 << 15)))) == total).all()


def test_decontamination_finds_reparameterised_questions(spark):
    item = "A train leaves the old station at 9 with Anna on board and runs 120 km before Anna leaves it and 9 others get in while the rest of them wait for dinner"
    again = item.replace("Anna", "Bert").replace("120", "75").replace(" 9 ", " 4 ")
    mixed = again.replace("Bert leaves", "Carl leaves")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [words(50) + ". " + item + ". " + words(20, 2), words(50) + ". " + again, words(50) + ". " + mixed, words(100, 4)]
    got = {r.doc_id: r for r in decontamination.find(docs(spark, texts), bench).collect()}
    assert set(got) == {0, 1} and got[0].exact and not got[1].exact
    assert {r.doc_id for r in decontamination.remove(docs(spark, texts), bench).collect()} == {2, 3}


def test_decontamination_in_parts_and_blocks(spark, monkeypatch):
    bench = items(spark)
    text = (words(400, 6) + " " + words(30, 5) + " " + words(300, 7)).encode()
    index = decontamination.ItemIndex([(1, words(30, 5).encode())])
    whole = decontamination._best(index, text, 0.8)
    monkeypatch.setattr(decontamination, "_CHUNK", 300)
    assert decontamination._best(index, text, 0.8) == whole and whole[0][2:4] == (400, 430)
    df = docs(spark, [text.decode()])
    assert sorted(decontamination.find(df, bench).collect()) == sorted(decontamination.find(df, bench, block_mb=1e-4).collect())


def test_decontamination_matches_brute_force(spark, real):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    w = lambda s: re.findall(r"[^\W_]+", s.lower())
    want = set()
    for b in bench.collect():
        t = w(b.text)
        grams = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
        for d in real.collect():
            x = w(d.text)
            own = {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
            if grams and len(grams & own) >= 0.95 * len(grams):
                want.add((d.doc_id, b.item_id))
    assert want <= {(r.doc_id, r.item_id) for r in decontamination.find(real, bench).collect()}


def test_chat_round_trip_and_machine(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "s<turn>\\"), (1, 1, "user", said), (1, 2, "assistant", said), (2, 0, "assistant", "x"), (3, 0, "user", None), (None, 0, None, "\n\\n"), (4, None, "us\ner", "b"), (4, 1, "user", "a"), (4, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat_format.format_turns(df.withColumn("pos", df.turn))
    read, _ = chat_format.reader(chat_format.Template())
    back = collections.Counter((r.conv_id, *read("".join(s.text for s in r.segments))) for r in turns.collect())
    assert back == collections.Counter((c, role or "", t or "") for c, _, role, t in rows)
    got = {r.conv_id: r for r in chat_format.digest(turns).collect()}
    assert got[1].valid and got[1].loss_chars == len(said) and got[4].n_turns == 3
    assert not got[2].valid and got[3].error == "ends in user"
    assert chat_format.digest(chat_format.format_turns(df.limit(0))).count() == 0


def test_digest_of_shuffled_turns(spark):
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", f"{c} {k}") for c in range(40) for k in range(4)]
    turns = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = sorted(chat_format.digest(turns).collect())
    mixed = turns.repartition(7).cache()
    assert sorted(chat_format.digest(mixed, ordered=False).collect()) == want and len(want) == 40
    with pytest.raises(Exception, match="should: pass ordered=False"):
        chat_format.digest(mixed).collect()


def test_reader_takes_long_texts_and_refuses_others():
    t = chat_format.Template()
    (esc, esc_role), (read, undo) = chat_format.escaper(t), chat_format.reader(t)
    r = random.Random(1)
    parts = [t.open, t.close, t.close.strip(), "\\", "\n", "### User:", "a", " "]
    for _ in range(300):
        role, text = ("".join(r.choice(parts) for _ in range(r.randint(0, 6))) for _ in range(2))
        whole = t.open + esc_role(role) + t.after_role + esc(text) + t.close
        assert read(whole) == (role, text) and undo(esc(text)) == text
    for bad in ("", "x", t.open + "user", t.open + "user\nabc", t.open + "user\nabc" + t.close + "x", t.open + "user\nabc\\" + t.close):
        with pytest.raises(ValueError):
            read(bad)
    for long in ("a word and another " * 1_100_000, "\\<turn> " * 2_500_000):  # 20 MB
        whole = t.open + "user" + t.after_role + esc(long) + t.close
        began = time.perf_counter()
        tracemalloc.start()
        assert read(whole) == ("user", long)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 30 * len(long) and time.perf_counter() - began < 60


def test_license_matches_brute_force(spark):
    r = random.Random(4)
    pool = [w.decode() for _, t in license_scan.TEMPLATES for w in license_scan.folded(t.encode()).split()]
    texts = ["\n".join(" ".join(r.choice(pool) for _ in range(r.randint(1, 14))) for _ in range(5)) for _ in range(60)] + [t for _, t in license_scan.TEMPLATES] + ["MIT  License\nGNU general\npublic LICENSE cc-by"]
    for row in license_scan.scan(docs(spark, texts), threshold=0.6).collect():
        text = texts[row.doc_id]
        want = set()
        for k, line in enumerate(text.split("\n")):
            own = set(license_scan.folded(line.encode()).split())
            for label, t in license_scan.TEMPLATES:
                tokens = set(license_scan.folded(t.encode()).split())
                if len(tokens & own) >= 0.6 * len(tokens) - 1e-9:
                    want.add((k, label, round(len(tokens & own) / len(tokens), 9)))
        assert {(b.line, b.label, round(b.containment, 9)) for b in row.blocks if b.line == b.last_line} == want
        found = {b.label for b in row.blocks}
        for label, t in license_scan.TEMPLATES:
            tokens, most, split = set(license_scan.folded(t.encode()).split()), 2 * len(license_scan.folded(t.encode()).split()), [x.encode() for x in text.split("\n")]
            for k in range(len(split)):
                own, n = set(), 0
                for x in split[k:]:
                    ws = license_scan.folded(x).split()
                    n += len(ws)
                    if n > most or not ws:
                        break
                    own |= set(ws)
                if len(tokens & own) >= 0.6 * len(tokens) - 1e-9:
                    assert label in found
        low = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        places = [i for p, _ in license_scan.PHRASES for i in range(len(low)) if low[i : i + len(p.split())] == p.split()]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(low), len(places), min(places, default=None), max(places, default=None))


def test_wrapped_notices_are_found_where_they_stand(spark):
    notice = next(t for label, t in license_scan.TEMPLATES if label == "bsd")
    wrapped = textwrap.wrap(notice, 40)
    near = ["Some code of mine.", *wrapped, "And on it goes for a while."]
    apart = [x for line in wrapped for x in (line, "")]
    got = {r.doc_id: r.blocks for r in license_scan.scan(docs(spark, ["\n".join(near), "\n".join(apart), " ".join(wrapped)])).collect()}
    assert [(b.label, b.line, b.last_line) for b in got[0]] == [("bsd", 1, len(wrapped))] and not got[1]
    assert [(b.label, b.line, b.last_line) for b in got[2]] == [("bsd", 0, 0)]


def test_long_texts_of_phrases_take_time_in_proportion(spark):
    text = b"cc by " * 3_300_000  # 20 MB
    ready = [(p.encode().split()[0], (b" " + p.encode() + b" ", label)) for p, label in license_scan.PHRASES]
    began = time.perf_counter()
    n, places, first, last, labels = license_scan.phrase_places(text, ready)
    assert (n, places, first, last, labels) == (6_600_000, 3_300_000, 0, 6_599_998, {"cc-by"}) and time.perf_counter() - began < 30


def test_compact_windows_match_definition():
    rng = np.random.default_rng(0)
    for t in range(100):
        n, w = int(rng.integers(1, 80)), int(rng.integers(1, 12))
        x = rng.integers(0, 40 if t % 2 else 10**9, n).astype(np.uint64)
        want = []
        for i in range(n):
            a = b = i
            while a > 0 and x[a - 1] > x[i]:
                a -= 1
            while b < n - 1 and x[b + 1] >= x[i]:
                b += 1
            if b - a + 1 >= w:
                want.append((a, i, b))
        assert sorted(zip(*substring_dedup.compact_windows(x, w), strict=True)) == sorted(want)


def test_compact_windows_of_several_texts_are_those_of_each():
    rng = np.random.default_rng(1)
    for _ in range(50):
        parts, w = [rng.integers(1, 60, int(rng.integers(0, 40))).astype(np.uint64) for _ in range(6)], int(rng.integers(1, 9))
        bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        got = sorted(zip(*substring_dedup.compact_windows(np.concatenate(parts), w, bounds), strict=True))
        assert got == sorted(tuple(v + b for v in t) for p, b in zip(parts, bounds) for t in zip(*substring_dedup.compact_windows(p, w), strict=True))
    texts = [words(n, n).encode() for n in (0, 3, 30, 4, 5, 200)]
    s, b = substring_dedup.shingles_of(texts)
    for t, x, y in zip(texts, b, b[1:]):
        assert (s[x:y] == substring_dedup.shingle_hashes(t)).all()


def test_repeated_passages_match_brute_force(spark, real):
    passage, near = words(70, 11), words(120, 12).split()
    edited = near[:60] + ["other"] + near[61:]
    texts = [words(90, 20) + " " + passage, passage + " " + words(60, 21) + " " + passage, words(30, 22) + " " + " ".join(near), " ".join(edited), words(300, 23)]
    got = collections.defaultdict(set)
    for r in substring_dedup.repeated_passages(docs(spark, texts)).collect():
        got[r.doc_id] |= set(range(r.first_word, r.end_word))
    assert got[1] == {*range(70), *range(130, 200)} and got[3] == set(range(120)) and set(got) == {1, 3}
    out = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs(spark, texts)).collect()}
    assert out[1].split() == words(60, 21).split() and 3 not in out and out[0] == texts[0]
    seen, want = {}, collections.defaultdict(set)
    for r in sorted(real.collect()):
        w = r.text.encode().lower().split()
        mine = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        for k, x in enumerate(mine):
            if x in seen:
                want[r.doc_id] |= set(range(k, k + 50))
        for x in mine:
            seen.setdefault(x, r.doc_id)
    found = collections.defaultdict(set)
    for r in substring_dedup.repeated_passages(real).collect():
        found[r.doc_id] |= set(range(r.first_word, r.end_word))
    assert want and all(v <= found[k] for k, v in want.items())


def test_sentencepiece_matches_library():
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, mine = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.load(path)
    texts = [t or "" for t in ODD] + ["a  b", "  lead", "x\ny\t", "\U0001f600a\x00b", "ab   ", "a" * 700, "<s> hi <0x0A>", "caféé naïve def foo(x):\n    return x"]
    got = sentencepiece_codec.encode_texts(mine, texts)
    assert got == lib.encode(texts)
    assert [sentencepiece_codec.decode_ids(mine, k) for k in got] == texts
    proto = pb.ModelProto()
    proto.ParseFromString(open(path, "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = p.score / 1000 - 8 if p.type == 1 and p.score > -1e8 else -60.0
    uni, ref = sentencepiece_codec.from_bytes(proto.SerializeToString()), sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for w in words(150, 30).split():
        own = sentencepiece_codec.encode_texts(uni, [w])[0]
        assert sum(ref.get_score(i) for i in own) == pytest.approx(sum(ref.get_score(i) for i in ref.nbest_encode_as_ids(w, 1)[0]), abs=1e-3)


def test_decode_operator(spark):
    m = sentencepiece_codec.load(sentencepiece_codec.default_model_path())
    coded = sentencepiece_codec.encode(docs(spark, ["a b", None, "é\n"]), m)
    assert {r.doc_id: r.text for r in sentencepiece_codec.decode(coded, m).collect()} == {0: "a b", 1: "", 2: "é\n"}


def test_simhash_matches_brute_force(spark, real):
    def plain(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = {r.doc_id: plain(r.text) for r in real.collect()}
    root = {i: i for i in rows}

    def find(x):
        return x if root[x] == x else find(root[x])

    ids = sorted(rows)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (rows[a] ^ rows[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for r in simhash.near_duplicates(real).collect():
        assert r.fingerprint == f"{rows[r.doc_id]:016x}" and r.component_id == find(r.doc_id)


def test_bk_tree_and_links_match_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (2**64 - 1) for b in base for _ in range(30)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert {tree.values[k] for k in tree.near(v, 3)} == {x for x in values if (x ^ v).bit_count() <= 3}

    def classes(links):
        root = {v: v for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        return {frozenset(v for v in values if find(v) == r) for r in {find(v) for v in values}}

    want = classes((a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 3)
    assert classes(simhash.shard_links(values)) == want
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    assert classes((r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.fingerprint_links(df).collect()) == want


def test_shards_are_even_and_gapless(spark, real):
    hot = docs(spark, ["same text here"] * 300 + [words(5 + k, k) for k in range(300)])
    for df, n in ((hot, 7), (real, 40)):
        rows = sharding.shard(df, n).collect()
        text = {r.doc_id: r.text for r in df.collect()}
        size = collections.Counter()
        for r in rows:
            assert r.size == len((text[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode())
            size[r.shard] += r.size
        assert max(size.values()) - min(size.values()) <= max(r.size for r in rows) or len(size) < n
        for s in size:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_splitters_and_parts_match_the_law(spark):
    rows = [(None, "same")] * 400 + [(7, "same")] * 200 + [(k, words(3 + k % 50, k)) for k in range(400)] + [(1000, words(4000, 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(df, 5, groups=4, per_range=8).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len(t) + 16, zlib.crc32(t.encode())) for i, t in rows)
    # by the law, whatever the splitters: middles of records in the whole order fall in their shard's part of all bytes
    total, before = sum(r.size for r in got), 0
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        assert r.shard == min(4, 5 * (2 * before + r.size) // (2 * total))
        before += r.size


def test_sharding_uses_no_python_worker(spark, real):
    plan = sharding.shard(real, 40)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_rules_match_brute_force(spark, real):
    for r in quality_rules.judge(quality_rules.measure(real)).join(real.select("doc_id", "text"), "doc_id").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        twice = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in r.text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text)), len(lines) - len(set(lines)), len(twice))
        assert r.base_failed == (len(w) < 50 or 100 * len(twice) > 50 * len(w)) and not (r.base_failed and r.kept)


def fence_by_hand(values, level, reach):
    """The smallest value that at least the level's share of all values doesn't pass, and beyond it."""
    v = sorted(values)
    at = lambda p: v[max(0, math.ceil(p * len(v) - 1e-9) - 1)]
    return at(level) + reach * (at(level) - at(0.5))


def test_fences_and_verdicts_match_brute_force(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality_rules.judge(quality_rules.measure(real).cache()).collect()
    ok = [r for r in got if not r.base_failed]
    seen = collections.defaultdict(set)
    for r in ok:
        want = []
        for name, ratio, level, reach in quality_rules.RULES:
            fence = fence_by_hand([x[ratio] for x in ok], level, reach)
            for group in ([x for x in ok if x.lang == r.lang], [x for x in ok if (x.lang, x.source) == (r.lang, r.source)]):
                own = fence_by_hand([x[ratio] for x in group], level, reach)
                fence = (len(group) * own + 100 * fence) / (len(group) + 100)
            seen[name].add(round(fence, 9))
            if (r[ratio] > fence + 1e-12) if level > 0.5 else (r[ratio] < fence - 1e-12):
                want.append(name)
        assert r.reasons == want and r.kept == (not want)
    assert all(len(v) > 10 for v in seen.values())  # groups have fences of their own


def test_a_groups_fence_moves_with_its_data(spark):
    def rows(symbols):
        plain = [(k, words(100, k), "en", "calm") for k in range(300)]
        return plain + [(300 + k, words(100, k) + " #" * (symbols * (k % 7)), "en", "code") for k in range(300)]

    def fence(symbols):
        df = quality_rules.measure(spark.createDataFrame(rows(symbols), "doc_id long, text string, lang string, source string"))
        found = quality_rules.fences(quality_rules._ratios(df), ["source"]).collect()
        return {r.source: r.fence.symbol_ratio for r in found}

    few, many = fence(1), fence(4)
    assert few["calm"] == many["calm"] < few["code"] < many["code"]


def test_pipeline_runs_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "sentencepiece"]
    out = corpus_pipeline.run(spark, DATA)
    assert 0 < out.count() < spark.read.parquet(f"{DATA}/documents.parquet").count() and out.where("not round_trip").count() == 0
