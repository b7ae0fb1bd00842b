"""SentencePiece encoding and decoding in batched numpy.

Texts are normalised as the model says and cut at word marks, where no piece
can span. Distinct words of a batch that aren't known yet are grouped by length
and each group advances together. A piece is found by probing a sorted array of
64-bit hashes of the pieces' characters with the hashes of all substrings of one
length at once.

``unigram`` models: Viterbi. Position by position, scores of all words and piece
lengths are compared at once, and the vectorised maxima leave backpointers.
``bpe`` models: a Viterbi path over their scores is not what the model means by
encoding (it gives other ids for many words), so the lattice of probed pieces is
searched by merges: in every step each word of a group takes its best-scored
adjacent pair.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BASE, mix64, powers, slices

MARK = "▁"
#: Words of this length or more aren't kept.
_LONG = 256
_KEEP = 300_000
_ROWS = 512
_POW = powers(BASE, 1 << 10)
#: A run of marks and what follows it.
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass
class Pieces:
    kind: str
    pieces: list[str]
    scores: np.ndarray
    usable: np.ndarray
    bytes_at: list[int]
    unk: int
    dummy_prefix: bool
    keys: np.ndarray = None
    ids: np.ndarray = None
    longest: int = 0
    by_piece: dict = field(default_factory=dict)
    name: str = ""

    @property
    def known(self) -> dict:
        """Ids of words seen before by this process, whatever task saw them."""
        return _KNOWN.setdefault(self.name, {})

    @known.setter
    def known(self, words: dict) -> None:
        _KNOWN[self.name] = words


_KNOWN: dict[str, dict] = {}


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str) -> Pieces:
    """Read a model file whose normaliser keeps the text as it is."""
    with open(path, "rb") as f:
        return from_bytes(f.read())


def from_bytes(data: bytes) -> Pieces:
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(data)
    norm = m.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only models with the identity normaliser are read")
    kind = {1: "unigram", 2: "bpe"}[m.trainer_spec.model_type]
    pieces = [p.piece for p in m.pieces]
    types = np.array([p.type for p in m.pieces])
    if any(MARK in p.lstrip(MARK) for p, t in zip(pieces, types, strict=True) if t == 1):
        raise ValueError("a piece spans words")
    scores = np.array([p.score for p in m.pieces], np.float64)
    usable = types == 1
    byte_ids = [0] * 256
    for i in np.flatnonzero(types == 6):
        byte_ids[int(pieces[i][1:-1], 16)] = int(i)
    out = Pieces(kind, pieces, scores, usable, byte_ids if (types == 6).any() else [], int(np.flatnonzero(types == 2)[0]), norm.add_dummy_prefix)
    own = np.flatnonzero(usable)
    hashes = np.array([_hash_one(pieces[i]) for i in own], np.uint64)
    order = np.argsort(hashes, kind="stable")
    if (np.diff(hashes[order]) == 0).any():
        raise ValueError("two pieces share a hash")
    out.keys, out.ids = hashes[order], own[order].astype(np.int64)
    out.name = hashlib.sha256(data).hexdigest()
    out.by_piece = {pieces[i]: int(i) for i in own}
    out.longest = max(len(pieces[i]) for i in own)
    return out


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)


def _hash_one(piece: str) -> np.uint64:
    return _spans(_prefix(_codes([piece])), np.zeros((1, 1), np.int64), np.array([[len(piece)]]))[0, 0]


def _prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix sums, one row a word; the highest position has power 0, so equal substrings need a shift only."""
    n, length = codes.shape
    pw = _POW[:length] if length <= len(_POW) else powers(BASE, length)
    out = np.zeros((n, length + 1), np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * pw, axis=1, out=out[:, 1:])
    return out


_INV = powers(pow(BASE, -1, 1 << 64), 1 << 10)


def _spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end) of each row."""
    top = int(start.max(initial=0)) + 1
    inv = _INV if top <= len(_INV) else powers(pow(BASE, -1, 1 << 64), top)
    h = (np.take_along_axis(prefix, end, 1) - np.take_along_axis(prefix, start, 1)) * inv[start]
    return mix64(h + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _probe(m: Pieces, h: np.ndarray) -> np.ndarray:
    """Piece ids, -1 where there is none."""
    at = np.searchsorted(m.keys, h)
    at[at == len(m.keys)] = 0
    return np.where(m.keys[at] == h, m.ids[at], -1)


def _fallback(m: Pieces, ch: str) -> list[int]:
    return [m.bytes_at[b] for b in ch.encode("utf-8", "surrogatepass")] if m.bytes_at else [m.unk]


def _viterbi(m: Pieces, words: list[str]) -> list[list[int]]:
    """Words of one length: best sums of scores, all words at once."""
    codes = _codes(words)
    n, length = codes.shape
    prefix = _prefix(codes)
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    back, which = np.zeros((n, length + 1), np.int64), np.full((n, length + 1), -1, np.int64)
    lowest = m.scores[m.usable].min() - 10.0  # the score of an unknown character
    for end in range(1, length + 1):
        starts = np.arange(max(0, end - m.longest), end)
        s = np.broadcast_to(starts, (n, len(starts)))
        ids = _probe(m, _spans(prefix, s, np.full_like(s, end)))
        value = np.where(ids >= 0, m.scores[ids], np.where(s == end - 1, lowest, -np.inf)) + best[:, starts]
        pick = value.argmax(1)
        row = np.arange(n)
        best[:, end], back[:, end], which[:, end] = value[row, pick], starts[pick], ids[row, pick]
    out = []
    for w, b, k in zip(words, back.tolist(), which.tolist(), strict=True):
        ids, end = [], length
        while end:
            ids.append([k[end]] if k[end] >= 0 else _fallback(m, w[end - 1])[::1])
            end = b[end]
        out.append(_joined(m, ids[::-1]))
    return out


def _joined(m: Pieces, parts: list[list[int]]) -> list[int]:
    """Without byte pieces, neighbouring unknown characters are one unknown piece."""
    out: list[int] = []
    for p in parts:
        if p == [m.unk] and out and out[-1] == m.unk and not m.bytes_at:
            continue
        out.extend(p)
    return out


def _at(prefix: np.ndarray, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of one substring [start, end) of each of the rows."""
    h = (prefix[rows, end] - prefix[rows, start]) * _INV[start]
    return mix64(h + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _merges(m: Pieces, words: list[str]) -> list[list[int]]:
    """Words of one length: every step merges each word's best-scored adjacent pair, the leftmost of equals.

    Symbols are linked by their starts; a step touches one symbol and its two
    neighbours of each word, besides the search for the best. Words that are done
    go once they are half of those held.
    """
    codes = _codes(words)
    n, length = codes.shape
    prefix = _prefix(codes)
    nxt = np.tile(np.arange(1, length + 1), (n, 1))
    prv = np.tile(np.arange(-1, length - 1), (n, 1))
    score = np.full((n, length), -np.inf, np.float32)
    if length > 1:
        s = np.broadcast_to(np.arange(length - 1), (n, length - 1))
        ids = _probe(m, _spans(prefix, s, s + 2))
        score[:, : length - 1] = np.where(ids >= 0, m.scores[ids], -np.inf)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    held, pre = np.arange(n), prefix

    def offer(rows, at):
        """Scores of the symbols' pairs with what follows them."""
        right = nxt[rows, at]
        ok = right < length
        rows, at, right = rows[ok], at[ok], right[ok]
        ids = _probe(m, _at(pre, rows, at, nxt[rows, right]))
        score[rows, at] = np.where(ids >= 0, m.scores[ids], -np.inf)

    while len(held):
        at = score.argmax(1)
        go = np.flatnonzero(score[np.arange(len(held)), at] > -np.inf)
        if 2 * len(go) <= len(held):
            rest = np.ones(len(held), bool)
            rest[go] = False
            done.append((held[rest], nxt[rest]))
            held, nxt, prv, score, pre, at = held[go], nxt[go], prv[go], score[go], pre[go], at[go]
            go = np.arange(len(held))
            if not len(held):
                break
            i = at
        else:
            i = at[go]
        j = nxt[go, i]
        after = nxt[go, j]
        nxt[go, i] = after
        score[go, j] = score[go, i] = -np.inf
        inner = after < length
        prv[go[inner], after[inner]] = i[inner]
        offer(go, i)
        left = prv[go, i]
        has = left >= 0
        score[go[has], left[has]] = -np.inf
        offer(go[has], left[has])
    where, links = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    # symbols of all words, one after the other; one probe for all
    starts, at = [np.zeros(len(where), np.int64)], np.zeros(len(where), np.int64)
    rows, open_ = [np.arange(len(where))], np.arange(len(where))
    while len(open_ := open_[(at := links[open_, at]) < length]):
        at = at[at < length]
        starts.append(at)
        rows.append(open_)
    r, s = np.concatenate(rows), np.concatenate(starts)
    order = np.lexsort((s, r))
    r, s = r[order], s[order]
    e = links[r, s]
    ids = _probe(m, _at(prefix, where[r], s, e))
    cuts = np.flatnonzero(np.diff(r)) + 1
    out: list = [None] * n
    whole = (ids >= 0).all()
    flat, first, last = ids.tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(ids)]
    for w, a, b in zip(where.tolist(), first, last, strict=True):
        part = flat[a:b]
        if not whole and min(part) < 0:
            part = _joined(m, [[k] if k >= 0 else _fallback(m, words[w][int(s[a + x]) : int(e[a + x])]) for x, k in enumerate(part)])
        out[w] = part
    return out


def _merge_long(m: Pieces, word: str) -> list[int]:
    """The same merges for one long word, by a heap, as batched steps would cost its length squared."""
    n = len(word)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    ids, alive, heap = m.by_piece, [True] * n, []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and (k := ids.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (-m.scores[k], i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if not alive[i] or j >= n or end[i] != mid or end[j] != stop:
            continue
        alive[j], end[i], nxt[i] = False, stop, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    out, i = [], 0
    while i < n:
        k = ids.get(word[i : end[i]])
        out.append([k] if k is not None else _fallback(m, word[i : end[i]]))
        i = nxt[i]
    return _joined(m, out)


def encode_words(m: Pieces, words: list[str]) -> dict[str, list[int]]:
    """Ids of distinct words; those of one length together, at most some 2**20 characters at once."""
    by: dict[int, list[str]] = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    out, run = {}, _viterbi if m.kind == "unigram" else _merges
    for length, same in by.items():
        if m.kind == "bpe" and length >= _LONG:
            out.update((w, _merge_long(m, w)) for w in same)
            continue
        step = max(1, (1 << 17) // length)
        for at in range(0, len(same), step):
            part = same[at : at + step]
            out.update(zip(part, run(m, part), strict=True))
    return out


def encode_packed(m: Pieces, texts: list[str | None]) -> list[bytes]:
    """Ids of whole texts as packed 32-bit integers; none for null and empty ones. Words seen before are looked up."""
    cut = [_WORDS.findall((MARK if m.dummy_prefix else "") + t.replace(" ", MARK)) if t else [] for t in texts]
    known = m.known
    fresh = {w for words in cut for w in words}.difference(known)
    got = {w: array("i", ids).tobytes() for w, ids in encode_words(m, list(fresh)).items()}
    if len(known) + len(got) > _KEEP:
        known = {w: known[w] for words in cut for w in words if w in known}
    known.update(got)
    m.known = known
    out = [b"".join(map(known.__getitem__, words)) for words in cut]
    for w in got:
        if len(w) >= _LONG:
            del known[w]
    return out


def encode_texts(m: Pieces, texts: list[str | None]) -> list[list[int]]:
    return [np.frombuffer(x, np.int32).tolist() for x in encode_packed(m, texts)]


def decode_ids(m: Pieces, ids: list[int], table: list[bytes] | None = None) -> str:
    """The text of the ids: pieces and bytes joined, marks to spaces, without the prefix's."""
    table = table or piece_bytes(m)
    text = b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if m.dummy_prefix and text.startswith(" ") else text


def piece_bytes(m: Pieces) -> list[bytes]:
    out = [p.encode() for p in m.pieces]
    for b, i in enumerate(m.bytes_at):
        out[i] = bytes([b])
    return [x if m.usable[i] or i in set(m.bytes_at) else (b" \xe2\x81\x87 " if i == m.unk else b"") for i, x in enumerate(out)]


def encode(df: DataFrame, model: Pieces, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """id, n_tokens and ids of every whole text; with ``check`` also whether the decoded ids give the text back.

    A null or empty text has no ids and comes back as an empty one. A text with
    U+2581 itself comes back with spaces there, as in the model's own library.
    Repeated rows give repeated results. Only the id and the text are read. Very
    long texts are cut into words like others; a word is as long as it is.
    """
    pieces = piece_bytes(model)

    def run(batches):
        for b in slices(batches, _ROWS):
            texts = b.column(1).to_pylist()
            packed = encode_packed(model, texts)
            n = np.fromiter((len(x) // 4 for x in packed), np.int64, len(packed))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            cols, names = [b.column(0), pa.array(n), lists], [id_col, "n_tokens", "ids"]
            if check:
                cols.append(pa.array([decode_ids(model, np.frombuffer(x, np.int32).tolist(), pieces) == (t or "") for x, t in zip(packed, texts, strict=True)], pa.bool_()))
                names.append("round_trip")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids array<int>" + (", round_trip boolean" if check else ""))


def decode(df: DataFrame, model: Pieces, id_col: str = "doc_id", ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """id and the decoded text; a null list decodes to an empty text. Ids out of the model's range are an error."""
    pieces = piece_bytes(model)

    def run(batches):
        for b in batches:
            texts = [decode_ids(model, x or [], pieces) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, out_col])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, `{out_col}` string")
