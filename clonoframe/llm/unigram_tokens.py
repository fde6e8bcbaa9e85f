"""Unigram pieces: Viterbi over a double-array trie, byte fallback, white-space markers.

The vocabulary is read from a SentencePiece model file on the driver and turned into arrays (a
trie of about one node per distinct piece prefix, bounded by the file) that are broadcast. Texts
are encoded whole where they lie, without a shuffle. No piece crosses from a word into the next
one, so a text splits into chunks at spaces and line ends whose best segmentations are
independent; distinct chunks of a batch are segmented together, one trie step for all of them
at a time, and remembered in a bounded cache.

The model file holds merge ranks. As log scores of a unigram model they are taken by Zipf's law:
the piece of rank r has probability proportional to 1 / (r + 1).

A marker stands for a space, one is put before the text and taken off on decoding. Characters
without a piece, and a marker character in the text itself, become byte pieces, so decoding
gives back every text.

Defined cases: null text encodes as empty text, which has no pieces and decodes to the empty
text; among segmentations of equal score the one whose last pieces are longest wins; repeated
rows get equal ids; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonoframe.llm.hashing import chunks

MARK = "▁"
#: Chunks longer than this many bytes are segmented one by one.
LONG = 192
#: Chunks remembered per worker, and lanes segmented together.
CACHE, LANES = 120_000, 8192
#: Taken off the lowest score for every byte piece.
FALLBACK = 10.0

_CHUNK = re.compile(f" +[^ \n{MARK}]*|[\n{MARK}]|[^ \n{MARK}]+")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Trie:
    """Double-array trie of byte strings: child of s by byte c is base[s] + c if check holds s."""

    def __init__(self, keys: Sequence[bytes]) -> None:
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = 4 * sum(map(len, keys)) + 1024
        base, check = [0] * size, [-1] * size
        value = [-1] * size
        check[0] = 0
        free = top = 257  # lower slots would need a base below 1
        stack = [(0, 0, len(order), 0)]
        while stack:
            node, low, high, depth = stack.pop()
            children: list[tuple[int, int, int]] = []
            i = low
            while i < high:
                key = keys[order[i]]
                if len(key) == depth:
                    value[node] = order[i]
                    i += 1
                    continue
                j = i
                while j < high and keys[order[j]][depth] == key[depth]:
                    j += 1
                children.append((key[depth], i, j))
                i = j
            if not children:
                continue
            while check[free] >= 0:
                free += 1
            # one child fills the first hole; more are placed near the end, where room is found fast
            at = free if len(children) == 1 else max(free, top - 256)
            while True:
                shift = at - children[0][0]
                if shift > 0 and all(check[shift + c] < 0 for c, _, _ in children):
                    break
                at += 1
            base[node] = shift
            for c, _, _ in children:
                check[shift + c] = node
            top = max(top, shift + children[-1][0])
            for c, i, j in children:
                stack.append((shift + c, i, j, depth + 1))
        used = max(k for k in range(size) if check[k] >= 0) + 257
        self.base = np.array(base[:used], np.int32)
        self.check = np.array(check[:used], np.int32)
        self.value = np.array(value[:used], np.int32)


class Vocabulary:
    """Pieces with log scores as arrays; what tasks need to encode and decode."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_id = np.zeros(256, np.int32)
        self.spelling = [b""] * size  # what each id decodes to
        ids, keys, ranks = [], [], []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte = int(piece[3:5], 16)
                self.bytes_id[byte] = i
                self.spelling[i] = bytes([byte])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    raise ValueError(f"piece {i} crosses words; chunks would not be independent")
                self.spelling[i] = piece.replace(MARK, " ").encode()
                ids.append(i)
                keys.append(piece.encode())
                ranks.append(-model.get_score(i))
        self.ids = np.array(ids, np.int32)
        weight = -np.log(np.array(ranks) + 1.0)
        self.scores = weight - np.log(np.exp(weight).sum())
        self.fallback = float(self.scores.min()) - FALLBACK
        self.trie = Trie(keys)
        self.known: dict[str, bytes] = {}  # chunks met in this process, bounded by CACHE


def _width(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


_WIDTH = np.array([_width(b) for b in range(256)])


def _bytes_of(raw: bytes, start: int, end: int, vocab: Vocabulary) -> list[int]:
    return [int(vocab.bytes_id[b]) for b in raw[start:end]]


def _trace(raw: bytes, came: Sequence[int], by: Sequence[int], vocab: Vocabulary) -> bytes:
    """Ids along the best path, from where each position came and by which piece (-1: bytes)."""
    at, out = len(raw), []
    while at > 0:
        start = int(came[at])
        if by[at] >= 0:
            out.append(int(vocab.ids[by[at]]))
        else:
            out.extend(reversed(_bytes_of(raw, start, at, vocab)))
        at = start
    return np.array(out[::-1], np.int32).tobytes()


def _segment_long(raw: bytes, vocab: Vocabulary) -> bytes:
    """Viterbi of one chunk, byte position by byte position."""
    base, check, value = vocab.trie.base, vocab.trie.check, vocab.trie.value
    n = len(raw)
    best, came, by = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        here = best[i]
        if here == -np.inf:
            continue
        node = 0
        for j in range(i, n):
            step = int(base[node]) + raw[j]
            if check[step] != node:
                break
            node = step
            piece = value[node]
            if piece >= 0 and (score := here + vocab.scores[piece]) > best[j + 1]:
                best[j + 1], came[j + 1], by[j + 1] = score, i, int(piece)
        end = min(n, i + _width(raw[i]))
        if (score := here + (end - i) * vocab.fallback) > best[end]:
            best[end], came[end], by[end] = score, i, -1
    return _trace(raw, came, by, vocab)


def _segment_lanes(raws: Sequence[bytes], vocab: Vocabulary) -> list[bytes]:
    """Viterbi of many chunks in step: one array operation moves all of them one byte on."""
    base, check, value = vocab.trie.base, vocab.trie.check, vocab.trie.value
    size = np.array([len(r) for r in raws])
    width = int(size.max())
    data = np.zeros((len(raws), width), np.uint8)
    data[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(raws), np.uint8)
    best = np.full((len(raws), width + 4), -np.inf)
    came = np.zeros((len(raws), width + 4), np.int32)
    by = np.full((len(raws), width + 4), -1, np.int32)
    best[:, 0] = 0
    for i in range(width):
        start = np.flatnonzero((size > i) & (best[:, i] > -np.inf))
        here = best[start, i]
        lane, score, node = start, here, np.zeros(len(start), np.int32)
        for j in range(i, width):
            inside = size[lane] > j
            step = base[node] + data[lane, j]
            inside &= check[step] == node
            lane, score, node = lane[inside], score[inside], step[inside]
            if not len(lane):
                break
            piece = value[node]
            gain = score + vocab.scores[piece]  # piece -1 reads some score, masked below
            won = (piece >= 0) & (gain > best[lane, j + 1])
            hit = lane[won]
            best[hit, j + 1], came[hit, j + 1], by[hit, j + 1] = gain[won], i, piece[won]
        end = np.minimum(size[start], i + _WIDTH[data[start, i]])
        gain = here + (end - i) * vocab.fallback
        won = gain > best[start, end]
        hit, end = start[won], end[won]
        best[hit, end], came[hit, end], by[hit, end] = gain[won], i, -1
    # walk all lanes back together
    at, parts = size.copy(), [[] for _ in raws]
    while len(open_lanes := np.flatnonzero(at > 0)):
        ends = at[open_lanes]
        froms, pieces = came[open_lanes, ends], by[open_lanes, ends]
        for lane, a, b, piece in zip(
            open_lanes.tolist(), froms.tolist(), ends.tolist(), pieces.tolist(), strict=True
        ):
            if piece >= 0:
                parts[lane].append(int(vocab.ids[piece]))
            else:
                parts[lane].extend(reversed(_bytes_of(raws[lane], a, b, vocab)))
        at[open_lanes] = froms
    return [np.array(p[::-1], np.int32).tobytes() for p in parts]


def segment(pieces: Sequence[str], vocab: Vocabulary) -> dict[str, bytes]:
    """Ids (int32 bytes) of distinct chunks."""
    out: dict[str, bytes] = {}
    short: list[tuple[str, bytes]] = []
    for chunk in pieces:
        if chunk == MARK:
            raw = MARK.encode()
            out[chunk] = np.array(_bytes_of(raw, 0, 3, vocab), np.int32).tobytes()
            continue
        raw = chunk.replace(" ", MARK).encode("utf-8", "surrogatepass")
        if len(raw) > LONG:
            out[chunk] = _segment_long(raw, vocab)
        else:
            short.append((chunk, raw))
    short.sort(key=lambda x: len(x[1]))
    for a in range(0, len(short), LANES):
        part = short[a : a + LANES]
        for (chunk, _), ids in zip(part, _segment_lanes([r for _, r in part], vocab), strict=True):
            out[chunk] = ids
    return out


def encode(texts: Sequence[str | None], vocab: Vocabulary) -> list[np.ndarray]:
    """Ids of whole texts."""
    known, out = vocab.known, []
    for a, b in chunks(texts):
        split = [_CHUNK.findall(f" {t}") if t else [] for t in texts[a:b]]
        if len(known) > CACHE:
            known.clear()
        fresh = set().union(*split).difference(known) if split else set()
        if fresh:
            known.update(segment(list(fresh), vocab))
        out += [np.frombuffer(b"".join(map(known.__getitem__, s)), np.int32) for s in split]
    return out


def decode(ids: Sequence[np.ndarray], vocab: Vocabulary) -> list[str]:
    """Texts of id sequences: markers become spaces, byte pieces join, the first space goes."""
    table = vocab.spelling
    raw = (b"".join(map(table.__getitem__, np.asarray(i).tolist())) for i in ids)
    return [r[1:].decode("utf-8", "surrogatepass") if r[:1] == b" " else r.decode("utf-8", "replace") for r in raw]


def vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast[Vocabulary]:
    """The vocabulary of a model file, broadcast: bounded by the file, about 3 MB here."""
    return spark.sparkContext.broadcast(Vocabulary(path or model_path()))


def decoder(vocab: Broadcast[Vocabulary]):
    """Column function: array<int> to text; null ids give null."""

    def run(ids: pd.Series) -> pd.Series:
        got = [i for i in ids if i is not None]
        texts = iter(decode(got, vocab.value))
        return pd.Series([None if i is None else next(texts) for i in ids], dtype=object)

    return F.pandas_udf(run, "string")


def encoded(docs: DataFrame, vocab: Broadcast[Vocabulary], text: str = "text") -> DataFrame:
    """Add ``ids`` (array<int>, replacing a column of that name); other columns pass as they are.

    Arrow batches are cut into slices of bounded text, so a task holds the ids of one slice.
    """
    rows = docs.select(*[c for c in docs.columns if c != "ids"])
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for a, b in chunks(texts):
                ids = encode(texts[a:b], vocab.value)
                ends = np.cumsum([0, *map(len, ids)])
                column = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32())
                )
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, column], names=[*part.schema.names, "ids"]
                )

    return rows.mapInArrow(run, schema)
