"""Token ids in files of canonical, length-limited Huffman codes.

1. Every whole text is tokenised once; ids go, as bytes, to the range of its document id and are
   staged there in ascending order (one shuffle of token bytes; nothing is sampled by running
   the tokeniser twice, the range bounds come from the ids alone).
2. Counts of all ids, summed in each task before the shuffle, give at most one row per id of the
   vocabulary. The driver makes code lengths by package-merge (optimal under the length limit);
   lengths alone define the canonical code.
3. Each range is written as blocks of whole documents. A block is decodable by itself: it holds
   its documents' ids and lengths, the bit stream, and the bit offset of every ``INTERVAL``-th
   id. Blocks are rows of Parquet files in ``<path>/blocks``, the code is ``<path>/code``.
4. Reading looks up ``LIMIT`` bits at a time in a table; all checkpoints of a block are decoded
   in step.

Defined cases: null text is an empty text, which holds the end id only; documents of equal id are
ordered by their ids' bytes; repeated rows are written as often as they come; a null doc_id comes
first; other columns are not stored; an empty table gives files without blocks and no rows; a very
long document makes a block of its own.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoframe.llm.hashing import chunks
from clonoframe.llm.shared import (
    freed_id,
    held_id,
    id_ranges,
    shuffle_partitions,
    staged,
    write,
)

LIMIT = 18  # longest code in bits; more where the vocabulary needs it
INTERVAL = 128  # ids between checkpoints
BLOCK = 1 << 17  # ids in a block, at least, but for the last
#: Characters encoded together; words and runs of words remembered per worker.
CHUNK, WORD_CACHE, RUN_CACHE = 1 << 23, 100_000, 500_000


def tokenizer_file(name: str = "word_bpe_49k.json") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


#: Where words of Latin letters may be cut: contractions, runs of letters, digits, other runs.
RUN = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:\W|_)+")
#: The same cuts for Arrow's engine, in words of the characters PLAIN allows.
_LETTER = r"A-Za-z\x{AA}\x{B2}\x{B3}\x{B5}\x{B9}\x{BA}\x{BC}-\x{BE}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"
CUT = rf"('(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9]+)"
PLAIN = r"^[\x21-\x7E\x{A1}-\x{AC}\x{AE}-\x{12F}\x{131}-\x{24F}]*$"
#: Runs encoded in one go, a space between them.
TOGETHER = 512
_PROBE = "It's  a\n\nProbe,\n 2 words' ends!' Été"


class WordTokenizer:
    """Encodes texts with a tokenizers model, remembering words and runs inside words.

    Holds for models whose pieces never span a space or line end and that drop both; then a
    text's ids are its words' ids one after the other. Models that also ignore case and split
    words as ``RUN`` does, marking the last piece of a run, need far fewer distinct strings: distinct
    words of Latin characters alone (``PLAIN``; characters beyond may combine with those before them)
    are cut into runs by Arrow, and new runs are encoded many at a time. Each property is checked on
    a probe.
    """

    def __init__(self, definition: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_buffer(definition)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        #: Runs met, by number; a run's ids lie between its place in ``begin`` and the next.
        self.runs: dict[str, int] = {}
        self.ids, self.begin = np.empty(0, np.uint32), np.zeros(1, np.int64)
        whole = self._ids(_PROBE)
        if [i for w in _PROBE.split() for i in self._ids(w)] != whole:
            raise ValueError("this tokenizer's pieces depend on the space between words")
        self.any_case = self._ids(_PROBE.lower()) == whole
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        vocabulary = self.model.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        runs = [self._ids(r) for w in _PROBE.split() for r in RUN.findall(w)]
        by_runs = [i for r in runs for i in r] == whole
        self.by_runs = by_runs and all(self.last[r].nonzero()[0].tolist() == [len(r) - 1] for r in runs)

    def _ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _lowered(self, texts: pa.Array) -> pa.Array:
        """A-Z in lower case, but for texts where that would make a special token."""
        low = pc.ascii_lower(texts)
        for token in self.special:
            low = pc.if_else(pc.match_substring(low, token.lower()), texts, low)
        return low

    def _encoded(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs without white space, and where each run's ids end: many in one text, told apart
        by the ids that end a run. Without empty runs each has such an id, so equal numbers are the same runs."""
        groups = [runs[i : i + TOGETHER] for i in range(0, len(runs), TOGETHER)]
        got = self.model.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        parts, sizes = [], []
        for group, one in zip(groups, got, strict=True):
            ids = np.array(one.ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            size = np.diff(ends, prepend=0)
            if len(ends) != len(group) or "" in group:  # a run that the model cuts again, or an empty one
                alone = list(map(self._ids, group))
                ids, size = np.array([i for a in alone for i in a], np.uint32), np.array(list(map(len, alone)))
            parts.append(ids)
            sizes.append(size)
        return np.concatenate(parts), np.cumsum(np.concatenate(sizes))

    def _of_runs(self, runs: list[str]) -> np.ndarray:
        """Numbers of distinct plain runs in the cache; only those never met are encoded."""
        at = np.fromiter(map(self.runs.get, runs, repeat(-1)), np.int64, len(runs))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            if len(self.runs) > RUN_CACHE:  # the runs of this chunk stay
                met = np.flatnonzero(at >= 0)
                self.ids, ends = _taken(self.ids, self.begin[at[met]], np.diff(self.begin)[at[met]], np.arange(len(met) + 1))
                self.begin, at[met] = ends, np.arange(len(met))
                self.runs = {runs[i]: n for n, i in enumerate(met.tolist())}
            fresh = [runs[i] for i in missing]
            ids, ends = self._encoded(fresh)
            numbers = range(len(self.runs), len(self.runs) + len(fresh))
            at[missing] = numbers
            self.runs.update(zip(fresh, numbers, strict=True))
            self.begin = np.concatenate([self.begin, ends + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
        return at

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Id bytes of distinct words of any kind; only those never met are encoded."""
        ids = list(map(self.words.get, words))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            if len(self.words) > WORD_CACHE:
                self.words.clear()
            fresh = [words[i] for i in missing]
            got = self.model.encode_batch_fast(fresh, add_special_tokens=False)
            for i, word, one in zip(missing, fresh, got, strict=True):
                ids[i] = self.words[word] = array("I", one.ids).tobytes()
        return ids

    def _plain(self, words: pa.Array) -> pa.Array:
        plain = pc.match_substring_regex(words, PLAIN)
        for token in self.special:
            plain = pc.and_not(plain, pc.match_substring(words, token, ignore_case=True))
        return plain

    def _pool(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: one array, and where in it each word begins and how many it has."""
        plain = self._plain(words) if self.by_runs else pa.array(np.zeros(len(words), bool))
        mask = plain.to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.replace_substring_regex(words.filter(plain), CUT, r"\1 "), " ")
        coded = cut.flatten().dictionary_encode()
        at = self._of_runs(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        first, ends = _taken(self.ids, self.begin[at], self.begin[at + 1] - self.begin[at], cut.offsets.to_numpy())
        rest = self._of_words(words.filter(pc.invert(plain)).to_pylist())
        size, begin = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        size[mask], begin[mask] = np.diff(ends), ends[:-1]
        size[~mask] = np.fromiter(map(len, rest), np.int64, len(rest)) // 4
        begin[~mask] = len(first) + np.cumsum(size[~mask]) - size[~mask]
        return np.concatenate([first, np.frombuffer(b"".join(rest), "<u4")]), begin, size

    def encode(self, texts: Sequence[str | None], end_id: int | None = None) -> list[np.ndarray]:
        """Ids (uint32) of whole texts, each followed by ``end_id`` if there is one."""
        out: list[np.ndarray] = []
        collect = gc.isenabled()
        gc.disable()  # the many small lists below hold no cycles
        try:
            for a, b in chunks(texts, CHUNK):
                column = pa.array([t or "" for t in texts[a:b]], pa.large_string())
                column = self._lowered(column) if self.any_case else column
                split = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
                coded = split.flatten().dictionary_encode()
                pool, begin, size = self._pool(coded.dictionary)
                at = coded.indices.to_numpy()
                flat, ends = _taken(pool, begin[at], size[at], split.offsets.to_numpy())
                if end_id is not None:
                    flat = np.insert(flat, ends[1:], np.uint32(end_id))
                    ends = ends + np.arange(len(ends))
                out += np.split(flat, ends[1:-1])
        finally:
            if collect:
                gc.enable()
        return out


def _taken(pool: np.ndarray, begin: np.ndarray, size: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of a pool one after the other, and the ends of every list of them."""
    ends = np.concatenate(([0], np.cumsum(size)))
    take = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)
    return pool[take], ends[offsets - offsets[0]]


_tokenizers: dict[int, WordTokenizer] = {}


def _tokenizer(definition: Broadcast[bytes]) -> WordTokenizer:
    """One tokenizer per process and definition."""
    key = hash(definition.value)
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = WordTokenizer(definition.value)
    return _tokenizers[key]


def _forget() -> None:
    """Drop the caches of a worker that tokenised before; later steps have no use for them."""
    if _tokenizers:
        _tokenizers.clear()
        pa.default_memory_pool().release_unused()


@lru_cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """Set up once a process."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(ids: np.ndarray) -> bytes:
    """Compressed ids, after the number of bytes each takes: 2 if all fit, else 4."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + _zstd()[0].compress(ids.astype(f"<u{width}"))


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(_zstd()[1].decompress(memoryview(data)[1:]), f"<u{data[0]}").astype(np.uint32)


def tokenized(docs: DataFrame, definition: bytes, end_id: int) -> DataFrame:
    """(doc_id, n, ids): packed ids of each whole text with the end id; null doc_ids held."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(shared)
        for batch in batches:
            doc_ids, texts = batch["doc_id"].to_numpy(), batch["text"].tolist()
            for a, b in chunks(texts, CHUNK):
                ids = tokenizer.encode(texts[a:b], end_id)
                yield pd.DataFrame(
                    {"doc_id": doc_ids[a:b], "n": [len(i) for i in ids], "ids": list(map(_pack, ids))}
                )

    rows = docs.select(held_id().alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id long, n long, ids binary")


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Running count of ids over a task's rows; a task holds one shard."""
    _forget()
    shard, start = None, 0
    for batch in batches:
        starts = []
        for own, n in zip(batch["shard"].tolist(), batch["n"].tolist(), strict=True):
            if own != shard:
                shard, start = own, 0
            starts.append(start)
            start += n
        yield batch.assign(start=starts)


def in_order(tokens: DataFrame, parts: int, ranges: Column) -> DataFrame:
    """Staged (shard, start, doc_id, n, ids): shards are ascending id ranges, sorted inside."""
    dealt = tokens.withColumn("shard", ranges).repartitionById(parts, F.col("shard"))
    rows = dealt.sortWithinPartitions("shard", "doc_id", "ids")
    return staged(rows.mapInPandas(_numbered, "doc_id long, n long, ids binary, shard int, start long"))


def counted(tokens: DataFrame) -> dict[int, int]:
    """Count of every id met: at most one entry per id of the vocabulary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _forget()
        total, held, size = np.zeros(0, np.int64), [], 0

        def add() -> None:
            nonlocal total, held, size
            own = np.bincount(np.concatenate([np.empty(0, np.uint32), *held]), minlength=len(total))
            own[: len(total)] += total
            total, held, size = own, [], 0

        for batch in batches:
            for data in batch["ids"]:
                held.append(_unpack(data))
                size += len(held[-1])
                if size >= 1 << 20:  # a table of the vocabulary is filled once for many documents
                    add()
        add()
        some = np.flatnonzero(total)
        yield pd.DataFrame({"id": some, "n": total[some]})

    sums = tokens.select("ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in sums.collect()}


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Optimal code lengths of at most ``limit`` bits, by package-merge.

    The list of each level holds the symbols' weights and the pairs of the list below, sorted;
    taking the 2n - 2 cheapest on top, a symbol's length is the number of levels where it is in.
    """
    symbols = sorted(counts, key=lambda s: (counts[s], s))
    n = len(symbols)
    if n < 2:
        return {s: 1 for s in symbols}
    limit = max(limit, (n - 1).bit_length())
    weights = np.array([counts[s] for s in symbols], np.int64)
    levels, below = [], np.empty(0, np.int64)
    for _ in range(limit):
        pairs = below[: len(below) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weights, pairs))
        order = np.argsort(both, kind="stable")
        levels.append(order < n)  # which entries are symbols
        below = both[order]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_symbol in reversed(levels):
        own = int(is_symbol[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    return {s: int(k) for s, k in zip(symbols, lengths, strict=True)}


class Code:
    """The canonical code of given lengths: codes for writing, a lookup table for reading."""

    def __init__(self, lengths: dict[int, int]) -> None:
        order = sorted(lengths, key=lambda s: (lengths[s], s))
        self.bits = max(lengths.values(), default=1)
        size = max(order, default=0) + 1
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        #: By the next ``bits`` bits, the symbol times 64 and its length.
        self.entry_at = np.zeros(1 << self.bits, np.uint32 if size < 1 << 26 else np.int64)
        code = last = 0
        for symbol in order:
            length = lengths[symbol]
            code <<= length - last
            last = length
            self.code[symbol], self.length[symbol] = code, length
            span = self.bits - length
            self.entry_at[code << span : (code + 1) << span] = symbol << 6 | length
            code += 1

    def write(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bit stream (most significant bit first) and bit offsets of every INTERVAL-th id."""
        length = self.length[ids]
        ends = np.cumsum(length)
        starts = ends - length
        word, inside = starts >> 5, starts & 31
        value = self.code[ids] << (64 - inside - length).astype(np.uint64)
        size = (int(ends[-1]) >> 5) + 2 if len(ids) else 1
        # codes share no bits, so sums of 32-bit halves are exact in floating point
        total = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), size)
        total += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
        stream = total.astype(np.uint32).astype(">u4").tobytes()
        return stream[: (int(ends[-1]) + 7) // 8 if len(ids) else 0], starts[::INTERVAL]

    def read(self, stream: bytes, marks: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a stream; all intervals advance together, one id per step."""
        raw = np.frombuffer(stream + b"\0" * 8, np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        out = np.zeros((INTERVAL, len(marks)), self.entry_at.dtype)
        at = marks.astype(np.int64)
        for k in range(min(n, INTERVAL)):
            if k == (n - 1) % INTERVAL + 1:  # the last interval is over
                at = at[:-1]
            bits = (window[at >> 3] >> (32 - self.bits - (at & 7)).astype(np.uint32)) & np.uint32(
                (1 << self.bits) - 1
            )
            found = self.entry_at[bits]
            out[k, : len(at)] = found
            at = at + (found & 63)
        return (out.T.ravel()[:n] >> 6).astype(np.uint32)


BLOCKS = (
    "shard int, start long, doc_ids array<long>, sizes array<long>, marks array<long>,"
    " stream binary"
)


def _writer(code: Broadcast[Code]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Blocks of documents that follow each other in one shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _forget()
        at, doc_ids, held, size = (-1, 0), [], [], 0

        def full() -> pd.DataFrame:
            stream, marks = code.value.write(np.concatenate(held))
            return pd.DataFrame(
                {"shard": [at[0]], "start": [at[1]], "doc_ids": [doc_ids],
                 "sizes": [[len(h) for h in held]], "marks": [marks], "stream": [stream]}
            )

        for batch in batches:
            for row in batch.itertuples(index=False):
                if held and ((row.shard, row.start) != (at[0], at[1] + size) or size >= BLOCK):
                    yield full()
                    held = []
                if not held:
                    at, doc_ids, size = (row.shard, row.start), [], 0
                doc_ids.append(row.doc_id)
                held.append(_unpack(row.ids))
                size += len(held[-1])
        if held:
            yield full()

    return run


def write_files(docs: DataFrame, path: str, definition: bytes, end_id: int) -> None:
    """Tokenise, count, and write the files of ``docs`` (doc_id, text) below ``path``."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    ranges = id_ranges(docs.select(held_id().alias("doc_id")), parts)
    tokens = in_order(tokenized(docs, definition, end_id), parts, ranges)
    lengths = code_lengths(counted(tokens))
    table = spark.createDataFrame(sorted(lengths.items()), "id long, length int")
    write(table.coalesce(1), f"{path}/code")
    code = spark.sparkContext.broadcast(Code(lengths))
    write(tokens.mapInPandas(_writer(code), BLOCKS), f"{path}/blocks")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document read back from the files.

    ``start`` counts the ids before a document: a block knows its place in its shard, and the
    totals of the shards, as many as shuffle partitions when the files were written, are summed.
    """
    lengths = {r["id"]: r["length"] for r in spark.read.parquet(f"{path}/code").collect()}
    code = spark.sparkContext.broadcast(Code(lengths))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = blocks.groupBy("shard").agg(F.sum(size).alias("n")).orderBy("shard").collect()
    begins, before = {}, 0
    for row in totals:
        begins[row["shard"]] = before
        before += row["n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _forget()
        for batch in batches:
            for row in batch.itertuples(index=False):
                sizes = np.asarray(row.sizes)
                ids = code.value.read(row.stream, np.asarray(row.marks), int(sizes.sum()))
                ends = np.cumsum(sizes)
                yield pd.DataFrame(
                    {"doc_id": np.asarray(row.doc_ids),
                     "start": begins[row.shard] + row.start + ends - sizes, "n_tokens": sizes,
                     "ids": [p.astype("<u4").tobytes() for p in np.split(ids, ends[:-1])]}
                )

    rows = blocks.mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")
    return rows.withColumn("doc_id", freed_id())
