"""Token ids in grammar-compressed shard files, with random access.

Documents are dealt to ranges of ascending id; each range becomes a row of
shards. A shard's ids are compressed by Re-Pair: pairs of neighbouring ids get
nonterminals, the most frequent first, and their occurrences, left to right and
never across a document's end, are replaced, until no pair occurs ``LEAST_COUNT``
times. A round takes all pairs that occur at least a ``CLASS``-th as often as the
most frequent one, so there are few rounds however many rules. A shard stores its
rules, each symbol's expansion length, and where each document starts among the
symbols, so one document, or a stretch of its ids, is decoded without the rest.

The files are Parquet; a row holds one shard: ``range``, ``shard`` (its place in
the range), ``first_doc``, ``before`` (the ids of the range's shards before it),
``n_ids`` and the blobs ``docs``, ``rules`` and ``symbols`` (see ``pack``). ``read`` gives the ids per document with ``start``,
the number of ids of all documents before it.

Defined results: a null or empty text has the end id alone; repeated ids keep
all their rows, ordered by their texts' hashes among themselves; an empty table makes no
shards. A shard ends after the document that brings it to ``SHARD_IDS`` ids.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import fresh_path, materialize, read_table, ship

END_ID = 0
#: Fixed value: the pattern by which byte-level pre-tokenisation splits a text, for the characters that ``odd`` lets pass.
PATTERN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s0-9A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+|\s+(?!\S)|\s+")
SHARD_IDS = 1_000_000
#: A rule takes 8 bytes of a shard (its pair and its length) and each use spares 2 or more, so much fewer uses don't pay.
LEAST_COUNT = 8
CLASS = 8
CHUNK_CHARS = 1_000_000
BROADCAST_RANGES = 1_000_000
#: Words whose ids a Python worker remembers, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 500_000, 64
#: What ``odd`` lets pass: line ends, printable ASCII, and the UTF-8 bytes of characters from U+00C0 to U+024F.
_PLAIN = bytes([10, *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xCA)])


def odd(text: str) -> bool:
    """Whether a text has characters on whose class Python's and the library's Unicode versions might differ."""
    return bool(text.encode("utf-8", "replace").translate(None, _PLAIN))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder(dict):
    """Ids as the tokenizers library gives them.

    A text of plain characters is cut into words by the vocabulary's own pattern, and the library's model is asked
    once for each distinct word; any other text, and one with a special token's string, goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.char_of = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}

    def __missing__(self, word: str) -> bytes:
        spelled = word.encode().decode("latin-1").translate(self.char_of)
        ids = b"".join([self.bytes_of[t.id] for t in self.model.tokenize(spelled)])
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = lambda t: not odd(t) and not any(s in t for s in self.special)
        words = lambda t: np.frombuffer(b"".join(map(self.__getitem__, PATTERN.findall(t))), np.int32)
        return [words(t) if plain(t) else np.array(self.library.encode(t, add_special_tokens=False).ids, np.int32) for t in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def compress(ids: np.ndarray, last: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (symbols, rules as pairs, for each symbol whether it ends a document). ``last`` marks documents' ends."""
    symbols, last, rules, base = ids.astype(np.uint32), last.copy(), [], first_rule
    mark = np.zeros(1 << 20, bool)
    while len(symbols) > 1:
        # a pair as one number: of 32 bits as long as all symbols take 16
        bits, code_type, factor, top = (16, np.uint32, 0x9E3779B1, 12) if base <= 65536 else (32, np.uint64, 0x9E3779B97F4A7C15, 44)
        h = lambda x: (x * code_type(factor)) >> code_type(top)  # noqa: B023, E731
        code = (symbols[:-1].astype(code_type) << code_type(bits)) | symbols[1:]
        inside = code[~last[:-1]]
        if not len(inside):
            break
        inside.sort()
        edge = np.r_[0, np.flatnonzero(inside[1:] != inside[:-1]) + 1, len(inside)]
        count = np.diff(edge)
        most = int(count.max())
        if most < LEAST_COUNT:
            break
        pairs = inside[edge[np.flatnonzero(count >= max(LEAST_COUNT, -(-most // CLASS)))]]
        mark[h(pairs)] = True
        at = np.flatnonzero(mark[h(code)] & ~last[:-1])  # a hashed mark spares most searches
        mark[h(pairs)] = False
        number = np.searchsorted(pairs, code[at])
        number[number == len(pairs)] = 0
        hit = pairs[number] == code[at]
        at, number = at[hit], number[hit]
        run = np.flatnonzero(np.r_[True, np.diff(at) != 1])  # overlapping occurrences: every other one, from the left
        odd_ones = (np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0
        at, number = at[odd_ones], number[odd_ones]
        used = np.zeros(len(pairs), bool)  # pairs that overlap others may have no occurrence left, and get no rule
        used[number] = True
        number, pairs = (np.cumsum(used) - 1)[number], pairs[used]
        rules.append(np.stack([pairs >> code_type(bits), pairs & code_type((1 << bits) - 1)], axis=1).astype(np.uint32))
        symbols[at] = (base + number).astype(np.uint32)
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, last, base = symbols[keep], last[keep], base + len(pairs)
    return symbols, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), last


def expansions(rules: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, starts, ids): what every symbol stands for. Rules refer to earlier symbols; those whose parts are known go together."""
    length, start, flat = np.ones(first_rule, np.int64), np.arange(first_rule), np.arange(first_rule)
    done = 0
    while done < len(rules):
        parts = rules[done:].astype(np.int64)
        late = np.flatnonzero((parts >= first_rule + done).any(axis=1))
        parts = parts[: late[0] if len(late) else len(parts)].ravel()
        ids = _open(parts, length, start, flat)
        own = length[parts].reshape(-1, 2).sum(axis=1)
        start = np.r_[start, len(flat) + np.r_[0, np.cumsum(own)[:-1]]]
        length, flat = np.r_[length, own], np.r_[flat, ids]
        done += len(parts) // 2
    return length, start, flat


def _open(symbols: np.ndarray, length: np.ndarray, start: np.ndarray, flat: np.ndarray) -> np.ndarray:
    n = length[symbols]
    return flat[np.repeat(start[symbols] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))]


def _kind(symbols: int) -> str:
    return "<u2" if symbols <= 65536 else "<u4"


def pack(docs: list[int | None], sizes: list[int], ids: np.ndarray, first_rule: int) -> dict[str, bytes]:
    """docs: per document its id (int64), id count and symbol count (int64 each), null flag (1 byte); rules: their number (uint32),
    pairs, then uint32 expansion lengths; symbols. Pairs and symbols are uint16, or uint32 where the shard has more of them. All little-endian."""
    last = np.zeros(len(ids), bool)
    last[np.cumsum(sizes) - 1] = True
    symbols, rules, last = compress(ids, last, first_rule)
    ends = np.flatnonzero(last) + 1
    table = np.stack([np.array([d or 0 for d in docs], np.int64), np.array(sizes, np.int64), np.diff(np.r_[0, ends])], axis=1)
    lengths = expansions(rules, first_rule)[0][first_rule:]
    kind = _kind(first_rule + len(rules))
    return {
        "docs": table.astype("<i8").tobytes() + bytes(d is None for d in docs),
        "rules": len(rules).to_bytes(4, "little") + rules.astype(kind).tobytes() + lengths.astype("<u4").tobytes(),
        "symbols": symbols.astype(kind).tobytes(),
    }


class Shard:
    """One shard's blobs, opened for reading."""

    def __init__(self, docs: bytes, rules: bytes, symbols: bytes, first_rule: int) -> None:
        n, count = len(docs) // 25, int.from_bytes(rules[:4], "little")
        self.table = np.frombuffer(docs[: 24 * n], "<i8").reshape(n, 3)
        self.ids = [None if null else int(d) for d, null in zip(self.table[:, 0], docs[24 * n :])]
        kind = _kind(first_rule + count)
        pairs = np.frombuffer(rules, kind, 2 * count, 4).reshape(-1, 2).astype(np.int64)
        self.symbols = np.frombuffer(symbols, kind).astype(np.int64)
        self.bounds = np.r_[0, np.cumsum(self.table[:, 2])]
        self.length, self.start, self.flat = expansions(pairs, first_rule)

    def document(self, k: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids ``begin`` to ``end`` of the k-th document; expansion lengths tell which symbols to open."""
        own = self.symbols[self.bounds[k] : self.bounds[k + 1]]
        n = self.length[own]
        upto = np.cumsum(n)
        end = int(upto[-1]) if end is None else min(end, int(upto[-1]))
        a, b = np.searchsorted(upto, begin, side="right"), np.searchsorted(upto, end, side="left") + 1
        own, n, before = own[a:b], n[a:b], int(upto[a - 1]) if a else 0
        return _open(own, self.length, self.start, self.flat)[begin - before : end - before]

    def all_ids(self) -> np.ndarray:
        return _open(self.symbols, self.length, self.start, self.flat)


def _write(path: str, first_rule: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    docs: list[int | None] = []
    pieces: list[np.ndarray] = []
    total = before = 0

    def shard() -> pa.RecordBatch:
        blobs = pack(docs, [len(x) for x in pieces], np.concatenate(pieces), first_rule)
        row = {"range": pa.array([part], pa.int32()), "shard": pa.array([number], pa.int32()), "first_doc": pa.array([docs[0]], pa.int64()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([total], pa.int64())}
        return pa.RecordBatch.from_pydict(row | {k: pa.array([v], pa.binary()) for k, v in blobs.items()})

    for batch in batches:
        ids = batch.column(0).to_pylist()
        texts = batch.column(1).to_pylist()
        sizes = [len(x) if x else 0 for x in texts]
        at = 0
        while at < len(ids):
            upto, chars = at, 0
            while upto < len(ids) and (upto == at or chars + sizes[upto] <= CHUNK_CHARS):
                chars += sizes[upto]
                upto += 1
            for d, x in zip(ids[at:upto], encoder(path).encode([t or "" for t in texts[at:upto]])):
                docs.append(d)
                pieces.append(np.append(x, np.int32(END_ID)))
                total += len(x) + 1
                if total >= SHARD_IDS:
                    yield shard()
                    before += total
                    docs, pieces, total, number = [], [], 0, number + 1
            at = upto
    if docs:
        yield shard()


SCHEMA = "range int, shard int, first_doc long, before long, n_ids long, docs binary, rules binary, symbols binary"


def vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def write(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", tokenizer: str | None = None) -> None:
    """Encode ``text`` and write the shards of all rows, in ascending ``key`` order, to ``path``."""
    ship(df.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    # the text's hash comes after the key, so that rows of one id (or of none) may fall to several ranges
    dealt = df.select(F.col(key).alias("k"), F.col(text).alias("t")).repartitionByRange(ranges, F.col("k").asc_nulls_first(), F.xxhash64("t"))
    dealt = dealt.sortWithinPartitions(F.col("k").asc_nulls_first(), F.xxhash64("t"), F.col("t").asc_nulls_first())
    dealt.mapInArrow(partial(_write, tokenizer, vocabulary(tokenizer)), SCHEMA).write.mode("overwrite").parquet(path)


def _read(first_rule: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row["docs"], row["rules"], row["symbols"], first_rule)
            n = shard.table[:, 1]
            inner = np.r_[0, np.cumsum(n)]
            starts, ids = row["start"] + inner[:-1], shard.all_ids().astype("<u4")
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(inner[:-1].tolist(), inner[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard.ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _read_ids(first_rule: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row["docs"], row["rules"], row["symbols"], first_rule)
            n = shard.table[:, 1]
            starts = row["start"] + np.r_[0, np.cumsum(n)[:-1]]
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(shard.all_ids().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(shard.ids, pa.int64()), pa.array(starts, pa.int64()), ids], ["doc_id", "start", "ids"])


def placed(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``start``, the ids in all shards before: those of earlier ranges, and those before it in its own."""
    ship(spark)
    shards = spark.read.schema(SCHEMA).parquet(path)
    totals = shards.groupBy("range").agg(F.sum("n_ids").alias("all_ids"))
    # a row per range, of which there are as many as the writing job had tasks
    earlier = materialize(totals.select("range", F.coalesce(F.sum("all_ids").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier")), "shard-ranges")
    if earlier.count() <= BROADCAST_RANGES:  # no blob is moved
        earlier = F.broadcast(earlier)
    return shards.join(earlier, "range").select((F.col("before") + F.col("earlier")).alias("start"), "docs", "rules", "symbols")


def read(spark: SparkSession, path: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, ids of every document in the files."""
    first_rule = vocabulary(tokenizer or default_tokenizer())
    return placed(spark, path).mapInArrow(partial(_read_ids, first_rule), "doc_id long, start long, ids array<int>")


def read_checked(spark: SparkSession, path: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian 32-bit integers, of every document in the files."""
    first_rule = vocabulary(tokenizer or default_tokenizer())
    return placed(spark, path).mapInArrow(partial(_read, first_rule), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-shards")
    write(read_table(spark, sf_dir, "documents"), path)
    return read_checked(spark, path)
