"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is cut where no piece of the vocabulary can cross: before every run of
spaces and around every line end. The distinct words of a batch lie in flat
numpy symbol arrays; each round takes every word's smallest pair rank
(segmented minimum), merges that pair's leftmost occurrence in all words at
once, and compacts, until no word has a pair left. In words of more than
``LONG_WORD`` symbols (texts without spaces, say) a round takes the least rank of
them all and merges every occurrence of its pair at once, so far as no merge
makes a pair of a lesser rank; there are then at most as many rounds as ranks,
and each costs what it merges. Results per word are kept in a bounded cache of
the Python worker, so a frequent word is merged once.

Defined results: a null text counts as empty and has no ids; an empty text has
no ids and decodes to the empty text; bytes that spell no character decode to
U+FFFD each; rows are independent, so repeated rows, ties and empty tables need
no rule. A model whose results these rules don't give (another kind of model, or
one that normalises its input) is refused when it is loaded.
Other columns of the input pass through untouched; the names of the new columns
are parameters and replace columns of the same name.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import read_table, ship
from quern.llm.grams import slices, texts_of

SPACE = "▁"
codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))
LONG_WORD = 256
CACHE_WORDS = 200_000
CHUNK_CHARS = 1_000_000
NO_PAIR = np.int64(2**62)
_WORDS = re.compile(" *[^ \n]+| +|\n")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _slot(codes: np.ndarray, shift: np.uint64) -> np.ndarray:
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)


class PieceModel:
    """Pieces, pair ranks and byte ids of a BPE model with byte fallback and no normalisation."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.size = n
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        pieces = {sp.id_to_piece(i): i for i in range(n) if i not in special}
        self.byte_id = np.zeros(256, np.int32)
        surface: list[bytes] = []
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[1:-1], 16)
                self.byte_id[value] = i
                surface.append(bytes([value]))
            elif sp.is_unknown(i):
                surface.append(" ⁇ ".encode())
            elif i in special:
                surface.append(b"")
            else:
                surface.append(sp.id_to_piece(i).replace(SPACE, " ").encode())
        self.surface = surface
        self.pieces = pieces
        self.score = {i: sp.get_score(i) for i in pieces.values()}

    @cached_property
    def symbols(self) -> dict[str, int]:
        """Pieces and, above their ids, the single characters that only occur within pieces."""
        symbols = dict(self.pieces)
        for piece in self.pieces:
            for c in piece:
                symbols.setdefault(c, len(symbols) + self.size)
        return symbols

    @cached_property
    def symbol_of(self) -> np.ndarray:
        out = np.full(0x110000, -1, np.int32)
        for s, i in self.symbols.items():
            if len(s) == 1:
                out[ord(s)] = i
        return out

    def _pairs(self) -> dict[int, tuple[int, int]]:
        rank = {i: r for r, i in enumerate(sorted(self.pieces.values(), key=lambda i: (-self.score[i], i)))}
        pairs: dict[int, tuple[int, int]] = {}
        for piece, i in self.pieces.items():
            for k in range(1, len(piece)):
                a, b = self.symbols.get(piece[:k]), self.symbols.get(piece[k:])
                if a is not None and b is not None:
                    pairs[(a << 20) | b] = (rank[i], i)
        return pairs

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.uint64]:
        """Open-addressing table of the pairs, for vectorised look-ups."""
        return self._table(self._pairs())

    def _table(self, pairs: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.uint64]:
        bits = max(4, int(len(pairs) * 4).bit_length())
        shift = np.uint64(64 - bits)
        keys = np.full(1 << bits, -1, np.int64)
        values = np.full(1 << bits, -1, np.int64)
        todo = np.fromiter(pairs, np.int64, len(pairs))
        value = np.array([(r << 20) | i for r, i in pairs.values()], np.int64).reshape(-1)
        slot = _slot(todo, shift)
        while len(todo):
            free = keys[slot] == -1
            first = np.zeros(len(todo), bool)
            index = np.flatnonzero(free)
            first[index[np.unique(slot[index], return_index=True)[1]]] = True
            keys[slot[first]], values[slot[first]] = todo[first], value[first]
            todo, value, slot = todo[~first], value[~first], (slot[~first] + 1) & (len(keys) - 1)
        return keys, values, shift

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """(rank << 20) | piece id for each pair, -1 where there is none."""
        codes = (left.astype(np.int64) << 20) | right
        out = np.full(len(codes), -1, np.int64)
        keys, values, shift = self.table
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        slot = _slot(codes[todo], shift)
        while len(todo):
            key = keys[slot]
            hit = key == codes[todo]
            out[todo[hit]] = values[slot[hit]]
            more = ~hit & (key != -1)
            todo, slot = todo[more], (slot[more] + 1) & (len(keys) - 1)
        return out

    def ids_of_char(self, c: str, symbol: int) -> list[int]:
        return [symbol] if 0 <= symbol < self.size else self.byte_id[list(c.encode("utf-8", "replace"))].tolist()

    def merge_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, by rounds over flat arrays."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= LONG_WORD]
        if long := [k for k, w in enumerate(words) if len(w) > LONG_WORD]:
            for k, ids in zip(long, self.merge_long([words[k] for k in long])):
                out[k] = ids
        if not short:
            return out
        chars = np.frombuffer("".join(words[k] for k in short).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.symbol_of[chars]
        points = chars.astype(np.int64)
        sizes = np.array([len(words[k]) for k in short], np.int64)
        owner = np.repeat(np.array(short, np.int64), sizes)
        ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            found = np.full(len(symbols), -1, np.int64)
            found[:-1] = self.look_up(symbols[:-1], symbols[1:])
            found[:-1][owner[1:] != owner[:-1]] = -1
            at = np.arange(len(symbols), dtype=np.int64)
            key = np.where(found >= 0, ((found >> 20) << 32) | at, NO_PAIR)
            least = np.minimum.reduceat(key, starts)
            live = least != NO_PAIR
            where = least[live] & 0xFFFFFFFF
            symbols[where] = (found[where] & 0xFFFFF).astype(np.int32)
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            on = np.repeat(live, np.diff(np.r_[starts, len(symbols)]))
            ended.append((symbols[~on], owner[~on], points[~on]))
            keep &= on
            symbols, owner, points = symbols[keep], owner[keep], points[keep]
        for s, o, p in ended:
            if not len(s):
                continue
            cut = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            plain = (s >= 0) & (s < self.size)
            ok = np.logical_and.reduceat(plain, cut)
            ends = np.r_[cut[1:], len(s)]
            for a, b, good in zip(cut.tolist(), ends.tolist(), ok.tolist()):
                if good:
                    out[o[a]] = s[a:b].copy()
                else:
                    ids: list[int] = []
                    for x, c in zip(s[a:b].tolist(), p[a:b].tolist()):
                        ids += self.ids_of_char(chr(c), x)
                    out[o[a]] = np.array(ids, np.int32)
        return out

    def merge_long(self, words: list[str]) -> list[np.ndarray]:
        """The same merges, by rounds of the least rank over all words at once."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(w) for w in words], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        symbols, n = self.symbol_of[points], len(points)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)
        after[ends - 1], before[np.r_[0, ends[:-1]]] = -1, -1
        dead, now = np.zeros(n, bool), np.full(n, -1, np.int64)  # now: rank and piece of the pair that begins here
        buckets: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def offer(at: np.ndarray) -> None:
            """Look up the pairs that begin ``at`` and put them where their rank's round will find them."""
            at = at[after[at] >= 0]
            now[at] = self.look_up(symbols[at], symbols[after[at]])
            at = at[now[at] >= 0]
            rank = now[at] >> 20
            order = np.argsort(rank, kind="stable")
            edge = np.flatnonzero(np.r_[True, np.diff(rank[order]) != 0]) if len(at) else []
            for own in np.split(at[order], edge[1:]) if len(at) else ():
                put(int(now[own[0]] >> 20), own)

        def put(rank: int, at: np.ndarray) -> None:
            if rank not in buckets:
                heapq.heappush(ranks, rank)
            buckets.setdefault(rank, []).append(at)

        offer(np.arange(n))
        while ranks:
            rank = heapq.heappop(ranks)
            at = np.unique(np.concatenate(buckets.pop(rank)))
            at = at[now[at] >> 20 == rank]
            if not len(at):
                continue
            run = np.flatnonzero(np.r_[True, after[at[:-1]] != at[1:]])  # overlapping occurrences: every other one, from the left
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            piece = (now[at] & 0xFFFFF).astype(np.int32)
            right = after[at]
            left, beyond = before[at], after[right]
            follows = np.r_[False, left[1:] == right[:-1]]  # its left neighbour has just been merged
            lefts = np.where(left >= 0, np.where(follows, piece, symbols[left]), -1)
            made = np.stack([self.look_up(lefts, piece), self.look_up(piece, np.where(beyond >= 0, symbols[beyond], -1))])
            lesser = ((made >= 0) & (made >> 20 < rank)).any(axis=0)
            if lesser.any():  # each word goes on only up to the first merge that makes a pair of a lesser rank
                seen = np.cumsum(lesser) - lesser
                first = np.flatnonzero(np.r_[True, np.diff(owner[at]) != 0])
                fits = seen == np.repeat(seen[first], np.diff(np.r_[first, len(at)]))
                put(rank, at[~fits])
                at, piece, right, beyond = at[fits], piece[fits], right[fits], beyond[fits]
            symbols[at], dead[right], now[right] = piece, True, -1
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            now[at] = -1
            offer(np.unique(np.r_[at, before[at][before[at] >= 0]]))
        out = []
        for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
            alive = a + np.flatnonzero(~dead[a:b])
            own = symbols[alive]
            if not ((own >= 0) & (own < self.size)).all():
                own = np.array([i for x, c in zip(own.tolist(), points[alive].tolist()) for i in self.ids_of_char(chr(c), x)], np.int32)
            out.append(own.astype(np.int32))
        return out


#: Texts on which a model must agree with the library before it is used.
PROBES = ("Hello  world", " a\tb\nc ", "ﬁ① Å é中😀\0x", "a" * 400 + " 12.5")


class WordCache(dict):
    """Ids per word, bounded: once full, the words of one chunk that it lacks stay in ``own``."""

    own: dict[str, bytes]

    def __missing__(self, word: str) -> bytes:
        return self.own[word]


class Codec:
    """Whole texts to ids and back, with the bounded word cache."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = PieceModel(path)
        self.cache = WordCache()
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(own.tolist() != (want := library.encode(t)) or self.decode(own) != library.decode(want) for t, own in zip(PROBES, self.encode(list(PROBES)))):
            raise ValueError(f"{path} is no BPE model without normalisation that cuts words before spaces")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for a in _chunks([len(t) for t in texts], CHUNK_CHARS):
            words = [_WORDS.findall((" " + t).replace(SPACE, " ")) if t else [] for t in texts[a]]
            new = set().union(*words).difference(self.cache)
            merged = dict(zip(new, (x.tobytes() for x in self.model.merge_words([w.replace(" ", SPACE) for w in new]))))
            if len(self.cache) < CACHE_WORDS:
                self.cache.update(merged)
            else:
                self.cache.own = merged
            get = self.cache.__getitem__
            out += [np.frombuffer(b"".join(map(get, w)), np.int32) for w in words]
        return out

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.model.surface.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "each_byte")


def _chunks(sizes: list[int], most: int) -> Iterator[slice]:
    a = total = 0
    for k, n in enumerate(sizes):
        if k > a and total + n > most:
            yield slice(a, k)
            a, total = k, 0
        total += n
    if len(sizes) > a:
        yield slice(a, len(sizes))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per model and Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(df: DataFrame, text: str = "text", ids: str = "ids", model: str | None = None, decoded: str | None = None) -> DataFrame:
    """``df`` with ``ids``: array of int, the pieces of ``text``; with ``decoded`` also what those ids spell, in the same pass."""
    ship(df.sparkSession)
    path = model or default_model()
    keep = [c for c in df.columns if c not in (ids, decoded)]
    new = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    return df.select(*keep).mapInArrow(partial(_encode_batches, path, text, ids, decoded, keep), T.StructType([*(df.schema[c] for c in keep), *new]))


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", model: str | None = None) -> DataFrame:
    """``df`` with ``text``: what the pieces in ``ids`` spell; null ids count as none."""
    ship(df.sparkSession)
    path = model or default_model()
    keep = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(text, T.StringType())])
    return df.select(*keep).mapInArrow(partial(_decode_batches, path, ids, text, keep), schema)


def _encode_batches(path: str, text: str, ids: str, decoded: str | None, keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        arrays = codec(path).encode([x or "" for x in texts_of(part, text)])
        offsets = np.zeros(len(arrays) + 1, np.int32)
        np.cumsum([len(x) for x in arrays], out=offsets[1:])
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int32)))
        spelled = [pa.array([codec(path).decode(x) for x in arrays], pa.string())] if decoded else []
        yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keep] + [lists, *spelled], [*keep, ids, *([decoded] if decoded else [])])


def _decode_batches(path: str, ids: str, text: str, keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        lists = batch.column(batch.schema.get_field_index(ids))
        flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        texts = [codec(path).decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(texts, pa.string())], [*keep, text])


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, from the operator's ids and decoded texts."""
    told = encode(docs.select("doc_id", "text"), model=model, decoded="decoded")
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
