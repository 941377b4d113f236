"""Exact BPE ids of texts by backtracking, and texts from ids by an offset table.

A word's last byte carries an end mark, so a word is a string over 512 symbols
and every vocabulary entry is one too. An id sequence is what the merges give if
and only if each neighbouring pair of ids, merged alone, stays that pair. So a
word is encoded without merging: an Aho-Corasick automaton over the reversed
entries tells the longest entry that starts at every place; entries are taken
from the left, the longest first; one that doesn't fit the last one taken, or
that ends where no way leads on, gives way to its longest proper prefix, and
where none is left the last one is taken back and the place closed. A place is
closed once, so the work is linear in the word's length. Which pairs fit is
looked up in a compatibility table that is filled as pairs are met: a pair
doesn't fit if, taking its merges back from the latest on, some merge across its
border would have come first.

Distinct words are encoded once in a Python worker. Texts of characters up to
U+017F are normalised and cut here; for others the library's own normaliser and
pre-tokeniser are asked, whose Unicode version counts. Ids become a text by
copying stretches of one blob that holds all entries, found by an offset table.

Defined results: a null or empty text has no ids and an empty decoded text;
special tokens written in a text get their own ids, as in the library; repeated
rows and ids are encoded each; other columns are left out by ``digests`` and kept
by ``encode`` and ``decode``; a tokenizer of another build than this one reads
(BPE with an end-of-word suffix over byte-level words) is refused at load, and so
is one whose ids differ from the library's on the probes.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import read_table, ship
from quern.llm.grams import slices, texts_of

#: Words and pairs that a Python worker remembers, and the longest of those words.
CACHE_WORDS, CACHE_CHARS, CACHE_PAIRS = 500_000, 64, 4_000_000
#: Ids that are decoded at a time.
IDS_AT_ONCE = 1_000_000
#: Fixed value: the words of the tokenizer's own pattern, for lower-cased characters up to U+017F.
PATTERN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ſ0-9²³¹¼½¾]+")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The UTF-8 bytes of characters up to U+017F.
_PLAIN = bytes([*range(128), *range(0x80, 0xC0), *range(0xC2, 0xC6)])
_ENDS = 0xE000
PROBES = ("Don't they're it'S 12 ab3", "  a\tb\r\nc ", "ÀÉß ¿¡ ½ª ſ İ Ÿ", "é 中文 😀 ​ \x1c\x85", "x" * 300, "<|startoftext|>hello world<|endoftext|>!!", "https://www.example.com/a_b?c=d&e=%20", "")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _char_of() -> list[str]:
    """Byte-level spelling: printable bytes stand for themselves, the others for characters from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Codec:
    """One tokenizer: its vocabulary as symbol strings, its merges, and what is remembered."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._refuse(spec)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        char_of = _char_of()
        self.spelling = {b: c for b, c in enumerate(char_of)}
        n = max([*vocab.values(), *self.special.values()]) + 1
        symbols = {vocab[c]: c for c in char_of} | {vocab[c + suffix]: chr(_ENDS + ord(c)) for c in char_of}
        # by id: the two parts of its merge, and when that merge comes; single symbols come before all merges
        self.left, self.right, self.rank = list(range(n)), list(range(n)), [-1] * n
        self.merged: dict[int, int] = {}
        self.n = n
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if z in symbols:
                raise ValueError(f"two merges make the entry {a + b!r}")
            symbols[z] = symbols[x] + symbols[y]
            self.left[z], self.right[z], self.rank[z] = x, y, rank
            self.merged[x * n + y] = z
        by_string = {s: i for i, s in symbols.items()}
        self.size = [len(symbols.get(i, "")) for i in range(n)]
        self.shorter = [-1] * n
        self.automaton = ahocorasick.Automaton()
        for i, s in symbols.items():
            self.automaton.add_word(s[::-1], i)
            self.shorter[i] = next((by_string[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in by_string), -1)
        self.automaton.make_automaton()
        self.fit: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.own_words: dict[str, bytes] = {}
        # the offset table: every entry and a space after it
        text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        spelled = [(text_of.get(i, "") + " ").encode() for i in range(n)]
        self.length = np.array([len(x) for x in spelled], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.blob = np.frombuffer(b"".join(spelled), np.uint8)
        for text in PROBES:
            ids = self.library.encode(text, add_special_tokens=False).ids
            if self.encode(text).tolist() != ids or self.decode(np.array(ids, np.int64)) != self.library.decode(ids, skip_special_tokens=False):
                raise ValueError(f"the tokenizer gives other ids for {text!r}")

    @staticmethod
    def _refuse(spec: dict) -> None:
        model, normalizer, cuts, added = spec["model"], spec["normalizer"] or {}, spec["pre_tokenizer"] or {}, spec["added_tokens"]
        steps = [(s["type"], s.get("pattern"), s.get("content")) for s in normalizer.get("normalizers", [])]
        parts = cuts.get("pretokenizers", [])
        fits = (
            model["type"] == "BPE" and model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix") and not model.get("dropout")
            and not model.get("ignore_merges") and not model.get("byte_fallback") and spec.get("decoder") is None
            and steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": SPLIT} and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
            and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        )
        if not fits:
            raise ValueError("not a tokenizer of the build that this encoder reads")

    def fits(self, a: int, b: int) -> bool:
        """Whether the pair stays as it is when its bytes are merged."""
        key = a * self.n + b
        known = self.fit.get(key)
        if known is None:
            if len(self.fit) >= CACHE_PAIRS:
                self.fit.clear()
            known = self.fit[key] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        rank, merged, n = self.rank, self.merged, self.n
        # a merge across the border before this rank would have come before the merge that was taken back last
        before = len(merged)
        while True:
            across = merged.get(a * n + b)
            if across is not None and rank[across] < before:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:  # the later merge is taken back; of equal merges the left one came first
                before, a = rank[a], self.right[a]
            else:
                before, b = rank[b] + 1, self.left[b]

    def word(self, spelled: str) -> bytes:
        """Ids of one word, given in byte-level spelling, as 32-bit integers."""
        symbols = spelled[:-1] + chr(_ENDS + ord(spelled[-1]))
        n, size, shorter = len(symbols), self.size, self.shorter
        longest = [-1] * n
        for end, entry in self.automaton.iter(symbols[::-1]):  # several entries that end at one place come longest first
            if longest[n - 1 - end] < 0:
                longest[n - 1 - end] = entry
        taken, at, closed, entry = [], 0, bytearray(n + 1), longest[0]
        while at < n:
            last = taken[-1] if taken else -1
            while entry >= 0 and (closed[at + size[entry]] or (last >= 0 and not self.fits(last, entry))):
                entry = shorter[entry]
            if entry >= 0:
                taken.append(entry)
                at += size[entry]
                entry = longest[at] if at < n else -1
            else:
                closed[at] = 1
                entry = taken.pop()
                at -= size[entry]
        return np.array(taken, np.uint32).tobytes()

    def _remembered(self, held: dict[str, bytes], word: str, spelled: str) -> bytes:
        ids = self.word(spelled)
        if len(word) <= CACHE_CHARS:
            if len(held) >= CACHE_WORDS:
                held.clear()
            held[word] = ids
        return ids

    def _segment(self, text: str) -> list[bytes]:
        if not text.encode("utf-8", "replace").translate(None, _PLAIN) and "İ" not in text:
            get = self.words.get
            return [get(w) or self._remembered(self.words, w, w.encode().decode("latin-1").translate(self.spelling)) for w in PATTERN.findall(text.lower())]
        get = self.own_words.get
        return [get(w) or self._remembered(self.own_words, w, w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def encode(self, text: str) -> np.ndarray:
        parts, at = [], 0
        for m in self.specials.finditer(text) if self.specials else ():
            parts += self._segment(text[at : m.start()])
            parts.append(np.uint32(self.special[m[0]]).tobytes())
            at = m.end()
        parts += self._segment(text[at:] if at else text)
        return np.frombuffer(b"".join(parts), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return self.decoded(ids).decode("utf-8")

    def decoded(self, ids: np.ndarray) -> bytes:
        """The entries, parted by spaces, in UTF-8."""
        out = []
        for at in range(0, len(ids), IDS_AT_ONCE):
            own = ids[at : at + IDS_AT_ONCE].astype(np.int64)
            n = self.length[own]
            first = self.offset[own] - np.concatenate([[0], np.cumsum(n)[:-1]])
            out.append(self.blob[np.repeat(first, n) + np.arange(int(n.sum()))].tobytes())
        return b"".join(out)[:-1]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _ids_array(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint32), *rows]).astype(np.int32)))


def _with_ids(path: str, text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [codec(path).encode(t or "") for t in texts_of(batch, text)]
        yield pa.RecordBatch.from_arrays([*batch.columns, _ids_array(rows)], [*batch.schema.names, "_ids"])


def _with_text(path: str, ids: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [codec(path).decode(np.array(x or [], np.int64)) for x in texts_of(batch, ids)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.string())], [*batch.schema.names, "_decoded"])


def _digests(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in slices(batches):
        counts, of_ids, of_texts = [], [], []
        for t in batch.column(1).to_pylist():
            ids = own.encode(t or "")
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            of_texts.append(hashlib.sha256(own.decoded(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_texts)], ["k", "n_tokens", "ids_sha256", "decoded_sha256"])


def _mapped(df: DataFrame, function, name: str, kind: str) -> DataFrame:
    """``df`` with a column ``name`` that ``function`` makes; a column of that name in the input is replaced."""
    ship(df.sparkSession)
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` {kind}"])
    return df.mapInArrow(function, schema)


def encode(df: DataFrame, text: str = "text", to: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """``df`` with the ids of ``text``, an array, in column ``to``."""
    made = _mapped(df.drop("_ids"), partial(_with_ids, tokenizer or default_tokenizer(), text), "_ids", "array<int>")
    return made.drop(*([to] if to in df.columns else [])).withColumnRenamed("_ids", to)


def decode(df: DataFrame, ids: str = "ids", to: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """``df`` with the text of ``ids`` in column ``to``."""
    made = _mapped(df.drop("_decoded"), partial(_with_text, tokenizer or default_tokenizer(), ids), "_decoded", "string")
    return made.drop(*([to] if to in df.columns else [])).withColumnRenamed("_decoded", to)


def digests(df: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded, then decoded from the ids; nothing is shuffled."""
    ship(df.sparkSession)
    made = df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(partial(_digests, tokenizer or default_tokenizer()), f"k {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return made.withColumnRenamed("k", key)


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
