"""Benchmark decontamination by edit distance.

Texts are sequences of lower-cased words; an item is found in a document where
some stretch of it is within a quarter of the item's words of the item, in word
edits. The steps, each without loss or with a recall that is set:

1. Windows. An item with n words and at most k edits keeps a run of at least
   (n - k) / (k + 1) words unedited, so only places that share such a run with
   an item can match it, and only where enough of them meet (q-gram lemma).
   There the item-sized windows that start up to k words around the place where
   the runs put the item's start are taken.
2. CGK embedding (Chakraborty, Goldenberg, Koucky, 2016): a random walk copies a
   word sequence to one of three times its length, so that few edits become
   few differing places.
3. Bit-sampling LSH: tables of a few sampled places each. For every item length,
   as many tables, from as many walks, are used as find ``RECALL`` of randomly
   edited items of that length; a length for which ``MOST_WALKS`` walks don't is
   not hashed, all its windows go on to the next step (``recalls`` tells both).
4. Exact edit distance of every colliding item against the document's stretch.

Words are runs of letters, digits and underscores; in scripts that don't part
words by spaces (Chinese, Japanese, Thai and the like) every character is one.
Items go to the tasks in blocks of at most ``BLOCK_CHARS`` characters, one pass
each, so what is broadcast is bounded; with several blocks each one's findings
are written before the next is made. Defined results: items of fewer than
``FUZZY_WORDS`` words match only verbatim; null items, items without words and
null or empty documents match nothing; repeated documents and items are reported
each; one row per document row and item, for the closest stretch, the first of
them on a tie; other columns are left out by ``contaminated`` and kept by
``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialize, read_table, ship
from quern.llm.shingles import mix

#: Items with fewer words allow no edits.
FUZZY_WORDS = 5
#: Edits allowed, as a share of the item's words.
EDITS = 0.25
RECALL = 0.99
SAMPLED = 3
TABLES_A_WALK = 16
MOST_WALKS = 24
BLOCK_CHARS = 16_000_000
DOCS_AT_ONCE = 250
U = np.uint64
#: Simulated edits for each item length; places of a text that are looked up at a time.
TRIALS = 200
PLACES = 16_384
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORD = re.compile(f"[{_UNSPACED}]|[^\\W{_UNSPACED}]+")


def _lowered(text: str) -> str:
    """Lower case, but for the rare text that it would change in length: its places would move."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def words(text: str | None) -> list[str]:
    return _WORD.findall(_lowered(text)) if text else []


def allowed(n: int) -> int:
    return int(EDITS * n) if n >= FUZZY_WORDS else 0


def run_length(n: int) -> int:
    """Words in a row that stay unedited somewhere, whatever the allowed edits are."""
    k = allowed(n)
    return -(-(n - k) // (k + 1))


def walk(rows: np.ndarray, seed: int) -> np.ndarray:
    """CGK embedding of each row (words as positive numbers): three times as long, 0 past its end."""
    count, n = rows.shape
    padded = np.concatenate([rows, np.zeros((count, 1), rows.dtype)], axis=1)
    at, line = np.zeros(count, np.int64), np.arange(count)
    out = np.empty((count, 3 * n), rows.dtype)
    for j in range(3 * n):
        own = padded[line, at]
        out[:, j] = own
        at = np.minimum(at + (mix(own.astype(U) + U(j << 32), seed) & U(1)).astype(np.int64), n)
    return out


def table_keys(rows: np.ndarray, first: int, end: int) -> np.ndarray:
    """LSH keys of each row, a column per table, by walks ``first`` to ``end``."""
    n, keys = rows.shape[1], []
    for w in range(first, end):
        embedded = walk(rows, 101 + w).astype(U)
        places = np.random.default_rng(1000 * w + n).integers(0, 3 * n, (TABLES_A_WALK, SAMPLED))
        for t, own in enumerate(places):
            key = np.full(len(rows), U(w * TABLES_A_WALK + t))
            for p in own:
                key = mix(key, 1) + embedded[:, p]
            keys.append(mix(key, 2))
    return np.stack(keys, axis=1) if keys else np.zeros((len(rows), 0), U)


def edit_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least word edits between ``item`` and any stretch of ``text``; that stretch's begin and end, the first on a tie."""
    m = len(text)
    cost, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    steps = np.arange(m + 1)
    for w in item:
        moved = np.empty(m + 1, np.int64)
        moved[0], moved[1:] = cost[0] + 1, np.minimum(cost[:-1] + (text != w), cost[1:] + 1)
        start = begin.copy()
        start[1:][cost[:-1] + (text != w) <= cost[1:] + 1] = begin[:-1][cost[:-1] + (text != w) <= cost[1:] + 1]
        # an insertion extends the best cell to the left
        shifted = moved - steps
        best = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == best, steps, 0))
        source = np.where(shifted == best, steps, source)
        cost, begin = best + steps, start[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


@dataclass
class Items:
    """A block of items, ready to be looked up."""

    ids: list[int | None]
    number: dict[str, int]  # word -> positive number
    rows: list[np.ndarray]
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # run length -> sorted codes, item, place
    tables: dict[int, list[tuple[np.ndarray, np.ndarray]]]  # item length -> per table sorted keys, item; none where all windows are verified
    of_length: dict[int, np.ndarray]  # item length -> items
    walks: dict[int, tuple[int, float]]  # item length -> walks (0: not hashed), recall in simulation

    def __post_init__(self) -> None:
        self.length = np.array([len(r) for r in self.rows])


def _codes(numbers: np.ndarray, q: int) -> np.ndarray:
    return _code([numbers[k : len(numbers) - q + 1 + k] for k in range(q)])


def _code(columns: list[np.ndarray]) -> np.ndarray:
    """A number per run of words; two runs with one number by chance only cost a look."""
    code = np.zeros(len(columns[0]), U)
    for column in columns:
        code = code * U(0x9E3779B97F4A7C15) + column.astype(U)
    return code


def _edited(row: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An item after as many random edits as are allowed, cut or filled to its own length."""
    edited = row.tolist()
    for _ in range(allowed(len(row))):
        kind, p = rng.integers(3), int(rng.integers(len(edited)))
        edited[p : p + (kind > 0)] = [] if kind == 1 and len(edited) > 1 else [int(rng.integers(1 << 30, 1 << 31))]
    return np.array((edited + [0] * len(row))[: len(row)], np.int64)


def walks_needed(rows: list[np.ndarray], seed: int = 7) -> tuple[int, float]:
    """Walks whose tables find ``RECALL`` of the edited items ``rows``, all of one length, and the share found; 0 walks if ``MOST_WALKS`` don't."""
    rng = np.random.default_rng(seed)
    if not allowed(len(rows[0])):
        return 1, 1.0
    whole = np.stack([rows[k % len(rows)] for k in range(max(TRIALS, min(len(rows), 4 * TRIALS)))])
    edited, hit = np.stack([_edited(r, rng) for r in whole]), np.zeros(len(whole), bool)
    for w in range(MOST_WALKS):
        hit |= (table_keys(whole, w, w + 1) == table_keys(edited, w, w + 1)).any(axis=1)
        if hit.mean() >= RECALL:
            return w + 1, float(hit.mean())
    return 0, 1.0


def prepare(items: list[tuple[int | None, str | None]]) -> Items | None:
    told = [(i, w) for i, t in items if (w := words(t))]
    if not told:
        return None
    number: dict[str, int] = {}
    rows = [np.array([number.setdefault(w, len(number) + 1) for w in ws], np.int64) for _, ws in told]
    runs: dict[int, list] = {}
    lengths: dict[int, list[int]] = {}
    for k, row in enumerate(rows):
        code = _codes(row, q := run_length(len(row)))
        runs.setdefault(q, []).append((code, np.full(len(code), k), np.arange(len(code))))
        lengths.setdefault(len(row), []).append(k)
    tables, walks, of_length = {}, {}, {n: np.array(own) for n, own in lengths.items()}
    for n, own in of_length.items():
        walks[n] = walks_needed([rows[k] for k in own])
        keys = table_keys(np.stack([rows[k] for k in own]), 0, walks[n][0])
        order = np.argsort(keys, axis=0)
        tables[n] = [(keys[order[:, t], t], own[order[:, t]]) for t in range(keys.shape[1])]
    ready = {}
    for q, parts in runs.items():
        code, item, place = (np.concatenate([p[x] for p in parts]) for x in range(3))
        order = np.argsort(code, kind="stable")
        ready[q] = (code[order], item[order], place[order])
    return Items([i for i, _ in told], number, rows, ready, tables, of_length, walks)


def recalls(benchmark: DataFrame) -> list[tuple[int, int, float]]:
    """(item length, walks, recall in simulation) for every length of each block of items; 0 walks where all windows are verified."""
    return [(n, *told) for items in blocks(benchmark) for n, told in sorted(items.walks.items())]


def _windows(items: Items, numbers: np.ndarray) -> dict[int, np.ndarray]:
    """Item length -> starts of the windows that may match an item of that length.

    By the q-gram lemma an item with k edits keeps all but k * q of its q-word runs, and those lie at most k words
    out of line; a window is taken only where as many runs of one item meet.
    """
    known = numbers > 0
    found: dict[int, list[np.ndarray]] = {}
    for q, (codes, item, place) in items.runs.items():
        if len(numbers) < q:
            continue
        whole = np.flatnonzero(np.logical_and.reduce([known[k : len(numbers) - q + 1 + k] for k in range(q)]))
        # slices overlap by more than a matching stretch takes up, so each place's runs meet in one of them
        spare = 3 * int(items.length.max())
        at = 0
        while at < len(whole):
            stop = min(len(whole), at + PLACES)
            upto = int(np.searchsorted(whole, whole[stop - 1] + spare, "right")) if stop < len(whole) else stop
            for n, starts in _met(items, numbers, codes, item, place, q, whole[at:upto]):
                found.setdefault(n, []).append(starts)
            at = stop
    return {n: np.unique(np.concatenate(s)) for n, s in found.items()}


def _met(items: Items, numbers: np.ndarray, codes: np.ndarray, item: np.ndarray, place: np.ndarray, q: int, whole: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(item length, starts): windows around the places ``whole`` where enough runs of one item meet."""
    code = _code([numbers[whole + k] for k in range(q)])
    lo = np.searchsorted(codes, code, "left")
    hit = np.flatnonzero(codes[np.minimum(lo, len(codes) - 1)] == code)
    lo, whole = lo[hit], whole[hit]
    count = np.searchsorted(codes, code[hit], "right") - lo
    at = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(int(count.sum()))
    who, line = item[at], np.repeat(whole, count) - place[at]
    order = np.lexsort((line, who))
    who, line = who[order], line[order]
    n = items.length[who]
    k = np.where(n >= FUZZY_WORDS, (EDITS * n).astype(np.int64), 0)
    far = np.arange(len(who)) + np.maximum(n - q + 1 - k * q, 1) - 1
    near = np.minimum(far, len(who) - 1)
    good = np.flatnonzero((far < len(who)) & (who[near] == who) & (line[near] - line <= 2 * k))
    if not len(good):
        return
    spans = np.unique(np.stack([n[good], line[good] - k[good], line[near[good]] + k[good] + 1], axis=1), axis=0)
    for size in np.unique(spans[:, 0]).tolist():
        a, b = spans[spans[:, 0] == size, 1:].T
        wide = b - a
        yield size, np.unique(np.repeat(a - np.r_[0, np.cumsum(wide)[:-1]], wide) + np.arange(int(wide.sum())))


def find(items: Items, texts: list[str | None]) -> list[list[tuple[int | None, int, int, int]]]:
    """For each whole text (item id, begin, end, edits) of every item found; places in code points, end exclusive."""
    get = items.number.get
    numbers: list[np.ndarray] = []
    asked: dict[int, list[tuple[int, np.ndarray]]] = {}
    for d, text in enumerate(texts):
        own = np.array([get(w, 0) for w in words(text)], np.int64)
        numbers.append(own)
        for n, starts in _windows(items, own).items():
            asked.setdefault(n, []).append((d, starts[(starts > -n) & (starts < len(own))]))
    hits = [np.zeros((0, 3), np.int64)]
    for n, places in asked.items():
        for doc, start, rows in _rows(numbers, places, n):
            hits.append(_colliding(items, n, doc, start, rows))
    hits = np.concatenate(hits)
    hits = hits[np.lexsort(hits.T[::-1])]
    spots: dict[int, dict[int, np.ndarray]] = {}
    edge = np.flatnonzero(np.r_[True, (hits[1:, :2] != hits[:-1, :2]).any(axis=1), True]) if len(hits) else []
    for a, b in zip(edge[:-1], edge[1:]):
        spots.setdefault(int(hits[a, 0]), {})[int(hits[a, 1])] = hits[a:b, 2]
    return [_confirmed(items, texts[d], numbers[d], spots[d]) if d in spots else [] for d in range(len(texts))]


def _colliding(items: Items, n: int, doc: np.ndarray, start: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distinct (document, item, start) of the windows that share a table's key with an item, or of all if the length is not hashed."""
    found = []
    if not items.tables[n]:
        own = items.of_length[n]
        found.append(np.stack([np.repeat(doc, len(own)), np.tile(own, len(doc)), np.repeat(start, len(own))], axis=1))
    keys = table_keys(rows, 0, items.walks[n][0])
    for t, (sorted_keys, item) in enumerate(items.tables[n]):
        lo = np.searchsorted(sorted_keys, keys[:, t], "left")
        count = np.searchsorted(sorted_keys, keys[:, t], "right") - lo
        r = np.repeat(np.arange(len(rows)), count)
        at = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(int(count.sum()))
        found.append(np.stack([doc[r], item[at], start[r]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def _rows(numbers: list[np.ndarray], places: list[tuple[int, np.ndarray]], n: int, most: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of n words, many documents at a time: document, start, words."""
    docs, starts, rows, size = [], [], [], 0
    for d, at in places:
        # words unknown to the items are numbered by their place, apart from each other and from all known words
        own = np.where(numbers[d] > 0, numbers[d], (1 << 32) + np.arange(len(numbers[d])))
        padded = np.concatenate([np.zeros(n, np.int64), own, np.zeros(n, np.int64)])
        for a in range(0, len(at), most):
            part = at[a : a + most]
            docs.append(np.full(len(part), d))
            starts.append(part)
            rows.append(padded[part[:, None] + n + np.arange(n)])
            size += len(part)
            if size >= most:
                yield np.concatenate(docs), np.concatenate(starts), np.concatenate(rows)
                docs, starts, rows, size = [], [], [], 0
    if size:
        yield np.concatenate(docs), np.concatenate(starts), np.concatenate(rows)


def _confirmed(items: Items, text: str, numbers: np.ndarray, spots: dict[int, np.ndarray]) -> list[tuple[int | None, int, int, int]]:
    """The colliding items that exact edit distance confirms."""
    out, ends = [], None
    for k, starts in sorted(spots.items()):
        row, best = items.rows[k], None
        n, most, starts = len(row), allowed(len(row)), starts.tolist()
        same = next((s for s in starts if s >= 0 and np.array_equal(numbers[s : s + n], row)), None)
        if same is not None:
            best = (0, same, same + n)
        else:
            for a, b in _merged(starts, n + most):
                a, b = max(0, a - most), min(len(numbers), b + n + most)
                edits, begin, end = edit_match(row, numbers[a:b])
                if edits <= most and (best is None or edits < best[0]):
                    best = (edits, a + begin, a + end)
        if best and best[2] > best[1]:
            ends = ends or [m.span() for m in _WORD.finditer(_lowered(text))]
            out.append((items.ids[k], ends[best[1]][0], ends[best[2] - 1][1], best[0]))
    return out


def _merged(starts: list[int], gap: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in starts:
        if out and s - out[-1][1] <= gap:
            out[-1][1] = s
        else:
            out.append([s, s])
    return [(a, b) for a, b in out]


_SCHEMA = "doc_id long, item_id long, begin int, end int, edits int"


def _find(items, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    for part in (batch.slice(at, DOCS_AT_ONCE) for batch in batches for at in range(0, batch.num_rows, DOCS_AT_ONCE)):
        rows = [(d, *hit) for d, hits in zip(part.column(0).to_pylist(), find(items.value, part.column(1).to_pylist())) for hit in hits]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in _SCHEMA.split(", ")])


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items, block by block; a block is as large as the driver holds at a time."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator(prefetchPartitions=False):
        held.append((r.item_id, r.text))
        size += len(r.text or "")
        if size >= BLOCK_CHARS:
            if ready := prepare(held):
                yield ready
            held, size = [], 0
    if ready := prepare(held):
        yield ready


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, begin, end, edits: every item found in every whole text of ``docs`` (doc_id, text)."""
    spark, found = docs.sparkSession, []
    ship(spark)
    for items, alone in _sole(blocks(benchmark)):
        sent = spark.sparkContext.broadcast(items)
        found.append(docs.select("doc_id", "text").mapInArrow(partial(_find, sent), _SCHEMA))
        if not alone:
            found[-1] = materialize(found[-1], "contaminated")
            sent.unpersist()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _SCHEMA)


def _sole(parts: Iterator[Items]) -> Iterator[tuple[Items, bool]]:
    """Every block, and whether it is the only one."""
    first = next(parts, None)
    second = next(parts, None)
    if first is not None:
        yield first, second is None
    del first
    if second is not None:
        yield second, False
        yield from ((x, False) for x in parts)


def _keep(items, text: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (batch.slice(at, DOCS_AT_ONCE) for batch in batches for at in range(0, batch.num_rows, DOCS_AT_ONCE)):
        found = find(items.value, part.column(part.schema.get_field_index(text)).to_pylist())
        yield part.filter(pa.array([not hits for hits in found], pa.bool_()))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in whose texts no item is found; nothing is shuffled."""
    ship(docs.sparkSession)
    for items, alone in _sole(blocks(benchmark)):
        sent = docs.sparkSession.sparkContext.broadcast(items)
        docs = docs.mapInArrow(partial(_keep, sent, text), docs.schema)
        if not alone:
            docs = materialize(docs, "decontaminated")
            sent.unpersist()
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
