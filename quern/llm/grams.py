"""Hashed character n-grams of whole texts, for the linear classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters of one text that are in work at a time; longer texts go through in overlapping pieces, whole.
PIECE_CHARS = 1_000_000
_GOLDEN, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def code_points(text: str | None) -> np.ndarray:
    """Lower-cased code points with a space on either side, so that n-grams see the text's ends as word ends."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4") if text else np.zeros(0, "<u4")


def codes(points: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Hashes, below 2**bits, of every n-gram of each size."""
    top = max(sizes)
    for at in range(0, max(1, len(points)), PIECE_CHARS):
        piece = points[at : at + PIECE_CHARS + top - 1].astype(np.uint64)
        last = at + PIECE_CHARS >= len(points)
        run = piece
        for n in range(2, top + 1):
            if len(piece) < n:
                break
            run = run[:-1] * _STEP + piece[n - 1 :]
            if n in sizes:
                own = run if last else run[:PIECE_CHARS]
                mixed = (own ^ (own >> np.uint64(32))) * _GOLDEN + np.uint64(n << 56)
                yield ((mixed ^ (mixed >> np.uint64(29))) * _GOLDEN >> np.uint64(64 - bits)).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows, fewer at a time: what is in work as Python objects stays small whatever the batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
