"""Arrow string columns as numpy arrays: one flat text with offsets, or blocks of rows of similar length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    data = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"").cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = data.buffers()[2]
    text = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return text, offsets - offsets[0]


def to_strings(text: np.ndarray, offsets: np.ndarray) -> pa.Array:
    out = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(text, np.uint8)))
    return out.cast(pa.string())


def sliced(text: np.ndarray, offsets: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """Of each row the bytes [start, start + length) as a string column."""
    new = np.concatenate([[0], np.cumsum(length)])
    take = np.arange(new[-1]) + np.repeat(offsets[:-1] + start - new[:-1], length)
    return to_strings(text[take], new)


@dataclass
class Block:
    """Rows of similar length: a matrix padded with 0 on the right, and the true lengths."""

    rows: np.ndarray
    lengths: np.ndarray
    bases: np.ndarray
    quals: np.ndarray | None = None

    @property
    def width(self) -> int:
        return self.bases.shape[1]


def matrix(text: np.ndarray, offsets: np.ndarray, rows: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    at = np.arange(width)
    place = (offsets[rows] + start[rows])[:, None] + at
    inside = at < length[rows][:, None]
    out = np.zeros((len(rows), width), np.uint8)
    out[inside] = text[place[inside]]
    return out


def blocks(seq: tuple[np.ndarray, np.ndarray], qual: tuple[np.ndarray, np.ndarray] | None, start: np.ndarray, length: np.ndarray, step: int = 32) -> Iterator[Block]:
    """Blocks covering all rows, each padded to a multiple of `step`, so that little of a matrix is padding."""
    group = -(-length // step)
    for g in np.unique(group):
        rows = np.flatnonzero(group == g)
        width = max(1, int(length[rows].max(initial=0)))
        yield Block(rows, length[rows], matrix(*seq, rows, start, length, width), matrix(*qual, rows, start, length, width) if qual is not None else None)
