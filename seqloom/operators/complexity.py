"""Entropy in windows along a sequence: values, trims, masks and marks. Counts of a window are differences of running counts, over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3] * 2


def window_entropies(bases: str, window: int, k: int) -> np.ndarray:
    """Entropy of the k-mers of each window (A, C, G, T and anything else as a fifth symbol) over the logarithm of their number.

    A sequence shorter than the window is one window.
    """
    code = _CODE[np.frombuffer(bases.encode("latin-1", "replace"), np.uint8)].astype(np.int64)
    n = len(code) - k + 1
    if n < 1:
        return np.zeros(0)
    keys = sum(code[i : i + n] * 5 ** (k - 1 - i) for i in range(k))
    _, keys = np.unique(keys, return_inverse=True)
    size = min(window - k + 1, n)
    out, table = [], np.r_[0.0, np.arange(1, size + 1) / size]
    table[1:] *= -np.log(table[1:])
    span = max(1, 2_000_000 // (keys.max() + 1))
    for at in range(0, n - size + 1, span):  # a stretch of windows at a time
        part = keys[at : at + span + size - 1]
        running = np.zeros((len(part) + 1, keys.max() + 1), np.int32)
        running[np.arange(1, len(part) + 1), part] = 1
        np.cumsum(running, 0, out=running)
        out.append(table[running[size:] - running[:-size]].sum(1))
    return np.concatenate(out) / np.log(size) if size > 1 else np.zeros(n)


def low_spans(values: np.ndarray, length: int, window: int, least: float) -> np.ndarray:
    """Whether each symbol lies in a window with less entropy than ``least``."""
    low = np.flatnonzero(values < least)
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, low, 1)
    np.add.at(change, np.minimum(low + window, length), -1)
    return np.cumsum(change[:-1]) > 0


def windowed(reads: DataFrame, bases: str = "bases", window: int = 50, k: int = 5, least: float = 0.7, mode: str = "mark", symbol: str = "N") -> DataFrame:
    """Adds ``low_entropy`` (lowest of all windows), ``mean_entropy`` and ``low_bases``; ``mask`` replaces symbols of low windows, ``lower`` puts them in
    lower case, ``trim`` cuts them off both ends, ``mark`` leaves the sequence. A sequence without a k-mer has entropy 0 and is low throughout."""
    names, at = reads.columns, reads.columns.index(bases)

    def edited(text: str) -> tuple[str, float, float, int]:
        values = window_entropies(text, window, k)
        low = low_spans(values, len(text), window, least) if len(values) else np.ones(len(text), bool)
        if mode == "trim":
            good = np.flatnonzero(~low)
            text = text[good[0] : good[-1] + 1] if len(good) else ""
        elif mode != "mark" and low.any():
            symbols = np.array(list(text))
            symbols[low] = symbol if mode == "mask" else np.char.lower(symbols[low])
            text = "".join(symbols)
        return text, float(values.min()) if len(values) else 0.0, float(values.mean()) if len(values) else 0.0, int(low.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [edited(x) if x is not None else (None, None, None, None) for x in batch.column(at).to_pylist()]
            texts, lowest, mean, count = zip(*found, strict=True) if found else ((), (), (), ())
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lowest, pa.float64()), pa.array(mean, pa.float64()), pa.array(count, pa.int32())], names=[*names, "low_entropy", "mean_entropy", "low_bases"])

    more = [T.StructField("low_entropy", T.DoubleType()), T.StructField("mean_entropy", T.DoubleType()), T.StructField("low_bases", T.IntegerType())]
    return reads.mapInArrow(run, T.StructType([*reads.schema.fields, *more]))
