"""Sets of 32-bit integers in the public Roaring formats: portable and frozen. Arrow UDFs over numpy."""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf

# Fixed values of the formats: cookies, fewest containers for which a run file has offsets, container codes of the frozen form.
PLAIN, RUNS, FROZEN = 12346, 12347, 13766
OFFSETS_FROM = 4
ARRAY_MOST, BITMAP_BYTES = 4096, 8192
F_BITMAP, F_ARRAY, F_RUN = 1, 2, 3


def _runs(low: np.ndarray) -> np.ndarray:
    """(start, length - 1) of each run of sorted distinct numbers."""
    breaks = np.flatnonzero(np.diff(low.astype(np.int64)) != 1)
    first, last = np.append(0, breaks + 1), np.append(breaks, len(low) - 1)
    return np.stack([low[first], low[last] - low[first]], 1).astype("<u2")


def _containers(values, optimize: bool):
    v = np.unique(np.asarray(list(values) if not isinstance(values, np.ndarray) else values, np.int64))
    if len(v) and (v[0] < 0 or v[-1] >= 1 << 32):
        raise ValueError("a set holds numbers from 0 to 2**32 - 1")
    keys, starts = np.unique(v >> 16, return_index=True)
    for key, low in zip(keys.tolist(), np.split(v & 0xFFFF, starts[1:]), strict=True) if len(v) else ():
        runs = _runs(low)
        plain = 2 * len(low) if len(low) <= ARRAY_MOST else BITMAP_BYTES
        if optimize and 2 + 4 * len(runs) <= plain:
            yield key, len(low), "run", runs
        elif len(low) <= ARRAY_MOST:
            yield key, len(low), "array", low.astype("<u2")
        else:
            bits = np.zeros(1 << 16, np.uint8)
            bits[low] = 1
            yield key, len(low), "bitmap", np.packbits(bits, bitorder="little")


def encode(values, optimize: bool = True) -> bytes:
    """The portable form; with `optimize` containers become runs where that is no longer."""
    own = list(_containers(values, optimize))
    n, any_run = len(own), any(kind == "run" for _, _, kind, _ in own)
    descriptions = b"".join(struct.pack("<HH", key, count - 1) for key, count, _, _ in own)
    bodies = [struct.pack("<H", len(x)) + x.tobytes() if kind == "run" else x.tobytes() for _, _, kind, x in own]
    if any_run:
        marks = np.packbits([kind == "run" for _, _, kind, _ in own], bitorder="little").tobytes()
        head = struct.pack("<I", RUNS | (n - 1) << 16) + marks + descriptions
    else:
        head = struct.pack("<II", PLAIN, n) + descriptions
    if not any_run or n >= OFFSETS_FROM:
        at, offsets = len(head) + 4 * n, []
        for b in bodies:
            offsets.append(at)
            at += len(b)
        head += struct.pack(f"<{n}I", *offsets)
    return head + b"".join(bodies)


def _expand(runs: np.ndarray) -> np.ndarray:
    return np.concatenate([np.arange(int(s), int(s) + int(k) + 1) for s, k in runs]) if len(runs) else np.zeros(0, np.int64)


def decode(raw: bytes) -> np.ndarray:
    """Sorted numbers of a portable form; ValueError for bytes that are none."""
    try:
        (cookie,) = struct.unpack_from("<I", raw)
        at = 4
        if cookie & 0xFFFF == RUNS:
            n = (cookie >> 16) + 1
            marks = np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8, at), bitorder="little")[:n].astype(bool)
            at += (n + 7) // 8
        elif cookie == PLAIN:
            (n,) = struct.unpack_from("<I", raw, at)
            at += 4
            if n > 1 << 16:
                raise ValueError("too many containers")
            marks = np.zeros(n, bool)
        else:
            raise ValueError(f"no set begins with {cookie}")
        described = np.frombuffer(raw, "<u2", 2 * n, at).reshape(n, 2)
        at += 4 * n + (4 * n if cookie == PLAIN or n >= OFFSETS_FROM else 0)
        parts = []
        for (key, less), run in zip(described.tolist(), marks, strict=True):
            if run:
                (k,) = struct.unpack_from("<H", raw, at)
                low = _expand(np.frombuffer(raw, "<u2", 2 * k, at + 2).reshape(k, 2))
                at += 2 + 4 * k
            elif less + 1 <= ARRAY_MOST:
                low = np.frombuffer(raw, "<u2", less + 1, at).astype(np.int64)
                at += 2 * (less + 1)
            else:
                low = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, BITMAP_BYTES, at), bitorder="little"))
                at += BITMAP_BYTES
            parts.append(low + (key << 16))
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)
    except (struct.error, ValueError) as e:
        raise ValueError(f"bytes are no set: {e}") from e


def freeze(values, optimize: bool = True) -> bytes:
    """The frozen form: all bitmaps, runs, arrays, keys, counts and codes in turn, then the header."""
    own = list(_containers(values, optimize))
    by = {kind: b"".join(x.tobytes() for _, _, k, x in own if k == kind) for kind in ("bitmap", "run", "array")}
    keys = struct.pack(f"<{len(own)}H", *[key for key, *_ in own])
    counts = struct.pack(f"<{len(own)}H", *[len(x) if kind == "run" else count - 1 for _, count, kind, x in own])
    codes = bytes({"bitmap": F_BITMAP, "array": F_ARRAY, "run": F_RUN}[kind] for _, _, kind, _ in own)
    return by["bitmap"] + by["run"] + by["array"] + keys + counts + codes + struct.pack("<I", FROZEN | len(own) << 15)


def thaw(raw: bytes) -> np.ndarray:
    """Sorted numbers of a frozen form."""
    (head,) = struct.unpack_from("<I", raw, len(raw) - 4)
    if head & 0x7FFF != FROZEN:
        raise ValueError("bytes are no frozen set")
    n = head >> 15
    at = len(raw) - 4 - 5 * n
    keys, counts, codes = np.frombuffer(raw, "<u2", n, at), np.frombuffer(raw, "<u2", n, at + 2 * n), raw[at + 4 * n : at + 5 * n]
    n_runs = sum(int(c) for c, k in zip(counts, codes, strict=True) if k == F_RUN)
    at_run = BITMAP_BYTES * codes.count(F_BITMAP)
    at_bitmap, at_array, parts = 0, at_run + 4 * n_runs, []
    for key, count, code in zip(keys.tolist(), counts.tolist(), codes, strict=True):
        if code == F_BITMAP:
            low = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, BITMAP_BYTES, at_bitmap), bitorder="little"))
            at_bitmap += BITMAP_BYTES
        elif code == F_RUN:
            low = _expand(np.frombuffer(raw, "<u2", 2 * count, at_run).reshape(count, 2))
            at_run += 4 * count
        else:
            low = np.frombuffer(raw, "<u2", count + 1, at_array).astype(np.int64)
            at_array += 2 * (count + 1)
        parts.append(low + (key << 16))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def frozen_size(values) -> int:
    return len(freeze(values))


def to_base64(values) -> str:
    return base64.b64encode(encode(values)).decode()


def from_base64(text: str) -> np.ndarray:
    return decode(base64.b64decode(text))


def udfs():
    """(array<bigint> -> binary, binary -> array<bigint>, array -> frozen, frozen -> array) as Arrow UDFs."""
    def each(f, kind):
        def run(col: pa.Array) -> pa.Array:
            return pa.array([None if x is None else f(x) for x in col.to_pylist()], kind)

        return run

    ints = pa.list_(pa.int64())
    return (
        arrow_udf(each(encode, pa.binary()), "binary"), arrow_udf(each(lambda b: decode(b).tolist(), ints), "array<bigint>"),
        arrow_udf(each(freeze, pa.binary()), "binary"), arrow_udf(each(lambda b: thaw(b).tolist(), ints), "array<bigint>"),
    )
