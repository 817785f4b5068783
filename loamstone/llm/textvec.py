"""Vectorised word hashing over the byte buffers of Arrow string columns."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Bytes of text that are expanded at once; a longer text is expanded alone.
CHUNK_BYTES = 1 << 20

#: Words of more bytes are hashed one by one.
LONG_WORD = 256


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A-Z as a-z, all other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: The low bytes of a lane that belong to a word, by their number.
_LANE = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U)

WHITESPACE = np.zeros(256, dtype=bool)
WHITESPACE[[9, 10, 11, 12, 13, 32]] = True

def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about CHUNK_BYTES of text; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(at, at[first] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = WHITESPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and offsets of each row's words in them; blank: which bytes are between words."""
    inside = ~blank[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]  # a word does not run on into the next row
    ends[cuts - 1] = inside[cuts - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def folded(data: np.ndarray) -> np.ndarray:
    """data with A-Z lower-cased and eight more bytes, as span_hashes() takes it."""
    out = np.zeros(len(data) + 8, dtype=np.uint8)
    np.take(FOLD, data, out=out[: len(data)])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of folded() bytes.

    The bytes are taken in lanes of eight, each mixed into the state by the
    bijection mix64, so spans of one length up to eight bytes never collide
    and longer ones only as random functions do; a polynomial modulo 2^64
    would have words that collide under every base.
    """
    size = stops - starts
    out = mix64(size.astype(U) * U(0x9E3779B97F4A7C15) + U(seed))
    if not len(out):
        return out
    lanes = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    short = size <= LONG_WORD
    at = np.flatnonzero(short & (size > 0))
    done = 0
    while len(at):
        lane = lanes[starts[at] + done] & _LANE[np.minimum(size[at] - done, 8)]
        out[at] = mix64((out[at] * U(0xD6E8FEB86659FD93)) ^ lane)
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(~short).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : stops[i]].tobytes(), seed)
    return out


def shingle_sets(hashes: np.ndarray, rows: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles; with fewer words the whole row is one."""

    def chain(parts):
        x = mix64(parts[0] + U(len(parts)))
        for p in parts[1:]:
            x = mix64(x * U(0xD6E8FEB86659FD93) + p)
        return x

    many = max(len(hashes) - n + 1, 0)
    full = chain([hashes[j : j + many] for j in range(n)]) if many else np.zeros(0, dtype=U)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(full[a : b - n + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            yield chain([hashes[j : j + 1] for j in range(a, b)])
        else:
            yield np.zeros(0, dtype=U)


def _rank(*columns: np.ndarray) -> np.ndarray:
    """Numbers for the rows of some columns of numbers below 2^31, equal exactly where the rows are."""
    x = columns[0]
    for y in columns[1:]:
        x = x * (int(y.max()) + 1) + y
        x = np.unique(x, return_inverse=True)[1].astype(np.int64)
    return x


def word_numbers(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Numbers for words of folded() bytes, equal exactly where the words are: words that hash alike are compared."""
    h = span_hashes(data, starts, stops)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    size, twin = stops - starts, first[number]
    same = size == size[twin]
    lanes = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    at, done = np.flatnonzero(same & (size <= LONG_WORD) & (twin != np.arange(len(h)))), 0
    while len(at):
        differ = (lanes[starts[at] + done] ^ lanes[starts[twin[at]] + done]) & _LANE[np.minimum(size[at] - done, 8)]
        same[at[differ != 0]] = False
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(same & (size > LONG_WORD)).tolist():
        j = twin[i]
        same[i] = np.array_equal(data[starts[i] : stops[i]], data[starts[j] : stops[j]])
    if same.all():
        return number.astype(np.int64)
    names: dict[bytes, int] = {}
    return np.array([names.setdefault(data[a:b].tobytes(), len(names)) for a, b in zip(starts, stops, strict=True)], dtype=np.int64)


def exact_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the sorted numbers of its distinct n-word shingles; among these texts equal shingles, and no others, have equal numbers."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = folded(np.frombuffer(b"".join(texts), dtype=np.uint8))
    starts, stops, rows = words(data[:-8], offsets)
    if not len(starts):
        return [np.zeros(0, dtype=np.int64) for _ in texts]
    single = word_numbers(data, starts, stops)
    full, have = single, 1
    while have < n <= len(single):  # numbers of longer runs from those of shorter ones
        step = min(have, n - have)
        tail = full if step == have else _runs(single, step)
        full, have = _rank(full[: len(full) - step], tail[have : have + len(full) - step]), have + step
    wholes: dict[tuple, int] = {}
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(full[a : b - n + 1]))
        elif b > a:
            out.append(np.array([-1 - wholes.setdefault(tuple(single[a:b].tolist()), len(wholes))], dtype=np.int64))
        else:
            out.append(np.zeros(0, dtype=np.int64))
    return out


def _runs(single: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the runs of n words, by first word."""
    many = max(len(single) - n + 1, 0)
    return _rank(*[single[j : j + many] for j in range(n)]) if many else np.zeros(0, dtype=np.int64)


def release_memory() -> None:
    """Give freed memory back to the system, as a Python worker lives on after its task; where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
