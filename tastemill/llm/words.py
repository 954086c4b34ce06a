"""Words of whole texts as arrays: the helpers of the operators that run numpy inside Spark's tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x ^= x >> np.uint64(27)
    x = x * MIX_2
    x ^= x >> np.uint64(31)
    return x


def split(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all words ``[^\\x20\\x09-\\x0D]+``, where each text's codes begin (one more at the end), and the words by code."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    encoded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    codes, words, bounds = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary, bounds - bounds[0]
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        full = codes != empty
        bounds = np.r_[0, np.cumsum(full)][bounds]
        codes = codes[full]
    return codes, bounds, words


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words, the same in every process: a polynomial of their bytes and their length."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, offsets, data = words.cast(pa.large_string()).buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    text = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(text), BASE)])
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(len(text), BASE_INVERSE)])
    prefix = np.r_[np.uint64(0), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[:-1])]
    return mix(mix((prefix[at[1:]] - prefix[at[:-1]]) * inverse[at[:-1]]) + np.diff(at).astype(np.uint64))


def hashed(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    codes, bounds, words = split(texts, lower)
    return word_hashes(words)[codes], bounds


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of ``starts[i] .. starts[i] + lengths[i]`` of all i in order."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - np.r_[0, ends[:-1]], lengths) + np.arange(ends[-1] if len(ends) else 0)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values))
