"""Words of Arrow text columns as numbers, and hashes of runs of words (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multipliers of the two run hashes and of the bit mixer.
P_HIGH, P_LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of each word in the slice's dictionary, where each text's words
    begin (one more entry at the end), and the dictionary."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten().dictionary_encode()
    ids, words = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    blank = pc.index(words, "").as_py() if len(words) else -1  # beside leading and trailing white space
    if blank >= 0:
        keep = ids != blank
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        ids = ids[keep]
    return ids, starts, words


def word_hashes(ids: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word."""
    digest = xxhash.xxh3_128_digest
    table = np.frombuffer(b"".join(map(digest, words.cast(pa.binary()).to_pylist())), np.uint64).reshape(-1, 2)
    return table[ids, 0], table[ids, 1]


def run_hashes(h: np.ndarray, size: int, p: np.uint64) -> np.ndarray:
    """Polynomial hash of each run of ``size`` neighbours, built by doubling."""
    if len(h) < size:
        return h[:0]
    out, have, power, step, step_power = None, 0, None, h, p
    width = 1
    while True:
        if size & width:
            if out is None:
                out, have, power = step, width, step_power
            else:  # `out` covers what follows the next `width` words
                n = len(h) - (have + width) + 1
                out = step[:n] * power + out[width:width + n]
                have, power = have + width, np.uint64(int(power) * int(step_power) % 2 ** 64)
        width *= 2
        if width > size:
            break
        half = width // 2
        n = len(step) - half
        step = step[:n] * step_power + step[half:half + n]
        step_power = np.uint64(int(step_power) ** 2 % 2 ** 64)
    out = out[:len(h) - size + 1]
    out = (out ^ (out >> np.uint64(31))) * MIX
    return out ^ (out >> np.uint64(29))


def run_starts(starts: np.ndarray, size: int) -> np.ndarray:
    """Positions in the flat words where a run of ``size`` words of one text begins."""
    lengths = np.maximum(np.diff(starts) - size + 1, 0)
    first = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return first + np.arange(len(first))
