"""Substring dedup: words covered by a window of words seen earlier are removed.

Documents are dealt once into blocks of a few MB by a hash of ``doc_id``; all
three passes below use that one shuffle of the text.

1. Each block sketches its windows: ``depth`` rows of counters, kept sparse
   (sorted cells, a cell twice if the block holds it twice or more). Sketches
   are cut by cell range; each range is merged into one dense piece of the
   count-min sketch and answers, for each block's cells, whether the merged
   count is two or more. Counts only ever overestimate.
2. Windows that every row estimates as repeated go, once per block with the
   block's earliest document, to a shard by their 128-bit fingerprint, which
   finds the earliest occurrence of each: the exact grouping. It answers, for
   each block's windows, whether an earlier one exists elsewhere.
3. Each block removes the words covered by windows with an earlier occurrence,
   in another block (the answer) or in itself.

The sketch grows with the corpus (``load`` cells for each window, cut into
pieces of ``piece`` cells), so the share of falsely repeated windows stays the
same at any size. Hot passages meet once per block. Nothing reaches the
driver but the size of the text.

Empty and NULL texts have no words. Rows with the same ``doc_id`` are separate
documents ordered by text; a NULL ``doc_id`` comes last. An empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count, id_text
from .words import P_HIGH, P_LOW, run_hashes, run_starts, word_hashes, word_ids

MESSAGE = "block long, shard long, kind int, data binary, more binary"
SCHEMA = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("kind", pa.int32()), ("data", pa.binary()), ("more", pa.binary())])
ANSWER, ENTRY, MASK = 0, 1, 2


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers in as many bytes each as the largest needs (told in the first byte)."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return out.view("<u8").ravel()


def pack_ids(ids: np.ndarray) -> bytes:
    """Signed numbers as the smallest one and the distances from it."""
    return ids.min().tobytes() + pack(ids.view(np.uint64) - ids.min().view(np.uint64))


def unpack_ids(data: bytes) -> np.ndarray:
    return (unpack(data[8:]) + np.frombuffer(data, np.uint64, 1)).view(np.int64)


def _messages(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)] if rows else [pa.array([], t) for t in SCHEMA.types], schema=SCHEMA)


class Block:
    """The windows of one block of documents, in the order of (doc_id, text, position)."""

    def __init__(self, table: pa.Table, size: int, depth: int, width_bits: int, piece_bits: int):
        order = [("no_id", "ascending"), ("doc_id", "ascending"), ("text", "ascending")]
        self.table = table.append_column("no_id", table["doc_id"].is_null()).sort_by(order)
        self.size, self.depth, self.width_bits, self.piece_bits = size, depth, width_bits, piece_bits
        self.number = table["block"][0].as_py()
        ids, self.starts, words = word_ids(self.table["text"].combine_chunks())
        self.n = len(ids)
        at = run_starts(self.starts, size)
        high, low = word_hashes(ids, words) if self.n else (np.zeros(0, np.uint64),) * 2
        self.at = at
        self.high, self.low = run_hashes(high, size, P_HIGH)[at] if len(at) else high[:0], run_hashes(low, size, P_LOW)[at] if len(at) else low[:0]

    def cells(self):
        """For each row of the sketch and each piece: piece, its distinct cells
        (sorted, within the piece), whether this block holds each twice."""
        for row, h in zip(range(self.depth), (self.high, self.low)):
            cells, counts = np.unique(h >> np.uint64(64 - self.width_bits), return_counts=True)
            pieces = cells >> np.uint64(self.piece_bits)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(pieces)) + 1, [len(cells)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a:
                    number = row * (1 << (self.width_bits - self.piece_bits)) + int(pieces[a])
                    yield row, number, cells[a:b], counts[a:b] > 1

    def sketch(self) -> pa.Table:
        mask = np.uint64((1 << self.piece_bits) - 1)
        rows = []
        for _, number, cells, twice in self.cells():
            local = np.repeat(cells & mask, 1 + twice)
            rows.append((self.number, number, ANSWER, pack(np.diff(local, prepend=np.uint64(0))), None))
        return _messages(rows)

    def repeated(self, answers: dict[int, bytes]) -> np.ndarray:
        """Windows (as positions in ``at``) that all rows estimate as repeated."""
        keep = np.ones(len(self.at), bool)
        found: list[list[np.ndarray]] = [[] for _ in range(self.depth)]
        for row, number, cells, _ in self.cells():
            bits = np.unpackbits(np.frombuffer(answers[number], np.uint8), count=len(cells)).astype(bool)
            found[row].append(cells[bits])
        for row, h in zip(range(self.depth), (self.high, self.low)):
            hot = np.concatenate(found[row]) if found[row] else np.zeros(0, np.uint64)
            cells = h >> np.uint64(64 - self.width_bits)
            where = np.searchsorted(hot, cells)
            keep &= (hot[np.minimum(where, len(hot) - 1)] == cells) if len(hot) else False
        return np.flatnonzero(keep)

    def groups(self, windows: np.ndarray):
        """The given windows sorted by fingerprint, then position, and which of them come first of their kind."""
        order = windows[np.lexsort((windows, self.low[windows], self.high[windows]))]
        high, low = self.high[order], self.low[order]
        first = np.ones(len(order), bool)
        first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        return order, first

    def shards(self, firsts: np.ndarray):
        """Cut the sorted first windows by the top bits of their fingerprint."""
        bits = self.width_bits - self.piece_bits
        number = self.high[firsts] >> np.uint64(64 - bits) if bits else np.zeros(len(firsts), np.uint64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(firsts)]])
        return [(int(number[a]), a, b) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]

    def entries(self, answers: dict[int, bytes]) -> pa.Table:
        windows = self.repeated(answers)
        order, first = self.groups(windows)
        firsts = order[first]
        doc = np.searchsorted(self.starts, self.at[firsts], side="right") - 1
        ids = self.table["doc_id"].fill_null((1 << 63) - 1).to_numpy().astype(np.int64)[doc]
        rows = [(self.number, n, ENTRY, np.stack([self.high[firsts[a:b]], self.low[firsts[a:b]]]).tobytes(), pack_ids(ids[a:b]))
                for n, a, b in self.shards(firsts)]
        kept = np.zeros(len(self.at), bool)
        kept[windows] = True
        rows.append((self.number, self.number, MASK, np.packbits(kept).tobytes(), None))
        return _messages(rows)

    def removed(self, mask: bytes, answers: dict[int, bytes]) -> np.ndarray:
        """Which words go."""
        windows = np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=len(self.at)))
        order, first = self.groups(windows)
        firsts = np.flatnonzero(first)
        earlier = np.zeros(len(firsts), bool)
        for n, a, b in self.shards(order[firsts]):
            earlier[a:b] = np.unpackbits(np.frombuffer(answers[n], np.uint8), count=b - a)
        covered = ~first
        covered[firsts] = earlier
        steps = np.zeros(self.n + 1, np.int32)
        at = self.at[order[covered]]
        steps[at] += 1  # positions are distinct
        steps[at + self.size] -= 1
        return np.cumsum(steps[:-1]) > 0


def _merge_piece(table: pa.Table, piece_bits: int) -> pa.Table:
    """One piece of the merged sketch: counters up to two; the answer for each block."""
    counts = np.zeros(1 << piece_bits, np.uint8)
    cells = [np.cumsum(unpack(d), dtype=np.uint64) for d in table["data"].to_pylist()]
    distinct = []
    for c in cells:
        new = np.ones(len(c), bool)
        new[1:] = c[1:] != c[:-1]
        d = c[new]
        distinct.append(d)
        counts[d] = np.minimum(counts[d] + 1, 2)
        counts[c[~new]] = 2
    return _messages([(b, s, ANSWER, np.packbits(counts[d] > 1).tobytes(), None)
                      for b, s, d in zip(table["block"].to_pylist(), table["shard"].to_pylist(), distinct)])


def _earliest(table: pa.Table) -> pa.Table:
    """The exact grouping of one shard; masks pass through to their block."""
    rows, high, low, ids, blocks = [], [], [], [], []
    for r in table.to_pylist():
        if r["kind"] == MASK:
            rows.append((r["block"], r["shard"], MASK, r["data"], None))
            continue
        h, lo = np.frombuffer(r["data"], np.uint64).reshape(2, -1)
        high.append(h)
        low.append(lo)
        ids.append(unpack_ids(r["more"]))
        blocks.append((r["block"], r["shard"], len(h)))
    if blocks:
        h, lo, doc = map(np.concatenate, (high, low, ids))
        order = np.lexsort((doc, lo, h))
        first = np.ones(len(order), bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (lo[order][1:] != lo[order][:-1])
        earlier = np.empty(len(order), bool)
        earlier[order] = ~first
        at = 0
        for block, shard, n in blocks:
            rows.append((block, shard, ANSWER, np.packbits(earlier[at:at + n]).tobytes(), None))
            at += n
    return _messages(rows)


def _answers(table: pa.Table) -> tuple[dict[int, bytes], bytes]:
    answers, mask = {}, b""
    for kind, shard, data in zip(table["kind"].to_pylist(), table["shard"].to_pylist(), table["data"].to_pylist()):
        if kind == MASK:
            mask = data
        else:
            answers[shard] = data
    return answers, mask


def substring_dedup(docs: DataFrame, window: int = 20, depth: int = 2, load: int = 8, piece_bits: int = 24, block_bytes: int = 4 << 20) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for each input row."""
    rows = id_text(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = block_count(rows, block_bytes)
    width_bits = max(piece_bits, int(max(1, load * total // 6)).bit_length())
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))

    def block(table: pa.Table) -> Block:
        return Block(table, window, depth, width_bits, piece_bits)

    def sketch(table: pa.Table) -> pa.Table:
        return block(table).sketch()

    def merge(table: pa.Table) -> pa.Table:
        return _merge_piece(table, piece_bits)

    def entries(left: pa.Table, right: pa.Table) -> pa.Table:
        return block(left).entries(_answers(right)[0])

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        answers, mask = _answers(right)
        b = block(left)
        gone = b.removed(mask, answers)
        n_gone = np.concatenate([[0], np.cumsum(gone)])[b.starts]
        texts, kept = b.table["text"].cast(pa.binary()).to_pylist(), []
        for i, text in enumerate(texts):
            words = text.split()
            if n_gone[i + 1] > n_gone[i]:
                words = compress(words, (~gone[b.starts[i]:b.starts[i + 1]]).tolist())
            kept.append(b" ".join(words))
        return pa.table({"doc_id": b.table["doc_id"].combine_chunks(), "n_words": pa.array(np.diff(b.starts), pa.int64()), "n_removed": pa.array(np.diff(n_gone), pa.int64()),
                         "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    by_block = dealt.groupBy("block")
    merged = by_block.applyInArrow(sketch, MESSAGE).groupBy("shard").applyInArrow(merge, MESSAGE)
    found = by_block.cogroup(merged.groupBy("block")).applyInArrow(entries, MESSAGE).groupBy("shard").applyInArrow(_earliest, MESSAGE)
    return by_block.cogroup(found.groupBy("block")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept_text string")
