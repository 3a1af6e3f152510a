"""Cross-tokenizer alignment by sparse incidence products.

Every text is encoded by two tokenizers, A (byte-level BPE) and B (sentence
pieces). Tokens and the bytes they stand for are incidence matrices in CSR form,
built by hand from the tokens' lengths. Gustavson's row-by-row product A·Bᵀ over
the bytes has an entry wherever two tokens overlap: the links, valued with the
bytes they share. Offsets where tokens of both sides end cut the text into groups;
the product of the token-group incidences has an entry for every pair of a shared
group. Of that product only the size is formed (its symbolic phase), as a group
without a common offset for long would make it quadratic.

How often a pair of ids is linked is counted over the corpus:

1. One pass encodes the texts into blocks (a task's slices up to ``block_bytes`` of
   text) and writes the ids, 16 bits each where that holds the vocabulary, bucketed by
   block into the shared folder. Texts are tokenized once and never shuffled.
2. Every block lists its distinct pairs with their number. They are summed by pair
   (with partial aggregation), the highest count of each B id is found, and both
   return to the blocks that hold the pair. What is shuffled are distinct pairs of
   blocks: a frequent pair is one row for each block.
3. The bucketed table meets the answers by block without being shuffled.

Texts that are NULL or empty, or whose joined token bytes (of A or B) differ from
blank + text, have no tokens: zeros and empty groups. Rows with the same ``doc_id``
are aligned each for itself; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _byte_letters
from .common import block_count, checkpointed, ensure_checkpoint_dir, id_text, slices
from .token_count import read_spec

SPACE_SIGN = "▁"
#: Characters outside the ranges that all Unicode versions of the last years class alike.
RECENT = re.compile("[^\x00-\u036f\u0400-\u0525\u2000-\u2bff\u3000-\u312d\u4e00-\u9fa5\uac00-\ud7a3\uff00-\uffef\U0001f300-\U0001f64f]")


class Vocabulary:
    """Bytes of every id in one buffer with an offset table, and the encoder."""

    def __init__(self, spec: str | bytes):
        if isinstance(spec, str):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_str(spec)
            self.model.no_truncation()
            self.model.no_padding()
            self.model.encode_special_tokens = True  # special strings in a text are plain text
            self.blank = " "
            letters, parsed = _byte_letters(), json.loads(spec)
            self.quick = self._quick(parsed, letters)
            names = {i: t.encode() if t not in parsed["model"]["vocab"] else bytes(letters[c] for c in t)
                     for t, i in parsed["model"]["vocab"].items() | {(t["content"], t["id"]) for t in parsed["added_tokens"]}}
            tokens = [names.get(i, b"") for i in range(max(names) + 1)]
        else:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_proto=spec)
            self.blank = ""  # the model adds it
            pieces = ((i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))
            tokens = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in pieces]
        self.size = len(tokens)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    def _quick(self, parsed: dict, letters: dict[str, int]):
        """The same vocabulary in the faster library that merges by rank, if the file says no more than it
        can express: plain byte-level pieces, ids of merged tokens in the order of the merges."""
        model, cut = parsed["model"], parsed["pre_tokenizer"]
        plain = (parsed["normalizer"] is None and cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
                 and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if not plain or made != sorted(set(made)):
            return None
        import public_tokenizers
        import tiktoken

        added = {t["content"] for t in parsed["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
        return tiktoken.Encoding("quick", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of blank + text. Texts with characters that not all Unicode versions class
        alike go through the file's own library."""
        if not self.blank:
            return self.model.encode(texts, num_threads=1, return_type="numpy")
        texts = [self.blank + t for t in texts]
        slow = [i for i, t in enumerate(texts) if self.quick is None or RECENT.search(t)]
        out = dict(zip(slow, (np.array(e.ids, self.type) for e in self.model.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False))))
        return [out[i] if i in out else self.quick.encode_to_numpy(t) for i, t in enumerate(texts)]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the tokens stand for."""
        return self.bytes[ranges(self.offsets[ids], self.lengths[ids])]


@lru_cache(4)
def load(spec: str | bytes) -> Vocabulary:
    return Vocabulary(spec)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` for ``sizes[0]`` numbers, then those of the next."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Csr:
    """A matrix of zeros and ones: row ``i`` has entries in the columns ``columns[starts[i]:starts[i + 1]]``."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, width: int):
        self.starts, self.columns, self.width = starts, columns, width

    @staticmethod
    def of_runs(sizes: np.ndarray) -> Csr:
        """Row ``i`` covers the next ``sizes[i]`` columns (tokens over bytes)."""
        starts = np.concatenate([[0], np.cumsum(sizes)])
        return Csr(starts, np.arange(starts[-1]), int(starts[-1]))

    @staticmethod
    def of_labels(labels: np.ndarray, width: int) -> Csr:
        """Row ``i`` has its one entry in column ``labels[i]`` (tokens in groups)."""
        return Csr(np.arange(len(labels) + 1), labels, width)

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        if (np.diff(self.columns) < 0).any():
            rows = rows[np.argsort(self.columns, kind="stable")]
        return Csr(np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))]), rows, len(self.starts) - 1)

    def product(self, other: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gustavson: row ``i`` of the product gathers the rows of ``other`` that
        row ``i`` names, adding equal columns up. Row, column and value of its entries."""
        sizes = np.diff(other.starts)[self.columns]
        columns = other.columns[ranges(other.starts[self.columns], sizes)]
        rows = np.repeat(np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)), sizes)
        keys = rows * other.width + columns
        if len(keys) and (np.diff(keys) < 0).any():
            keys = np.sort(keys, kind="stable")
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[first] // other.width, keys[first] % other.width, np.diff(first, append=len(keys))

    def product_size(self, other: Csr) -> np.ndarray:
        """Symbolic phase: the number of entries of each row of the product, if rows have one entry each."""
        return np.diff(other.starts)[self.columns]


class Aligned:
    """Alignment of a run of documents whose tokens stand for the same bytes on both sides."""

    def __init__(self, a_lengths: np.ndarray, b_lengths: np.ndarray):
        over_a, over_b = Csr.of_runs(a_lengths), Csr.of_runs(b_lengths)
        self.link_a, self.link_b, self.shared_bytes = over_a.product(over_b.transposed())
        cuts = np.intersect1d(over_a.starts[1:], over_b.starts[1:], assume_unique=True)
        self.n_groups = len(cuts)
        self.cuts = cuts
        self.group_a = np.searchsorted(cuts, over_a.starts[1:])
        self.group_b = np.searchsorted(cuts, over_b.starts[1:])

    def group_links(self) -> np.ndarray:
        """For each A token, with how many B tokens it shares its group."""
        return Csr.of_labels(self.group_a, self.n_groups).product_size(Csr.of_labels(self.group_b, self.n_groups).transposed())


class Slice:
    """Documents of one slice: ids of both sides end to end, and how many each document has."""

    def __init__(self, a: Vocabulary, b: Vocabulary, a_ids: list[bytes], b_ids: list[bytes]):
        self.a, self.b = a, b
        self.ids_a, self.ids_b = (np.frombuffer(b"".join(x), v.type).astype(np.int64) for x, v in ((a_ids, a), (b_ids, b)))
        self.n_a, self.n_b = (np.array([len(i) // v.type.itemsize for i in x], np.int64) for x, v in ((a_ids, a), (b_ids, b)))
        self.aligned = Aligned(a.lengths[self.ids_a], b.lengths[self.ids_b])
        self.doc_of_a = np.repeat(np.arange(len(a_ids)), self.n_a)
        self.pairs = (self.ids_a[self.aligned.link_a] << 32) | self.ids_b[self.aligned.link_b]
        self.doc_of_link = self.doc_of_a[self.aligned.link_a]

    def per_document(self, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sums of whole numbers by document, exact in 64 bits."""
        out = np.zeros(len(self.n_a), np.int64)
        np.add.at(out, rows, values)
        return out

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every document."""
        last_a, last_b = (np.diff(g, append=-1) != 0 for g in (self.aligned.group_a, self.aligned.group_b))
        at_a = np.arange(len(self.ids_a)) + np.searchsorted(self.aligned.group_b, self.aligned.group_a)
        at_b = np.arange(len(self.ids_b)) + np.searchsorted(self.aligned.group_a, self.aligned.group_b, side="right")
        order = np.empty(len(self.ids_a) + len(self.ids_b), np.int64)
        order[at_a] = 2 * self.ids_a + last_a
        order[at_b] = 2 * (self.a.size + self.ids_b) + last_b
        names = written(self.a.size, self.b.size)
        ends = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        return ["".join(map(names.__getitem__, order[s:e].tolist()))[:-1] for s, e in zip(ends, ends[1:])]


@lru_cache(1)
def written(size_a: int, size_b: int) -> list[str]:
    """Every id with what follows it: ``,`` inside a group's side, ``|`` after its A ids, ``;`` after its B ids."""
    return [f"{i}{c}" for i in range(size_a) for c in ",|"] + [f"{i}{c}" for i in range(size_b) for c in ",;"]


def encoded(texts: list[str], a: Vocabulary, b: Vocabulary) -> tuple[list[bytes], list[bytes]]:
    """Packed ids of both sides; none where the bytes of either side are not blank + text."""
    want = [(" " + t).encode() if t else b"" for t in texts]
    sides = [[x if w else x[:0] for x, w in zip(v.encode(texts), want)] for v in (a, b)]
    bytes_wanted, sizes = np.frombuffer(b"".join(want), np.uint8), np.array(list(map(len, want)))
    same = np.ones(len(texts), bool)
    for v, ids in zip((a, b), sides):
        lengths = np.array([int(v.lengths[x].sum()) for x in ids])
        same &= lengths == sizes
        if (lengths == sizes).all() and np.array_equal(v.joined(np.concatenate(ids) if ids else np.zeros(0, int)), bytes_wanted):
            continue
        same &= [bool(s) and v.joined(x).tobytes() == w for s, x, w in zip(same, ids, want)]
    return tuple([x.astype(v.type).tobytes() if s else b"" for x, s in zip(ids, same)] for v, ids in zip((a, b), sides))


def merged(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order and the sums of their counts."""
    order = np.argsort(pairs, kind="stable")
    pairs, counts = pairs[order], counts[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], np.add.reduceat(counts, first) if len(first) else counts


class Pairs:
    """Distinct pairs of a block with their number; slices are merged when they have doubled it."""

    def __init__(self):
        self.kept, self.new, self.n_new = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0

    def add(self, pairs: np.ndarray) -> None:
        self.new.append(np.unique(pairs, return_counts=True))
        self.n_new += len(self.new[-1][0])
        if self.n_new > len(self.kept[0]) + (1 << 18):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.new:
            self.kept = merged(*(np.concatenate(x) for x in zip(self.kept, *self.new)))
            self.new, self.n_new = [], 0
        return self.kept


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def encode_blocks(docs: DataFrame, specs, block_bytes: int) -> DataFrame:
    """``block, doc_id, a, b``: packed ids of all texts, bucketed by block."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = map(load, specs.value)
        task, number, filled = TaskContext.get().partitionId(), 0, 0
        for part in slices(batches, 1 << 20):
            texts = part["text"].to_pylist()
            out_a, out_b = encoded(texts, a, b)
            if filled and filled + part["text"].nbytes > block_bytes:
                number, filled = number + 1, 0
            filled += part["text"].nbytes
            block = np.full(len(texts), (task << 32) + number, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block), part["doc_id"], pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], names=["block", "doc_id", "a", "b"])

    rows = id_text(docs)
    name = f"token_blocks_{uuid.uuid4().hex}"
    buckets = min(block_count(rows, block_bytes), 100_000)  # Spark's limit; a bucket may hold several blocks
    rows.mapInArrow(run, "block long, doc_id long, a binary, b binary").write.bucketBy(buckets, "block").option("compression", "zstd") \
        .option("path", f"{ensure_checkpoint_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files stay in the shared folder
    return table


def pair_counts(blocks: DataFrame, specs) -> DataFrame:
    """``block, pair, n``: the distinct pairs (A id in the high half, B id in the low) of each block's part of a partition."""
    schema = pa.schema([("block", pa.int64()), ("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = map(load, specs.value)
        held, block = Pairs(), None

        def flush():
            pairs, n = held.merge()
            for at in range(0, len(pairs), 1 << 16):
                p = pairs[at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), block, np.int64)), pa.array(p), pa.array(n[at:at + (1 << 16)])], schema=schema)

        for batch in batches:
            ids = batch["block"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]]).tolist()
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                if block is not None and ids[s] != block:
                    yield from flush()
                    held = Pairs()
                block = int(ids[s])
                for part in slices(iter([batch.slice(s, e - s)]), 1 << 20):
                    held.add(Slice(a, b, part["a"].to_pylist(), part["b"].to_pylist()).pairs)
        if block is not None:
            yield from flush()

    return blocks.select("block", "a", "b").mapInArrow(run, "block long, pair long, n long")


def align(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None, block_bytes: int = 16 << 20) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_group_links, n_best, count_sum, groups`` of every row.

    ``n_links`` pairs of tokens overlap, ``n_group_links`` share a group; ``n_best``
    links have the highest count of their B id in the corpus, ``count_sum`` adds the
    counts of all links; ``groups`` lists the ids as ``a1,a2|b1;a3|b2,b3``."""
    default = default_paths()
    paths = (tokenizer_a or default[0], tokenizer_b or default[1])
    specs = docs.sparkSession.sparkContext.broadcast([read_spec(p) for p in paths])
    blocks = encode_blocks(docs, specs, block_bytes)
    found = checkpointed(pair_counts(blocks, specs))
    counts = found.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b_id", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    best = counts.groupBy(F.col("b_id").alias("best_of")).agg(F.max("count").alias("most"))
    known = counts.join(best, F.col("b_id") == F.col("best_of")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = found.select("block", "pair").join(known, "pair").select("block", "pair", "count", "best")
    fields = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_group_links", "n_best", "count_sum")), ("groups", pa.string())]

    def run(rows: pa.Table, table: pa.Table) -> pa.Table:
        a, b = map(load, specs.value)
        pairs, count, is_best = table["pair"].to_numpy(), table["count"].to_numpy(), table["best"].to_numpy()
        order = np.argsort(pairs, kind="stable")
        pairs, count, is_best = pairs[order], count[order], is_best[order]
        out = []
        for part in slices(iter(rows.to_batches()), 1 << 20):
            s = Slice(a, b, part["a"].to_pylist(), part["b"].to_pylist())
            at = np.searchsorted(pairs, s.pairs)
            n = len(s.n_a)
            ends = np.concatenate([[0], np.cumsum(np.bincount(s.doc_of_a, a.lengths[s.ids_a], minlength=n).astype(np.int64))])
            n_groups = np.diff(np.searchsorted(s.aligned.cuts, ends, side="right"))
            out.append(pa.RecordBatch.from_arrays([
                part["doc_id"], pa.array(s.n_a), pa.array(s.n_b), pa.array(n_groups), pa.array(np.bincount(s.doc_of_link, minlength=n)),
                pa.array(s.per_document(s.aligned.group_links(), s.doc_of_a)), pa.array(s.per_document(is_best[at].astype(np.int64), s.doc_of_link)),
                pa.array(s.per_document(count[at], s.doc_of_link)), pa.array(s.groups(), pa.string())], schema=pa.schema(fields)))
        return pa.Table.from_batches(out, schema=pa.schema(fields))

    ddl = ", ".join(f"{c} {'string' if c == 'groups' else 'long'}" for c, _ in fields)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, ddl)
