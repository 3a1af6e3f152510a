"""MinHash near-dedup with SetSketch registers.

Each text is a set of word shingles. A register holds an exponentially spaced,
truncated minimum: ``floor(1 - log_base(min h))`` clipped to 16 bits, ``h``
being exponential for each shingle. Registers of a union are the larger of
each (``merge_registers``), and two sets agree in a register about as often as
their Jaccard similarity says.

1. One pass sketches every text; equal sets become one class (a row each from here).
2. Bands of registers deal the classes to buckets; buckets of one class are
   dropped. Every other class is linked with the bucket's smallest one first.
3. Candidate pairs are estimated by the joint likelihood of the register
   comparisons given both cardinalities; those that could reach the threshold
   are verified on their full shingle sets; verified links become components.
4. Buckets that still span two or more components are searched for all pairs of
   different components that could reach the threshold. Few pairs are verified
   one by one; a bucket dense with them is given the full sets once and counts
   inside its task, listing only links that connect. So no group is expanded
   into all its pairs, and no link between components stays untested. Buckets of
   many or long classes are cut into tasks of two chunks each.

A link that no band proposes is missed with probability (1 - s^rows)^bands: 3e-6
at similarity 0.8 with the parameters here.

Texts without words are linked with nothing. Rows with the same ``doc_id`` are
separate texts with that id. A NULL ``doc_id`` is kept as it is, counts as the
largest and is never the smallest id of others. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, id_text, slices, whole_row
from .words import P_HIGH, run_hashes, run_starts, word_hashes, word_ids

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base and rate of the registers.
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 1
#: A task holds the sets of two chunks of about so many shingles (8 bytes each).
CHUNK_SHINGLES = 4_000_000
SKETCH = "doc_id long, text_key long, n_shingles long, set_id binary, registers binary"


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased word shingles of each text (repeats
    included) and where each text's begin; a text of fewer words is one shingle."""
    ids, starts, words = word_ids(pc.ascii_lower(texts))
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h, _ = word_hashes(ids, words)
    lengths = np.diff(starts)
    counts = np.where(lengths == 0, 0, np.maximum(lengths - size + 1, 1))
    out_starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(out_starts[-1], np.uint64)
    if len(h) >= size:
        whole = run_hashes(h, size, P_HIGH)
        out[np.repeat(lengths >= size, counts)] = whole[run_starts(starts, size)]
    for n in range(1, size):
        short = np.flatnonzero(lengths == n)
        if len(short):
            out[out_starts[short]] = run_hashes(h, n, P_HIGH)[starts[short]] + np.uint64(n)
    return out, out_starts


def register_values(h: np.ndarray, starts: np.ndarray, registers: int = REGISTERS, seed: int = 7) -> np.ndarray:
    """SetSketch registers of each non-empty segment of ``h`` (texts x registers, 16 bits)."""
    keys = (h >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(seed)
    times = rng.integers(0, 1 << 32, registers, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    plus = rng.integers(0, 1 << 32, registers, dtype=np.uint64).astype(np.uint32)
    least = np.empty((registers, len(starts) - 1), np.uint32)
    at = 0
    while at < len(starts) - 1:  # pieces that stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + 32768, side="right")) - 1)
        to = min(to, len(starts) - 1)
        part = keys[starts[at]:starts[to]]
        cuts = starts[at:to] - starts[at]
        room = np.empty_like(part)
        for j in range(registers):
            np.bitwise_xor(part, plus[j], out=room)
            np.multiply(room, times[j], out=room)
            np.minimum.reduceat(room, cuts, out=least[j, at:to])
        at = to
    exponential = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0 ** 32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def likely_jaccard(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs, from the numbers of
    registers where the first is above or below the second and from both set sizes.

    With u and v the shares of the two sizes, a register is above with
    probability u - vJ, below with v - uJ and equal with J (for a base near 1);
    the maximum of the joint likelihood is a root of a quadratic equation."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    same = registers - above - below
    middle = u * u * (same + below) + v * v * (same + above)
    return (middle - np.sqrt(np.maximum(middle ** 2 - 4 * registers * same * (u * v) ** 2, 0))) / (2 * registers * u * v)


#: Stands for a NULL id where ids are compared: the largest.
NO_ID = (1 << 63) - 1


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, set_id, registers``; set_id and registers are
    NULL for empty sets, ``text_key`` is a hash of the text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("registers", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, starts = shingles(part["text"], size)
            full = np.diff(starts) > 0
            values = register_values(h, starts[np.append(full, True)]) if full.any() else None
            n, set_ids, registers, row = [], [], [], 0
            for a, b in zip(starts[:-1], starts[1:]):
                if a == b:
                    n.append(0)
                    set_ids.append(None)
                    registers.append(None)
                    continue
                distinct = np.sort(h[a:b])
                distinct = distinct[np.append(True, distinct[1:] != distinct[:-1])]
                n.append(len(distinct))
                set_ids.append(xxhash.xxh3_128_digest(distinct.tobytes()))
                registers.append(values[row].tobytes())
                row += 1
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_key"], pa.array(n, pa.int64()), pa.array(set_ids, pa.binary()), pa.array(registers, pa.binary())], schema=schema)

    return id_text(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(run, SKETCH)


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """``node, shingles`` (sorted distinct 64-bit hashes) of ``node, text, set_id``
    rows; a row whose text has another set (of a repeated id) gives none."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, starts = shingles(part["text"], size)
            sets = [np.unique(h[a:b]).tobytes() for a, b in zip(starts[:-1], starts[1:])]
            keep = pa.array([xxhash.xxh3_128_digest(s) == i for i, s in zip(part["set_id"].to_pylist(), sets)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part["node"], pa.array(sets, pa.binary())], schema=schema).filter(keep)

    return texts.mapInArrow(run, "node long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose full sets reach the similarity."""
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keep = []
            for x, y in zip(part["set_a"].to_pylist(), part["set_b"].to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([part["a"], part["b"]], schema=schema).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` after linking: each round every root moves to the neighbour
    of smallest hash, links shrink to those between different roots, until none is left."""
    while True:
        a, b = labels.toDF("a", "root_a"), labels.toDF("b", "root_b")
        links = checkpointed(links.join(a, "a").join(b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).filter("a <> b").distinct())
        if links.isEmpty():
            return labels
        ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = F.min(F.struct(F.xxhash64("b").alias("h"), "b"))
        moves = ways.groupBy("a").agg(best.alias("best")).filter(F.col("best") < F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b"))).select(F.col("a").alias("root"), F.col("best.b").alias("to"))
        labels = checkpointed(labels.join(moves, "root", "left").select("node", F.coalesce("to", "root").alias("root")))


def _close(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of register rows, and whether it may reach the floor."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    j = likely_jaccard(above.astype(float), below.astype(float), n_a.astype(float), n_b.astype(float))
    return j, j >= floor


TASK = ["key", "one", "two"]
FOUND = "key long, one long, two long, a long, b long"


def _candidates(table: pa.Table, floor: float, dense: int) -> pa.Table:
    """Pairs of one bucket (or of two chunks of it) that lie in different
    components and may reach the floor. A pair that also shares an earlier band
    is left to that band's bucket. With more than ``dense`` pairs for each
    class, the classes themselves are listed (b is NULL) in place of the pairs."""
    task = [table[c][0].as_py() for c in TASK]
    band = task[0] & (BANDS - 1)
    ids, roots, chunk = (table[c].to_numpy() for c in ("node", "root", "chunk"))
    regs = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint16).reshape(len(ids), REGISTERS)
    sizes = table["n_shingles"].to_numpy().astype(float)
    earlier = regs[:, :band * ROWS].reshape(len(ids), band, ROWS)
    pairs, involved = [], set()
    for i in range(len(ids)):
        # each pair once; of two chunks, pairs across them
        others = np.arange(i + 1, len(ids))
        others = others[(roots[others] != roots[i]) & ((chunk[others] != chunk[i]) | (task[1] == task[2])) & (np.minimum(sizes[others], sizes[i]) >= floor * np.maximum(sizes[others], sizes[i]))]
        if band and len(others):
            others = others[~(earlier[others] == earlier[i]).all(axis=2).any(axis=1)]
        if not len(others):
            continue
        _, near = _close(regs[others], np.broadcast_to(regs[i], (len(others), REGISTERS)), sizes[others], np.full(len(others), sizes[i]), floor)
        if near.any():
            involved.update([i, *others[near]])
            if len(pairs) <= dense * len(ids):
                pairs += [sorted((ids[i], ids[o])) for o in others[near]]
    rows = [(ids[i], None) for i in sorted(involved)] if len(pairs) > dense * len(ids) else pairs
    return pa.table({**{c: pa.array([v] * len(rows), t) for c, v, t in zip(TASK, task, [pa.int64()] * 3)},
                     "a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())})


def _dense_links(table: pa.Table, percent: int) -> pa.Table:
    """Links inside a dense bucket, found on the full sets: every pair of
    classes that isn't connected yet is counted, links that connect are listed
    (fewer than there are classes)."""
    ids, roots = table["node"].to_pylist(), table["root"].to_numpy().copy()
    sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(values), np.int32)
    links = []
    for i in range(len(ids)):
        own = flat[starts[i]:starts[i] + sizes[i]]
        mark[own] = 1
        others = np.flatnonzero((roots != roots[i]) & (np.arange(len(ids)) > i) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])))
        if len(others):
            lengths = sizes[others]
            ends = np.cumsum(lengths)
            at = np.repeat(starts[others] - (ends - lengths), lengths) + np.arange(ends[-1])
            shared = np.add.reduceat(mark[flat[at]], ends - lengths)
            for o in others[100 * shared >= percent * (lengths + sizes[i] - shared)]:
                if roots[o] != roots[i]:
                    links.append((ids[i], ids[o]))
                    roots[roots == roots[o]] = roots[i]
        mark[own] = 0
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def grouped(docs: DataFrame, size: int = 5, percent: int = 80, margin: float = 0.14, chunk_rows: int = 1024, dense: int = 4) -> DataFrame:
    """``doc_id, text_key, n_shingles, component, least`` for each input row: the number of its component and the
    smallest id in it (both NULL for texts without words, which are alone).

    ``margin`` is how far below the threshold an estimate may lie and still be
    verified (4.5 standard deviations of the estimate)."""
    floor = percent / 100 - margin
    rows = checkpointed(sketches(docs, size))
    big = F.lit(NO_ID)
    some = rows.filter("set_id is not null")
    classes = some.groupBy("set_id").agg(F.min(F.struct(F.coalesce("doc_id", big).alias("id"), "text_key", "n_shingles", "registers")).alias("r"))
    classes = checkpointed(classes.select(F.monotonically_increasing_id().alias("node"), "set_id", "r.id", "r.text_key", "r.n_shingles", "r.registers"))
    # a bucket's key holds its band in the lowest bits
    keys = F.array(*[F.xxhash64(F.substring("registers", 1 + 2 * ROWS * k, 2 * ROWS), F.lit(k)).bitwiseAND(F.lit(-BANDS)).bitwiseOR(F.lit(k)) for k in range(BANDS)])
    banded = classes.select("node", F.explode(keys).alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).filter("n > 1").select("key", "hub")
    members = checkpointed(banded.join(buckets, "key"))
    nodes = checkpointed(members.select("node").distinct().join(classes, "node"))
    # the full sets of everything that may ever be compared: the text of one document of each class
    keyed = id_text(docs).select(F.coalesce("doc_id", big).alias("id"), F.xxhash64("text").alias("text_key"), "text")
    texts = keyed.join(nodes.select("id", "text_key", "node", "set_id"), ["id", "text_key"]).select("node", "text", "set_id")
    sets = checkpointed(shingle_sets(texts, size).dropDuplicates(["node"]))

    first = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    reg = nodes.select("node", "n_shingles", "registers")
    sketched = first.join(reg.toDF("a", "n_a", "reg_a"), "a").join(reg.toDF("b", "n_b", "reg_b"), "b")
    pair_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            a, b = (np.frombuffer(b"".join(part[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("reg_a", "reg_b"))
            _, near = _close(a, b, part["n_a"].to_numpy(), part["n_b"].to_numpy(), floor)
            yield pa.RecordBatch.from_arrays([part["a"], part["b"]], schema=pair_schema).filter(pa.array(near))

    pairs = sketched.select("a", "b", "n_a", "n_b", "reg_a", "reg_b").mapInArrow(likely, "a long, b long")
    tested = checkpointed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = joined_components(nodes.select("node", F.col("node").alias("root")), checkpointed(verified(tested, sets, percent)))

    open_members = members.select("key", "node").join(labels, "node").join(reg, "node")
    spread = open_members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total")).filter("low <> high") \
        .select("key", F.ceil(F.greatest(F.col("n") / F.lit(chunk_rows), F.col("total") / F.lit(CHUNK_SHINGLES))).alias("chunks"))
    chunked = open_members.join(spread, "key").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    # a bucket of more chunks is one task for each two of them
    task = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("chunk")).alias("one"), F.greatest(c, F.col("chunk")).alias("two"))))
    tasks = chunked.withColumn("task", task).select("key", F.col("task.one").alias("one"), F.col("task.two").alias("two"), "chunk", "node", "root", "n_shingles", "registers")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def search(table: pa.Table) -> pa.Table:
        return _candidates(table, floor, dense)

    def count(table: pa.Table) -> pa.Table:
        return _dense_links(table, percent)

    found = checkpointed(tasks.repartition(parts, *TASK).groupBy(*TASK).applyInArrow(search, FOUND))
    new = found.filter("b is not null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
    full = found.filter("b is null").select(*TASK, F.col("a").alias("node")).join(labels, "node").join(sets, "node")
    counted = full.repartition(parts, *TASK).groupBy(*TASK).applyInArrow(count, "a long, b long")
    labels = joined_components(labels, checkpointed(verified(new, sets, percent).unionByName(counted)))
    least = labels.join(nodes.select("node", "id"), "node").groupBy("root").agg(F.min("id").alias("least"))
    component = labels.join(least, "root").select("node", "root", "least")
    alone = classes.select("set_id", "node", "id").join(component, "node", "left").select(
        "set_id", F.coalesce("root", "node").alias("component"), F.coalesce("least", "id").alias("least"))
    # texts without words stay out of the join, where they would share one key
    nothing = F.lit(None).cast("long")
    return some.join(alone, "set_id").unionByName(rows.filter("set_id is null").withColumns({"component": nothing, "least": nothing}))


def near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each input row (parameters of ``grouped``)."""
    out = grouped(docs, **parameters)
    component_id = F.when(F.col("least") == NO_ID, F.col("doc_id")).otherwise(F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)) & (F.col("doc_id").isNotNull() | F.col("component_id").isNull()))


def deduplicated(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, all their columns: of each component the one of the smallest id
    (a NULL id last, rows of one id by a hash of their text, equal rows once), and all texts without words."""
    key = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text_key")
    found = checkpointed(grouped(docs, **parameters).filter("component is not null").select("component", key.alias("key")))
    first = found.groupBy("component").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("component", "first")
    copies = found.join(first, "component")
    dropped = copies.filter("key <> first").select("key.id", "key.text_key").distinct()
    # equal rows (id and text) are told apart by their number; few rows
    twice = copies.filter("key = first").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key.id", "key.text_key")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(whole_row(docs).alias("own"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("text_key"))
    left = own.join(dropped, ["id", "text_key"], "left_anti")
    if twice.isEmpty():
        return left.select("own.*")
    nth = F.row_number().over(Window.partitionBy("id", "text_key").orderBy("id"))
    once = left.join(twice, ["id", "text_key"], "left_semi").withColumn("nth", nth).filter("nth = 1").drop("nth")
    return left.join(twice, ["id", "text_key"], "left_anti").unionByName(once).select("own.*")
