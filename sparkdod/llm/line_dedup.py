"""Line dedup over content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines decides whether a chunk may
end behind them. A chunk begins at every non-blank line and runs to the first border behind
its second line that the hash allows, or over ``longest`` lines. So it depends on
its own lines alone: a passage gives the same chunks whatever stands before and after it,
and a line added or taken shifts only the chunks that hold it.

1. Chunks are counted by hash. Those seen twice or more set bits in a bitmap of fixed
   size (``bitmap_bits``: 8 MB), which is broadcast to keep single chunks out of
   the following shuffles. It may let a single chunk through, never lose a repeated one.
2. Repeated chunks meet with their bytes, with partial aggregation (a hot chunk is one row
   per task): the least and the greatest text of a fingerprint are compared, and only if
   they are equal is the chunk the same everywhere. Fingerprints of unequal texts are grouped by the
   texts themselves.
3. Of each group the first one, by ``doc_id`` and place, stays; the lines of all others are
   removed. The first occurrence of a line always stays somewhere. Blank lines belong to no chunk
   and go only inside one.

NULL and empty texts have one blank line and lose nothing. Rows with the same
``doc_id`` are separate documents in the order of a hash of their text; rows of
the same id and text are one document listed twice and fare alike. A NULL
``doc_id`` comes last. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, checkpointed, id_text, slices

#: Multiplier and mixer of the rolling hash; it forbids a border where its low bits are zero (one in eight).
ROLL, MIX, LOW = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 7
MASK64 = (1 << 64) - 1
BITMAP_BYTES = 4096  # of Spark's bitmap functions
FIELDS = {"h": pa.int64(), "g": pa.int64(), "doc_id": pa.int64(), "row": pa.int64(), "place": pa.int32(), "body": pa.binary()}


def border(before: int, after: int) -> bool:
    """Whether a chunk may end behind two lines, from their hashes."""
    r = (before * ROLL + after) & MASK64
    return (((r ^ (r >> 31)) * MIX) & MASK64) >> 32 & LOW != 0


def chunks(text: str, longest: int = 3) -> Iterator[tuple[int, int, bytes]]:
    """First line, line after the last, and bytes of each chunk (blank lines between left out)."""
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip(SPACE)]
    if len(full) < 2:
        return
    data = [lines[i].encode() for i in full]
    hashes = [xxhash.xxh3_64_intdigest(x) for x in data]
    ends = [False] + [border(a, b) for a, b in zip(hashes, hashes[1:])]
    for k in range(len(full) - 1):
        e = k + 1
        while not ends[e] and e - k + 1 < longest and e + 1 < len(full):
            e += 1
        if ends[e] or e - k + 1 == longest:  # else the text ends inside the chunk
            yield full[k], full[e] + 1, b"\n".join(data[k:e + 1])


def chunk_rows(rows: DataFrame, columns: list[str], longest: int, repeated=None) -> DataFrame:
    """The named columns of each chunk: ``h, g`` (its fingerprint), ``doc_id, row, place`` and ``body``;
    with a broadcast bitmap only of those it lets through."""
    schema = pa.schema([(c, FIELDS[c]) for c in columns])
    picked = [list(FIELDS).index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if repeated is None else np.frombuffer(repeated.value, np.uint8)
        for part in slices(batches):
            out = []
            for doc_id, row, text in zip(part["doc_id"].to_pylist(), part["row"].to_pylist(), part["text"].to_pylist()):
                for place, (_, _, body) in enumerate(chunks(text, longest)):
                    digest = blake2b(body, digest_size=16).digest()
                    if bits is not None:
                        at = int.from_bytes(digest[:8], "little") % (8 * len(bits))
                        if not bits[at >> 3] >> (at & 7) & 1:
                            continue
                    out.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), doc_id, row, place, body))
            found = list(zip(*out)) or [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(found[k], schema.field(n).type) for n, k in enumerate(picked)], schema=schema)

    kinds = {"place": "int", "body": "binary"}
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in columns))


def repeated_bitmap(rows: DataFrame, longest: int, bits: int):
    """Broadcast bitmap of the hashes of chunks seen twice or more: ``bits / 8`` bytes however many there are."""
    counted = chunk_rows(rows, ["h"], longest).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    at = F.pmod(F.col("h"), F.lit(bits)).alias("at")  # bits is a power of two: the same as of the unsigned hash
    per = 8 * BITMAP_BYTES
    parts = counted.select(at).groupBy((F.col("at") / per).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("at") % per).alias("map")).collect()
    table = bytearray(bits // 8)
    for r in parts:
        table[r["part"] * BITMAP_BYTES:(r["part"] + 1) * BITMAP_BYTES] = r["map"]
    return rows.sparkSession.sparkContext.broadcast(bytes(table))


def first_places(rows: DataFrame, longest: int, repeated) -> tuple[DataFrame, DataFrame]:
    """``h, g, first`` of the chunks that are the same bytes wherever their fingerprint stands, and
    ``h, g, body, first`` of the texts of other fingerprints."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "place")
    table = chunk_rows(rows, list(FIELDS), longest, repeated)
    met = checkpointed(table.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.min("body").alias("least"), F.max("body").alias("greatest"))
                       .filter("n > 1").select("h", "g", "first", (F.col("least") == F.col("greatest")).alias("same")))
    mixed = met.filter("not same").select("h", "g")
    texts = table.join(mixed, ["h", "g"]).groupBy("h", "g", "body").agg(F.min(place).alias("first"))
    return met.filter("same").select("h", "g", "first"), texts


def line_dedup(docs: DataFrame, longest: int = 3, bitmap_bits: int = 1 << 26) -> DataFrame:
    """``doc_id, n_lines, n_removed_lines, kept_text`` for each input row."""
    rows = id_text(docs).withColumn("row", F.xxhash64("text"))  # tells rows of one id apart
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "place")
    repeated = repeated_bitmap(rows, longest, bitmap_bits)
    first, texts = first_places(rows, longest, repeated)
    columns = ["h", "g", "doc_id", "row", "place"]
    gone = chunk_rows(rows, columns, longest, repeated).join(first, ["h", "g"]).filter(place != F.col("first")).select("doc_id", "row", "place")
    if not texts.isEmpty():
        own = chunk_rows(rows, [*columns, "body"], longest, repeated).join(texts, ["h", "g", "body"]).filter(place != F.col("first"))
        gone = gone.unionByName(own.select("doc_id", "row", "place"))
    lost = gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("place")).alias("places"))
    joined = rows.join(lost.withColumnsRenamed({"doc_id": "d", "row": "r"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed_lines", pa.int64()), ("kept_text", pa.string())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n, removed, kept = [], [], []
            for text, places in zip(part["text"].to_pylist(), part["places"].to_pylist()):
                lines = text.split("\n")
                n.append(len(lines))
                if not places:
                    removed.append(0)
                    kept.append(text)
                    continue
                go = np.zeros(len(lines), bool)
                places = set(places)
                for place, (a, b, _) in enumerate(chunks(text, longest)):
                    if place in places:
                        go[a:b] = True
                removed.append(int(go.sum()))
                kept.append("\n".join(x for x, g in zip(lines, go) if not g))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return joined.select("doc_id", "text", "places").mapInArrow(remove, "doc_id long, n_lines long, n_removed_lines long, kept_text string")
