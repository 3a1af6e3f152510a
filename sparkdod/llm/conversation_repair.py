"""Conversation structure repair.

A conversation is in order if its role initials read ``(s?(ua)+)?``. Each of its rows
may be kept (cost 0), get the role user or assistant (2) or be deleted (3; blank rows
and repeats of an earlier role and text must be), and rows of user or assistant with
an empty text may be inserted anywhere (2); a row that stays without a closing mark
costs 1 more. The cheapest edits are wanted, and of equally cheap ones those whose
initials (Delete, Insert, Keep, Rerole), read in order, are first in ASCII: the audit.

1. Rows are placed by range partitions of (conversation, turn, role, text hash), so a
   partition holds about ``rows_per_part`` rows and a conversation of any length is
   cut into segments. Rows that repeat are found by joins on (conversation, role, text).
2. Cost DP: nodes are (place between rows, state of the pattern's automaton). A
   segment acts on the costs behind it as a 4 x 4 min-plus matrix; only the matrix of
   a partition's first conversation goes to the driver (one row a partition), which
   chains them from the last partition to the first.
3. Prefix-doubling path ranking: every node keeps its optimal arcs. Nodes are ranked by the
   first letter of their least audit, then by 2, 4, 8, ... letters: the rank for
   twice the length is that of the pair (own rank, rank of the node so many
   letters on). From a node a letter leads to one node only (each state admits one
   role), so the pointers to the node 2^k letters on are single-valued. Ranks pick among
   a node's optimal arcs, and the doubled pointers mark the whole least path at once.
4. Edits meet the texts by place. A digest is folded over each conversation's rows as a
   sorted stream, with one letter for each edit in memory.

NULL in role or text counts as one blank. A NULL ``conv_id`` is a conversation of its own;
NULL turns come first, equal turns are ordered by role, then by a hash of the text (equal
rows are alike). A role that is empty or begins with any other letter can't be kept. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: White space at the end of a text is passed over when looking for its closing mark.
TRIMMED = " \t\n\x0b\x0c\r"
#: Faults of a row, the first that applies.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States of the pattern: nothing yet, after s, after u, after a.
EMPTY, S, U, A = range(4)
#: State after a kept row with initial s, u, a or any other (-1: not allowed) - fixed by the pattern.
AFTER = np.array([[S, U, -1, -1], [-1, U, -1, -1], [-1, -1, A, -1], [-1, U, -1, -1]])
#: State after the one role that may be inserted or given in a state, and that role.
NEXT = np.array([U, U, A, U])
ROLE = ("user", "user", "assistant", "user")
#: Letters of the audit in ASCII order, and costs.
LETTERS = "DIKR"
D, I, K, R = range(4)
COST = (3, 2, 0, 2)
FAR = 1 << 40
#: Costs behind a conversation's last row: insert what the pattern still lacks.
END = (0, 4, 2, 0)


def step(behind: tuple[int, ...], initial: int, fault: int) -> tuple[int, ...]:
    """Cheapest costs from the four states before a row, given those behind it."""
    gone = [3 + v for v in behind]
    if fault not in (BLANK, DUPLICATE):
        late = int(fault == TRUNCATED)
        for s in range(4):
            gone[s] = min(gone[s], 2 + late + behind[NEXT_LIST[s]])
            t = AFTER_LIST[s][initial]
            if t >= 0:
                gone[s] = min(gone[s], late + behind[t])
    u = min(gone[U], 2 + gone[A])
    return min(gone[EMPTY], 2 + u), min(gone[S], 2 + u), u, min(gone[A], 2 + u)


NEXT_LIST, AFTER_LIST = NEXT.tolist(), AFTER.tolist()


def head_matrix(initial: list[int], fault: list[int]) -> list[list[int]]:
    """Min-plus matrix of a segment: row s, column t is the cheapest way from s to t."""
    columns = []
    for t in range(4):
        v = tuple(0 if s == t else FAR for s in range(4))
        for i in range(len(initial) - 1, -1, -1):
            v = step(v, initial[i], fault[i])
        columns.append(v)
    return [[min(FAR, columns[t][s]) for t in range(4)] for s in range(4)]


class Segments:
    """The conversations of one partition: costs, optimal arcs, ranks and least paths."""

    def __init__(self, starts: np.ndarray, initial: np.ndarray, fault: np.ndarray, after: tuple[int, ...] | None):
        n, self.starts = len(initial), starts
        ends = np.append(starts[1:], n)
        conversation = np.repeat(np.arange(len(starts)), ends - starts)
        self.place = np.arange(n) + conversation  # of the node before each row; one more place behind a conversation
        self.end_place = ends + np.arange(len(starts))
        self.row_of_place = np.full(n + len(starts), -1)
        self.row_of_place[self.place] = np.arange(n)
        self.open = after is not None
        self.costs = self._costs(ends.tolist(), initial.tolist(), fault.tolist(), after)
        self._arcs(initial, fault)
        self._rank()

    def _costs(self, ends, initial, fault, after) -> np.ndarray:
        out = [END] * len(self.row_of_place)
        for c in range(len(ends) - 1, -1, -1):
            v = tuple(after) if after is not None and c == len(ends) - 1 else END
            out[ends[c] + c] = v
            for i in range(ends[c] - 1, int(self.starts[c]) - 1, -1):
                v = out[i + c] = step(v, initial[i], fault[i])
        return np.array(out, np.int64).reshape(-1, 4)

    def _arcs(self, initial: np.ndarray, fault: np.ndarray) -> None:
        """``targets[letter, node]``: where an optimal arc leads, -1 where there is none."""
        v, places = self.costs, len(self.costs)
        node = np.arange(places * 4).reshape(places, 4)
        targets = np.full((4, places, 4), -1)
        p, late, free = self.place, (fault == TRUNCATED).astype(np.int64), ~np.isin(fault, (BLANK, DUPLICATE))
        inside = np.ones(places, bool)
        if self.open:
            inside[self.end_place[-1]] = False  # the next partition goes on from there
        for s in range(4):
            t = NEXT[s]
            targets[I, :, s] = np.where(inside & (v[:, s] == 2 + v[:, t]), node[:, t], -1)
            targets[D, p, s] = np.where(v[p, s] == 3 + v[p + 1, s], node[p + 1, s], -1)
            targets[R, p, s] = np.where(free & (v[p, s] == 2 + late + v[p + 1, t]), node[p + 1, t], -1)
            kept = AFTER[s][initial]
            targets[K, p, s] = np.where(free & (kept >= 0) & (v[p, s] == late + v[p + 1, kept]), node[p + 1, kept], -1)
        self.targets = targets.reshape(4, -1)

    def _rank(self) -> None:
        """Ranks of all nodes by their least audits, with the doubled pointers."""
        nodes = self.targets.shape[1]
        has = self.targets >= 0
        self.letter = np.where(has.any(axis=0), has.argmax(axis=0), -1)  # the least letter; ends have none
        jump = np.where(self.letter >= 0, self.targets[self.letter, np.arange(nodes)], np.arange(nodes))
        rank, self.left = self.letter + 1, (self.letter >= 0).astype(np.int64)
        self.jumps = [jump]
        while (self.letter[jump] >= 0).any():
            rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1]
            self.left = self.left + self.left[jump]
            jump = jump[jump]
            self.jumps.append(jump)
        # the arc of each node: the least letter, then the least rank behind it
        behind = np.where(has, np.arange(4)[:, None] * (rank.max() + 1) + rank[self.targets], FAR)
        self.choice = np.where(self.letter >= 0, behind.argmin(axis=0), -1)

    def exits(self) -> list[int]:
        """For each state before the last conversation, the state behind its segment."""
        first = (self.starts[-1] + len(self.starts) - 1) * 4 + np.arange(4)
        for jump in reversed(self.jumps):
            first = jump[first]
        return (first % 4).tolist()

    def edits(self, entry: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, order within it, letter and state of each edit on the least paths. Inserted rows go with
        the row they precede, at the end of a conversation with its last row."""
        start = (self.starts + np.arange(len(self.starts))) * 4
        start[0] += entry
        on = np.zeros(self.targets.shape[1], bool)
        on[start] = True
        for jump in reversed(self.jumps):
            on[jump[on]] = True
        nodes = np.flatnonzero(on & (self.choice >= 0))
        place = nodes // 4
        nodes = nodes[np.lexsort((-self.left[nodes], place))]
        place = nodes // 4
        row = self.row_of_place[place]
        row[row < 0] = self.row_of_place[place[row < 0] - 1]
        order = np.arange(len(row)) - np.searchsorted(row, row)
        return row, order, self.choice[nodes], nodes % 4


def changes(conv: pa.Array) -> np.ndarray:
    """First rows of the conversations in an ordered column; NULL equals NULL."""
    if isinstance(conv, pa.ChunkedArray):
        conv = conv.combine_chunks()
    a, b = conv[1:], conv[:-1]
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.concatenate([[0], np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1]) if len(conv) else np.zeros(0, np.int64)


def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, first rows, initials and faults of a partition in order."""
    table = table.take(pc.sort_indices(table["pos"]))
    return table["pos"].to_numpy(), changes(table["conv_id"]), table["initial"].to_numpy(), table["fault"].to_numpy()


def placed(rows: DataFrame, rows_per_part: int) -> DataFrame:
    """Rows with ``part`` and ``pos``, which numbers them by conversation and turn."""
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    spark = rows.sparkSession
    parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 4 * spark.sparkContext.defaultParallelism), -(-plain.count() // rows_per_part))
    keyed = plain.withColumn("h", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id())  # equal rows may be dealt to several partitions
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "h", "nth"]
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return checkpointed(dealt.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"), "conv_id", "turn", "role", "text"))


def repeats(rows: DataFrame) -> DataFrame:
    """``pos`` of the rows whose role and text stand earlier in their conversation. Texts are
    compared where their hashes meet."""
    hashed = rows.select("pos", "conv_id", "role", "text", F.xxhash64("conv_id", "role", "text").alias("h"))
    often = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    alike = hashed.join(often, "h")
    first = alike.groupBy("h", F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t")).agg(F.min("pos").alias("first"))
    same = (F.col("conv_id").eqNullSafe(F.col("c"))) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t"))
    return alike.join(first.withColumnRenamed("h", "k"), (F.col("h") == F.col("k")) & same).filter("pos > first").select("pos")


def coded(rows: DataFrame) -> DataFrame:
    """``part, pos, conv_id, initial, fault`` of each row, without its text."""
    trimmed = F.rtrim("text", F.lit(TRIMMED))
    own = F.when(trimmed == "", BLANK).when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    initial = F.substring("role", 1, 1)
    known = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    again = repeats(rows).withColumn("again", F.lit(True))
    fault = F.when((F.col("own") != BLANK) & F.col("again"), DUPLICATE).otherwise(F.col("own"))
    own_rows = rows.select("part", "pos", "conv_id", known.alias("initial"), own.alias("own"))
    return checkpointed(own_rows.join(again, "pos", "left").select("part", "pos", "conv_id", "initial", fault.alias("fault")))


class Chain:
    """What partitions need to know of each other: costs behind the last conversation, the
    state in which the first one is entered, and the initial before it. One row a partition."""

    def __init__(self, heads: pd.DataFrame, conversations: list):
        self.parts = heads["part"].tolist()
        self.whole = heads["whole"].tolist()
        self.last = heads["last_initial"].tolist()
        first, last = zip(*conversations) if conversations else ((), ())
        n = len(self.parts)
        self.joined = [k + 1 < n and first[k + 1] == last[k] for k in range(n)]  # goes on in the next partition
        self.after: dict[int, tuple[int, ...]] = {}
        behind = END
        for k in range(n - 1, -1, -1):
            if self.joined[k]:
                self.after[self.parts[k]] = behind
            m = np.array(heads["matrix"].iloc[k]).reshape(4, 4)
            end = behind if self.whole[k] and self.joined[k] else END
            behind = tuple(int(x) for x in (m + np.array(end)).min(axis=1))
        self.before = {self.parts[k + 1]: self.last[k] for k in range(n - 1) if self.joined[k]}

    def entries(self, exits: dict[int, list[int]]) -> dict[int, int]:
        out, state = {}, EMPTY
        for k, part in enumerate(self.parts):
            if not (k and self.joined[k - 1]):
                state = EMPTY
            out[part] = state
            if self.joined[k]:
                state = exits[part][state if self.whole[k] else EMPTY]
        return out


def chained(codes: DataFrame) -> tuple[Chain, dict[int, int]]:
    """The chain, and each partition's entry state."""
    conv = next(f for f in codes.schema.fields if f.name == "conv_id")
    kind = conv.dataType.simpleString()

    def heads(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["pos"]))
        _, starts, initial, fault = arrays(table)
        end = int(starts[1]) if len(starts) > 1 else len(initial)
        matrix = head_matrix(initial[:end].tolist(), fault[:end].tolist())
        return pa.table({"part": table["part"][:1], "first": table["conv_id"][:1], "last": table["conv_id"][-1:], "whole": [len(starts) == 1],
                         "last_initial": pa.array([initial[-1]], pa.int32()), "matrix": pa.array([sum(matrix, [])], pa.list_(pa.int64()))})

    found = codes.groupBy("part").applyInArrow(heads, f"part int, first {kind}, last {kind}, whole boolean, last_initial int, matrix array<long>").collect()
    found.sort(key=lambda r: r["part"])
    frame = pd.DataFrame({c: [r[c] for r in found] for c in ("part", "whole", "last_initial", "matrix")})
    chain = Chain(frame, [(r["first"], r["last"]) for r in found])
    if not chain.after:
        return chain, chain.entries({})
    after = codes.sparkSession.sparkContext.broadcast(chain.after)

    def exits(table: pa.Table) -> pa.Table:
        _, starts, initial, fault = arrays(table)
        part = table["part"][0].as_py()
        begin = int(starts[-1])
        last = Segments(np.zeros(1, np.int64), initial[begin:], fault[begin:], after.value[part])
        return pa.table({"part": pa.array([part], pa.int32()), "exits": pa.array([last.exits()], pa.list_(pa.int32()))})

    cut = codes.filter(F.col("part").isin(list(chain.after)))
    return chain, chain.entries({r["part"]: r["exits"] for r in cut.groupBy("part").applyInArrow(exits, "part int, exits array<int>").collect()})


def edits(codes: DataFrame) -> DataFrame:
    """``pos, nth, letter, role, fault, illegal``: the edits of all conversations in order. ``fault`` and
    ``illegal`` (the row before has an initial it may not follow) are set on the edit of the row itself."""
    chain, entries = chained(codes)
    known = codes.sparkSession.sparkContext.broadcast((chain.after, entries, chain.before))
    schema = pa.schema([("pos", pa.int64()), ("nth", pa.int32()), ("letter", pa.string()), ("new_role", pa.string()), ("fault", pa.int32()), ("illegal", pa.bool_())])

    def run(table: pa.Table) -> pa.Table:
        after, entry, before = known.value
        part = table["part"][0].as_py()
        pos, starts, initial, fault = arrays(table)
        row, order, letter, state = Segments(starts, initial, fault, after.get(part)).edits(entry[part])
        earlier = np.concatenate([[before.get(part, -1)], initial[:-1]])
        fresh = np.zeros(len(initial), bool)
        fresh[starts] = True
        fresh[0] = part not in before
        legal = ((earlier == 0) & (initial == 1)) | ((earlier == 1) & (initial == 2)) | ((earlier == 2) & (initial == 1))
        own = letter != I
        role = np.array(ROLE, object)[state]
        role[(letter == K) | (letter == D)] = None
        return pa.table([pa.array(pos[row]), pa.array(order, pa.int32()), pa.array(np.array(list(LETTERS), object)[letter], pa.string()), pa.array(role, pa.string()),
                         pa.array(np.where(own, fault[row], FINE), pa.int32()), pa.array(own & ~legal[row] & ~fresh[row])], schema=schema)

    return codes.groupBy("part").applyInArrow(run, "pos long, nth int, letter string, new_role string, fault int, illegal boolean")


def repair(rows: DataFrame, rows_per_part: int = 200_000) -> DataFrame:
    """``conv_id, pos, nth, turn, letter, role, text, fault, illegal``: one row for each edit, in the order of
    ``pos`` and ``nth``. Rows with letter D go, all others are the repaired conversation; inserted ones have an empty
    text and no turn."""
    table = placed(rows, rows_per_part)
    made = edits(coded(table))
    own = F.col("letter") != "I"
    return made.join(table.drop("part"), "pos").select(
        "conv_id", "pos", "nth", F.when(own, F.col("turn")).alias("turn"), "letter", F.coalesce("new_role", "role").alias("role"),
        F.when(own, F.col("text")).otherwise(F.lit("")).alias("text"), "fault", "illegal")


class Digest:
    """Figures of one conversation, row by row."""

    def __init__(self):
        self.turns, self.low, self.high, self.last = 0, None, None, None
        self.faults, self.illegal, self.cost, self.audit, self.sha, self.written = [0] * 4, 0, 0, bytearray(), hashlib.sha256(), False

    def add(self, turn, letter, role, text, fault, illegal) -> None:
        if turn is not None and letter != "I":
            if turn != self.last:
                self.turns += 1
            self.last = self.high = turn
            self.low = turn if self.low is None else self.low
        self.faults[fault] += 1
        self.illegal += illegal
        self.cost += COST[LETTERS.index(letter)] + (fault == TRUNCATED and letter != "D")
        self.audit += letter.encode()
        if letter != "D":
            self.sha.update(f"{chr(10) * self.written}{role}:{text}".encode())
            self.written = True

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *self.faults[1:], self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest()


DIGEST = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id`` and the digest columns of each conversation of ``repair``'s rows. A conversation's hash
    goes over its texts in order, so it is one sorted stream; nothing but the audit grows with its length."""
    conv = next(f for f in repaired.schema.fields if f.name == "conv_id")
    columns = ["turn", "letter", "role", "text", "fault", "illegal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None

        def batch(rows, kind):
            conv, figures = zip(*rows)
            values = [pa.array(conv, kind)] + [pa.array(x, pa.int64() if k < 6 else pa.string()) for k, x in enumerate(zip(*figures))]
            return pa.RecordBatch.from_arrays(values, names=["conv_id", *DIGEST])

        for b in batches:
            kind, done = b.schema.field("conv_id").type, []
            for conv, *values in zip(b["conv_id"].to_pylist(), *(b[c].to_pylist() for c in columns)):
                if digest is None or conv != current:
                    if digest is not None:
                        done.append((current, digest.row()))
                    current, digest = conv, Digest()
                digest.add(*values)
            if done:
                yield batch(done, kind)
        if digest is not None:
            yield batch([(current, digest.row())], kind)

    ordered = repaired.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "pos", "nth").select("conv_id", *columns)
    return ordered.mapInArrow(run, f"conv_id {conv.dataType.simpleString()}, " + ", ".join(f"{c} {'string' if c in DIGEST[6:] else 'long'}" for c in DIGEST))


def digests_of_all(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """``digests`` with a row of zeros, an empty audit and the hash of nothing for each conversation of ``rows`` that has none left."""
    nothing = dict(zip(DIGEST, Digest().row()))
    all_ids = rows.select(F.col("conv_id").alias("id")).distinct()
    joined = all_ids.join(digests(repaired), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(F.col("id").alias("conv_id"), *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in nothing.items()])


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by ``crc32(conv_id:turn) % 20``: 0 drops a row, 1 empties its text, 2 takes its
    closing marks, 3 repeats it, 4 makes its role user. NULL counts as one blank."""
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    harm = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(harm == 1, "").when(harm == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    made = rows.filter(harm != 0).select("conv_id", "turn", F.when(harm == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"), F.when(harm == 3, 2).otherwise(1).alias("copies"))
    return made.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("col")
