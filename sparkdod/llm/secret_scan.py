"""Secret scans with inferred grammars.

1. One pass finds the base kinds (assign, access, hex) and all other tokens of 12
   credential characters or more, with or without a digit.
2. A bounded sample of the credentials so labelled (the ``sample`` smallest
   hashes of each kind, up to ``longest`` characters) trains one probabilistic automaton for each kind: their
   prefix tree over a length class and character classes, whose states are merged when their
   outgoing frequencies agree (Hoeffding bounds, after ALERGIA). As strings begin with
   their length class, lengths keep states of their own and ends are judged by length.
3. All other tokens are scored by format likelihood: the automaton's mean log
   probability (characters of a class are alike) against that of the corpus' own
   tokens, the character bigrams of all texts (at most 68 x 68 counts). Those above ``margin`` and above
   the least likely of the credentials trained on become spans of kind ``format``.

Base spans are regular matches and stay, whatever the automata say. Without any
credential in the corpus there is no automaton and no further span.

Positions are code points, end exclusive. NULL and empty texts have no spans.
Rows with the same ``doc_id`` are searched each for itself; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_text, slices

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINT = re.compile(r"passw(?:or)?d|secret|token|api_?key", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Candidates: tokens of credential characters.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
SPANS_DDL = "array<struct<kind:string,start:int,end:int,value:string>>"


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """kind, start, end and credential of the base matches, by start, then kind."""
    out = []
    if ASSIGN_HINT.search(text):
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Other tokens that might be credentials: those that no base span touches."""
    starts, reach = [s[1] for s in base], list(accumulate((s[2] for s in base), max))
    out = []
    for m in TOKEN.finditer(text):
        before = bisect_left(starts, m.end())  # base spans that begin before the token ends
        if not (before and reach[before - 1] > m.start()):
            out.append(("format", m.start(), m.end(), m[0]))
    return out


#: Length classes: up to 11 characters, 12 to 15, ... (fixed values).
LENGTHS = (12, 16, 20, 24, 32, 40, 48, 64, 96, 128)
#: How many characters a class has; signs stand for themselves.
CLASS_SIZE = {"h": 6, "l": 20, "H": 6, "L": 20, "d": 10}


def classes(token: str) -> list[str]:
    """Length class, then character classes: lower hex letters h, other lower l, upper hex H, other upper L, digits d, signs as they are."""
    return [f"<{bisect_right(LENGTHS, len(token))}>"] + ["d" if "0" <= c <= "9" else "h" if "a" <= c <= "f" else "l" if "a" <= c <= "z" else "H" if "A" <= c <= "F" else "L" if "A" <= c <= "Z" else c for c in token]


class Automaton:
    """Probabilistic deterministic automaton learnt by merging the states of a
    prefix tree. ``next[s][c]`` is the state after symbol c, ``seen[s][c]`` how
    often it was taken, ``ends[s]`` how often a string ended there."""

    END = "$"

    def __init__(self, strings: list[list[str]], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.seen: list[Counter] = [Counter()]
        for s in strings:
            at = 0
            for c in s:
                self.seen[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.seen.append(Counter())
                at = self.next[at][c]
            self.seen[at][self.END] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def _alike(self, a: int, b: int) -> bool:
        """Whether the two states, and those that follow them, agree within the bounds."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.seen[a].total(), self.seen[b].total()
            if not n or not m:
                continue
            room = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for c in self.seen[a].keys() | self.seen[b].keys():
                if abs(self.seen[a][c] / n - self.seen[b][c] / m) > room:
                    return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below state b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.seen[a].update(self.seen[b])
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge_states(self) -> None:
        """Accepted states are final; a state that follows one is merged into
        the first accepted state it agrees with, or accepted itself."""
        accepted, members = [0], {0}
        while True:
            edge = next(((s, c, t) for s in accepted for c, t in sorted(self.next[s].items()) if t not in members), None)
            if edge is None:
                return
            s, c, t = edge
            like = next((a for a in accepted if self._alike(a, t)), None)
            if like is None:
                accepted.append(t)
                members.add(t)
            else:
                self.next[s][c] = like
                self._fold(like, t)

    def table(self) -> dict:
        """Log probabilities by state and symbol, and the states that follow."""
        out: dict[int, dict[str, tuple[float, int]]] = {}
        todo = [0]
        while todo:
            s = todo.pop()
            if s in out:
                continue
            total = self.seen[s].total() + 1.0
            out[s] = {c: (math.log(n / total), self.next[s].get(c, -1)) for c, n in self.seen[s].items()}
            todo += self.next[s].values()
        return out


def likelihood(table: dict, symbols: list[str], unseen: float = -7.0) -> float:
    """Mean log probability of a string and its end, characters of a class being alike; a string
    that leaves the automaton goes on from the start at the price of an unseen symbol."""
    at, total = 0, 0.0
    for c in (*symbols, Automaton.END):
        p, to = table[at].get(c, (unseen, 0))
        total += p - math.log(CLASS_SIZE.get(c, 1))
        at = max(to, 0)
    return total / (len(symbols) + 1)


#: Number of each credential character by byte; all others are 0, the border of a token.
SYMBOL = np.zeros(256, np.int64)
SYMBOL[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", np.uint8)] = np.arange(1, 68)
N_SYMBOLS = 68


def bigrams(text: bytes) -> np.ndarray:
    """How often each pair of symbols follows each other."""
    at = SYMBOL[np.frombuffer(b"\n" + text + b"\n", np.uint8)]
    return np.bincount(at[:-1] * N_SYMBOLS + at[1:], minlength=N_SYMBOLS ** 2)


#: Share of each class in ordinary words, the rest for signs: half of the smoothing of bigrams (fixed values).
PRIOR = {"h": 0.23, "l": 0.62, "H": 0.015, "L": 0.035, "d": 0.05}


class Ordinary:
    """Character bigrams of ordinary tokens, smoothed by characters: half as they occur in
    the corpus, half as in ordinary words, so that a small corpus full of credentials isn't taken for ordinary."""

    def __init__(self, counts: np.ndarray, weight: float = 200.0):
        pairs = counts.reshape(N_SYMBOLS, N_SYMBOLS).astype(float)
        pairs[0, 0] = 0  # outside of tokens
        ones = pairs.sum(axis=0) + 0.5
        ones[1:] /= ones[1:].sum()
        prior = np.array([PRIOR.get(c := classes(chr(b))[1], 0.05) / CLASS_SIZE.get(c, 5) for b in np.argsort(SYMBOL)[-N_SYMBOLS + 1:]])
        ones[1:] = (ones[1:] + prior / prior.sum()) / 2
        ones[0] = 0.15  # the end
        ones /= ones.sum()
        self.log = np.log((pairs + weight * ones) / (pairs.sum(axis=1, keepdims=True) + weight))

    def likelihood(self, token: str) -> float:
        """Mean log probability of a token with its end, over as many symbols as the automata score."""
        at = SYMBOL[np.frombuffer(f" {token} ".encode(), np.uint8)]
        return float(self.log[at[:-1], at[1:]].sum()) / (len(token) + 2)


def without_base(text: str) -> str:
    """The text with a blank in place of each base span: known credentials are not ordinary."""
    out, at = [], 0
    for _, start, end, _ in base_spans(text):
        if start >= at:
            out.append(text[at:start])
        at = max(at, end)
    return " ".join([*out, text[at:]]) if at else text


def ordinary_bigrams(docs: DataFrame) -> np.ndarray:
    """Bigrams of all texts outside base spans: added up in each task and by pair, at most 4,624 rows for the driver."""
    schema = pa.schema([("pair", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_SYMBOLS ** 2, np.int64)
        for part in slices(batches):
            total += bigrams("\n".join(map(without_base, part["text"].to_pylist())).encode())
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], schema=schema)

    out = np.zeros(N_SYMBOLS ** 2, np.int64)
    for r in docs.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out


def format_score(tables: dict[str, tuple[dict, float]], ordinary: Ordinary, token: str, margin: float) -> float | None:
    """The best automaton's lead over ordinary tokens, None below the margin."""
    symbols, plain = classes(token), None
    best = None
    for table, least in tables.values():
        p = likelihood(table, symbols)
        if p >= least:
            plain = ordinary.likelihood(token) if plain is None else plain
            if p - plain >= margin and (best is None or p - plain > best):
                best = p - plain
    return best


def learn(samples: dict[str, list[str]], alpha: float = 0.05) -> dict[str, tuple[dict, float]]:
    """For each kind its automaton's table and the mean log probability of its least likely example."""
    out = {}
    for kind, strings in samples.items():
        symbols = [classes(s) for s in strings]
        table = Automaton(symbols, alpha).table()
        out[kind] = (table, min(likelihood(table, s) for s in symbols))
    return out


def smallest(values: DataFrame, n: int, longest: int) -> list[str]:
    """At most ``n`` distinct values of at most ``longest`` characters, those of the smallest hashes: a top-n on every task, then of those."""
    kept = values.filter(F.length("value") <= longest).distinct()
    return [r["value"] for r in kept.orderBy(F.xxhash64("value"), "value").limit(n).collect()]


def find_secrets(docs: DataFrame, sample: int = 500, margin: float = 0.2, alpha: float = 0.05, longest: int = 256) -> DataFrame:
    """``doc_id, spans`` (kind, start, end, value), by start, then kind. Training takes ``sample`` credentials of each
    kind, of up to ``longest`` characters; all tokens are scored."""
    schema = pa.schema([("doc_id", pa.int64()), ("base", SPANS), ("others", SPANS)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "value")
        for part in slices(batches):
            base, others = [], []
            for text in part["text"].to_pylist():
                found = base_spans(text)
                base.append([dict(zip(names, s)) for s in found])
                others.append([dict(zip(names, s)) for s in candidates(text, found)])
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(base, SPANS), pa.array(others, SPANS)], schema=schema)

    scanned = checkpointed(id_text(docs).mapInArrow(scan, f"doc_id long, base {SPANS_DDL}, others {SPANS_DDL}"))
    labelled = scanned.select(F.explode("base").alias("s")).select("s.kind", "s.value")
    samples = {kind: found for kind in KINDS if (found := smallest(labelled.filter(F.col("kind") == kind).select("value"), sample, longest))}
    plain = Ordinary(ordinary_bigrams(id_text(docs)))
    models = docs.sparkSession.sparkContext.broadcast((learn(samples, alpha), plain))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, plain = models.value
        for part in slices(batches):
            spans = []
            for base, others in zip(part["base"].to_pylist(), part["others"].to_pylist()):
                more = [s for s in others if format_score(tables, plain, s["value"], margin) is not None]
                order = (*KINDS, "format")
                spans.append(sorted(base + more, key=lambda s: (s["start"], order.index(s["kind"]))))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(spans, SPANS)], names=["doc_id", "spans"])

    return scanned.mapInArrow(score, f"doc_id long, spans {SPANS_DDL}")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
