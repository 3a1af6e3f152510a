"""BPE encoding and decoding.

Encoding walks each piece of text with the longest vocabulary entry that an
Aho-Corasick automaton finds at a position. A token may follow another only
if no merge would have joined characters across their border; that is looked
up in a pair-compatibility table (filled as pairs are met). A token that
doesn't fit is shortened, and a position without a fitting token is marked
dead and left for good, so the walk is linear and gives exactly the tokens
that merging pairs by rank gives. Decoding gathers bytes from one buffer of
all vocabulary strings through an offset table.

The tokenizer file (``tokenizers`` JSON: normalizer NFC + white space + lower
case, a Split pattern, byte level, BPE with a word-end suffix) is read once on
the driver and broadcast; its size is that of the vocabulary.

NULL and empty texts give no ids and an empty decoded text; rows with the
same ``doc_id`` are encoded each for itself; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_text, slices

#: Chunks longer than this are encoded without being remembered; the memory of
#: a worker holds at most so many chunks and token pairs.
LONGEST_REMEMBERED = 48
REMEMBERED = 200_000

#: What the normalizer turns into one blank (Unicode White_Space).
BLANKS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@lru_cache(1)
def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable
    Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model, letters = spec["model"], _byte_letters()
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        # A piece is a string of symbols: a byte, or 256 + byte for its last byte.
        symbols: dict[str, str] = {}
        for letter, byte in letters.items():
            symbols[letter], symbols[letter + end] = chr(byte), chr(256 + byte)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            symbols[a + b] = symbols[a] + symbols[b]
            self.merge_rank[vocab[a], vocab[b]] = rank
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b], rank))
        self.by_symbols = {s: vocab[t] for t, s in symbols.items() if t in vocab}
        self.length = {i: len(s) for s, i in self.by_symbols.items()}
        self.symbols = {i: s for s, i in self.by_symbols.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.by_symbols.items():
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = {t: np.uint32(i).tobytes() for t, i in added.items()}
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.odd_blanks = regex.compile("[\x1c-\x1f]")
        self.blanks = regex.compile(f"[{BLANKS}]+")
        self.known: dict[str, bytes] = {}
        # offset table of the decoder: every entry is followed by one blank
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in added.items()}
        entries = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.table = np.frombuffer(b"".join(entries), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(e) for e in entries])]).astype(np.int64)

    # -- encoding ---------------------------------------------------------
    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stood at the border while ``token`` was built, each
        with the rank of the merge that used it up."""
        out, used = [(token, float("inf"))], self.parts.get(token)
        while used:
            out.append((used[side], used[2]))
            used = self.parts.get(used[side])
        return out

    def _fit(self, left: int, right: int) -> bool:
        """Whether merging leaves the border of these two tokens alone. A merge
        across it comes first if its rank is below that of the merge that used
        up the left side; against the right side it wins ties, being further left."""
        lefts, rights = self._spine(left, 1), self._spine(right, 0)
        rank = self.merge_rank
        return not any((r := rank.get((x, y))) is not None and r < used_x and r <= used_y
                       for x, used_x in lefts for y, used_y in rights)

    def _prefix(self, token: int) -> int | None:
        """The longest other token that this one begins with."""
        if token not in self.shorter:
            s = self.symbols[token]
            self.shorter[token] = next((t for k in range(len(s) - 1, 0, -1) if (t := self.by_symbols.get(s[:k])) is not None), None)
        return self.shorter[token]

    def encode_piece(self, piece: str) -> list[int]:
        """Tokens of one piece, the walk described above."""
        data = piece.encode()
        s = data[:-1].decode("latin-1") + chr(256 + data[-1])
        n, length, fits = len(s), self.length, self.fits
        longest: list[int | None] = [None] * n
        for end, (token, size) in self.automaton.iter(s):
            longest[end + 1 - size] = token  # ends grow, so the longest is written last
        dead, out, at, token = bytearray(n + 1), [], 0, longest[0]
        while True:
            while token is not None:
                if not dead[at + length[token]]:
                    if not out:
                        break
                    pair = (out[-1], token)
                    ok = fits.get(pair)
                    if ok is None:
                        if len(fits) >= REMEMBERED:
                            fits.clear()
                        ok = fits[pair] = self._fit(*pair)
                    if ok:
                        break
                token = self._prefix(token)
            if token is not None:
                out.append(token)
                at += length[token]
                if at == n:
                    return out
                token = longest[at]
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = self._prefix(token)

    def _chunk(self, chunk: str) -> bytes:
        ids = [i for piece in self.split.findall(chunk) for i in self.encode_piece(piece)]
        packed = np.array(ids, "<u4").tobytes()
        if len(chunk) <= LONGEST_REMEMBERED:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[chunk] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        known, out = self.known.get, []
        for section in self.added_split.split(text) if self.added_split else [text]:
            if section in self.added:
                out.append(self.added[section])
                continue
            if not section.isascii():
                section = unicodedata.normalize("NFC", section).replace("Σ", "σ")  # no final sigma
            section = section.lower()
            chunks = self.blanks.split(section) if self.odd_blanks.search(section) else section.split()
            out += [found if (found := known(c)) is not None else self._chunk(c) for c in chunks if c]
        return b"".join(out)

    # -- decoding ---------------------------------------------------------
    def decode(self, packed: bytes, step: int = 1 << 16) -> bytes:
        """UTF-8 of the vocabulary strings of the ids, joined by one blank."""
        ids, out = np.frombuffer(packed, "<u4"), []
        for at in range(0, len(ids), step):
            part = ids[at:at + step]
            start = self.offsets[part]
            size = self.offsets[part + 1] - start
            ends = np.cumsum(size)
            source = np.repeat(start - (ends - size), size)
            source += np.arange(len(source))
            out.append(self.table[source].tobytes())
        return b"".join(out)[:-1]


@lru_cache(2)
def load(spec: str) -> Bpe:
    return Bpe(spec)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, tokenizer: str | None = None, decoded: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit integers) of
    every text, with the decoded text as ``decoded`` if asked for. One row per
    input row, one pass, no shuffle."""
    with open(tokenizer or default_path(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())] + [("decoded", pa.string())] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(spec.value)
        for part in slices(batches):
            ids = [bpe.encode(t) for t in part["text"].to_pylist()]
            columns = [part["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([bpe.decode(x) for x in ids], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, text`` of a table of ``doc_id, ids``; NULL ids give an empty text."""
    with open(tokenizer or default_path(), encoding="utf-8") as f:
        spec = encoded.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(spec.value)
        for part in slices(batches):
            texts = [bpe.decode(x or b"") for x in part["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(texts, pa.binary()).cast(pa.string())], schema=schema)

    return encoded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, text string")
