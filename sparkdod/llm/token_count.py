"""Token counts by overlap resynchronisation.

The tokenizer library encodes texts; a huge one is encoded in chunks that
overlap. Inside an overlap the encodings of both chunks are spliced at a
*stable common boundary*: a place that both have as a token border, and of which
the two characters around it prove that it is one in the whole text too:

* no piece that the byte-level pattern cuts holds white space behind anything else,
  so a border lies before white space that follows another character;
* a letter is never followed in its piece by a digit or sign, a digit never by a
  letter or sign, and a sign other than the apostrophe never by a letter or digit
  (``'s``, ``'ll``, ... do join);
* pieces of the sentence-piece vocabulary hold the space sign in front only (checked
  when it is loaded), so only the first rule is used there.

What stands left of such a border can't change the tokens right of it, and the left
chunk has seen the character behind it. A place inside a special token's string is
no border. If an overlap holds no such place it is widened, twice as far each time,
and when it has reached back to the last splice the chunk itself grows, at the end to
the whole rest of the text: the count is exact for any text.

Special strings inside a text count as the library's default has them (one token).
NULL and empty texts have 0 bytes and 0 tokens; rows with the same ``doc_id`` are
counted each for itself; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_text, slices

#: White space that every version of every library takes as such.
SURE_SPACE = frozenset(" \t\n\r")
#: Characters up to here have been letters, digits and signs since before any of the libraries.
OLD = "龥"


def kind(c: str) -> str:
    """``S`` white space, ``L`` letter, ``N`` digit, ``O`` sign, ``?`` what libraries might see differently."""
    if c in SURE_SPACE:
        return "S"
    if c.isascii():
        return "L" if c.isalpha() else "N" if c.isdigit() else "O" if c.isprintable() else "?"
    group = unicodedata.category(c)[0]
    if c > OLD or group in "CZ" or c.isspace():
        return "?"
    return group if group in "LN" else "O" if group in "PS" else "?"


class JsonTokenizer:
    """A byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(spec)
        self.model.no_truncation()
        self.model.no_padding()
        added = self.model.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or any(kind(c) == "S" for c in t.content) for t in added):
            raise ValueError("added tokens that take white space have no proven borders")
        self.special = [t.content for t in added]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def ends(self, text: str) -> np.ndarray:
        """Where each token ends, in characters."""
        return np.array([b for _, b in self.model.encode(text, add_special_tokens=False).offsets], np.int64)

    def stable(self, text: str, at: int) -> bool:
        a, b = kind(text[at - 1]), kind(text[at])
        if a == "?" or b == "?" or a == b or a == "S" or (a == "O" and b != "S" and text[at - 1] == "'"):
            return False
        return not any((found := text.find(s, max(0, at - len(s) + 1), at + len(s) - 1)) >= 0 and found < at < found + len(s) for s in self.special)


class PieceTokenizer:
    """A BPE file of the ``sentencepiece`` library."""

    def __init__(self, spec: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=spec)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        self.spaces_lead = all("▁" not in p.lstrip("▁") for p in pieces)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.model.encode(texts, num_threads=1)]

    def ends(self, text: str) -> np.ndarray:
        ends = np.array([p.end for p in self.model.encode(text, return_type="proto").pieces], np.int64)  # in bytes
        data = np.frombuffer(text.encode(), np.uint8)
        return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[ends]

    def stable(self, text: str, at: int) -> bool:
        return self.spaces_lead and text[at] == " " and text[at - 1].isalnum() and kind(text[at - 1]) != "?"


def count_long(tokenizer, text: str, size: int, overlap: int) -> int:
    """Tokens of one text from chunks of ``size`` characters and more."""
    total, done = 0, -1  # tokens of text[:done] are in the total; `done` is a proven border (a leading space sign may end at 0)
    at, ends = 0, None  # the chunk that holds text[done:], from `at`
    stop = min(len(text), size)
    while True:
        if ends is None:
            ends = at + tokenizer.ends(text[at:stop])
        if stop == len(text):
            return total + int((ends > done).sum())
        width, splice = overlap, None
        while splice is None and stop - width > done:
            start = stop - width
            following = min(len(text), start + max(size, 2 * width))
            more = start + tokenizer.ends(text[start:following])
            common = np.intersect1d(ends, more)
            common = common[(common > max(start, done)) & (common < stop)]
            splice = next((int(p) for p in common[::-1] if tokenizer.stable(text, int(p))), None)
            width *= 2
        if splice is None:  # no border back to the last splice: a larger chunk
            stop, ends = min(len(text), stop + max(size, stop - at)), None
            continue
        total += int(((ends > done) & (ends <= splice)).sum())
        done, at, stop, ends = splice, start, following, more


@lru_cache(2)
def load(spec: str | bytes):
    return JsonTokenizer(spec) if isinstance(spec, str) else PieceTokenizer(spec)


def read_spec(path: str) -> str | bytes:
    """A tokenizer file's content, read on the driver: text of a ``.json``, bytes of a ``.model``."""
    with open(path, "rb") as f:
        content = f.read()
    return content if path.endswith(".model") else content.decode()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 512, chunk_chars: int = 1 << 15, overlap_chars: int = 1 << 8) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens) of
    every text. One row per input row, one pass, no shuffle; texts longer than
    ``chunk_chars`` are encoded in chunks."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer or default_path()))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(spec.value)
        for part in slices(batches, 1 << 20):
            texts = part["text"].to_pylist()
            n = np.zeros(len(texts), np.int64)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk_chars]
            n[short] = model.counts([texts[i] for i in short])
            for i, t in enumerate(texts):
                if len(t) > chunk_chars:
                    n[i] = count_long(model, t, chunk_chars, overlap_chars)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pc.binary_length(part["text"]).cast(pa.int64()), pa.array(n), pa.array(n > limit)], schema=schema)

    return id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
