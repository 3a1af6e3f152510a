"""Line-first quality cleaning.

Every line is judged by itself: punctuation (too many symbols, or all in
capitals), navigation (items between separators), boilerplate (phrases of page
furniture), monotony (hardly any different words). Failing lines are removed; a
document that loses more than ``most_lost`` percent of its words is rejected, and so is
one whose text as given fails the base limits (fewer than ``least_words``
words, or more than ``most_repeated`` percent of words in five-word windows that
the text holds twice).

NULL and empty texts have no words and fail. Rows with the same ``doc_id`` are
judged each for itself; other columns are ignored; no rows for an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import SPACE, id_text, slices
from .words import P_HIGH, run_hashes, run_starts, word_hashes, word_ids

SYMBOLS = "#*$%&|<>"
BOILERPLATE = re.compile(
    r"cookie (?:policy|settings)|privacy policy|terms (?:of use|of service|and conditions)|all rights reserved|subscribe to our"
    r"|sign up for|click here|read more|share this|enable javascript|powered by|lorem ipsum|back to top", re.IGNORECASE)


#: Upper and lower case letters (a capital line has the one kind only).
UPPER, LOWER = regex.compile(r"\p{Lu}"), regex.compile(r"\p{Ll}")
SEPARATOR = re.compile(r" [|>»·](?= )")


def bad_line(line: str, most_symbols: int = 10, least_items: int = 3, most_monotone: int = 25) -> str | None:
    """The rule that a line fails, None if it passes. Blank lines pass.

    Percentages are of the line's characters (symbols) and words (different
    words among ten or more; less in very long lines)."""
    words = line.encode().split()
    n = len(words)
    if not n:
        return None
    symbols, marks = sum(map(line.count, SYMBOLS)), line.count("!")
    many = 100 * symbols > most_symbols * len(line)
    if many and line.count("|") + line.count(">") < least_items - 1:
        return "punctuation"
    if n > 1 and "!!" in line and not LOWER.search(line) and UPPER.search(line) or marks > n:
        return "punctuation"
    separators = len(SEPARATOR.findall(line))
    if many or separators >= least_items - 1 and 5 * separators >= n:
        return "navigation"
    if n <= 30 and BOILERPLATE.search(line):
        return "boilerplate"
    if n >= 10 and 100 * len(set(words)) * (1000 + n) <= most_monotone * n * 1000:
        return "monotony"
    return None


def repeated_words(ids: np.ndarray, h: np.ndarray, starts: np.ndarray, size: int = 5) -> np.ndarray:
    """For each text, the words inside windows that it holds twice or more.
    Windows of equal hash are compared word by word."""
    out = np.zeros(len(starts) - 1, np.int64)
    windows = run_hashes(h, size, P_HIGH)
    for t in np.flatnonzero(np.diff(starts) > size):
        a, b = starts[t], starts[t + 1]
        own = windows[a:b - size + 1]
        ordered = np.sort(own)
        if not (ordered[1:] == ordered[:-1]).any():
            continue
        order = np.argsort(own, kind="stable")
        near = np.flatnonzero(own[order][1:] == own[order][:-1])
        rows = ids[a:b][order[:, None] + np.arange(size)]
        same = (rows[near] == rows[near + 1]).all(axis=1)
        if same.all():
            hits = np.union1d(order[near], order[near + 1])
        else:  # two different windows of one hash
            seen: dict[bytes, list[int]] = {}
            for i in range(len(own)):
                seen.setdefault(ids[a + i:a + i + size].tobytes(), []).append(i)
            hits = np.array([i for at in seen.values() if len(at) > 1 for i in at], int)
        cover = np.zeros(b - a, bool)
        for k in range(size):
            cover[hits + k] = True
        out[t] = cover.sum()
    return out


def clean(docs: DataFrame, least_words: int = 10, most_repeated: int = 20, most_lost: int = 50, texts: bool = True) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_bad_lines, lost_words, kept`` and with ``texts`` the text
    without its failing lines as ``clean_text``."""
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [("doc_id", pa.int64()), *((c, pa.int64()) for c in longs), ("base_failed", pa.bool_()), ("n_bad_lines", pa.int64()), ("lost_words", pa.int64()), ("kept", pa.bool_())]
    fields += [("clean_text", pa.string())] * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            text = part["text"]
            ids, starts, words = word_ids(text)
            n = np.diff(starts)
            chars = pc.utf8_length(text).to_numpy().astype(np.int64) - sum(pc.count_substring(text, c).to_numpy().astype(np.int64) for c in SPACE)
            symbols = sum(pc.count_substring(text, c).to_numpy().astype(np.int64) for c in SYMBOLS)
            repeats = repeated_words(ids, word_hashes(ids, words)[0], starts) if len(ids) else np.zeros(len(n), np.int64)
            dup, bad, lost, cleaned = [], [], [], []
            for whole in text.to_pylist():
                lines = whole.split("\n")
                full = [x for x in lines if x.strip(SPACE)]
                dup.append(len(full) - len(set(full)))
                failing = [bad_line(x) is not None for x in lines]
                bad.append(sum(failing))
                lost.append(sum(len(x.encode().split()) for x, f in zip(lines, failing) if f))
                if texts:
                    cleaned.append("\n".join(x for x, f in zip(lines, failing) if not f))
            lost = np.array(lost, np.int64)
            failed = (n < least_words) | (100 * repeats > most_repeated * n)
            kept = ~failed & (100 * lost <= most_lost * n)
            yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(x, pa.int64()) for x in (n, chars, symbols, dup, repeats)), pa.array(failed), pa.array(bad, pa.int64()),
                                              pa.array(lost), pa.array(kept)] + [pa.array(cleaned, pa.string())] * texts, schema=pa.schema(fields))

    ddl = "doc_id long, " + ", ".join(f"{c} long" for c in longs) + ", base_failed boolean, n_bad_lines long, lost_words long, kept boolean" + ", clean_text string" * texts
    return id_text(docs).mapInArrow(run, ddl)
