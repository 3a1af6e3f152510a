"""Token counts and token alignment against the libraries and brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkdod.llm import queries, token_align, token_count
from sparkdod.llm.common import documents

PARTS = ["a", "b ", " ", "\n", "  ", "'s", "'ll", "12", "é", "漢字", "。", "<|endoftext|>", "<|end", "▁", "!!", "\t", "🙂", "don't", "\x1c", "\x85", "Σ", "-", "_", "the the"]


@pytest.fixture(scope="module", params=["byte_bpe_50k.json", "piece_bpe_32k.model"])
def tokenizer(request):
    return token_count.load(token_count.read_spec(public_tokenizers.path(request.param)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=250), st.sampled_from([(20, 2), (40, 8), (200, 16)]))
def test_spliced_counts(tokenizer, parts, sizes):
    text = "".join(parts)
    assert token_count.count_long(tokenizer, text, *sizes) == tokenizer.counts([text])[0]


def test_overlaps_widen_where_no_border_is_proven(tokenizer):
    for text in ("x" * 5000, "漢字" * 2000 + " end", "a" * 700 + " " + "b" * 3000, " " * 3000, "é" * 100 + "\n" * 900 + "é"):
        assert token_count.count_long(tokenizer, text, 64, 8) == tokenizer.counts([text])[0]


def test_special_strings_are_no_borders():
    model = token_count.load(token_count.read_spec(token_count.default_path()))
    text = "one<|endoftext|>two three"
    assert [p for p in range(1, len(text)) if model.stable(text, p)] == [3, 16, 19]  # around the string, not inside it
    assert model.stable("one<|endof text|>", 4) is False and model.stable("one<|endof text|>", 3) is True


def test_token_count_query(spark, sf001):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r["doc_id"]: r["text"] or "" for r in documents(spark, sf001).collect()}
    for r in token_count.token_counts(documents(spark, sf001), chunk_chars=500, overlap_chars=32).collect():
        n = len(model.encode(want[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(want[r["doc_id"]].encode()), n, n > 512)
    assert sorted(queries.op13_token_counts(spark, sf001).collect()) == sorted(token_count.token_counts(documents(spark, sf001), chunk_chars=300).collect())


# -- alignment ------------------------------------------------------------------
def brute_alignment(texts):
    """Tokens, links and groups by walking over both token lists; counts by a Counter over the corpus."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    byte_of = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def spans(ids, bytes_of):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(bytes_of(i)), i))
            at = out[-1][1]
        return out

    found, count = {}, Counter()
    for key, text in texts:
        found[key] = None
        if not text:
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        a_bytes = lambda i: bytes(byte_of[c] for c in a.id_to_token(i))
        if any(b"".join(map(f, ids)) != (" " + text).encode() for f, ids in ((a_bytes, x), (piece, y))):
            continue
        x, y = spans(x, a_bytes), spans(y, piece)
        links = [(p[2], q[2]) for p in x for q in y if p[0] < q[1] and q[0] < p[1]]
        cuts = sorted({p[1] for p in x} & {q[1] for q in y})
        groups = [([p[2] for p in x if s < p[1] <= e], [q[2] for q in y if s < q[1] <= e]) for s, e in zip([0, *cuts], cuts)]
        found[key] = (x, y, links, groups)
        count.update(links)
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = {}
    for key, f in found.items():
        if f is None:
            out[key] = (0,) * 7 + ("",)
        else:
            x, y, links, groups = f
            out[key] = (len(x), len(y), len(groups), len(links), sum(len(p) * len(q) for p, q in groups), sum(count[k] == best[k[1]] for k in links),
                        sum(count[k] for k in links), ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups))
    return out


def test_alignment(spark):
    rng = random.Random(6)
    words = ["the", "quick", "naïve", "漢字", "antidisestablishment", "12.5", "🙂", "<|endoftext|>", "<s>", "\n\n", "x_y", "  ", "Ünïcode", "▁", "é", "ﬁ"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(120)] + [(200, None), (201, ""), (202, " "), (203, "a▁b"), (204, "漢" * 150)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute_alignment(texts)
    for block_bytes in (300, 16 << 20):
        out = token_align.align(df, block_bytes=block_bytes).collect()
        assert {r["doc_id"]: tuple(r)[1:] for r in out} == want
    assert sum(w[0] == 0 for w in want.values()) >= 3 and any(w[0] for w in want.values())


def test_alignment_query(spark, sf001):
    texts = [(r["doc_id"], r["text"]) for r in documents(spark, sf001).collect()]
    short = sorted(texts, key=lambda t: len(t[1] or ""))[:120]
    df = spark.createDataFrame(short, "doc_id long, text string")
    want = brute_alignment(short)
    assert {r["doc_id"]: tuple(r)[1:] for r in token_align.align(df).collect()} == want
    out = queries.op12_token_alignment(spark, sf001).collect()
    assert len(out) == len(texts)
    for r in out:
        if r["doc_id"] in want:  # figures that don't depend on the other documents
            w = want[r["doc_id"]]
            assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_group_links"]) == w[:5]
            assert r["groups_sha256"] == (hashlib.sha256(w[7].encode()).hexdigest() if w[0] else "")
    assert sum(r["n_links"] for r in out) > sum(r["n_best"] for r in out) > 0


def test_products():
    rng = np.random.default_rng(3)
    dense = [(rng.random((7, 9)) < 0.3).astype(int), (rng.random((9, 5)) < 0.4).astype(int)]
    csr = [token_align.Csr(np.concatenate([[0], np.cumsum(m.sum(axis=1))]), np.nonzero(m)[1], m.shape[1]) for m in dense]
    rows, columns, values = csr[0].product(csr[1])
    got = np.zeros((7, 5), int)
    got[rows, columns] = values
    assert (got == dense[0] @ dense[1]).all() and (values > 0).all()
    t = csr[0].transposed()
    assert [t.columns[t.starts[i]:t.starts[i + 1]].tolist() for i in range(9)] == [np.nonzero(c)[0].tolist() for c in dense[0].T]
    aligned = token_align.Aligned(np.array([2, 3, 1]), np.array([1, 1, 4]))
    assert list(zip(aligned.link_a, aligned.link_b, aligned.shared_bytes)) == [(0, 0, 1), (0, 1, 1), (1, 2, 3), (2, 2, 1)]
    assert aligned.group_links().tolist() == [2, 1, 1]
