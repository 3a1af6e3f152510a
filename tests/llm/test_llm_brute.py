"""Operators against brute force, an exact round trip or held-out accuracy."""

import hashlib
import random
import re
import struct
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkdod.llm import bpe, line_dedup, mixing, near_dup, pii, quality, queries, secret_scan, substring_dedup, toxicity
from sparkdod.llm.common import documents

SCHEMA = "doc_id long, text string, lang string, source string"
SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark, sf001):
    return {r["doc_id"]: r["text"] for r in documents(spark, sf001).collect()}


# -- near dedup ---------------------------------------------------------------
def shingle_set(text):
    w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()


def brute_components(sets):
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def edited(rng, words, share):
    return " ".join(f"e{rng.randrange(10 ** 6)}" if rng.random() < share else w for w in words)


@pytest.mark.parametrize("chunk_rows, dense", [(1024, 4), (1024, 0), (7, 0), (7, 1000)])
def test_near_duplicates_of_a_large_group(spark, chunk_rows, dense):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(i, edited(rng, base, 0.022)) for i in range(160)] + [(200 + i, edited(rng, base[:60] + [f"v{i}" for i in range(60)], 0.02)) for i in range(40)]
    rows += [(300 + i, " ".join(f"r{rng.randrange(10 ** 6)}" for _ in range(50))) for i in range(40)] + [(400, rows[3][1]), (401, "Two Words"), (402, "two words"), (403, "")]
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4, chunk_rows=chunk_rows, dense=dense).collect()
    sets = {i: shingle_set(t) for i, t in rows}
    want = brute_components(sets)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2 ** 63, 3000).astype(np.uint64)
    a, b = h[:2000], h[500:]
    values = near_dup.register_values(np.concatenate([a, b, h]), np.array([0, 2000, 4500, 7500]))
    assert (near_dup.merge_registers(values[0], values[1]) == values[2]).all()
    above, below = (values[0] > values[1]).sum(), (values[0] < values[1]).sum()
    j = near_dup.likely_jaccard(*(np.array([x], float) for x in (above, below, 2000, 2500)))[0]
    assert abs(j - 0.5) < 0.15


# -- substring dedup ----------------------------------------------------------
@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(60):
        w = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 90))]
        if rng.random() < 0.5:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(5):30 - rng.randrange(5)]
        if rng.random() < 0.2:
            w += w
        rows.append((i * 3 - 20, rng.choice(SPACES).join(w)))
    rows.append((1000, " ".join(["a"] * 70)))
    out = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=2000, piece_bits=10).collect()}
    seen, gone = set(), defaultdict(set)
    for i, t in sorted(rows):
        w = words_of(t)
        for k in range(len(w) - 19):
            key = tuple(w[k:k + 20])
            if key in seen:
                gone[i].update(range(k, k + 20))
            seen.add(key)
    for i, t in rows:
        w = words_of(t)
        assert (out[i]["n_words"], out[i]["n_removed"]) == (len(w), len(gone[i]))
        assert out[i]["kept_text"] == " ".join(x for k, x in enumerate(w) if k not in gone[i])


# -- BPE ----------------------------------------------------------------------
@pytest.fixture(scope="module")
def reference_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own_tokenizer():
    with open(bpe.default_path(), encoding="utf-8") as f:
        return bpe.load(f.read())


def test_bpe_query(spark, sf001, texts, reference_tokenizer):
    rows = queries.op3_bpe(spark, sf001).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference_tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)))
        assert r["decoded_sha256"] == sha(reference_tokenizer.decode(ids, skip_special_tokens=False))


def test_bpe_vocabulary(reference_tokenizer, own_tokenizer):
    for token in list(reference_tokenizer.get_vocab())[::7]:
        text = token.replace("</w>", " ")
        assert list(np.frombuffer(own_tokenizer.encode(text), "<u4")) == reference_tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("aabnis'stdv \n", max_size=60), st.text("éÇΣσςİ\x1c\x85\xa0½²Ⅷ漢🙂ﬁǅ <|endoftext|>", max_size=40)))
def test_bpe_texts(reference_tokenizer, own_tokenizer, text):
    text = "".join(c for c in text if unicodedata.category(c) not in ("Cs", "Cn"))
    ids = reference_tokenizer.encode(text, add_special_tokens=False).ids
    packed = own_tokenizer.encode(text)
    assert list(np.frombuffer(packed, "<u4")) == ids
    assert own_tokenizer.decode(packed).decode() == reference_tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_decode_table(spark, reference_tokenizer):
    df = spark.createDataFrame([(1, "Hello, WORLD"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df)).collect()} == {1: "hello</w> ,</w> world</w>", 2: ""}


# -- PII ----------------------------------------------------------------------
PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def pii_base(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PII.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


def test_pii_query(spark, sf001, texts):
    for r in queries.op4_pii(spark, sf001).collect():
        base = pii_base(texts[r["doc_id"]])
        assert r["base_sha256"] == sha(",".join(base)) and r["spans"].startswith(",".join(base))


def test_pii_patterns(spark):
    rng = random.Random(5)
    parts = ["a@b.c", "_d@e.f", "x%y@h-1.org", "1.2.3.4", ".5.6.7.8", "256.1.1.1", "0001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+49", "é🙂", " ", "1", "2", "@", "+", ".", "-", "5555555555554444"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))) for i in range(400)] + [(500, "1" * 30_000), (501, "1 " * 20_000), (502, "a" * 50_000 + "@"), (503, "a@b" + ".c" * 9_000), (504, None)]
    for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] in pii.BASE_KINDS] == pii_base(dict(rows)[r["doc_id"]])


def test_pii_checksum_and_context(spark):
    rows = [(1, "my IBAN is DE89 3704 0044 0532 0130 00 ok"), (2, "IBAN DE89 3704 0044 0532 0130 01 is wrong"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789"), (5, "call (212) 555-0123 now"), (6, "code 212-555-0123")]
    got = {r["doc_id"]: [(s["kind"], s["match"]) for s in r["spans"]] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [("iban", "DE89 3704 0044 0532 0130 00")], 2: [], 3: [("ssn", "123-45-6789")], 4: [], 5: [("local_phone", "(212) 555-0123")], 6: []}


def test_pii_iban_before_words_like_its_groups(spark):
    ibans = ["BE68 5390 0754 7034", "AT611904300234573201", "ES9121000418450200051332", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"]
    tails = ["", " BIC", " VISA", " VISA CARD", " 2024 EUR", " Bic", ".", " BIC1 is it"]
    rows = [(i, f"pay to {iban}{tail}") for i, (iban, tail) in enumerate((x, y) for x in ibans for y in tails)] + [(900, "BE68 5390 0754 7035 BIC"), (901, "BE68 5390 0754 70341")]
    got = {r["doc_id"]: [(s["kind"], s["match"], s["start"], s["end"]) for s in r["spans"] if s["kind"] == "iban"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: [("iban", iban, 7, 7 + len(iban))] for i, (iban, _) in enumerate((x, y) for x in ibans for y in tails)}
    assert got == want | {900: [], 901: []}


# -- quality ------------------------------------------------------------------
def test_quality_query(spark, sf001, texts):
    for r in queries.op5_quality(spark, sf001).collect():
        t = texts[r["doc_id"]]
        w = words_of(t)
        windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        n = Counter(windows)
        repeated = {k for i, x in enumerate(windows) if n[x] > 1 for k in range(i, i + 5)}
        lines = [x for x in t.split("\n") if words_of(x)]
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == \
            (len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(repeated), failed)
        assert not (failed and r["kept"])


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("n_words >= 10").select("kept", "quality").collect()
    assert sum(r["kept"] for r in rows if r["quality"] == 1) >= 0.97 * sum(r["quality"] for r in rows)
    assert sum(not r["kept"] for r in rows if r["quality"] == 0) >= 0.9 * sum(r["quality"] == 0 for r in rows)


def test_line_rules():
    assert quality.bad_line("A sentence with a few words, and an end.") is None
    assert quality.bad_line("home | about | contact | help") == "navigation"
    assert quality.bad_line("BUY!! NOW!! CHEAP!!") == "punctuation"
    assert quality.bad_line("We use cookies, see our privacy policy.") == "boilerplate"
    assert quality.bad_line("la " * 40) == "monotony"
    assert quality.bad_line("   ") is None


# -- lines --------------------------------------------------------------------
def earlier_runs(rows):
    """For each (id, text), the lines that belong to a run of two non-blank lines standing earlier elsewhere."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        lines = t.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip()]
        out[i] = set()
        for a, b in zip(full, full[1:]):
            if (lines[a], lines[b]) in seen:
                out[i] |= {a, b}
            seen.setdefault((lines[a], lines[b]), i)
    return out


def passages(seed, longest):
    """Every passage of 3 to 10 lines stands in two documents between different neighbours."""
    rng, rows, planted = random.Random(seed), [], {}
    for n in range(3, longest + 1):
        for k in range(30):
            passage = [f"passage {n} {k} line {i}." for i in range(n)]
            for copy in range(2):
                before, after = ([f"own {n} {k} {copy} {rng.random()}" for _ in range(rng.randrange(1, 6))] for _ in range(2))
                planted[len(rows)] = (n, copy, set(range(len(before), len(before) + n)))
                rows.append((len(rows), "\n".join(before + passage + after)))
    return rows, planted


def test_line_dedup_finds_passages_between_different_neighbours(spark):
    rows, planted = passages(11, 10)
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found, all_lines = Counter(), Counter()
    for i, t in rows:
        kept = set(out[i]["kept_text"].split("\n"))  # lines of a document are all different here
        lost = {k for k, x in enumerate(t.split("\n")) if x not in kept}
        n, copy, own = planted[i]
        assert out[i]["n_removed_lines"] == len(lost) and (lost <= own if copy else not lost)  # nothing else goes, first copies stay
        found[n] += len(lost)
        all_lines[n] += len(own) * copy
    assert sum(found.values()) >= 0.95 * sum(all_lines.values())
    assert all(found[n] >= 0.9 * all_lines[n] for n in all_lines)


def test_line_dedup_removes_only_what_stands_earlier(spark):
    rng = random.Random(9)
    shared = [f"shared line {i}." for i in range(30)]
    rows = []
    for i in range(60):
        own = [f"own {i} {k} {rng.random()}" for k in range(rng.randrange(0, 8))]
        own[1:1] = shared[rng.randrange(4):rng.randrange(10, 30)] if rng.random() < 0.6 else []
        rows.append((i, "\n".join(own)))
    may, total, want = earlier_runs(rows), 0, 0
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        kept = set(out[i]["kept_text"].split("\n"))
        lost = {k for k, x in enumerate(t.split("\n")) if x and x not in kept}
        assert lost <= may[i]
        total, want = total + len(lost), want + len(may[i])
    assert total >= 0.95 * want > 300


def test_line_dedup_query_against_brute_force(spark, sf001, texts):
    rows = [(i, t or "") for i, t in texts.items()]
    may = earlier_runs(rows)
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(documents(spark, sf001)).collect()}
    assert all(r["n_lines"] == len((texts[i] or "").split("\n")) for i, r in got.items())
    removed, want = sum(r["n_removed_lines"] for r in got.values()), sum(map(len, may.values()))
    # blank lines inside removed runs go too
    blank = sum(1 for i, t in rows for x in t.split("\n") if not x.strip())
    assert 0.95 * want <= removed <= want + blank


def test_line_chunks_depend_on_their_own_lines():
    lines = [f"line {i}" for i in range(200)]
    bodies = lambda x: {c for _, _, c in line_dedup.chunks("\n".join(x))}
    assert bodies(lines) <= bodies(["new", *lines]) and len(bodies(lines) & bodies(lines[:100] + ["new"] + lines[100:])) >= len(bodies(lines)) - 5
    lengths = Counter(b - a for a, b, _ in line_dedup.chunks("\n".join(lines)))
    assert set(lengths) == {2, 3}  # some borders are forbidden


def test_line_chunks_of_one_fingerprint_are_compared_by_bytes(spark, monkeypatch):
    """With a fingerprint that takes all chunks for one, only equal bytes go."""
    rows = [(i, f"a {i % 3}\nb {i % 3}\nc {i}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.xxhash64("text"))
    table = line_dedup.chunk_rows(df, list(line_dedup.FIELDS), 3).withColumns({"h": F.lit(1).cast("long"), "g": F.lit(1).cast("long")})
    monkeypatch.setattr(line_dedup, "chunk_rows", lambda rows, columns, longest, repeated=None: table.select(columns))
    out = {r["doc_id"]: r["n_removed_lines"] for r in line_dedup.line_dedup(df.drop("row")).collect()}
    want = {i: 0 for i in range(9)}
    seen = set()
    for i, t in rows:
        for a, b, body in line_dedup.chunks(t):
            want[i] = max(want[i], b - a) if body in seen else want[i]
        seen |= {body for _, _, body in line_dedup.chunks(t)}
    assert out == want and sum(want.values()) > 0


# -- secrets ------------------------------------------------------------------
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets_base(t):
    t = t or ""
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return [x for _, _, x in sorted(found)]


def test_secrets_query(spark, sf001, texts):
    for r in queries.op8_secrets(spark, sf001).collect():
        assert r["base_sha256"] == sha(",".join(secrets_base(texts[r["doc_id"]])))


def test_secret_formats_are_learnt(spark):
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    fresh = lambda: "".join(rng.choice(letters) for _ in range(32))
    rows = [(i, f'some text API_KEY: "{fresh()}" and more') for i in range(300)]
    held = [(1000 + i, f"a bare {fresh()} in text") for i in range(100)]
    clean = [(2000 + i, "ordinarily hyphenated-words-of-some-length-2 pass-through-unmarked_1 and 1234567890123456789012") for i in range(100)]
    out = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secret_scan.find_secrets(spark.createDataFrame(rows + held + clean, "doc_id long, text string")).collect()}
    assert all(out[i] == ["assign"] for i, _ in rows)
    assert sum(out[i] == ["format"] for i, _ in held) >= 90
    assert sum("format" in out[i] for i, _ in clean) <= 5


def held_out(rng, kind, n):
    """A credential of a kind and length class that the base patterns don't take when it stands alone."""
    if kind == "hex":
        return "".join(rng.choice("0123456789abcdef") for _ in range(n))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    return "".join(rng.choice(letters) for _ in range(n))


def secret_rates(seed=4):
    """Models learnt from the documents of sf0.01 and labelled credentials of 12 to 40 characters: recall on
    held-out ones by length, and the share of other tokens found, in documents that were not learnt from."""
    import pyarrow.parquet as pq

    rng = random.Random(seed)
    lengths = (12, 14, 16, 20, 24, 32, 40)
    train = {"assign": [held_out(rng, "assign", n) for n in lengths for _ in range(70)], "hex": [held_out(rng, "hex", n) for n in (16, 32, 40) for _ in range(160)]}
    tables = secret_scan.learn(train)
    tokens = lambda sf: {s[3] for t in pq.read_table(f"/root/testdata/{sf}/documents.parquet")["text"].to_pylist() if t for s in secret_scan.candidates(t, secret_scan.base_spans(t))}
    plain = secret_scan.Ordinary(secret_scan.bigrams("\n".join(t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()).encode()))
    words = sorted(tokens("sf0.1") - tokens("sf0.01"))
    hit = lambda tokens: sum(secret_scan.format_score(tables, plain, t, 0.2) is not None for t in tokens) / len(tokens)
    recall = {("assign", n): hit([held_out(rng, "assign", n) for _ in range(300)]) for n in lengths}
    return tables, recall, hit(words)


def test_secret_automata_have_states_and_recall():
    tables, recall, wrong = secret_rates()
    assert all(len(table) >= 2 for table, _ in tables.values())  # lengths are judged apart from characters
    assert all(r >= 0.9 for r in recall.values()), recall
    assert wrong <= 0.02, wrong


def test_every_token_of_twelve_characters_is_a_candidate():
    text = "password=abcdefghijkl1 abcdefghijkl AbcdefghijkL shorttoken1 0123456789ab abc/def+ghi=="
    found = [s[3] for s in secret_scan.candidates(text, secret_scan.base_spans(text))]
    assert found == ["abcdefghijkl", "AbcdefghijkL", "0123456789ab", "abc/def+ghi=="]


# -- mixing -------------------------------------------------------------------
def brute_targets(size, most=3.0):
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight, total = {s: k % 3 + 1 for k, s in enumerate(order)}, sum(size.values())
    target, capped = {}, {}
    while True:
        rest = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / (sum(weight[s] for s in rest) or 1)
        target = capped | {s: weight[s] * level for s in rest}
        over = [s for s in rest if target[s] > most * size[s]]
        if not over:
            return target
        capped |= {s: most * size[s] for s in over}


@pytest.mark.parametrize("block_rows", [2048, 150])
def test_mixing(spark, block_rows):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.1) * 5)), "en", rng.choice(["a", "b", "c", "d", "é", None, "a", "a", "a", "a"])) for i in range(2500)] + [(9999, "one tiny source", "en", "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df, block_rows=block_rows).collect()
    size = Counter()
    for r in out:
        size[r["source"]] += r["size"]
    target, taken = brute_targets(dict(size)), Counter()
    for r in out:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert r["size"] == len(words_of(rows[r["doc_id"]][1] if r["doc_id"] < 9999 else rows[-1][1])) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert not {s: (taken[s], target[s]) for s in target if abs(taken[s] - target[s]) > max(8, 0.01 * target[s])}
    again = mixing.mix(df.repartition(7), block_rows=block_rows).collect()
    assert {(r["doc_id"], r["taken"]) for r in out} == {(r["doc_id"], r["taken"]) for r in again}
    listed = Counter(r["doc_id"] for r in mixing.mixed(df, block_rows=block_rows).select("doc_id").collect())
    assert all(listed[r["doc_id"]] == r["copies"] for r in out if r["size"])


def _mixed_sizes(spark, sizes, **parameters):
    rows = [(s, n) for s, many in sizes.items() for n in many]
    df = spark.createDataFrame([(i, " ".join(["w"] * n), "en", s) for i, (s, n) in enumerate(rows)], SCHEMA)
    taken, target = Counter(), {}
    for r in mixing.mix(df, **parameters).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    listed = Counter()
    for r in mixing.mixed(df, **parameters).select("source", "text").collect():
        listed[r["source"]] += len(words_of(r["text"]))
    assert listed == +taken
    return taken, target


def test_mixing_takes_a_document_above_the_target_if_that_is_nearer(spark):
    taken, target = _mixed_sizes(spark, {"a": [800], "b": [1000], "c": [1200]})
    assert target == {"a": 500, "b": 1000, "c": 1500} and taken == {"a": 800, "b": 1000, "c": 1200}
    taken, target = _mixed_sizes(spark, {"a": [10_000] + [100] * 10, None: [100] * 88}, weights=(1,))
    assert target == {"a": 9900, None: 9900} and taken == {"a": 10_000, None: 9900}
    taken, target = _mixed_sizes(spark, {"a": [1001, 700], "b": [100] * 6}, weights=(1000, 1301))  # 700 or 1,400 is farther off than 1,001
    assert abs(target["a"] - 1000) < 1e-6 and taken == {"a": 1001, "b": 1300}
    taken, target = _mixed_sizes(spark, {"a": [3000, 100, 100, 100], "b": [2100]}, weights=(1, 20))  # the others reach it
    assert abs(taken["a"] - target["a"]) <= 50


def test_mixing_of_small_sources_is_no_farther_off_than_any_document_alone(spark):
    rng = random.Random(8)
    sizes = {f"s{k:02d}": [int(rng.paretovariate(0.9) * 20) for _ in range(rng.randrange(1, 5))] for k in range(40)}
    sizes["s00"] = sizes["s00"] + [4000]
    taken, target = _mixed_sizes(spark, sizes)
    for s, many in sizes.items():
        assert all(abs(taken[s] - target[s]) <= n - target[s] + 1e-6 for n in many if n > target[s])
        assert taken[s] or all(2 * target[s] <= n for n in many)


# -- toxicity -----------------------------------------------------------------
def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 2 = 0"), queries.severity_grade())
    assert model.thresholds == sorted(model.thresholds)
    held = toxicity.severity(docs, model).withColumnRenamed("toxic", "found").join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    clean, bad = [r for r in held if not r["toxic"]], [r for r in held if r["toxic"]]
    assert sum(r["found"] for r in clean) <= 0.01 * len(clean)
    assert sum(r["found"] for r in bad) >= 0.85 * len(bad)  # some labels are noise
    mean = lambda rows: sum(r["severity"] for r in rows) / len(rows)
    assert mean(bad) > 0.5 > 0.05 > mean(clean)


def test_toxicity_of_too_many_grades_is_an_error(spark):
    docs = spark.range(101).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    with pytest.raises(ValueError, match="100 grades"):
        toxicity.train(docs, docs, F.col("doc_id"))


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.random(600) * 4
    grades = np.digitize(x + rng.normal(0, 0.3, 600), [1, 2.5])
    w, theta = toxicity.fit_ordinal([{0: np.expm1(v)} for v in x], grades, np.ones(600), 1, 3, ridge=0)
    assert w[0] > 0 and theta[0] < theta[1]
    above = toxicity.Model({"f": 1.0}, list(theta)).above(w[0] * x)
    assert np.corrcoef(above.sum(axis=1), grades)[0, 1] > 0.9
