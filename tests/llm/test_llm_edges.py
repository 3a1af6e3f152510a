"""Every operator on nulls, empty and long texts, ties, repeated rows, empty
tables and columns whose names the operators use themselves."""

import pytest
from pyspark.sql import functions as F

from sparkdod.llm import bpe, exact_dedup, line_dedup, mixing, near_dup, pii, quality, secret_scan, substring_dedup, token_align, token_count, toxicity

LONG = " ".join(f"word{i % 997}x{i % 1009}" for i in range(60_000))
SAME = "one two three four five six seven eight nine ten"
ROWS = [
    (1, None, "en", "a"), (2, "", None, None), (3, " \t\n\x0b\x0c\r ", "en", "b"), (4, LONG, "en", "a"), (5, LONG, "en", "a"),
    (6, SAME, "en", "b"), (7, SAME, "en", "b"), (7, SAME, "en", "b"), (8, SAME.replace(" ", "\n"), "en", None), (9, "x", "de", "a"),
    (None, SAME + " eleven", "en", "c"), (None, None, None, None), (10, "naïve 漢字 🙂 Ünïcode", "fr", "é"), (-5, "minus five words are here now", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that the operators use for their own columns.
CLASHING = ["block", "row", "size", "key", "nth", "h", "digest", "order", "set_id", "registers", "kept", "spans", "ids", "band", "node", "own", "n_cp", "copies", "i", "d", "k"]


def _one_row_each(out):
    return out.count()


OPERATORS = {
    "near_dup": lambda d: near_dup.near_duplicates(d), "substring_dedup": lambda d: substring_dedup.substring_dedup(d), "bpe": lambda d: bpe.encode(d, decoded=True),
    "pii": pii.find_pii, "quality": quality.clean, "exact_dedup": exact_dedup.exact_dedup, "line_dedup": line_dedup.line_dedup, "secrets": secret_scan.find_secrets,
    "mixing": mixing.mix, "toxicity": lambda d: toxicity.severity(d, toxicity.Model({"x": 1.0}, [0.5])),
    "token_align": token_align.align, "token_count": token_count.token_counts,
}


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHING}).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, name):
    rows = OPERATORS[name](odd).collect()
    assert len(rows) == len(ROWS)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_defined_results(spark, odd):
    near = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(odd, size=4).collect()}
    # no words: alone; equal sets: the smallest id; a NULL id joins the group of its text
    assert {(1, 0, 1, True), (2, 0, 2, True), (5, len({tuple(LONG.split()[i:i + 4]) for i in range(59_997)}), 4, False), (7, 7, 6, False), (8, 7, 6, False), (9, 1, 9, True), (None, 8, 6, False), (None, 0, None, True)} <= near
    exact = exact_dedup.exact_dedup(odd).collect()
    kept = sorted((r["keep_id"], r["group_size"]) for r in exact if r["kept"] and r["doc_id"] is not None)
    assert kept == [(-5, 1), (3, 4), (4, 2), (6, 4), (9, 1), (10, 1)]  # of the empty texts row 3 has the most code points
    assert sum(r["kept"] for r in exact) == 7
    sub = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(odd).collect()}
    assert {(1, 0, 0), (4, 60_000, 0), (5, 60_000, 60_000), (9, 1, 0)} <= sub
    mix = {(r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(odd).collect()}
    assert (1, 0, 0) in mix and (2, 0, 0) in mix
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.encode(odd).collect() if r["doc_id"] in (1, 2, 3)} == {1: 0, 2: 0, 3: 0}
    assert [r["severity"] for r in toxicity.severity(odd, toxicity.Model()).collect()] == [0.0] * len(ROWS)


def test_rows_with_all_columns(spark, odd):
    assert exact_dedup.deduplicated(odd).columns == odd.columns
    assert exact_dedup.deduplicated(odd).count() == 7
    assert near_dup.deduplicated(odd).columns == odd.columns
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0
    assert toxicity.without_toxic(odd, toxicity.Model({"x": 1.0}, [0.5])).filter("doc_id = 9").count() == 0


def test_near_dedup_keeps_one_row_of_each_component(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "end"])
    a, b = " ".join(words), " ".join(f"v{i}" for i in range(60))
    c = [" ".join([f"u{i}" for i in range(59)] + [x]) for x in ("one", "two", "three")]
    rows = [(1, a), (2, near), (2, b), (None, c[0]), (None, c[1]), (None, c[2]), (7, b), (8, "same text twice over and over"), (8, "same text twice over and over"), (9, None), (9, None)]
    out = [tuple(r) for r in near_dup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, (r for r in out if r[0] is not None))) == sorted(map(str, [(1, a), (2, b), (8, rows[7][1]), (9, None), (9, None)]))
    nulls = [t for i, t in out if i is None]
    assert len(nulls) == 1 and nulls[0] in c


@pytest.mark.parametrize("stage", [near_dup.deduplicated, exact_dedup.deduplicated, mixing.mixed])
def test_columns_with_dots_and_empty_tables(spark, stage):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumnsRenamed({"lang": "a.b"}).withColumn("c`d", F.lit(1))
    out = stage(df)
    assert out.columns == df.columns and out.count() > 0
    assert stage(df.limit(0)).count() == 0
