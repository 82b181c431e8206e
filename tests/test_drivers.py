import pytest
from pyspark.sql import functions as F

from quillwork.operators import drivers
from quillwork.operators.align import minimise
from quillwork.sources import io


def blocks(spark, rows):
    return spark.createDataFrame([(i, s, s.split(), [(a, b, t, c, "REQUIRED", "-NONE-", str(k)) for a, b, t, c, k in e]) for i, s, e in rows], f"sent_id long, source string, tokens array<string>, edits {io.EDITS}")


def test_pairs_to_blocks(spark):
    pairs = spark.createDataFrame([(0, "a b c", "a b c", "a x c"), (1, "a b", "a  b", "a"), (2, " ", "x", "y"), (3, "sub way", "subway", "sub way")], "row_idx long, source string, t0 string, t1 string")
    got = {r["sent_id"]: [(e["start"], e["end"], e["err_type"], e["correction"], e["coder"]) for e in r["edits"]] for r in drivers.annotate_pairs(pairs, ["t0", "t1"]).collect()}
    assert got[0] == [(-1, -1, "noop", "-NONE-", "0"), (1, 2, "R:OTHER", "x", "1")]
    assert got[1] == [(1, 2, "U:OTHER", "", "1")]
    assert 2 not in got and got[3] == [(0, 2, "R:ORTH", "subway", "0"), (-1, -1, "noop", "-NONE-", "1")]


def test_minimise(spark):
    df = spark.createDataFrame([("a b c".split(), "a x c".split()), ("a b".split(), "a b".split()), ("a a".split(), "a".split()), ([], ["x"])], "o array<string>, c array<string>")
    got = [tuple(r["m"]) for r in df.select(minimise(F.col("o"), F.col("c"), F.lit(5), F.lit(5) + F.size("o")).alias("m")).collect()]
    assert got == [(6, 7, "x"), (7, 7, ""), (6, 7, ""), (5, 5, "x")]


def test_reannotate(spark):
    b = blocks(spark, [(0, "a b c d", [(1, 3, "X", "b q", 0), (3, 4, "Um", "", 0)]), (1, "e", [(-1, -1, "noop", "-NONE-", 0)])])
    gold = {r["sent_id"]: [(e["start"], e["end"], e["err_type"], e["correction"]) for e in r["edits"]] for r in drivers.reannotate(b, "gold").collect()}
    assert gold == {0: [(2, 3, "R:OTHER", "q"), (3, 4, "UNK", "")], 1: [(-1, -1, "noop", "-NONE-")]}
    auto = {r["sent_id"]: [(e["start"], e["end"], e["correction"]) for e in r["edits"]] for r in drivers.reannotate(b, "auto").collect()}
    assert auto == {0: [(2, 3, "q")], 1: [(-1, -1, "-NONE-")]}
    with pytest.raises(ValueError):
        drivers.reannotate(b, "other")


def test_chain_and_scores(spark):
    pairs = spark.createDataFrame([(0, "el a mers", "el au mers"), (1, "si casa", "și casa"), (2, "x y", "x y")], "row_idx long, source string, target string")
    lex = spark.createDataFrame([(0, "casa", "casă", "Ncfsry")], "row_idx int, form string, lemma string, msd string")
    got = {r["sent_id"]: (r["tags"], r["target"]) for r in drivers.training_table(pairs, lex, word_list=spark.createDataFrame([("a",)], "word string")).collect()}
    assert got[0] == (["$KEEP", "$REPLACE_VERB_au", "$KEEP"], "el au mers") and got[1] == (["$REPLACE_SPELL_și", "$KEEP"], "și casa")
    ref = blocks(spark, [(0, "a b c", [(0, 1, "R:OTHER", "x", 0), (1, 2, "R:SPELL", "y", 0), (0, 1, "R:OTHER", "z", 1)]), (1, "a", [])])
    hyp = blocks(spark, [(0, "a b c", [(0, 1, "R:OTHER", "z", 0)]), (1, "a", [(0, 1, "U:OTHER", "", 0)])])
    s = drivers.evaluate(hyp, ref).first()
    assert (s["tp"], s["fp"], s["fn"]) == (1, 1, 0)
    assert {r["cat"] for r in drivers.evaluate(hyp, ref, level=3).collect()} == {"R:OTHER"}
    with pytest.raises(ValueError):
        drivers.evaluate(hyp.where("sent_id = 0"), ref)
