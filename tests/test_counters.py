"""Counts that cost no pass, and the join of rows with their edits."""

from quillwork.functions.counters import Counters
from quillwork.operators import drivers, reclass, tags


def test_counts_of_a_run(spark):
    edit = "struct<start:int,end:int,err_type:string,correction:string>"
    rows = [(0, ["si", "b"], [(0, 1, "R:OTHER", "și")]), (1, ["a"], [(-1, -1, "noop", "-NONE-")]), (2, ["a", "b"], [(1, 1, "M:OTHER", ","), (0, 1, "R:NOUN", "x")]), (3, ["c"], [])]
    blocks = spark.createDataFrame(rows, f"sent_id long, tokens array<string>, edits array<{edit}>").repartition(3)
    c = Counters()
    out = reclass.pass_one_blocks(blocks, c)
    plain = {r["sent_id"]: r["edits"] for r in reclass.pass_one_blocks(blocks).collect()}
    assert {r["sent_id"]: r["edits"] for r in out.collect()} == plain and out.columns == blocks.columns
    assert c.get() == {"edits": 3, "retyped": 2}
    keeps = spark.createDataFrame([(k, ["$KEEP"] if k % 3 else ["$DELETE"]) for k in range(300)], "sent_id long, tags array<string>").repartition(4)
    c = Counters()
    got = tags.sample_clean(keeps, counters=c).collect()
    kept = sum(r["tags"] == ["$KEEP"] for r in got)
    assert c.get() == {"clean": 200, "written": len(got), "kept_clean": kept} and 0 < kept < 200
    c = Counters()
    assert tags.sample_clean(keeps.limit(0), counters=c).count() == 0 and c.get() == {"clean": 0, "written": 0, "kept_clean": 0}


def test_rows_with_their_edits(spark):
    left = spark.createDataFrame([("a", 1, "old"), ("a", 2, "old"), ("b", 3, "old"), (None, 4, "old"), ("c", 5, "old")], "source string, id int, err_type string")
    edits = spark.createDataFrame([("a", 0, 1, "R:X", "x"), ("a", 2, 2, "M:Y", None), ("z", 0, 1, "R:X", "x"), (None, 1, 2, "U:Z", "")], "source string, start_tok long, end_tok long, err_type string, correction string")
    got = sorted(tuple(r) for r in drivers.with_edits(left, edits).select("id", "start_tok", "end_tok", "err_type", "correction").collect())
    assert got == [(1, 0, 1, "R:X", "x"), (1, 2, 2, "M:Y", ""), (2, 0, 1, "R:X", "x"), (2, 2, 2, "M:Y", ""), (3, -1, -1, "correct", ""), (4, 1, 2, "U:Z", ""), (5, -1, -1, "correct", "")]
