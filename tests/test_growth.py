"""Steps that a query's time or memory hangs on as its tables grow: they are dealt, made once, and made right."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.functions import text as X
from quillwork.operators import align, cluster, score, tags, typing_rules
from quillwork.plans import catalogue, derived
from quillwork.sources import io

SF = "/root/testdata/sf0.001"


def test_sentences_of_a_small_file_are_made_by_several_tasks(spark):
    for made in (derived.sentence_pairs(spark, SF), derived.tagged_sentences(spark, SF)):
        assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_scored_edits_are_made_once(spark):
    hyp, ref = derived.hypotheses(spark, SF)
    for edits in (hyp, ref):
        assert edits.inputFiles() and all("/quillwork/edits-" in f for f in edits.inputFiles())


def test_white_space_is_that_of_python(spark):
    space = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = ["", " ", "a", "".join(space), None, *[f"{x}a{x}{x}b​{x}" for x in space]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", X.tokens(F.col("t")).alias("k"), X.strip_space(F.col("t")).alias("s"), X.has_word(F.col("t")).alias("h")).collect()
    assert all((r["k"], r["s"], r["h"]) == ((None, None, None) if r["t"] is None else (r["t"].split(), r["t"].strip(), bool(r["t"].split()))) for r in got)


def test_places_of_edits_are_those_of_their_law(spark, tmp_path):
    rows = [(d, "s", " ".join("w" * n)) for d in (-40, -17, -1, 0, 1, 16, 17, 40) for n in (0, 1, 16, 17, 18, 60)] + [(None, "s", "w w"), (3, "s", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in derived.derived_edits(spark, str(tmp_path)).collect():
        assert [e["start"] for e in r["edits"]] == ([] if r["doc_id"] is None else [p for p in range(len(r["toks"] or [])) if (r["doc_id"] + p) % 17 == 0])


def test_runs_of_arrays_are_those_of_rows(spark):
    rng = random.Random(3)
    rows = [(k % 37 if k % 11 else None, [rng.choice(["a", "b", None]) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 3] + [rng.randrange(30) for _ in range(60)])]
    rows = [(k, g, [x if rng.random() < 0.8 else rng.choice(["a", "c", None]) for x in g]) for k, g in rows]
    for some in (rows, [r for r in rows if r[0] is not None and r[0] > 30][:4], []):
        df = spark.createDataFrame(some, "seq long, gold array<string>, pred array<string>")
        each = df.select("seq", F.posexplode(F.arrays_zip("gold", "pred")).alias("pos", "x")).select("seq", "pos", "x.gold", "x.pred")
        # rows of a seq that repeats, or of none, have ties in their places, so that only single ones are held against the rows
        alone = df.join(df.where("seq is not null").groupBy("seq").count().where("count = 1"), "seq", "left_semi")
        assert score.array_run_f1(alone, "seq", "gold", "pred").collect() == score.sequence_run_f1(each.join(alone.select("seq"), "seq", "left_semi"), "seq", "pos", "gold", "pred").collect()
    copies = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "a", "c"])] * 2 + [(None, ["a"], ["a"])], "seq long, gold array<string>, pred array<string>")
    r = score.array_run_f1(copies, "seq", "gold", "pred").first()
    assert (r["tp"], r["n_gold"], r["n_pred"]) == (1, 3, 3)


def test_sequence_run_f1_moves_no_words(spark):
    plan = catalogue.sequence_run_f1(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_m2_blocks_are_parsed_once(spark, tmp_path):
    blocks = ["S a b\nA 0 1|||R:X|||c|||REQUIRED|||-NONE-|||0\nA 1 1|||M:X", "S ", "S  \n ", " \nS x \nA 1|||U:X|||", "A 0 1|||R:X|||c", "Sx", "S \nA 0 0|||M:X|||d|||REQUIRED|||-NONE-|||1"]
    spark.createDataFrame([("\n\n".join(blocks),)], "value string").write.text(f"{tmp_path}/m2")
    raw = io.with_row_idx(spark.read.option("lineSep", "\n\n").text(f"{tmp_path}/m2"))
    want = raw.select(F.col("row_idx").alias("sent_id"), io.parse_m2(F.col("value")).alias("b")).where("b is not null").select("sent_id", "b.*")
    got = io.read_m2(spark, f"{tmp_path}/m2")
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and got.count() == 3
    assert io.flat_edits(got).select("start_tok")._jdf.queryExecution().optimizedPlan().toString().count(r"\|\|\|") == 1


def test_tags_are_counted_before_they_are_joined(spark):
    t = spark.createDataFrame([("$REPLACE_a",)] * 5 + [("$REPLACE_b",)] * 4 + [("$DELETE",)], "tag string")
    n = t.groupBy("tag").agg(F.count("*").alias("n"))
    assert set(tags.collapse_rare(n, weight="n").groupBy("tag").agg(F.sum("n").alias("n")).collect()) == set(tags.collapse_rare(t).groupBy("tag").agg(F.count("*").alias("n")).collect())
    vocab = spark.createDataFrame([("$REPLACE",), ("$REPLACE_a",), ("$KEEP",)], "tag string")
    assert set(tags.class_weights(n, vocab, "n").collect()) == set(tags.class_weights(t, vocab).collect())
    for query in (catalogue.rare_tag_collapse, catalogue.class_weights):
        assert all("/quillwork/tag-counts-" in f for f in query(spark, SF).inputFiles())


def test_a_lexicon_is_made_of_distinct_words(spark):
    assert all("/quillwork/words-" in f for f in catalogue._lexicon(spark, SF).inputFiles())


def test_sentences_of_arrays_are_compared_as_rows(spark):
    rng = random.Random(5)
    types = ["R:A", "R:B", "M:A", "UNK", None]

    def edits(repeat):
        some = [rng.randrange(0, 12, 2) for _ in range(rng.randrange(7))]
        return [(p, p + rng.randrange(3), rng.choice(types if repeat else [*types, "noop"]), rng.choice("xy")) for p in (some if repeat else sorted(set(some)))] + ([] if repeat or rng.random() < 0.8 else [(-1, -1, "noop", "-NONE-")])

    single = [(k, edits(False), edits(False)) for k in range(60)]
    odd = [(100 + k // 2, edits(True), edits(True)) for k in range(24)] + [(None, edits(True), edits(True))] * 2 + [(200 + k, edits(True), edits(True)) for k in range(24)] + [(300, None, [(0, 1, "R:A", "x")]), (301, [(0, 1, "R:A", "x")], None), (302, None, None)]
    shape = "array<struct<start:int,end:int,err_type:string,correction:string>>"
    for rows, modes in ((single + odd, score.MODES), (single, ["correction"]), ([], ["span"])):
        df = spark.createDataFrame(rows, f"sent_id long, hyp {shape}, ref {shape}")
        each = [df.select("sent_id", F.lit(0).alias("coder"), F.inline(side)) for side in ("hyp", "ref")]
        for mode in modes:
            hyp, ref = (score.edit_keys(e, mode) for e in each)
            want, got = score.compare(hyp.drop("coder"), ref), score.array_compare(df, mode)
            assert got.schema.simpleString() == want.schema.simpleString()
            assert sorted(got.groupBy("sent_id", "coder", "cat").sum("tp", "fp", "fn").collect(), key=str) == sorted(want.groupBy("sent_id", "coder", "cat").sum("tp", "fp", "fn").collect(), key=str)
    with pytest.raises(ValueError):
        score.array_compare(df, "words")


@pytest.mark.parametrize("query", [catalogue.prf_span_detection, catalogue.prf_rollup, catalogue.prf_correction_type])
def test_scores_are_made_of_counts_of_sentences(spark, query):
    made = query(spark, SF)
    assert made.inputFiles() and all("/quillwork/sentence-counts-" in f for f in made.inputFiles())
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()


def test_words_are_split_by_one_class_of_characters(spark):
    codes = spark.range(0x110000).where("(id < 55296 or id > 57343) and id <> 65279").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    odd = codes.where((F.size(X.tokens(F.concat(F.lit("a"), "c", F.lit("b")))) == 2) | ~X.has_word(F.col("c"))).select("id", "c", F.size(X.tokens(F.concat("c", F.lit("a"), "c", "c", F.lit("b"), "c"))).alias("n"), X.has_word(F.col("c")).alias("w"))
    got = odd.collect()
    assert [r.id for r in sorted(got)] == [x for x in range(0x110000) if chr(x).isspace()] and all(r.n == 2 and not r.w for r in got)
    assert "&&" not in str(X.tokens(F.col("c"))) + str(X.has_word(F.col("c")))
    rows = spark.createDataFrame([("",), (" \t",), (None,), ("\u3000a\x1c\u2003b\u200bc\n",), ("\ufeffa",)], "c string").select(X.tokens(F.col("c")).alias("t"), X.has_word(F.col("c")).alias("w")).collect()
    assert [tuple(r) for r in rows] == [([], False), ([], False), (None, None), (["a", "b\u200bc"], True), (["\ufeffa"], True)]


def test_silhouette_copies_no_point_for_the_blocks_it_meets(spark):
    """Blocks are rows of one written table; the plan has no copy of a point by block, and near, equal, far and odd points come out right."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3)) + 1e4
    x[20:30], x[30:35] = x[10:20], x[:5] + 1e-5
    y = [i % 3 if i % 20 else None for i in range(60)]
    p = spark.createDataFrame([(i % 58, [float(v) for v in r], c) for i, (r, c) in enumerate(zip(x, y))], "id long, x array<double>, cluster int").repartition(3)
    got = cluster.silhouette_rows(p, block=7)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "Generate" not in plan and plan.count("silhouette-blocks") + plan.count("Relation") >= 2
    sums = {}
    for i in range(60):
        for j in range(60):
            t = sums.setdefault((i % 58, y[i]), {}).setdefault(y[j], [0.0, 0])
            t[0], t[1] = t[0] + np.sqrt(((x[i] - x[j]) ** 2).sum()), t[1] + 1
    rows = got.collect()
    assert len(rows) == len(sums)
    for r in rows:
        by = sums[r["id"], r["cluster"]]
        a = next((t / (n - 1) for c, (t, n) in by.items() if c is not None and c == r["cluster"] and n > 1), 0.0)
        b = min((t / n for c, (t, n) in by.items() if None not in (c, r["cluster"]) and c != r["cluster"]), default=None)
        assert r["a"] == pytest.approx(a, abs=1e-9) and (r["b"] is None if b is None else r["b"] == pytest.approx(b, abs=1e-9))
    few = spark.createDataFrame([(0, [float("nan")], 0), (1, [1.0], 0), (2, [3.0], 1)], "id long, x array<double>, cluster int")
    assert {r["id"]: r["b"] for r in cluster.silhouette_rows(few).collect()}[1] == 2.0
    assert cluster.silhouette_rows(few.limit(0)).count() == 0


def test_silhouette_shares_the_step(spark):
    plan = catalogue.silhouette(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "Generate" not in plan


def test_merged_m2_moves_no_block(spark, tmp_path, monkeypatch):
    """Blocks keep the order of paths, files and splits; malformed ones go; an input may be written over; no block is dealt by ranges."""
    blocks = lambda tag, n: "\n\n".join(x for k in range(n) for x in (f"S {tag} {k}\nA 0 1|||R:X|||c{k}|||REQUIRED|||-NONE-|||0", "broken"))
    a, b, out = (str(tmp_path / x) for x in ("a", "b", "out"))
    for path, names in ((a, ("x", "y", "z")), (b, ("v",))):
        for i, name in enumerate(names):
            os.makedirs(path, exist_ok=True)
            with open(f"{path}/part-{i}", "w") as f:
                f.write(blocks(name, 40))
    want = [f"{t} {k}" for t in ("v", "x", "y", "z", "v") for k in range(40)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    monkeypatch.delattr(type(spark.range(1)), "repartitionByRange")
    try:
        io.merge_m2(spark, [b, a, b], out)
        read = io.read_m2(spark, out).orderBy("sent_id").collect()
        io.merge_m2(spark, [out, b], out, mode="overwrite", compression="gzip")
        again = io.read_m2(spark, out).orderBy("sent_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["source"] for r in read] == want and [r["sent_id"] for r in read] == list(range(200)) and read[1]["edits"][0]["correction"] == "c1"
    assert [r["source"] for r in again] == want + want[:40] and sorted(os.listdir(tmp_path)) == ["a", "b", "out"]
    with pytest.raises(Exception, match="already exists"):
        io.merge_m2(spark, [a], out)
    io.merge_m2(spark, [a], out, mode="append")
    assert io.read_m2(spark, out).count() == 360


def test_alignment_makes_the_cells_that_count(monkeypatch):
    """The path is Table's, of few cells: words far from the diagonal are never priced."""
    rng = random.Random(7)
    words = [f"{x}{y}{x}" for x in "abcdefgh" for y in "klmnop"]
    tok = lambda w: {"text": w, "lemma": w, "pos": "X", "tag": "", "dep": ""}
    cells = []
    for _ in range(150):
        a = [rng.choice(words[: rng.choice([3, 48])]) for _ in range(rng.randrange(1, 30))]
        b = [x for w in a for x in rng.choice([[w]] * 8 + [[], [w, w], [w[::-1] + "z"]])]
        if len(b) > 4:
            b[1], b[3] = b[3], b[1]
        info = [tok(w) for w in a], [tok(w) for w in b]
        want = align.Table(a, b, *info, *align.LINGUISTIC).path()
        assert all(align.linguistic_path(a, b, *info, most) == want for most in (None, abs(len(a) - len(b)), abs(len(a) - len(b)) + 2.5))
    monkeypatch.setattr(align, "char_floor", lambda *_: cells.append(1) or 0.0)
    a = [f"w{k}" for k in range(90)]
    b = [*a[:40], "other", *a[41:]]
    align.linguistic_path(a, b, [tok(w) for w in a], [tok(w) for w in b])
    assert len(cells) < 1500


def test_a_word_written_as_several_is_told_without_an_expression():
    tok = lambda w: {"text": w}
    cases = [("abcd", ["ab", "cd"], True), ("abcd", ["ab", "d"], True), ("aba", ["ab", "ba"], False), ("a.c", ["a", "c"], True), ("abxcxd", ["a", "x", "xd"], True), ("abxd", ["a", "x", "xd"], False), ("don't", ["do", "n't"], True)]
    for one, many, want in cases:
        edits = [("S", 0, 1, 0, 1), *[("I", 1, 1, k, k + 1) for k in range(1, len(many))]]
        assert align.splits_word([tok(one)], [tok(w) for w in many], edits) is want


def test_edits_are_typed_without_their_sentences(spark):
    pairs = derived.sentence_pairs(spark, SF)
    plan = typing_rules.typed_edits(pairs, spark.createDataFrame([("the",)], "word string"))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert joins and len([x for x in typing_rules.typed_edits(pairs).inputFiles()]) == 1
    above = plan[: plan.index("Generate")]
    assert "orig#" not in above.split("Join")[0] and "_o#" in plan
