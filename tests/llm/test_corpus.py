"""Each corpus operator against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillwork.llm import chat, common, decontam, html_extract, licenses, mixing, near, quality, sharding, simhash, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, size string, kept string"
WORDS = "der die das und ein ist mit von auf an in im es er sie wir ihr nicht auch nur noch schon sehr viel mehr".split()
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=120, seed=3):
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) + r.choice(["", "", "s", "en", "t"]) for _ in range(r.randint(60, 200))) for _ in range(12)]
    passage = " ".join(r.choice(WORDS) + str(k) for k in range(70))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "ein"), (4, "ein zwei")]
    for i in range(5, n):
        t = r.choice(base)
        kind = r.random()
        if kind < 0.3:
            w = t.split()
            w[r.randrange(len(w))] = "anders"
            t = " ".join(w)
        elif kind < 0.5:
            w = t.split()
            at = r.randrange(len(w))
            t = " ".join(w[:at]) + "\n" + passage + "\n" + " ".join(w[at:])
        elif kind < 0.8:
            t = " ".join(r.choice(WORDS) for _ in range(r.randint(1, 150)))
        rows.append((i, t))
    rows.append((n, " ".join(r.choice(WORDS) for _ in range(8000))))
    rows.append((20, rows[20][1]))  # a repeated row
    return [(i, t, "de", [None, "a", "b", "c"][i % 4] if i else None, len(t or ""), "x", "y", "z") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return SPACE.findall(t or "")


def test_vectorised_words():
    import pyarrow as pa

    texts = ["a b\tc", None, "", "  ", "ä ö\x0bü\x85x", "a\x1cb c", "end"]
    t = common.Tokens(pa.array(texts))
    assert [bytes(t.data[a:b]).decode() for a, b in zip(t.start, t.end)] == [w for x in texts for w in words(x)]
    assert t.doc.tolist() == [i for i, x in enumerate(texts) for _ in words(x)]
    one = {bytes(t.data[a:b]): h for a, b, h in zip(t.start, t.end, t.hash)}
    other = common.Tokens(pa.array(["zz c end a"]))
    assert {bytes(other.data[a:b]): h for a, b, h in zip(other.start, other.end, other.hash)}[b"c"] == one[b"c"]


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100, 100 + k) for k in range(1, 40)] + [(i, i + 1) for i in range(200, 230)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_covering_masks_cover():
    masks = simhash.covering_masks(list(range(64)))
    assert len(masks) == 15 and all(m.bit_count() == 32 for m in masks)
    r = random.Random(2)
    for _ in range(3000):
        d = sum(1 << p for p in r.sample(range(64), 3))
        assert any(not d & m for m in masks)
    for path in [(0,), (3, 7), (1, 2, 14)]:
        deep = simhash.mask_tree(path)
        fixed = simhash.mask_tree(path[:-1])[path[-1]] if len(path) > 1 else masks[path[0]]
        for _ in range(300):
            free = [p for p in range(64) if not fixed >> p & 1]
            d = sum(1 << p for p in r.sample(free, min(3, len(free))))
            assert any(not d & m for m in deep)


def plain_fingerprint(text):
    """The contract's fingerprint, bit by bit."""
    import xxhash

    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[j : j + 3]) for j in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def simhash_brute(rows):
    fp = {}
    for row in rows:
        fp.setdefault(plain_fingerprint(row[1]), []).append(row[0])
    keys, parent = sorted(fp), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for k, ids in fp.items():
        least[find(k)] = min(least.get(find(k), 10**9), *ids)
    return {i: (f"{k:016x}", least[find(k)]) for k, ids in fp.items() for i in ids}


@pytest.mark.parametrize("bucket", [128, 2])
def test_simhash(spark, docs, bucket):
    want = simhash_brute(corpus())
    nodes = simhash.fingerprints(docs).groupBy("fp").agg(F.min("doc_id").alias("least"))
    pairs = {(r["a"], r["b"]) for r in simhash.links(nodes.select("fp"), bucket=bucket).collect()}
    keys = sorted(r["fp"] for r in nodes.collect())
    assert pairs == {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(corpus())
    assert all((r["fingerprint"], r["component_id"]) == want[r["doc_id"]] for r in got)
    kept = [r["doc_id"] for r in simhash.representatives(docs).collect()]
    assert sorted(kept) == sorted({c for _, c in want.values()})
    if bucket == 128:
        a, b = "der die das und ein ist mit von auf an", "sie wir ihr nicht auch nur noch schon sehr viel"
        rows = spark.createDataFrame([(1, a, "k"), (5, a, "k"), (5, b, "k"), (5, b, "k"), (None, b, "k")], "doc_id long, text string, component_id string")
        assert sorted((r["doc_id"], r["text"]) for r in simhash.representatives(rows).collect()) == [(1, a), (5, b)]


def substring_brute(rows):
    """The contract's digest of each row (doc_id, text), as a Counter."""
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        w = words(t)
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    want = Counter()
    for i, t in rows:
        w = words(t)
        cut = [False] * len(w)
        for j in range(len(w) - 49):
            if i is not None and first[tuple(w[j : j + 50])] < i:
                cut[j : j + 50] = [True] * 50
        want[(i, len(w), sum(cut), hashlib.sha256(" ".join(x for x, c in zip(w, cut) if not c).encode()).hexdigest())] += 1
    return want


def test_substring(docs):
    rows = [(r[0], r[1]) for r in corpus()]
    got = substring.factored(docs).collect()
    want = substring_brute(rows)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want and sum(x[2] for x in want) > 0
    # factors and literals give the words back, and lie inside the spans
    text = {i: words(t) for i, t in rows}
    for r in got:
        own = text[r["doc_id"]]
        end = 0
        for f in r["factors"] or []:
            assert f["start"] >= end and f["length"] >= 50 and f["ref"] < r["doc_id"]
            assert text[f["ref"]][f["ref_start"] : f["ref_start"] + f["length"]] == own[f["start"] : f["start"] + f["length"]]
            assert any(s["start"] <= f["start"] and f["start"] + f["length"] <= s["start"] + s["length"] for s in r["spans"])
            end = f["start"] + f["length"]
        assert sum(s["length"] for s in r["spans"] or []) == r["n_removed"]


def test_substring_of_rows_that_share_an_id(spark):
    r = random.Random(8)
    a = " ".join(r.choice(WORDS) + str(r.randrange(99)) for _ in range(60))
    again = " ".join(["immer wieder das selbe"] * 40)
    rows = [(1, a), (5, a + " z"), (5, "c " + a), (6, "x"), (6, "x"), (7, again), (8, "erst " + again + " dann " + a), (9, a + " " + a), (None, a), (3, None)]
    schema = "doc_id long, text string, k long, hits string, sha string"
    df = spark.createDataFrame([(*x, 1, "h", "s") for x in rows], schema)
    got = substring.factored(df).collect()
    assert Counter((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got) == substring_brute(rows)


def test_parse_is_greedy():
    import numpy as np

    hit = np.arange(10, 40)
    ref = np.where(hit < 25, 3, 4)
    start = np.where(hit < 25, hit - 10, hit)
    factors, spans = substring.parse(200, hit, ref, start)
    assert factors == [(10, 64, 3, 0)] and spans == [(10, 79)]
    hit = np.concatenate([np.arange(10, 40), np.arange(80, 90)])
    factors, spans = substring.parse(200, hit, np.full(40, 3), hit - 10)
    assert factors == [(10, 79, 3, 0), (89, 50, 3, 79)] and spans == [(10, 129)]


def test_quality_counts(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(5, 60)], "doc_id long, quality int, toxic int")
    crf = quality.train(docs, labels)
    for r in quality.assess(docs, crf, ("doc_id", "text")).collect():
        t = r["text"] or ""
        w, seen, dup = words(t), set(), 0
        for line in t.split("\n"):
            dup += bool(words(line)) and line in seen
            seen.add(line)
        c, m = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2)), [0] * len(w)
        for j in range(len(w) - 2):
            if c[tuple(w[j : j + 3])] > 1:
                m[j : j + 3] = [1] * 3
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(m))
        assert r["base_failed"] == (len(w) < 50 or 100 * sum(m) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.train(docs, labels.where("false")).decode(__import__("numpy").zeros((2, quality.FEATURES)), __import__("numpy").array([0, 2])).tolist() == [1, 1]


def test_viterbi_is_best():
    import itertools

    import numpy as np

    from quillwork.llm.crf import ChainCRF

    rng = np.random.default_rng(0)
    crf = ChainCRF(2)
    crf.w, crf.trans = rng.normal(size=3), rng.normal(size=(2, 2))
    first = np.array([0, 3, 3, 8, 9])
    x = rng.normal(size=(9, 2))
    got, e = crf.decode(x, first), crf.emissions(x)
    for a, b in zip(first, first[1:]):
        score = lambda y: sum(e[a + t] * y[t] for t in range(b - a)) + sum(crf.trans[y[t], y[t + 1]] for t in range(b - a - 1))
        if b > a:
            assert score(got[a:b]) == pytest.approx(max(score(y) for y in itertools.product((0, 1), repeat=b - a)))


def test_mixing(docs):
    rows = mixing.mixed(docs).collect()
    src = {}
    for r in rows:
        s = src.setdefault(r["source"], [0, 0, r["target"]])
        s[0] += r["size"]
        s[1] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["source_size"] is not None
    total = sum(s[0] for s in src.values())
    assert sum(s[2] for s in src.values()) == pytest.approx(1.5 * total)
    names = sorted((k for k in src if k is not None)) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    open_, target, left = set(names), {}, 1.5 * total
    while open_:
        level = left / sum(weight[k] for k in open_)
        full = {k for k in open_ if 2 * src[k][0] <= level * weight[k]}
        if not full:
            target |= {k: level * weight[k] for k in open_}
            break
        target |= {k: 2.0 * src[k][0] for k in full}
        left -= sum(2 * src[k][0] for k in full)
        open_ -= full
    assert all(src[k][2] == pytest.approx(target[k]) and src[k][1] <= src[k][2] + 1e-6 for k in names)
    again = mixing.mixed(docs).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    copies = Counter(r["doc_id"] for r in mixing.remixed(docs).collect())
    assert copies == Counter({d: n for d, n in ((d, sum(r["copies"] for r in rows if r["doc_id"] == d)) for d in {r["doc_id"] for r in rows}) if n})


def test_sharding(docs):
    rows = corpus()
    got = sharding.sharded(docs).collect()
    n = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(n.values()) - min(n.get(s, 0) for s in range(16)) <= 1
    for s in n:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n[s]))
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in got)
    full = sharding.with_shards(docs).collect()
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in full) == Counter((r["doc_id"], r["shard"], r["slot"]) for r in got)


def test_sharding_keeps_copies_together(spark):
    rows = [(i, f"text {i // 4}") for i in range(160)] + [(1000 + i, "hot") for i in range(90)]
    got = {r["doc_id"]: r["shard"] for r in sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    cut = sum(len({got[i + k] for k in range(4)}) > 1 for i in range(0, 160, 4))
    assert cut <= 16 and max(Counter(got.values()).values()) - min(Counter(got.values()).values()) <= 1


def test_licenses(spark):
    rows = [(1, "Released under the MIT License."), (2, "x\nApache License,\nVersion 2 and CC BY-NC, under the mit license"), (3, None), (4, ""), (None, "This work is licensed under the GNU General Public License, version 3."), (6, "nothing here to see " * 400), (1, "Released under the MIT License."), (8, "Licensed under the GNU Public General License version 3 this work is")]
    got = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["n_base"], by[1]["first_word"], by[1]["last_word"], by[1]["base_labels"], by[1]["score"]) == (1, 1, 1, "mit", 1.0)
    assert (by[2]["n_words"], by[2]["n_base"], by[2]["first_word"], by[2]["last_word"], by[2]["base_labels"]) == (13, 3, 1, 9, "apache-2,cc-by-nc,mit")
    assert by[None]["labels"] == "gpl-3" and by[None]["base_labels"] == "" and by[8]["labels"] == "gpl-3" and by[3]["n_words"] == 0 and by[6]["score"] == 0.0


def test_wrapped_licenses(spark):
    rows = [
        (1, "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files"),
        (2, "You may not use this file except in compliance with the License.\nYou may obtain a copy of the License at"),
        (3, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
        (4, "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."), (5, "Permission is hereby granted\nto nobody"),
    ]
    got = {r["doc_id"]: r["labels"] for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mit", 2: "apache-2", 3: "bsd", 4: "mpl-2", 5: ""}


def test_two_licenses_in_a_line(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0. " + "some words between " * 9 + "Licensed under the GNU Lesser Public License."), (2, "Released under the Apache License, Version 2.0.")]
    got = {r["doc_id"]: r["labels"] for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "apache-2,lgpl", 2: "apache-2"}


def test_similarity_join_is_exact(spark):
    r = random.Random(5)
    vocab = sorted({w for _, t in licenses.TEMPLATES for w in t.split()}) + ["foo", "bar"]
    rows = []
    for i in range(300):
        _, t = r.choice(licenses.TEMPLATES)
        w = [x for x in t.split() if r.random() < 0.9] + [r.choice(vocab) for _ in range(r.randint(0, 6))]
        r.shuffle(w)
        rows.append((i, " ".join(w)))
    got = {}
    for x in licenses.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(x["doc_id"], {})[x["label"]] = x["score"]
    for i, t in rows:
        b = set(t.split())
        score = [(label, len(b & set(q.split())) / len(set(q.split()))) for label, q in licenses.TEMPLATES if b >= set(licenses.MUST.get(q, ())) and not b & set(licenses.BARRED.get(q, ()))]
        top = max([s for _, s in score if s >= 0.8 - 1e-9], default=None)
        assert got.get(i, {}) == ({label: pytest.approx(s) for label, s in score if top is not None and abs(s - top) < 1e-9} if top else {})


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, "A train leaves with John Smith at 60 km per hour and John Smith walks 5 miles after 60 km of track. How far is it?"), (2, "what is it"), (3, None)], "item_id long, text string")
    rows = [
        (1, "Intro words here. A train leaves with Mary at 75 km per hour and Mary walks 12 miles after 75 km of track. How far is it? Bye"),
        (2, "A train leaves with Mary at 75 km per hour and Peter walks 12 miles after 80 km of track. How far is it?"),
        (3, "nothing at all"), (4, None), (None, "So: what is it? yes"), (1, "other"), (7, "A train leaves with Mary at 75 km per hour."), (3, "nothing at all"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["items"]) for r in decontam.decontaminated(docs, bench).collect())
    assert got == Counter({(1, "1"): 1, (2, ""): 1, (3, ""): 2, (4, ""): 1, (None, "2"): 1, (1, ""): 1, (7, ""): 1})
    assert decontam.clean(docs, bench).count() == 6
    assert decontam.clean(docs, bench.where("false")).count() == len(rows)


FARM = [
    "Intro. The farm lies by the river and has a view\nof\nParis from the hill. Alice picks 12 apples there and sells 7 of them in town before noon, so how many are left over?",
    "so the farm lies by the river and has a view of paris from the hill. alice picks 12 apples there and sells 7 of them in town before noon, so how many are left over?",
    "They asked: The farm lies by the river and has a view of  Paris from the hill. Bob picks 30 apples there and sells 9 of them in town before noon, so how many are left over?",
    "The farm lies by the river and has a view of Paris from the hill. Alice picks 12 apples there and trades 7 of them in town before noon, so how many are left over?",
    "The farm lies by the river and has a view of Paris from the hill. Alice picks 12 ripe apples there and sells 7 of them in town before noon, so how many are left over?",
]


def test_decontamination_of_altered_passages(spark):
    bench = spark.createDataFrame([(1, "The farm lies by the river and has a view of Paris from the hill. Alice picks 12 apples there and sells 7 of them in town before noon, so how many are left over?"), (2, "Which of the towns is the oldest one")], "item_id long, text string")
    rows = [(10 + k, t) for k, t in enumerate(FARM)]
    docs = spark.createDataFrame([*rows, (2, "The farm lies by the river and has a view of Paris. Bob sells pears."), (3, "the question: Which of the towns is\nthe oldest one")], "doc_id long, text string")
    assert {r["doc_id"]: r["items"] for r in decontam.decontaminated(docs, bench).collect()} == {2: "", 3: "2"} | {k: "1" for k, _ in rows}


APPLES = "Mary has 5 red apples. John has 3 green apples. Mary gives John 2 apples. How many red apples does Mary have left then?"


ALTERED = [
    ("Anna has 7 red apples. Peter has 4 green apples. Anna gives Peter 1 apples. How many red apples does Anna have left then?", True),
    ("Anna has 7 red apples. Peter has 7 green apples. Anna gives Peter 7 apples. How many red apples does Anna have left then?", True),
    ("Anna has 7 red apples. Anna has 4 green apples. Anna gives Anna 1 apples. How many red apples does Anna have left then?", False),
    ("Anna has 7 red apples. Peter has 4 green apples. Peter gives Olga 1 apples. How many red apples does Paul have left then?", False),
    ("Der Hund hat 7 alte Knochen. Peter sucht 4 neue Knochen.", False),
]


@pytest.mark.parametrize("rows", [decontam.BROADCAST_ROWS, 0])
def test_decontamination_of_names_and_numbers(spark, rows):
    bench = spark.createDataFrame([(1, APPLES)], "item_id long, text string")
    docs = spark.createDataFrame([(k, "Before. " + t + " After.", "x", 7, "y") for k, (t, _) in enumerate(ALTERED)], "doc_id long, text string, key string, w long, row_hash string")
    assert {r["doc_id"] for r in decontam.found(docs, bench, broadcast_rows=rows).collect()} == {k for k, (_, hit) in enumerate(ALTERED) if hit}


def test_toxicity(spark):
    r = random.Random(4)
    bad = ["grobian", "schuft", "lump"]
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        w = [r.choice(WORDS) + r.choice(["", "en", "st"]) for _ in range(r.randint(20, 60))]
        if toxic:
            w[r.randrange(len(w))] = r.choice(bad) + r.choice(["", "isch", "."])
        rows.append((i, " ".join(w), int(toxic)))
    rows += [(1000, None, 0), (1001, "", 0)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(docs, *toxicity.train(docs, labels)).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    test = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert sum(p == y for p, y in test) / len(test) > 0.95
    assert got[1000]["score"] == got[1001]["score"] < 0.5
    flat = toxicity.scored(docs, *toxicity.train(docs, labels.where("toxic = 0")))
    assert flat.where("predicted = 1").count() == 0


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
    <article><h1>Big &amp; bold</h1><p>First  <b>para</b>graph&nbsp;here, it is long enough to read.<p>Second one<br>breaks. <!-- <p>no</p> --><script>var a="</p><p>x";</script></p><div class=ad>Buy now</div><ul><li>an item of the list<li>another item of it</ul></article>
    <section class="comments"><p>I liked this article a lot.</p></section><aside><p>Related: other stories.</p></aside><footer>&copy; 2020 all rights</footer></body></html>"""
    found = html_extract.blocks(page)
    assert [b[0] for b in found][3:6] == ["Big & bold", "First paragraph here, it is long enough to read.", "Second one breaks."]
    crf = html_extract.train()
    import numpy as np

    state = crf.decode(html_extract.features(found), np.array([0, len(found)]))
    assert [b[0] for b, s in zip(found, state) if s] == ["Big & bold", "First paragraph here, it is long enough to read.", "Second one breaks.", "an item of the list", "another item of it"]
    right = total = 0
    for source, truth in html_extract.labelled_pages(80, seed=99):
        f = html_extract.blocks(source)
        got = crf.decode(html_extract.features(f), np.array([0, len(f)]))
        right, total = right + sum(bool(a) == b for a, b in zip(got, truth)), total + len(truth)
    assert right / total > 0.97
    assert html_extract.blocks("") == [] and html_extract.blocks("plain < text > &lt;b&gt;") [0][0] == "plain < text > <b>"


def test_html_digit_share_of_whole_block():
    page = [("a" * 200 + "1" * 200, 0, 0.0), ("1" * 200 + "a" * 600, 0, 0.0)]
    assert html_extract.features(page)[:, -4].tolist() == [0.5, 0.25]


def test_html_table(spark):
    rows = [(1, "u", "<article><p>Hello there, dear reader of this page.</p></article>"), (2, "u", None), (2, "u", None), (None, None, "")]
    got = html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"), html_extract.train()).collect()
    assert Counter((r["page_id"], r["text"], r["n_chars"]) for r in got) == Counter({(1, "Hello there, dear reader of this page.", 38): 1, (2, "", 0): 2, (None, "", 0): 1})


def test_tool_calls(spark):
    import json

    call = lambda *cs: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": json.dumps(a)} for i, n, a in cs]})
    result = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call(("b", "search", {"query": "${a}", "limit": 3}), ("a", "calculator", {"expression": "1+1"}))), (1, 2, "tool", result("b", "B")), (1, 3, "tool", result("a", "A")), (1, 4, "tool", result("zz", "?")),
        (2, 0, "assistant", call(("x", "search", {"limit": "3", "query": "q"}), ("y", "nope", {}), ("x", "search", {"query": "again"}))), (2, 1, "tool", result("x", "r")),
        (3, 0, "assistant", call(("p", "search", {"query": "${q}"}), ("q", "search", {"query": "${p}"}))), (4, 0, "user", None), (4, 1, "user", "{not json"), (None, 0, "user", "lost"), (4, 1, "user", "{not json"),
    ]
    got = chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    one = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["position"])
    ids = [(r["kind"], json.loads(r["json"]).get("id") or json.loads(r["json"]).get("tool_call_id")) for r in one]
    assert ids.index(("call", "a")) < ids.index(("result", "a")) < ids.index(("call", "b")) < ids.index(("result", "b"))
    assert {(r["conv_id"], r["status"]) for r in got if r["kind"] != "message"} == {(1, "ok"), (1, "orphan"), (2, "limit is not integer"), (2, "unknown tool"), (2, "duplicate id"), (2, "ok"), (3, "cycle")}
    assert json.loads(next(r["json"] for r in one if r["kind"] == "call" and '"id":"b"' in r["json"]))["arguments"] == '{"limit":3,"query":"${a}"}'
    for c in (1, 2, 3, 4):
        pos = sorted(r["position"] for r in got if r["conv_id"] == c)
        assert pos == list(range(len(pos)))
    assert [(r["json"], r["position"]) for r in got if r["conv_id"] is None] == [('{"content":"lost","role":"user"}', None)]


def test_text_beside_tool_calls(spark):
    import json

    calls = [{"id": "a", "name": "calculator", "arguments": '{"expression":"1+1"}'}]
    rows = [
        (1, 0, "assistant", json.dumps({"content": "Let me see.", "tool_calls": calls})), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "2", "tool_calls": [calls[0] | {"id": "b"}]})),
        (2, 0, "assistant", json.dumps({"content": "", "tool_calls": calls})), (3, 0, "assistant", json.dumps({"content": None, "tool_calls": calls})),
    ]
    got = sorted(chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: (r["conv_id"], r["position"]))
    assert [(r["conv_id"], r["turn"], r["idx"], r["kind"], r["status"]) for r in got] == [
        (1, 0, 0, "message", "ok"), (1, 0, 1, "call", "ok"), (1, 1, 1, "call", "no result"), (1, 1, 0, "result", "ok"), (2, 0, 0, "call", "no result"), (3, 0, 0, "call", "no result"),
    ]
    assert got[0]["json"] == '{"content":"Let me see.","role":"assistant"}' and json.loads(got[3]["json"])["content"] == "2"


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "some words of a question that is long enough to count")], "item_id long, text string")
    for df in (
        simhash.near_duplicates(none), simhash.representatives(none), near.representatives(none), substring.factored(none), quality.assess(none, quality.train(none, labels)), mixing.mixed(none), mixing.remixed(none), sharding.sharded(none), sharding.with_shards(none),
        licenses.scanned(none), decontam.decontaminated(none, bench), decontam.clean(none, bench), toxicity.scored(none, *toxicity.train(none, labels)),
        html_extract.extracted(spark.createDataFrame([], "page_id long, url string, html string"), html_extract.train()), chat.linked(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ):
        assert df.count() == 0


def test_null_ids(spark):
    rows = [(None, "a b c " * 30), (None, None), (5, "a b c " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string"))
    assert simhash.near_duplicates(df).count() == 3 and sharding.sharded(df).count() == 3 and mixing.mixed(df).count() == 3 and licenses.scanned(df).count() == 3
    assert {(r["doc_id"], r["n_removed"]) for r in substring.factored(df).collect()} == {(None, 0), (5, 0)}
    assert sorted((r["doc_id"] is None, r["text"] is None) for r in simhash.representatives(df).collect()) == [(False, False), (True, True)]


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(__import__("quillwork.llm.oracles", fromlist=["x"]).ORACLES))
def test_oracle(spark, name):
    import os

    import duckdb

    from quillwork.llm import oracles, queries

    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    r = c.execute(oracles.ORACLES[name])
    cols = [d[0] for d in r.description]
    df = queries.QUERIES[name](spark, SF)
    flat = lambda rows, names: sorted(repr(tuple(round(x[i], 9) if isinstance(x[i], float) else x[i] for i in sorted(range(len(names)), key=lambda i: names[i]))) for x in rows)
    assert sorted(cols) == sorted(df.columns) and flat(df.collect(), df.columns) == flat(r.fetchall(), cols)


def near_brute(rows):
    """The smallest doc_id of each group of (doc_id, text): SimHash within 3 bits, or five-word shingles of similarity 0.8."""
    fp = {i: simhash.fingerprint((t or "").encode()) for i, t in rows}
    sets = {}
    for i, t in rows:
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(parent)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if (fp[a] ^ fp[b]).bit_count() <= 3 or both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    return sorted({find(i) for i in ids})


def test_near_copies_in_large_buckets(spark):
    r = random.Random(6)
    base = [r.choice(WORDS) + str(r.randrange(50)) for _ in range(300)]
    rows = []
    for i in range(90):
        w = list(base)
        w[r.randrange(300)] = f"neu{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(80))) for i in range(20)] + [(200, None), (201, ""), (202, "A b"), (203, "a B")]
    df = spark.createDataFrame([(*x, "t", 1) for x in rows], "doc_id long, text string, th string, `group` int")
    got = near.representatives(df)
    assert got.columns == df.columns and sorted(x["doc_id"] for x in got.collect()) == near_brute(rows)


def test_near_copies_around_the_threshold(spark, monkeypatch):
    """Texts of one large bucket that are alike pair by pair, not all like any of them: no link between components is lost."""
    for name, value in (("SMALL", 4), ("LEADERS", 2), ("CELL", 16)):
        monkeypatch.setattr(near, name, value)
    r = random.Random(8)
    base = [r.choice(WORDS) + str(r.randrange(50)) for _ in range(150)]
    rows = []
    for i in range(70):
        w = list(base)
        for k in range(r.choice((1, 3, 4, 5))):
            w[r.randrange(150)] = f"neu{i}x{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = near_brute(rows)
    assert 1 < len(expected) < 60
    assert sorted(x["doc_id"] for x in near.representatives(df).collect()) == expected


def test_near_copies_compare_few_pairs(spark, monkeypatch):
    """Of a large group around the threshold, pairs are compared in proportion to its texts, not to their square; no link is lost."""
    r = random.Random(9)
    base = [r.choice(WORDS) + str(r.randrange(50)) for _ in range(150)]
    rows = []
    for i in range(240):
        w = list(base)
        for k in range(r.choice((1, 3, 5, 7, 9))):
            w[r.randrange(150)] = f"neu{i}x{k}"
        rows.append((i, " ".join(w)))
    compared, plain = [], near._compared

    def counted(pairs, *rest):
        compared.append(pairs.distinct().count())
        return plain(pairs, *rest)

    monkeypatch.setattr(near, "_compared", counted)
    expected = near_brute(rows)
    assert 60 < len(expected) < 200
    assert sorted(x["doc_id"] for x in near.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == expected
    assert sum(compared) < 4 * len(rows)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, lang, source or "s", n) for i, t, lang, source, n, *_ in corpus() if i != 20] + [(20, corpus()[20][1], "de", "s", 1)]
    item = "welche frage steht hier mit vielen worten die keiner sonst so schreibt und wie lautet sie"
    rows.append((900, corpus()[30][1] + " " + item, "de", "s", 1))
    text = {r[0]: r[1] for r in rows}
    extra = ("kept", "shard", "slot", "law", "row", "copy", "nth", "th", "row_hash", "n_words")  # names that the operators use
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    spark.createDataFrame([(*x, *extra) for x in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 100, 2)] + [(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.materialize(stage(spark, docs, str(tmp_path)), f"test-{k}")
        kept.append([r["doc_id"] for r in docs.select("doc_id").collect()])
        assert docs.columns == (names if k < 4 else [c for c in names if c not in ("shard", "slot", "law")] + ["size", "text_crc32", "law", "shard", "slot"])
        assert all(r["kept"] == "kept" and r["th"] == "th" for r in docs.collect())
    failed = {i for i, t in text.items() if len(words(t)) < 50}
    assert not failed & set(kept[0])
    assert sorted(kept[1]) == near_brute([(i, text[i]) for i in kept[0]])
    assert sorted(kept[2]) == sorted(i for i in kept[1] if item not in text[i])
    assert set(kept[3]) <= set(kept[2]) and max(Counter(kept[3]).values()) <= 2
    assert Counter(kept[4]) == Counter(kept[3])
    n = Counter(r["shard"] for r in docs.collect())
    assert max(n.values()) - min(n.get(s, 0) for s in range(16)) <= 1


def test_line_labels_mix():
    """Lines of menus and of text in one document are told apart, whatever its label; copies don't make a line boilerplate."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(9)

    def prose():
        return " ".join(r.choice(WORDS) + str(r.randrange(99)) for _ in range(30)) + "."

    def menu():
        return " | ".join(r.choice(WORDS) for _ in range(8))

    def document():
        kinds = [r.random() < 0.6 for _ in range(12)]
        return "\n".join(prose() if k else menu() for k in kinds) + "\nRead more here", [*kinds, False]

    made = [document() for _ in range(60)]
    lines = quality.Lines(pa.array([t for t, _ in made]))
    bounds = list(zip(lines.first[:-1], lines.first[1:]))
    xs, hs = [lines.x[a:b] for a, b in bounds], [lines.line[a:b] for a, b in bounds]
    ys = quality.line_labels([int(30 * sum(k) > 15 * (12 - sum(k))) for _, k in made], xs, hs)
    crf = quality.ChainCRF(quality.FEATURES).fit(np.concatenate(xs[:40]), np.concatenate(ys[:40]), np.append(0, np.cumsum([len(x) for x in xs[:40]])))
    first = np.append(0, np.cumsum([len(x) for x in xs[40:]]))
    got = crf.decode(np.concatenate(xs[40:]), first)
    truth = np.concatenate([k for _, k in made[40:]])
    assert (got == truth).mean() > 0.93
    assert [y.tolist() for y in quality.line_labels([1] * 4, [xs[0]] * 4, [hs[0]] * 4)][0] == (~quality.marked(xs[0])).astype(int).tolist()


def test_html_is_linear():
    import time

    for page in ("<div>x" * 40_000, "<a '" * 60_000, "<a '>'" * 40_000, "<b>" * 30_000 + "</i><hr>" * 20_000, "<p>x</q>" * 30_000):
        start = time.perf_counter()
        html_extract.blocks(page)
        assert time.perf_counter() - start < 5


def test_tool_schemas(spark):
    schema = {"type": "object", "required": ["to"], "properties": {"to": {"type": "array", "items": {"type": "string"}}, "how": {"enum": ["fast", "slow"]}, "box": {"type": "object", "properties": {"w": {"type": "number"}}, "required": ["w"]}}}
    fault = lambda v: chat.fault_of(v, schema)
    assert fault({"to": ["a"], "how": "fast", "box": {"w": 1.5}}) is None and fault({}) == "missing to" and fault({"to": ["a", 1]}) == "to[1] is not string"
    assert fault({"to": [], "how": "x"}) == "how is not one of its values" and fault({"to": [], "box": {}}) == "missing box.w" and fault({"to": [], "box": {"w": True}}) == "box.w is not number"
    assert fault({"to": [], "no": 1}) == "unknown parameter no" and fault([]) == "arguments is not object"
    assert chat.canonical('{"b": 1, "a": "\\ud800x"}') == '{"a":"\\ud800x","b":1}' and chat.canonical('{"a": NaN}') is None and chat.canonical("[1e999]") is None
    table = spark.createDataFrame([("ping", '{"type": "object", "properties": {"n": {"type": "integer"}}}')], "name string, schema string")
    import json

    turn = json.dumps({"tool_calls": [{"id": "a", "name": "ping", "arguments": '{"n": "\\udcff"}'}, {"id": "b", "name": "ping", "arguments": '{"\\ud800": 1}'}]})
    got = chat.linked(spark.createDataFrame([(1, 0, "assistant", turn, "z", 1)], "conv_id long, turn long, role string, text string, json string, n int"), chat.schemas_of(table)).collect()
    assert sorted(r["status"] for r in got) == ["n is not integer", "unknown parameter \\ud800"]


def test_linking_against_brute_force(spark):
    import json

    r = random.Random(11)
    rows, want = [], {}
    for c in range(12):
        names = [f"k{i}" for i in range(r.randint(1, 6))]
        turns, deps = [], {x: r.sample(names[:k], r.randint(0, min(k, 2))) for k, x in enumerate(names)}
        order = list(names)
        r.shuffle(order)
        for x in order:
            turns.append(json.dumps({"tool_calls": [{"id": x, "name": "search", "arguments": json.dumps({"query": " ".join(f"${{{d}}}" for d in deps[x])})}]}))
        answers = [x for x in names if r.random() < 0.7] + ["none"]
        r.shuffle(answers)
        turns += [json.dumps({"tool_call_id": x, "content": x}) for x in answers]
        r.shuffle(turns)
        rows += [(c, t, "assistant", x) for t, x in enumerate(turns)]
        want[c] = (deps, set(answers))
    got = chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    for c, (deps, answers) in want.items():
        own = sorted((x for x in got if x["conv_id"] == c), key=lambda x: x["position"])
        name = lambda x: (x["kind"], json.loads(x["json"]).get("id") or json.loads(x["json"]).get("tool_call_id"))
        place = {name(x): k for k, x in enumerate(own)}
        assert [x["position"] for x in own] == list(range(len(own)))
        for x, before in deps.items():
            assert all(place[("call", d)] < place[("call", x)] and (d not in answers or place[("result", d)] < place[("call", x)]) for d in before)
            assert x not in answers or place[("call", x)] < place[("result", x)]
        assert {name(x): x["status"] for x in own} == {("call", x): "ok" if x in answers else "no result" for x in deps} | {("result", x): "ok" if x in deps else "orphan" for x in answers}
