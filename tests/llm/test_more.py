"""The chosen-path join, conversation repair and vector codes against brute force: nulls, ties, repeated rows, long inputs, clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.llm import chosen, codes, repair

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


# ---- near-duplicates ----


def shingle_set(text):
    w = SPACE.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def near_brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    out = []
    for k, (i, t) in enumerate(rows):
        c = least.get(find(k)) if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=repr)


def variants(r, size, changed, n):
    """n texts of about size words: an original, and copies of it with up to `changed` words put in place of others."""
    base = [f"w{r.randrange(10**6)}" for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        w = list(base)
        for _ in range(r.randint(1, changed)):
            w[r.randrange(size)] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_chosen_paths(spark):
    r = random.Random(5)
    texts = [None, "", " \n", "one", "One", "one two three four", "a b c d e", "b c d e a", "Wort " * 9000]
    texts += variants(r, 90, 3, 70) + variants(r, 200, 4, 50) + variants(r, 60, 1, 30)
    for k in range(30):  # a chain, each link at most two words away from the one before
        texts.append(texts[-1].replace(texts[-1].split()[7 * k % 50], f"c{k}", 1) if k else " ".join(f"k{j}" for j in range(70)))
    passage = " ".join(f"p{j}" for j in range(60))
    texts += [f"{' '.join(f'q{r.randrange(10**6)}' for _ in range(r.randint(5, 80)))} {passage}" for _ in range(60)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    rows += [(rows[3][0], rows[3][1]), (None, texts[12]), (None, None), (None, "alone here and nowhere else")]
    df = spark.createDataFrame([(i, t, "x", 1, True) for i, t in rows], "doc_id long, text string, sid string, n int, kept boolean").repartition(5)
    got = sorted([tuple(x) for x in chosen.near_duplicates(df).collect()], key=repr)
    assert got == near_brute(rows)


@pytest.mark.parametrize("levels", [0, 2])
def test_chosen_paths_below_the_root(spark, monkeypatch, levels):
    """With nodes closed at 2 texts nearly all go through leaders, branchings and early shingles."""
    monkeypatch.setattr(chosen, "SMALL", 2)
    monkeypatch.setattr(chosen, "LEVELS", levels)
    monkeypatch.setattr(chosen, "CELL", 8)
    r = random.Random(8)
    rows = list(enumerate(variants(r, 80, 4, 70) + variants(r, 80, 3, 30)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(x) for x in chosen.near_duplicates(df).collect()], key=repr) == near_brute(rows)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert chosen.near_duplicates(df).columns == ["doc_id", "n_shingles", "component_id", "kept"] and chosen.near_duplicates(df).count() == 0


# ---- conversations ----


def repair_brute(rows, damage=True):
    """The contract, by a table over (rows, role that is due) relaxed to its fix-point."""
    kept = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if n == 0:
            continue
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        kept += [(conv, turn, "user" if n == 4 else role, text)] * (2 if n == 3 else 1)
    out = []
    for conv in {c for c, *_ in rows}:
        mine = sorted([x for x in kept if x[0] == conv], key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))
        turns = [t for _, t, _, _ in mine if t is not None]
        faults, seen = [], set()
        for _, _, role, text in mine:
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        nxt = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        due = {"": "u", "s": "u", "u": "a", "a": "u"}
        best = {"": (0, "")}

        def relax(best):
            for _ in range(4):
                for s in list(best):
                    c, a = best[s]
                    if (c + 2, a + "I") < best.get(due[s], (10**9, "")):
                        best[due[s]] = (c + 2, a + "I")
            return best

        best = relax(best)
        for (_, _, role, _), fault in zip(mine, faults):
            then = {}

            def put(s, c, a):
                if (c, a) < then.get(s, (10**9, "")):
                    then[s] = (c, a)

            for s, (c, a) in best.items():
                put(s, c + 3, a + "D")
                if fault not in ("blank", "duplicate"):
                    x = fault == "truncated"
                    put(due[s], c + 2 + x, a + "R")
                    if (s, role[:1]) in nxt:
                        put(nxt[s, role[:1]], c + x, a + "K")
            best = relax(then)
        cost, audit = min(best[s] for s in ("", "a") if s in best)
        state, lines, k = "", [], 0
        for e in audit:
            if e == "I":
                state = due[state]
                lines.append(f"{dict(u='user', a='assistant')[state]}:")
                continue
            _, _, role, text = mine[k]
            k += 1
            if e == "K":
                state = nxt[state, role[:1]]
                lines.append(f"{role}:{text}")
            elif e == "R":
                state = due[state]
                lines.append(f"{dict(u='user', a='assistant')[state]}:{text}")
        initials = [x[2][:1] for x in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(r, n):
    out = []
    for conv in [None, *range(n)]:
        for turn in range(r.randint(1, 9)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
            text = r.choice([None, "", " \t", "Yes.", "What?", "no end", "Well! \n", f"turn {turn}.", "ä…", f"{conv}{turn}!"])
            out.append((conv, r.choice([turn, turn, turn, turn + 3, None]), role, text))
    return out


@pytest.mark.parametrize("damage", [True, False])
def test_repair(spark, damage):
    r = random.Random(2)
    rows = conversations(r, 150) + [(500, 1, "user", "Why? " * 20000), (500, 2, "assistant", "Because.")]
    df = spark.createDataFrame([(*x, "y", 0) for x in rows], "conv_id long, turn long, role string, text string, key string, cost int").repartition(3)
    assert sorted([tuple(x) for x in repair.report(df, damage).collect()], key=repr) == repair_brute(rows, damage)


def test_repair_of_a_long_conversation(spark):
    """Beyond FAN pieces, so that pieces are joined more than once."""
    r = random.Random(4)
    n = repair.PIECE * repair.FAN + 700
    rows = [(7, t, r.choice(["user", "assistant", "assistant", "system"]), f"turn {t % 900}" + r.choice([".", "", "!"])) for t in range(n)]
    rows += [(8, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(2 * repair.PIECE)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert sorted([tuple(x) for x in repair.report(df, True).collect()], key=repr) == repair_brute(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "system", "Be kind.")]
    placed = repair.placed(repair.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    found = repair.searched(placed)
    got = [tuple(x) for x in repair.repaired(placed, found).orderBy("nth").collect()]
    assert found.first()["audit"] == "IKKDR" and [(x[2], x[3], x[4]) for x in got] == [("user", "", "I"), ("assistant", "Hi.", "K"), ("user", "Hi.", "K"), ("assistant", "Be kind.", "R")]


def test_no_conversations(spark):
    assert repair.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- vector codes ----


def codes_brute(rows):
    own = [(i, [int(np.floor(1024 * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = len(own[0][1]) // 4
    first = sorted(own, key=lambda x: (x[0] is None, x[0] or 0, x[1]))[:256]
    books = [[x[1][p * d : (p + 1) * d] for x in first] for p in range(4)]

    def find(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            groups = {}
            for _, v, _ in own:
                part = v[p * d : (p + 1) * d]
                groups.setdefault(find(part, books[p])[1], []).append(part)
            books[p] = [[sum(c) // len(c) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by = [], {}
    for i, v, label in own:
        f = [find(v[p * d : (p + 1) * d], books[p]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in f), sum(x for x, _ in f), label))
        by[label] = by.get(label, 0) + out[-1][2]
    return sorted([(i, c, e, by[label], sha) for i, c, e, label in out], key=repr)


@pytest.mark.parametrize("n, scale", [(420, 1.0), (40, 1.0), (300, 20000.0)])
def test_codes(spark, n, scale):
    r = random.Random(n)
    rows = [(i, [scale * r.choice([r.uniform(-1, 1), 0.25, -0.001]) for _ in range(8)], r.choice([None, 0, 1, 2])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] + [0.0] * 7, 1), (n + 2, [float("nan")] * 8, 1), (n + 3, [float("inf")] + [0.0] * 7, 2), (5, rows[5][1], 1), (None, rows[9][1], None)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "z", 3) for x in rows], "vec_id long, embedding array<double>, label int, code string, error int").repartition(3)
    assert sorted([tuple(x) for x in codes.coded(df).collect()], key=repr) == codes_brute(rows)


def test_codes_by_many_labels(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 1)
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range(4)], r.choice([None, 0, 1])) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted([tuple(x) for x in codes.coded(df).collect()], key=repr) == codes_brute(rows)


def test_codes_of_odd_vectors(spark):
    df = spark.createDataFrame([(1, [0.5] * 8, 1), (2, [0.5] * 4, 1), (3, [1e30] * 8, 2), (4, [], 1)], "vec_id long, embedding array<double>, label int")
    got = {x["vec_id"]: (x["code"], x["error"], x["label_error"]) for x in codes.coded(df).collect()}
    assert got == {1: ("00000000", 0, 0), 2: (None, None, 0), 3: (None, None, None), 4: (None, None, 0)}
    assert codes.coded(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_screening_is_exact():
    """Values whose float32 products can't tell neighbours apart."""
    r = np.random.default_rng(3)
    entries = r.integers(-(2**20), 2**20, (256, 16)) + 2**26
    x = np.concatenate([entries[r.integers(0, 256, 500)] + r.integers(-2, 3, (500, 16)), (entries[:100] + entries[100:200]) // 2])
    index, least, again = codes.nearest(x, entries)
    for row, k, d in zip(x, index, least):
        exact = ((row - entries) ** 2).sum(1)
        assert d == exact.min() and k == exact.argmin()
    assert again > len(x)
    ties = np.zeros((3, 16), np.int64)
    assert codes.nearest(ties[:1], ties)[0].tolist() == [0]


# ---- tool calls as they are usually written ----


def test_usual_tool_calls(spark):
    import json

    from quillwork.llm import chat

    calls = [
        {"id": "a", "type": "function", "function": {"name": "search", "arguments": '{"query": "q", "limit": 2}'}},
        {"id": "b", "type": "function", "index": 1, "function": {"name": "calculator", "arguments": {"expression": "${a}+1"}, "strict": True}},
        {"id": "c", "name": "search", "arguments": "{}", "note": {"y": 1, "x": "ä"}}, {"id": "d", "type": "other"}, "no call",
    ]
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": calls})), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "1"})), (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": "2"}))]
    got = chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    own = {json.loads(r["json"]).get("id"): (r["status"], r["json"]) for r in got if r["kind"] == "call"}
    assert own["a"] == ("ok", '{"arguments":"{\\"limit\\":2,\\"query\\":\\"q\\"}","id":"a","name":"search","role":"assistant"}')
    b = json.loads(own["b"][1])
    assert own["b"][0] == "ok" and b["name"] == "calculator" and b["arguments"] == '{"expression":"${a}+1"}' and json.loads(b["extra"]) == {"function": {"strict": True}, "index": 1}
    assert own["c"][0] == "missing query" and json.loads(own["c"][1])["extra"] == '{"note":{"x":"ä","y":1}}'
    assert own["d"][0] == "unknown tool" and json.loads(json.loads(own["d"][1])["extra"]) == {"type": "other"} and len(got) == 7
    place = {(r["kind"], json.loads(r["json"]).get("id") or json.loads(r["json"]).get("tool_call_id")): r["position"] for r in got}
    assert place["result", "a"] < place["call", "b"] < place["result", "b"]


# ---- licenses named by the words that tell them apart ----


def test_licenses_are_named_by_their_own_words(spark):
    from quillwork.llm import licenses

    rows = [
        (1, "Licensed under the GNU General Public License."), (2, "The film was released under the name Dawn, and the license of the theatre ran out."),
        (3, "Licensed under Creative Commons Attribution-NonCommercial 4.0 International license"), (4, "Licensed under Creative Commons Attribution 4.0 International license"),
        (5, "Licensed under the GNU Lesser General Public License."), (6, "Er ging mit ihr. " * 40 + "Released under the MIT License. " + "Und so weiter. " * 40), (7, "Licensed under\nCreative Commons Attribution-\nShareAlike 4.0 International license."),
        (8, "This work is licensed under the GNU General Public License, version 1."), (9, "Licensed under Creative Commons Attribution 4.0 International license. " + "text between them goes on " * 5 + "Licensed under Creative Commons Attribution-NoDerivatives 4.0 International license."),
    ]
    got = {r["doc_id"]: r["labels"] for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "", 3: "cc-by-nc", 4: "cc-by", 5: "lgpl", 6: "mit", 7: "cc-by-sa", 8: "", 9: "cc-by,cc-by-nd"}
