"""The Romanian stemmer against published pairs and against the algorithm read literally, with a cursor."""

import random

from pyspark.sql import functions as F

from quillwork.functions import stem
from quillwork.operators import align, typing_rules

# Pairs of the algorithm's published sample vocabulary.
PAIRS = """abruptă abrupt|absent absent|absentă absent|absente absent|absenţa absenţ|absenţă absenţ|absenţi absenţ|absolut absol|absoluta absol|absolută absol|absolute absol|absolutul absol|absolutului absol
absolve absolv|absolvenţi absolvenţ|absolvenţii absolvenţ|absolvi absolv|absolvire absolv|absolvit absolv|absolviţi absolv|absorbant absorb|absorbantă absorb|absorbi absorb|absorbit absorb
abstinent abstinent|abstract abstract|abstractă abstract|abstracte abstract|abstractiza abstractiz|abstractizare abstractiz|abstractizat abstractiz|abuz abuz|abuza abuz|abuzat abuz|abuzez abuz|abuziv abuz|abuzivă abuz|abuzive abuz
ocol ocol|ocolea ocol|ocolesc ocol|ocoleşte ocol|ocoleau ocol|ocoli ocol|ocolire ocol|ocolirea ocol|ocolit ocol|ocolul ocol|ocolului ocol"""


class Cursor:
    """The algorithm step by step on a list of letters."""

    def __init__(self, word):
        self.w = word.lower()

    def v(self, c):
        return c in stem.VOWELS

    def prelude(self):
        w, at = list(self.w), 0
        while at + 2 < len(w):
            if self.v(w[at]) and w[at + 1] in "ui" and self.v(w[at + 2]):
                w[at + 1] = w[at + 1].upper()
                at += 3
            else:
                at += 1
        self.w = "".join(w)

    def past(self, at, vowel):
        while at < len(self.w):
            if self.v(self.w[at]) == vowel:
                return at + 1
            at += 1
        return None

    def regions(self):
        w, n = self.w, len(self.w)
        self.rv = self.r1 = self.r2 = n
        if n > 1:
            one, two = self.v(w[0]), self.v(w[1])
            found = (self.past(2, True) if not two else self.past(2, False)) if one else (self.past(2, True) if not two else 3 if n > 2 else None)
            self.rv = found if found is not None else n
        a = self.past(0, True)
        a = self.past(a, False) if a is not None else None
        if a is not None:
            self.r1 = a
            a = self.past(a, True)
            a = self.past(a, False) if a is not None else None
            self.r2 = a if a is not None else n

    def longest(self, suffixes, text=None):
        text = self.w if text is None else text
        return max((s for s in suffixes if text.endswith(s)), key=len, default="")

    def put(self, s, new):
        self.w = self.w[: len(self.w) - len(s)] + new

    def stem(self):
        self.prelude()
        self.regions()
        rules = {s: new for suffixes, new in stem.STEP_0 for s in suffixes}
        s = self.longest(rules)
        if s and len(self.w) - len(s) >= self.r1 and not (s == "ile" and self.w[:-3].endswith("ab")):
            self.put(s, rules[s])
        removed, rules = False, {s: new for suffixes, new in stem.COMBINED for s in suffixes}
        while (s := self.longest(rules)) and len(self.w) - len(s) >= self.r1:
            self.put(s, rules[s])
            removed = True
        s = self.longest((*stem.STANDARD, *stem.AFTER_T, *stem.PERSONS))
        if s and len(self.w) - len(s) >= self.r2:
            base = self.w[: len(self.w) - len(s)]
            if s in stem.AFTER_T:
                if base.endswith("ţ"):
                    self.w, removed = base[:-1] + "t", True
            else:
                self.w, removed = base + ("ist" if s in stem.PERSONS else ""), True
        if not removed:
            inside = self.w[self.rv :]
            s = self.longest((*stem.VERB_AFTER_CONSONANT, *stem.VERB_ANYWHERE), inside)
            before = inside[: len(inside) - len(s)][-1:]
            if s and (s in stem.VERB_ANYWHERE or before and (not self.v(before) or before == "u")):
                self.put(s, "")
        s = self.longest(stem.LAST)
        if s and len(self.w) - len(s) >= self.rv:
            self.put(s, "")
        return self.w.replace("I", "i").replace("U", "u")


def stems(spark, words, **options):
    return [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(stem.romanian(F.col("w"), **options)).collect()]


def test_published_pairs(spark):
    pairs = [p.split() for p in PAIRS.replace("\n", "|").split("|")]
    assert [(w, s) for (w, _), s in zip(pairs, stems(spark, [w for w, _ in pairs]))] == [tuple(p) for p in pairs]


def test_stems_literally(spark):
    r = random.Random(6)
    parts = [s for rules in (stem.STEP_0, stem.COMBINED) for suffixes, _ in rules for s in suffixes] + [*stem.STANDARD, *stem.AFTER_T, *stem.PERSONS, *stem.VERB_AFTER_CONSONANT, *stem.VERB_ANYWHERE, *stem.LAST]
    syllables = ["ca", "str", "ne", "io", "uia", "ţ", "al", "ort", "bă", "iua", "x", "ui", "aia", "b", "p", "mâ"]
    words = ["", "a", "b", "ab", "ba", "baa", "aab", "aba", "sine", "ABILITATE", "ile", "abile", "casabile", "aiaia", "aiua", "naţiune", "ş", "12", "à la"]
    words += ["".join(r.choice(syllables) for _ in range(r.randint(0, 4))) + "".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(3000)]
    assert stems(spark, words) == [Cursor(w).stem() for w in words]
    assert stems(spark, [None]) == [None]


def test_comma_below(spark):
    assert stems(spark, ["absolvenții", "ocolește"], comma=True) == ["absolvenţ", "ocol"] and stems(spark, ["absolvenții"]) != ["absolvenţ"]


def test_stems_in_types(spark):
    """Words of one stem and of other lemmas and parts of speech are MORPH where the stemmer is asked."""
    tok = lambda text, pos: (text, text.lower(), pos, "", "dep")
    rows = [(1, [tok("ocolesc", "VERB")], [tok("ocolul", "NOUN")]), (2, [tok("ocolesc", "VERB")], [tok("abuz", "NOUN")]), (3, [tok("ocolesc", "X")], [tok("ocolul", "NOUN")])]
    df = spark.createDataFrame(rows, f"sent_id long, orig array<{align.TOKEN}>, cor array<{align.TOKEN}>")
    words = spark.createDataFrame([("ocolesc",)], "word string")
    got = {r["sent_id"]: r["err_type"] for r in typing_rules.typed_edits(df, words, stem=lambda t: stem.romanian(t["text"])).collect()}
    assert got[1] == "R:MORPH" and got[2] != "R:MORPH" and got[3] != "R:MORPH"
