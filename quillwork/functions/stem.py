"""The Snowball stemmer for Romanian as Column expressions: suffix rules under the regions R1, R2 and RV.

A step looks for the longest of its suffixes (a regular expression that ends at the word's end finds it first) and acts if the suffix
lies in the step's region; only the verb step looks within its region alone. Each step's word is bound once, so that the expression
stays linear in the number of steps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Fixed values of the public algorithm (s and t with cedilla).
VOWELS = "aeiouâîă"
STEP_0 = (
    (("ul", "ului"), ""), (("aua",), "a"), (("ea", "ele", "elor"), "e"), (("ii", "iua", "iei", "iile", "iilor", "ilor"), "i"), (("ile",), "i"), (("atei",), "at"), (("aţie", "aţia"), "aţi"),
)
COMBINED = (
    (("abilitate", "abilitati", "abilităi", "abilităţi"), "abil"), (("ibilitate",), "ibil"), (("ivitate", "ivitati", "ivităi", "ivităţi"), "iv"),
    (("icitate", "icitati", "icităi", "icităţi", "icator", "icatori", "iciv", "iciva", "icive", "icivi", "icivă", "ical", "icala", "icale", "icali", "icală"), "ic"),
    (("ativ", "ativa", "ative", "ativi", "ativă", "aţiune", "atoare", "ator", "atori", "ătoare", "ător", "ători"), "at"),
    (("itiv", "itiva", "itive", "itivi", "itivă", "iţiune", "itoare", "itor", "itori"), "it"),
)
STANDARD = (
    "at", "ata", "ată", "ati", "ate", "ut", "uta", "ută", "uti", "ute", "it", "ita", "ită", "iti", "ite", "ic", "ica", "ice", "ici", "ică", "abil", "abila", "abile", "abili", "abilă",
    "ibil", "ibila", "ibile", "ibili", "ibilă", "oasa", "oasă", "oase", "os", "osi", "oşi", "ant", "anta", "ante", "anti", "antă", "ator", "atori", "itate", "itati", "ităi", "ităţi",
    "iv", "iva", "ive", "ivi", "ivă",
)
AFTER_T = ("iune", "iuni")
PERSONS = ("ism", "isme", "ist", "ista", "iste", "isti", "istă", "işti")
VERB_AFTER_CONSONANT = (
    "are", "ere", "ire", "âre", "ind", "ând", "indu", "ându", "eze", "ească", "ez", "ezi", "ează", "esc", "eşti", "eşte", "ăsc", "ăşti", "ăşte",
    "am", "ai", "au", "eam", "eai", "ea", "eaţi", "eau", "iam", "iai", "ia", "iaţi", "iau", "ui", "aşi", "arăm", "arăţi", "ară", "uşi", "urăm", "urăţi", "ură", "işi", "irăm", "irăţi", "iră",
    "âi", "âşi", "ârăm", "ârăţi", "âră", "asem", "aseşi", "ase", "aserăm", "aserăţi", "aseră", "isem", "iseşi", "ise", "iserăm", "iserăţi", "iseră", "âsem", "âseşi", "âse", "âserăm", "âserăţi", "âseră",
    "usem", "useşi", "use", "userăm", "userăţi", "useră",
)
VERB_ANYWHERE = ("ăm", "aţi", "em", "eţi", "im", "iţi", "âm", "âţi", "seşi", "serăm", "serăţi", "seră", "sei", "se", "sesem", "seseşi", "sese", "seserăm", "seserăţi", "seseră")
LAST = ("a", "e", "i", "ie", "ă")

_V, _C = f"[{VOWELS}]", f"[^{VOWELS}]"
#: What a word begins with up to its regions; without it a region is empty.
BEFORE_RV = f"(?s)^(?:{_V}(?:{_C}.*?{_V}|{_V}.*?{_C})|{_C}(?:{_C}.*?{_V}|{_V}.))"
BEFORE_R1 = f"^{_C}*{_V}+{_C}"
BEFORE_R2 = f"{BEFORE_R1}{_C}*{_V}+{_C}"


def ending(suffixes) -> str:
    """The expression of the longest of suffixes at a word's end."""
    return f"(?:{'|'.join(sorted(suffixes, key=lambda s: (-len(s), s)))})$"


def _cut(w: Column, s: Column) -> Column:
    return F.left(w, F.length(w) - F.length(s))


def _replaced(w: Column, s: Column, rules) -> Column:
    """w with its suffix s, one of the rules', replaced."""
    to = F.lit("")
    for suffixes, new in rules:
        to = F.when(s.isin(*suffixes), new).otherwise(to) if new else to
    return F.concat(_cut(w, s), to)


def _all(rules) -> list[str]:
    return [s for suffixes, _ in rules for s in suffixes]


def _inside(w: Column, s: Column, region: Column) -> Column:
    return (s != "") & (F.length(w) - F.length(s) >= region)


def _step_0(w: Column, r1: Column) -> Column:
    def act(s: Column) -> Column:
        barred = (s == "ile") & _cut(w, s).endswith("ab")
        return F.when(_inside(w, s, r1) & ~barred, _replaced(w, s, STEP_0)).otherwise(w)

    return let(F.regexp_extract(w, ending(_all(STEP_0)), 0), act)


def _combined(state: Column, r1: Column) -> Column:
    """One pass of the combined suffixes over struct(w, more, removed)."""
    w = state["w"]

    def act(s: Column) -> Column:
        found = state["more"] & _inside(w, s, r1)
        return F.struct(F.when(found, _replaced(w, s, COMBINED)).otherwise(w).alias("w"), found.alias("more"), (state["removed"] | found).alias("removed"))

    return let(F.when(state["more"], F.regexp_extract(w, ending(_all(COMBINED)), 0)).otherwise(""), act)


def _standard(state: Column, r2: Column) -> Column:
    w = state["w"]

    def act(s: Column) -> Column:
        base = _cut(w, s)
        after_t = s.isin(*AFTER_T)
        found = _inside(w, s, r2) & (~after_t | base.endswith("ţ"))
        new = F.when(after_t, F.concat(F.left(base, F.length(base) - 1), F.lit("t"))).when(s.isin(*PERSONS), F.concat(base, F.lit("ist"))).otherwise(base)
        return F.struct(F.when(found, new).otherwise(w).alias("w"), (state["removed"] | found).alias("removed"))

    return let(F.regexp_extract(w, ending((*STANDARD, *AFTER_T, *PERSONS)), 0), act)


def _verb(w: Column, rv: Column) -> Column:
    def act(s: Column) -> Column:
        rest = _cut(F.substring(w, rv + 1, F.length(w)), s)
        fits = s.isin(*VERB_ANYWHERE) | rest.rlike(f"(?:{_C}|u)$")
        return F.when((s != "") & fits, _cut(w, s)).otherwise(w)

    return let(F.regexp_extract(F.substring(w, rv + 1, F.length(w)), ending((*VERB_AFTER_CONSONANT, *VERB_ANYWHERE)), 0), act)


def _vowel(w: Column, rv: Column) -> Column:
    return let(F.regexp_extract(w, ending(LAST), 0), lambda s: F.when(_inside(w, s, rv), _cut(w, s)).otherwise(w))


def _region(w: Column, before: str) -> Column:
    return let(F.length(F.regexp_extract(w, before, 0)), lambda n: F.when(n > 0, n).otherwise(F.length(w)))


def romanian(word: Column, comma: bool = False) -> Column:
    """The stem of a word, lower-cased first. The rules know s and t with cedilla; comma=True takes those with a comma for them (and
    gives the stem with cedillas). Null stays null; a word without a vowel is its own stem."""
    low = F.lower(word)
    if comma:
        low = F.translate(low, "șț", "şţ")
    marked = F.regexp_replace(low, f"({_V})([ui])({_V})", "$1\u0001$2$3")  # u and i between vowels are consonants
    start = F.regexp_replace(F.regexp_replace(marked, "\u0001u", "U"), "\u0001i", "I")

    def stemmed(w: Column, rv: Column, r1: Column, r2: Column) -> Column:
        def rest(w0: Column) -> Column:
            first = F.struct(w0.alias("w"), F.lit(True).alias("more"), F.lit(False).alias("removed"))
            passes = F.sequence(F.lit(1), F.floor(F.length(w0) / 2).cast("int") + 1)
            return let(let(F.aggregate(passes, first, lambda state, _: _combined(state, r1)), lambda state: _standard(state, r2)), lambda state: let(F.when(state["removed"], state["w"]).otherwise(_verb(state["w"], rv)), lambda w1: _vowel(w1, rv)))

        return let(_step_0(w, r1), rest)

    with_regions = let(start, lambda w: F.struct(w.alias("w"), _region(w, BEFORE_RV).alias("rv"), _region(w, BEFORE_R1).alias("r1"), _region(w, BEFORE_R2).alias("r2")))
    return F.translate(let(with_regions, lambda x: stemmed(x["w"], x["rv"], x["r1"], x["r2"])), "UI", "ui")
