"""Reclassification of edits of type OTHER: by rules, then by a lexicon. Column expressions; the lexicon is a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions import text as X
from quillwork.functions.counters import Counters

# Fixed values.
AGREEMENT = (
    ("a", "au"), ("au", "a"), ("este", "sunt"), ("sunt", "este"), ("era", "erau"), ("erau", "era"), ("a fost", "au fost"), ("au fost", "a fost"), ("fusese", "fuseseră"), ("fuseseră", "fusese"),
    ("face", "fac"), ("fac", "face"), ("vine", "vin"), ("vin", "vine"), ("merge", "merg"), ("merg", "merge"), ("poate", "pot"), ("pot", "poate"), ("vrea", "vor"), ("vor", "vrea"),
    ("știe", "știu"), ("știu", "știe"), ("are", "au"), ("au", "are"), ("trebuie", "trebuiesc"),
)
TENSE = (
    ("merge", "a mers"), ("a mers", "merge"), ("face", "a făcut"), ("a făcut", "face"), ("vine", "a venit"), ("a venit", "vine"), ("este", "a fost"), ("a fost", "este"),
    ("are", "a avut"), ("a avut", "are"), ("știe", "a știut"), ("a știut", "știe"), ("vede", "a văzut"), ("a văzut", "vede"), ("zice", "a zis"), ("a zis", "zice"),
    ("pune", "a pus"), ("a pus", "pune"), ("vine", "va veni"), ("va veni", "vine"), ("merge", "va merge"), ("va merge", "merge"),
)
AGREEMENT_2 = (
    ("a", "au"), ("au", "a"), ("su", "au"), ("su", "și"), ("ai", "au"), ("au", "ai"), ("am", "a"), ("a", "am"), ("vi", "fi"), ("ri", "fi"), ("vor", "va"), ("va", "vor"),
    ("vz", "va"), ("vw", "va"), ("s", "să"), ("sa", "să"), ("z", "a"), ("w", "a"), ("or", "vor"), ("u", "au"), ("e", "este"), ("i", "și"), ("iș", "și"), ("su", "se"),
    ("sw", "se"), ("sw", "și"), ("ș", "și"),
)
CONJUNCTIONS = ("și", "sau", "dar", "că", "să", "ca", "ori", "iar")
DETERMINERS = ("un", "o", "unei", "unui", "al", "a", "ai", "ale", "cel", "cea", "cei", "cele")
PREPOSITIONS = ("în", "la", "de", "pe", "cu", "din", "prin", "pentru", "despre", "între", "până")
MOODS = {"i": "ind", "s": "subj", "m": "imp", "n": "inf", "p": "part", "g": "ger"}
TENSES = {"p": "pres", "i": "imperf", "s": "past", "l": "pluperf", "f": "fut"}
CASES = {"n": "nom", "g": "gen", "d": "dat", "a": "acc", "v": "voc", "r": "nom/acc", "y": "gen/dat"}


def pair_in(orig: Column, cor: Column, pairs: tuple) -> Column:
    """Whether the lower-cased (orig, cor) is among pairs."""
    return F.concat_ws("\t", F.lower(orig), F.lower(cor)).isin(*[f"{a}\t{b}" for a, b in pairs])


def verb_form(orig: Column, cor: Column) -> Column:
    o, c = X.strip_diacritics(F.lower(orig)), X.strip_diacritics(F.lower(cor))
    return ~X.diacritic_fix(orig, cor) & (X.positional_ratio(o, c) > 0.7) & (o != c) & (F.length(orig) > 2)


def noun_form(orig: Column, cor: Column) -> Column:
    o, c = X.strip_diacritics(F.lower(orig)), X.strip_diacritics(F.lower(cor))
    return (F.length(o) >= 3) & (F.length(c) >= 3) & (X.positional_ratio(o, c) > 0.6) & (o != c)


def replace_type(orig: Column, cor: Column, err_type: Column) -> Column:
    """Pass 1 for R:OTHER; other types stay."""
    o, c = X.strip_punct(orig), X.strip_punct(cor)
    return (
        F.when(err_type != "R:OTHER", err_type)
        .when(X.whitespace_fix(orig, cor) | X.case_fix(o, c), "R:ORTH").when(X.punct_only(orig, cor), "R:PUNCT").when(X.diacritic_fix(o, c), "R:SPELL")
        .when(pair_in(o, c, AGREEMENT), "R:VERB:SVA").when(pair_in(o, c, TENSE), "R:VERB:TENSE")
        .when(verb_form(o, c), "R:VERB:FORM").when(noun_form(o, c), "R:NOUN:FORM").otherwise(err_type)
    )


def one_sided_type(word: Column, err_type: Column) -> Column:
    """Pass 1 for M:OTHER and U:OTHER; other types stay."""
    t, op = X.strip_punct(word), F.substring(err_type, 1, 1)
    low = F.lower(t)
    return (
        F.when(~err_type.endswith(":OTHER"), err_type).when(F.translate(t, X.PUNCT, "") == "", F.concat(op, F.lit(":PUNCT")))
        .when(low.isin(*CONJUNCTIONS), F.concat(op, F.lit(":CONJ"))).when(low.isin(*DETERMINERS), F.concat(op, F.lit(":DET")))
        .when(low.isin(*PREPOSITIONS), F.concat(op, F.lit(":PREP"))).otherwise(err_type)
    )


def pass_one(orig: Column, cor: Column, err_type: Column, start: Column, end: Column) -> Column:
    """Pass 1 for any edit; edits at (-1, -1) stay."""
    return (
        F.when((start == -1) & (end == -1), err_type).when(err_type.startswith("R:"), replace_type(orig, cor, err_type))
        .when(err_type.startswith("M:"), one_sided_type(cor, err_type)).when(err_type.startswith("U:"), one_sided_type(orig, err_type)).otherwise(err_type)
    )


def retyped(old: Column, new: Column) -> Column:
    """How many edits of an array, placeholders aside, have another type in the other."""
    return F.size(F.filter(F.zip_with(old, new, lambda a, b: (a["start"] != -1) & (a["err_type"] != b["err_type"])), lambda x: x))


def pass_one_blocks(blocks: DataFrame, counters: Counters | None = None) -> DataFrame:
    """blocks (tokens, edits array<struct<start,end,err_type,correction,...>>) with the edits reclassified in place. counters: gets
    edits and retyped (by pass one) when the result is computed."""
    toks = F.col("tokens")
    if counters is not None:
        made = pass_one_blocks(blocks.withColumn("_old", F.col("edits")))
        own = F.size(F.filter("edits", lambda e: e["start"] != -1))
        return counters.observe(made, edits=own, retyped=retyped(F.col("_old"), F.col("edits"))).drop("_old")
    return blocks.withColumn("edits", F.transform("edits", lambda e: e.withField("err_type", pass_one(X.span_text(toks, e["start"], e["end"]), e["correction"], e["err_type"], e["start"], e["end"]))))


def decode_msd(msd: Column) -> Column:
    """A morpho-syntactic code as struct<cat,type,mood,tense,person,number,gender,case>; absent or unread positions are null."""
    cat = F.upper(F.substring(msd, 1, 1))

    def at(i: int, names: dict | None = None) -> Column:
        c = F.substring(msd, i + 1, 1)
        out = c
        if names:
            out = F.when(F.lit(False), F.lit(""))
            for k, v in names.items():
                out = out.when(c == k, v)
            out = out.otherwise(c)
        return F.when(F.length(msd) > i, out)

    verb, noun, adj = (cat == "V") & (F.length(msd) >= 3), (cat == "N") & (F.length(msd) >= 2), (cat == "A") & (F.length(msd) >= 2)
    return F.when(F.length(msd) > 0, F.struct(
        cat.alias("cat"), F.when(verb, at(1)).alias("type"), F.when(verb, at(2, MOODS)).alias("mood"), F.when(verb, at(3, TENSES)).alias("tense"), F.when(verb, at(4)).alias("person"),
        F.when(verb, at(5)).when(noun, at(3)).when(adj, at(4)).alias("number"), F.when(noun, at(2)).when(adj, at(3)).alias("gender"), F.when(noun, at(4, CASES)).when(adj, at(5)).alias("case"),
    ))


def first_entries(lexicon: DataFrame) -> DataFrame:
    """form, lemma, and the decoded code for the first entry (by row_idx) of each lower-cased form of lexicon (row_idx, form, lemma, msd)."""
    best = lexicon.groupBy(F.lower("form").alias("form")).agg(F.min_by(F.struct("lemma", "msd"), "row_idx").alias("e"))
    return best.select("form", F.col("e.lemma").alias("lemma"), decode_msd(F.col("e.msd")).alias("m"))


def pass_two(edits: DataFrame, lexicon: DataFrame, short_noise: bool = True) -> DataFrame:
    """edits (orig, correction, err_type) with err_type of R:OTHER rows decided by rules and the lexicon; short_noise=False leaves out
    the character-ratio rule, which is the one Python step."""
    lex = first_entries(lexicon)
    df = edits.withColumn("_o", F.lower(X.strip_punct(F.col("orig")))).withColumn("_c", F.lower(X.strip_punct(F.col("correction"))))
    for side in ("_o", "_c"):
        df = df.join(lex.select(F.col("form").alias(side), F.col("lemma").alias(f"{side}l"), F.col("m").alias(f"{side}m")), side, "left")
    o, c, orig, cor = F.col("_om"), F.col("_cm"), F.col("orig"), F.col("correction")
    same = F.col("_ol") == F.col("_cl")

    def differ(field: str) -> Column:
        return ~o[field].eqNullSafe(c[field])

    def both(cat: str) -> Column:
        return (o["cat"] == cat) & (c["cat"] == cat)

    noise = F.lit(False)
    if short_noise:
        asked = (F.col("err_type") == "R:OTHER") & (F.length(X.strip_punct(orig)) <= 4) & (F.col("_o") != F.col("_c"))
        noise = asked & (X.similarity_ratio(F.when(asked, F.col("_o")), F.when(asked, F.col("_c"))) >= 0.5)
    only = F.when(o.isNotNull() & c.isNull(), o["cat"]).when(o.isNull() & c.isNotNull(), c["cat"])
    new = (
        F.when(X.punct_only_nocase(orig, cor), "R:PUNCT").when(X.diacritic_fix(F.col("_o"), F.col("_c"), X.DIACRITICS_2), "R:SPELL").when(noise, "R:SPELL").when(pair_in(F.col("_o"), F.col("_c"), AGREEMENT_2), "R:VERB:SVA")
        .when(both("V") & same & differ("tense") & o["tense"].isNotNull() & c["tense"].isNotNull(), "R:VERB:TENSE").when(both("V") & same & differ("mood"), "R:VERB:FORM")
        .when(both("V") & same & (differ("number") | differ("person")), "R:VERB:SVA").when(both("V") & same, "R:VERB:FORM").when(both("V"), "R:VERB")
        .when(both("N") & same & differ("number"), "R:NOUN:NUM").when(both("N") & same, "R:NOUN:FORM").when(both("N"), "R:NOUN")
        .when(both("A") & same, "R:ADJ:FORM").when(both("A"), "R:ADJ").when(both("P"), "R:PRON").when(both("D"), "R:DET").when(both("S"), "R:PREP")
        .when(only == "V", "R:VERB").when(only == "N", "R:NOUN").when(only == "A", "R:ADJ").otherwise("R:OTHER")
    )
    return df.withColumn("err_type", F.when(F.col("err_type") == "R:OTHER", new).otherwise(F.col("err_type"))).drop("_o", "_c", "_ol", "_cl", "_om", "_cm")
