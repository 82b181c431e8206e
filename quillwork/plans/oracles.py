"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from quillwork.functions.text import PUNCT
from quillwork.operators import reclass, tags

from .derived import EDITS_SQL, HYP_SQL, TOKENS_SQL
from .roundtrips import ORACLES as ROUNDTRIPS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_X = "x AS (SELECT vec_id, label, unnest(generate_series(0, 63)) AS d, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_ZS = f"{_X}, m AS (SELECT d, avg(v) AS mu, stddev_pop(v) AS sd FROM x GROUP BY d), z AS (SELECT vec_id, label, x.d, (v - mu) / (sd + 1e-8) AS v FROM x JOIN m USING (d)), c AS (SELECT label AS cluster, d, avg(v) AS v FROM z GROUP BY label, d)"
_NEAR = f"""{_ZS}, q AS (SELECT vec_id, cluster, sum((z.v - c.v) * (z.v - c.v)) AS d2 FROM z JOIN c USING (d) GROUP BY vec_id, cluster),
r AS (SELECT vec_id, cluster, d2, row_number() OVER w AS k, lead(d2) OVER w AS d3 FROM q WINDOW w AS (PARTITION BY vec_id ORDER BY d2, cluster)),
a AS (SELECT vec_id, cluster, 1 - d2 / (d2 + d3 + 1e-8) AS confidence FROM r WHERE k = 1)"""
_DIST = f"{_X}, i AS (SELECT vec_id AS id, label, embedding FROM embeddings), p AS (SELECT a.id, a.label AS la, b.label AS lb, b.id AS other, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist FROM i a, i b), s AS (SELECT id, la, lb, sum(dist) AS t, count(*) AS n FROM p GROUP BY id, la, lb), r AS (SELECT id, coalesce(max(CASE WHEN la = lb AND n > 1 THEN t / (n - 1) END), 0.0) AS a, min(CASE WHEN la <> lb THEN t / n END) AS b FROM s GROUP BY id)"
_T = f"WITH {TOKENS_SQL}"
_E = f"WITH {TOKENS_SQL}, {EDITS_SQL}"


def _case(generation: dict, column: str = "err_type") -> str:
    return "CASE " + " ".join(f"WHEN {column} IN ({', '.join(map(_q, types))}) THEN {_q(base)}" for base, types in generation.items()) + f" ELSE {_q(tags.REPLACE)} END"


def _full(base: str, cor: str, none: bool) -> str:
    return f"CASE WHEN {base} IN ('$KEEP', '$DELETE') OR trim({cor}) = ''" + (f" OR trim({cor}) = '-NONE-'" if none else "") + f" THEN {base} ELSE {base} || '_' || trim({cor}) END"


_TAGS = f"g AS (SELECT doc_id, \"start\", err_type, b AS base, {_full('b', 'lower(correction)', True)} AS tag FROM (SELECT *, {_case(tags.GENERATION_B)} AS b FROM e))"
_BASE_OF = "CASE " + " ".join(f"WHEN starts_with(tag, {_q(b)}) THEN {_q(b)}" for b in tags.BASES) + " ELSE '$KEEP' END"
_PLACED = f"""k AS (SELECT doc_id, "start", "end", n, b, {_full('b', 'correction', True)} AS tag FROM (SELECT *, {_case(tags.GENERATION_B)} AS b FROM e)),
o AS (SELECT doc_id, "start" AS ord, unnest(CASE WHEN b = '$DELETE' THEN generate_series("start", least("end", n) - 1) WHEN b = '$APPEND' THEN [greatest("start" - 1, 0)] ELSE generate_series("start", greatest(least("end", n), "start" + 1) - 1) END) AS pos, b, tag, "start" FROM k),
l AS (SELECT doc_id, pos, arg_max(CASE WHEN b = '$DELETE' OR (b <> '$APPEND' AND pos > "start") THEN '$DELETE' ELSE tag END, ord) AS tag FROM o GROUP BY doc_id, pos),
f AS (SELECT p.doc_id, p.p AS pos, p.toks[p.p + 1] AS tok, coalesce(l.tag, '$KEEP') AS tag FROM p LEFT JOIN l ON l.doc_id = p.doc_id AND l.pos = p.p)"""
_PLACED_A = f"""k AS (SELECT doc_id, "start", "end", n, {_full('b', 'correction', False)} AS tag FROM (SELECT *, {_case(tags.GENERATION_A)} AS b FROM e)),
o AS (SELECT doc_id, "start" AS ord, unnest(CASE WHEN "end" = "start" THEN generate_series("start" - 1, "start" - 1) WHEN "start" >= n OR "end" > n THEN [] ELSE generate_series("start", "end" - 1) END) AS pos, "start", "end", tag FROM k),
l AS (SELECT doc_id, pos, arg_max(CASE WHEN "end" = "start" THEN '$APPEND' WHEN pos > "start" THEN '$DELETE' ELSE tag END, ord) AS tag FROM o WHERE pos >= 0 GROUP BY doc_id, pos),
f AS (SELECT p.doc_id, p.p AS pos, p.toks[p.p + 1] AS tok, coalesce(l.tag, '$KEEP') AS tag FROM p LEFT JOIN l ON l.doc_id = p.doc_id AND l.pos = p.p)"""
_JOINED = "SELECT t.doc_id, md5(coalesce(string_agg({what}, {sep} ORDER BY pos), '')) AS {name} FROM t LEFT JOIN f USING (doc_id) GROUP BY t.doc_id"


def _strip(s: str) -> str:
    return f"trim(trim({s}, {_q(PUNCT)}))"


def _plain(s: str) -> str:
    return f"translate(lower({s}), 'ăâșțĂÂȘȚ', 'aastAAST')"


def _pairs(o: str, c: str, pairs) -> str:
    return f"(lower({o}) || chr(9) || lower({c})) IN (" + ", ".join(_q(f"{a}\t{b}") for a, b in dict.fromkeys(pairs)) + ")"


def _diacritic(o: str, c: str, frm: str = "ăâșțĂÂȘȚ", to: str = "aastAAST") -> str:
    return f"(translate(lower({o}), {_q(frm)}, {_q(to)}) = translate(lower({c}), {_q(frm)}, {_q(to)}) AND lower({o}) <> lower({c}))"


_RATIO = "(CASE WHEN greatest(len({o}), len({c})) = 0 THEN 0.0 ELSE len(list_filter(generate_series(1, least(len({o}), len({c}))), lambda i: substr({o}, i, 1) = substr({c}, i, 1))) / greatest(len({o}), len({c})) END)"
_ORIG = "v AS (SELECT doc_id, \"start\", \"end\", err_type, correction, coalesce(array_to_string(toks[\"start\" + 1 : \"end\"], ' '), '') AS orig FROM e), w AS (SELECT *, " + _strip("orig") + " AS o, " + _strip("correction") + " AS c FROM v), y AS (SELECT *, " + _plain("o") + " AS po, " + _plain("c") + " AS pc FROM w)"
_R1 = _RATIO.format(o="po", c="pc")
_PASS1 = f"""CASE WHEN err_type = 'R:OTHER' THEN CASE
 WHEN (replace(orig, ' ', '') = replace(correction, ' ', '') AND orig <> correction) OR (lower(o) = lower(c) AND o <> c) THEN 'R:ORTH'
 WHEN o = c OR o = '' OR c = '' THEN 'R:PUNCT' WHEN {_diacritic('o', 'c')} THEN 'R:SPELL'
 WHEN {_pairs('o', 'c', reclass.AGREEMENT)} THEN 'R:VERB:SVA' WHEN {_pairs('o', 'c', reclass.TENSE)} THEN 'R:VERB:TENSE'
 WHEN NOT {_diacritic('o', 'c')} AND {_R1} > 0.7 AND po <> pc AND len(o) > 2 THEN 'R:VERB:FORM'
 WHEN len(po) >= 3 AND len(pc) >= 3 AND {_R1} > 0.6 AND po <> pc THEN 'R:NOUN:FORM' ELSE err_type END
 WHEN err_type IN ('M:OTHER', 'U:OTHER') THEN CASE WHEN translate(s, {_q(PUNCT)}, '') = '' THEN left(err_type, 1) || ':PUNCT'
 WHEN lower(s) IN ({', '.join(map(_q, reclass.CONJUNCTIONS))}) THEN left(err_type, 1) || ':CONJ' WHEN lower(s) IN ({', '.join(map(_q, reclass.DETERMINERS))}) THEN left(err_type, 1) || ':DET'
 WHEN lower(s) IN ({', '.join(map(_q, reclass.PREPOSITIONS))}) THEN left(err_type, 1) || ':PREP' ELSE err_type END ELSE err_type END"""
_LEX = f"""lx AS (SELECT DISTINCT lower({_strip('w')}) AS form FROM (SELECT unnest(toks) AS w FROM t)), lex AS (SELECT form, left(form, 4) AS lemma, CASE len(form) % 6 WHEN 0 THEN 'V3s' WHEN 1 THEN 'V3p' WHEN 2 THEN 'Ns' WHEN 3 THEN 'Np' WHEN 4 THEN 'A' ELSE 'S' END AS m FROM lx WHERE form <> '')"""
_PASS2 = f"""CASE WHEN lo = lc AND orig <> correction THEN 'R:PUNCT' WHEN {_diacritic('lo', 'lc', 'ăâșțĂÂȘȚîÎ', 'aastAAStiI')} THEN 'R:SPELL' WHEN {_pairs('lo', 'lc', reclass.AGREEMENT_2)} THEN 'R:VERB:SVA'
 WHEN a.m[1] = 'V' AND b.m[1] = 'V' THEN CASE WHEN a.lemma <> b.lemma THEN 'R:VERB' WHEN a.m <> b.m THEN 'R:VERB:SVA' ELSE 'R:VERB:FORM' END
 WHEN a.m[1] = 'N' AND b.m[1] = 'N' THEN CASE WHEN a.lemma <> b.lemma THEN 'R:NOUN' WHEN a.m <> b.m THEN 'R:NOUN:NUM' ELSE 'R:NOUN:FORM' END
 WHEN a.m = 'A' AND b.m = 'A' THEN CASE WHEN a.lemma = b.lemma THEN 'R:ADJ:FORM' ELSE 'R:ADJ' END WHEN a.m = 'S' AND b.m = 'S' THEN 'R:PREP'
 WHEN a.m IS NOT NULL AND b.m IS NULL AND a.m <> 'S' THEN CASE a.m[1] WHEN 'V' THEN 'R:VERB' WHEN 'N' THEN 'R:NOUN' ELSE 'R:ADJ' END
 WHEN b.m IS NOT NULL AND a.m IS NULL AND b.m <> 'S' THEN CASE b.m[1] WHEN 'V' THEN 'R:VERB' WHEN 'N' THEN 'R:NOUN' ELSE 'R:ADJ' END ELSE 'R:OTHER' END"""


def _keys(mode: str) -> str:
    """hk, rk: doc_id, key, cat of hypothesis and reference."""
    def one(name: str, src: str) -> str:
        if mode == "token":
            return f"{name} AS (SELECT doc_id, k || '|' || (k + 1) AS key, err_type AS cat FROM (SELECT doc_id, err_type, unnest(CASE WHEN \"start\" = \"end\" THEN [\"start\"] ELSE generate_series(\"start\", \"end\" - 1) END) AS k FROM {src}))"
        key = {"span": "\"start\" || '|' || \"end\"", "correction": "\"start\" || '|' || \"end\" || '|' || correction", "correction_type": "\"start\" || '|' || \"end\" || '|' || err_type || '|' || correction"}[mode]
        return f"{name} AS (SELECT doc_id, {key} AS key, err_type AS cat FROM {src})"

    return f"{one('hk', 'h')}, {one('rk', 'e')}"


def _counts(mode: str = "correction") -> str:
    return f"""{_E}, {HYP_SQL}, {_keys(mode)}, refs AS (SELECT DISTINCT doc_id FROM rk), n AS (
  SELECT r.cat, 1 AS tp, 0 AS fp, 0 AS fn FROM rk r WHERE EXISTS (SELECT 1 FROM hk WHERE hk.doc_id = r.doc_id AND hk.key = r.key)
  UNION ALL SELECT hk.cat, 0, 1, 0 FROM hk SEMI JOIN refs USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM rk r WHERE hk.doc_id = r.doc_id AND hk.key = r.key)
  UNION ALL SELECT r.cat, 0, 0, 1 FROM rk r WHERE NOT EXISTS (SELECT 1 FROM hk WHERE hk.doc_id = r.doc_id AND hk.key = r.key))"""


_SCORES = "tp, fp, fn, round(p, 4) AS p, round(r, 4) AS r, round(CASE WHEN p + r > 0 THEN 1.25 * p * r / (0.25 * p + r) ELSE 0.0 END, 4) AS f"
_PR = "CASE WHEN fp > 0 THEN tp / (tp + fp) ELSE 1.0 END::DOUBLE AS p, CASE WHEN fn > 0 THEN tp / (tp + fn) ELSE 1.0 END::DOUBLE AS r"
_SUMS = "sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn"
_PRED = f"tp_ AS (SELECT tag, CASE WHEN (doc_id + \"start\") % 4 = 0 THEN '$REPLACE' ELSE tag END AS pred FROM g), bb AS (SELECT tag, pred, {_BASE_OF} AS gb, {_BASE_OF.replace('(tag,', '(pred,')} AS pb FROM tp_), cl AS (SELECT unnest([{', '.join(_q(b) for b in tags.BASES if b != '$KEEP')}]) AS class)"


def _class(pred: str) -> str:
    return f"""{_E}, {_TAGS}, {_PRED}, n AS (SELECT class, count(*) FILTER (gb = class AND ({pred})) AS tp, count(*) FILTER (gb <> class AND ({pred})) AS fp, count(*) FILTER (gb = class AND NOT ({pred})) AS fn FROM cl, bb GROUP BY class),
    s AS (SELECT *, (CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END)::DOUBLE AS p, (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END)::DOUBLE AS r FROM n)
    SELECT class, tp, fp, fn, round(p, 6) AS prec, round(r, 6) AS rec, round(CASE WHEN p + r > 0 THEN 1.25 * p * r / (0.25 * p + r) ELSE 0.0 END, 6) AS f FROM s"""


def _islands(column: str) -> str:
    return f"(SELECT doc_id, min(pos) AS s, max(pos) AS e, {column} AS tag FROM (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY pos) AS isle FROM (SELECT *, CASE WHEN lag({column}) OVER (PARTITION BY doc_id ORDER BY pos) IS NOT DISTINCT FROM {column} THEN 0 ELSE 1 END AS b FROM u)) GROUP BY doc_id, isle, {column})"


_MIRROR = lambda v: f"(CASE WHEN {v} < 0 THEN -({v}) WHEN {v} > 7 THEN 14 - ({v}) ELSE {v} END)"


def _sobel(kernel) -> str:
    terms = [f"{kernel[a][b]} * px[{_MIRROR(f'(y + {a - 1})')} * 8 + {_MIRROR(f'(x + {b - 1})')} + 1]::DOUBLE" for a in range(3) for b in range(3) if kernel[a][b]]
    return "(" + " + ".join(terms) + ")"


_KX = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))
_KY = tuple(zip(*_KX))
_EDGE = f"gr AS (SELECT vec_id, embedding AS px, unnest(generate_series(0, 63)) AS k FROM embeddings), xy AS (SELECT vec_id, px, k % 8 AS x, k // 8 AS y FROM gr), mg AS (SELECT vec_id, x, y, sqrt({_sobel(_KX)} * {_sobel(_KX)} + {_sobel(_KY)} * {_sobel(_KY)}) AS m FROM xy), ed AS (SELECT vec_id, x, y, greatest(0.0, least(1.0, (m / (max(m) OVER (PARTITION BY vec_id) + 1e-8) - 0.25) / 0.75)) AS e FROM mg)"
_MSD = ("Vmip3s", "Vmis1p", "Vmnp", "Ncfsrn", "Ncmpoy", "Ncf", "Afpms-n", "Afp", "Px3fsr", "Di3ms", "Spsa", "V", "")


def _at(i: int, names: dict | None = None) -> str:
    c = f"substr(msd, {i + 1}, 1)"
    v = c if not names else f"CASE {c} " + " ".join(f"WHEN {_q(k)} THEN {_q(x)}" for k, x in names.items()) + f" ELSE {c} END"
    return f"CASE WHEN len(msd) > {i} THEN {v} END"


_V, _N, _A = "(msd[1] = 'V' AND len(msd) >= 3)", "(msd[1] = 'N' AND len(msd) >= 2)", "(msd[1] = 'A' AND len(msd) >= 2)"

ORACLES = {
    "nearest_center_confidence": f"WITH {_NEAR} SELECT vec_id, cluster, round(confidence, 6) AS confidence FROM a",
    "confidence_summary": f"WITH {_NEAR} SELECT round(avg(confidence), 6) AS mean, round(quantile_cont(confidence, 0.5), 6) AS median, round(quantile_cont(confidence, 0.1), 6) AS p10, round(quantile_cont(confidence, 0.9), 6) AS p90 FROM a",
    "per_cluster_confidence": f"WITH {_NEAR} SELECT cluster, round(avg(confidence), 6) AS mean_confidence, count(*) AS n FROM a GROUP BY cluster",
    "cluster_means_zspace": f"WITH {_ZS} SELECT cluster, d::INT AS d, round(v, 6) AS v FROM c",
    "silhouette": f"WITH {_DIST} SELECT round(avg((b - a) / (greatest(a, b) + 1e-8)), 6) AS silhouette FROM r",
    "silhouette_rows": f"WITH {_DIST} SELECT id AS vec_id, round(a, 6) AS a, round(b, 6) AS b, round((b - a) / (greatest(a, b) + 1e-8), 6) AS s FROM r",
    "davies_bouldin": f"WITH {_X}, c AS (SELECT label, d, avg(v) AS v FROM x GROUP BY ALL), q AS (SELECT vec_id, x.label, sqrt(sum((x.v - c.v) * (x.v - c.v))) AS dist FROM x JOIN c ON c.label = x.label AND c.d = x.d GROUP BY ALL), s AS (SELECT label, avg(dist + 1e-8) AS s FROM q GROUP BY label), k AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.v - b.v) * (a.v - b.v))) + 1e-8 AS dd FROM c a JOIN c b ON a.d = b.d AND a.label <> b.label GROUP BY ALL), r AS (SELECT i, max((si.s + sj.s) / dd) AS r FROM k JOIN s si ON si.label = i JOIN s sj ON sj.label = j GROUP BY i) SELECT round(avg(r), 6) AS davies_bouldin FROM r",
    "pca_project": f"WITH {_X} SELECT vec_id, round(sum((v - 0.01 * d) * (CASE WHEN d % 2 = 1 THEN 1.0 ELSE -1.0 END) / 8), 6) AS pc1, round(sum((v - 0.01 * d) * ((d % 5 - 2) / 10.0)), 6) AS pc2 FROM x GROUP BY vec_id",
    "sanitize_tokens": f"{_T} SELECT translate(w, 'ţşŢŞ', 'țșȚȘ') AS token, count(*) AS n FROM (SELECT unnest(toks) AS w FROM t) GROUP BY 1",
    "diacritic_fix_pairs": f"{_T}, d AS (SELECT DISTINCT unnest(toks) AS orig FROM t), e AS (SELECT orig, translate(orig, 'aăâsț', 'âaăsț') AS cor FROM d) SELECT orig, cor FROM e WHERE {_diacritic('orig', 'cor')}",
    "punct_and_case": f"{_E}, {_ORIG} SELECT doc_id, \"start\", o AS stripped, (o = c OR o = '' OR c = '') AS punct, (lower(orig) = lower(correction) AND orig <> correction) AS case_only, (replace(orig, ' ', '') = replace(correction, ' ', '') AND orig <> correction) AS ws FROM w WHERE err_type = 'R:OTHER'",
    "ordinal_split_counts": "WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT CASE WHEN doc_id < trunc(n * 0.7::DOUBLE) THEN 'train' WHEN doc_id < trunc(n * 0.7::DOUBLE) + trunc(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split, n_chars FROM documents, n) SELECT split, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM s GROUP BY split",
    "row_slice": "SELECT doc_id - 50 AS row_idx, lang FROM documents WHERE doc_id >= 50 AND doc_id < 150",
    "annotated_left_join": f"{_E} SELECT d.doc_id, d.lang, coalesce(\"start\", -1) AS start_tok, coalesce(\"end\", -1) AS end_tok, coalesce(err_type, 'correct') AS err_type, coalesce(correction, '') AS correction FROM documents d LEFT JOIN e USING (doc_id)",
    "first_target_per_source": "SELECT conv_id, arg_min(text, turn) AS first_text, arg_min(role, turn) AS first_role, count(*) AS n FROM conversations GROUP BY conv_id",
    "full_tag_build": f"{_E} SELECT doc_id, \"start\", {_full('a', 'correction', False)} AS tag_a, {_full('b', 'correction', True)} AS tag_b FROM (SELECT *, {_case(tags.GENERATION_A)} AS a, {_case(tags.GENERATION_B)} AS b FROM e)",
    "rare_tag_collapse": f"{_E}, {_TAGS}, n AS (SELECT tag, count(*) OVER (PARTITION BY tag) AS n FROM g) SELECT CASE WHEN n >= 5 THEN tag WHEN starts_with(tag, '$REPLACE') THEN '$REPLACE' WHEN starts_with(tag, '$APPEND') THEN '$APPEND' WHEN starts_with(tag, '$MORPH') THEN '$MORPH' ELSE tag END AS tag, count(*) AS n FROM n GROUP BY 1",
    "top_tags": f"{_E}, {_TAGS} SELECT tag, count(*) AS n FROM g GROUP BY tag ORDER BY n DESC, tag LIMIT 20",
    "class_weights": f"{_E}, {_TAGS}, voc AS (SELECT tag FROM g GROUP BY tag HAVING count(*) >= 3 UNION SELECT unnest([{', '.join(map(_q, tags.BASES))}])), rs AS (SELECT CASE WHEN tag IN (SELECT tag FROM voc) THEN tag ELSE {_BASE_OF} END AS tag FROM g), n AS (SELECT tag, count(*) AS n FROM rs GROUP BY tag), tot AS (SELECT sum(n)::DOUBLE AS total, (SELECT count(*) FROM voc) AS k FROM n) SELECT voc.tag, coalesce(n, 1) AS count, round(sqrt(total / (k * coalesce(n, 1))), 6) AS weight FROM voc LEFT JOIN n USING (tag), tot",
    "edits_to_tags": f"{_E}, {_PLACED} " + _JOINED.format(what="f.tag", sep="chr(10)", name="tags_md5"),
    "edits_to_tags_a": f"{_E}, {_PLACED_A} " + _JOINED.format(what="f.tag", sep="chr(10)", name="tags_md5"),
    "apply_tags": f"{_E}, {_PLACED}, ap AS (SELECT doc_id, pos, CASE WHEN tag = '$DELETE' THEN NULL WHEN tag = '$APPEND' OR tag = '$KEEP' THEN tok WHEN starts_with(tag, '$APPEND_') THEN tok || ' ' || substr(tag, 9) WHEN starts_with(tag, '$REPLACE_SPELL_') THEN substr(tag, 16) WHEN starts_with(tag, '$REPLACE_SPELL') THEN tok WHEN starts_with(tag, '$REPLACE_') THEN substr(tag, 10) ELSE tok END AS w FROM f) SELECT t.doc_id, md5(coalesce(string_agg(w, ' ' ORDER BY pos), '')) AS text_md5 FROM t LEFT JOIN ap USING (doc_id) GROUP BY t.doc_id",
    "reconstruct_target": f"{_E}, sp AS (SELECT p.doc_id, p.p AS pos, p.toks[p.p + 1] AS tok, s.err_type AS k, s.correction AS cor, (SELECT count(*) FROM e c WHERE c.doc_id = p.doc_id AND c.err_type NOT IN ('M:OTHER') AND c.\"start\" = p.p - 1 AND c.\"end\" = p.p + 1) AS inside FROM p LEFT JOIN e s ON s.doc_id = p.doc_id AND s.\"start\" = p.p), w AS (SELECT doc_id, pos, CASE WHEN k IS NULL THEN CASE WHEN inside > 0 THEN NULL ELSE tok END WHEN k = 'M:OTHER' THEN trim(cor) || ' ' || tok WHEN k = 'U:OTHER' THEN NULL ELSE nullif(trim(cor), '') END AS w FROM sp) SELECT t.doc_id, md5(coalesce(string_agg(w, ' ' ORDER BY pos), '')) AS target_md5 FROM t LEFT JOIN w USING (doc_id) GROUP BY t.doc_id",
    "all_keep_counts": f"{_E}, {_PLACED}, d AS (SELECT t.doc_id, coalesce(bool_and(f.tag = '$KEEP'), true) AS all_keep FROM t LEFT JOIN f USING (doc_id) GROUP BY t.doc_id) SELECT all_keep, count(*) AS n FROM d GROUP BY all_keep",
    "reclassify_pass1": f"{_E}, {_ORIG}, yy AS (SELECT *, CASE WHEN err_type = 'M:OTHER' THEN c ELSE o END AS s FROM y) SELECT doc_id, \"start\", {_PASS1} AS new_type FROM yy",
    "msd_decode": f"WITH p AS (SELECT p_partkey, ([{', '.join(map(_q, _MSD))}])[(p_partkey % {len(_MSD)} + 1)::INT] AS msd FROM part) SELECT p_partkey, msd, CASE WHEN msd <> '' THEN upper(msd[1]) END AS cat, CASE WHEN {_V} THEN {_at(1)} END AS type, CASE WHEN {_V} THEN {_at(2, reclass.MOODS)} END AS mood, CASE WHEN {_V} THEN {_at(3, reclass.TENSES)} END AS tense, CASE WHEN {_V} THEN {_at(4)} END AS person, CASE WHEN {_V} THEN {_at(5)} WHEN {_N} THEN {_at(3)} WHEN {_A} THEN {_at(4)} END AS number, CASE WHEN {_N} THEN {_at(2)} WHEN {_A} THEN {_at(3)} END AS gender, CASE WHEN {_N} THEN {_at(4, reclass.CASES)} WHEN {_A} THEN {_at(5)} END AS \"case\" FROM p",
    "lexicon_reclass": f"{_E}, {_ORIG}, {_LEX}, z AS (SELECT *, lower(o) AS lo, lower(c) AS lc FROM w WHERE err_type = 'R:OTHER') SELECT doc_id, \"start\", {_PASS2} AS err_type FROM z LEFT JOIN lex a ON a.form = lo LEFT JOIN lex b ON b.form = lc",
    "threshold_mask": f"WITH {_NEAR}, k AS (SELECT vec_id, '$REPLACE_' || cluster AS tag, round(confidence, 9) AS c FROM a) SELECT vec_id, CASE WHEN c < 0.5 THEN '$KEEP' ELSE tag END AS at_50, CASE WHEN c < 0.7 THEN '$KEEP' ELSE tag END AS at_70, CASE WHEN c < 0.8 THEN '$KEEP' ELSE tag END AS at_80 FROM k",
    "prf_by_category": f"{_counts()}, c AS (SELECT cat, {_SUMS} FROM n GROUP BY cat HAVING sum(tp) + sum(fn) > 0), s AS (SELECT *, {_PR} FROM c) SELECT cat, {_SCORES} FROM s",
    "prf_token_detection": f"{_counts('token')}, c AS (SELECT {_SUMS} FROM n), s AS (SELECT *, {_PR} FROM c) SELECT {_SCORES} FROM s",
    "prf_span_detection": f"{_counts('span')}, c AS (SELECT CASE WHEN cat = 'UNK' THEN cat ELSE substr(cat, 3) END AS cat, {_SUMS} FROM n GROUP BY 1 HAVING sum(tp) + sum(fn) > 0), s AS (SELECT *, {_PR} FROM c) SELECT cat, {_SCORES} FROM s",
    "prf_correction_type": f"{_counts('correction_type')}, c AS (SELECT {_SUMS} FROM n), s AS (SELECT *, {_PR} FROM c) SELECT {_SCORES} FROM s",
    "prf_rollup": f"{_counts()}, c AS (SELECT left(cat, 1) AS op, cat, {_SUMS} FROM n GROUP BY GROUPING SETS ((left(cat, 1), cat), (left(cat, 1)), ())), s AS (SELECT *, {_PR} FROM c) SELECT op, cat, {_SCORES} FROM s",
    "binary_fbeta": "WITH n AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality <> 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic <> 0) AS fn FROM labels), s AS (SELECT *, (CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END)::DOUBLE AS p, (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END)::DOUBLE AS r FROM n) SELECT tp, fp, fn, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 1.25 * p * r / (0.25 * p + r) ELSE 0.0 END, 6) AS f FROM s",
    "class_fbeta": _class("pb = class"),
    "class_fbeta_exact": _class("gb = class AND tag = pred"),
    "sequence_run_f1": f"{_T}, u AS (SELECT doc_id, p AS pos, CASE WHEN len(toks[p + 1]) > 4 THEN '$KEEP' ELSE '$REPLACE' END AS gold, CASE WHEN (doc_id + p) % 29 = 0 THEN '$DELETE' WHEN len(toks[p + 1]) > 4 THEN '$KEEP' ELSE '$REPLACE' END AS pred FROM (SELECT doc_id, toks, unnest(generate_series(0, len(toks) - 1)) AS p FROM t)), gi AS {_islands('gold')}, pi AS {_islands('pred')}, n AS (SELECT (SELECT count(*) FROM gi JOIN pi USING (doc_id, s, e, tag)) AS tp, (SELECT count(*) FROM gi) AS n_gold, (SELECT count(*) FROM pi) AS n_pred), s AS (SELECT *, (tp / n_pred)::DOUBLE AS p, (tp / n_gold)::DOUBLE AS r FROM n) SELECT tp, n_gold, n_pred, round(p, 6) AS p, round(r, 6) AS r, round(2 * p * r / (p + r), 6) AS f1 FROM s",
    "char_levenshtein": r"WITH b AS (SELECT item_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS text FROM benchmark) SELECT a.item_id AS item, levenshtein(a.text, b.text)::INT AS distance FROM b a JOIN b ON b.item_id = a.item_id + 1",
    "sobel_edges": f"WITH {_EDGE} SELECT vec_id, x::INT AS x, y::INT AS y, round(e, 5) AS e FROM ed",
    "edge_profile": f"WITH {_EDGE} SELECT vec_id, 'row' AS axis, y::INT AS k, round(sum(e), 4) AS total FROM ed GROUP BY vec_id, y UNION ALL SELECT vec_id, 'column', x::INT, round(sum(e), 4) FROM ed GROUP BY vec_id, x",
    "autocorr_peak": "WITH h AS (SELECT event_type, floor(epoch(ts) / 3600)::BIGINT AS h, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), d AS (SELECT event_type, h, n - avg(n) OVER (PARTITION BY event_type) AS v FROM h), e AS (SELECT event_type, sum(v * v) AS en FROM d GROUP BY 1), r AS (SELECT a.event_type, lag, round(sum(a.v * b.v) / (any_value(en) + 1e-8), 6) AS a FROM d a, (SELECT unnest(generate_series(2, 24)) AS lag) JOIN d b ON b.event_type = a.event_type AND b.h = a.h + lag JOIN e ON e.event_type = a.event_type GROUP BY 1, 2) SELECT event_type, arg_min(lag, round(-a * 1000000)::BIGINT * 100 + lag)::INT AS lag, max(a) AS peak FROM r GROUP BY event_type",
    "reflection_score_axis0": "WITH g AS (SELECT vec_id, k // 8 AS y, k % 8 AS x, abs(v)::DOUBLE AS v FROM (SELECT vec_id, unnest(generate_series(0, 63)) AS k, unnest(embedding) AS v FROM embeddings) WHERE k // 8 >= 1 AND k // 8 < 7) SELECT a.vec_id, round(sum(a.v * b.v) / (sum(a.v * a.v) + 1e-6), 6) AS score FROM g a JOIN g b ON a.vec_id = b.vec_id AND a.y = b.y AND a.x = 7 - b.x GROUP BY a.vec_id",
}

_BY_SOURCE = f"""u AS (SELECT e.*, array_to_string(e.toks, ' ') AS src, doc_id * 1000000 + "start" AS ord FROM e),
k AS (SELECT src, ord, "start", "end", n, {_full('b', 'correction', False)} AS tag FROM (SELECT *, {_case(tags.GENERATION_A)} AS b FROM u)),
o AS (SELECT src, ord, unnest(CASE WHEN "end" = "start" THEN generate_series("start" - 1, "start" - 1) WHEN "start" >= n OR "end" > n THEN [] ELSE generate_series("start", "end" - 1) END) AS pos, "start", "end", tag FROM k),
l AS (SELECT src, pos, arg_max(CASE WHEN "end" = "start" THEN '$APPEND' WHEN pos > "start" THEN '$DELETE' ELSE tag END, ord) AS tag FROM o WHERE pos >= 0 GROUP BY src, pos),
s AS (SELECT src, arg_min('t' || doc_id, ord) AS target, any_value(n) AS n FROM u GROUP BY src),
f AS (SELECT src, unnest(generate_series(0, n - 1)) AS pos FROM s)"""
ORACLES |= ROUNDTRIPS | {
    "tags_by_source": f"{_E}, {_BY_SOURCE} SELECT md5(src) AS source_md5, any_value(target) AS target, 'd' AS dataset, md5(string_agg(coalesce(tag, '$KEEP'), chr(10) ORDER BY pos)) AS tags_md5 FROM f LEFT JOIN l USING (src, pos) JOIN s USING (src) GROUP BY src",
}


def _annotators() -> str:
    """Sentence after sentence, the coder that leads to the best F over the totals so far."""
    with_h = "(SELECT 1 FROM hk WHERE hk.doc_id = r.doc_id AND hk.key = r.key)"
    f = "round(CASE WHEN p + r > 0 THEN 1.25 * p * r / (0.25 * p + r) ELSE 0.0 END, 4)"
    ratio = lambda x: f"CASE WHEN {x} > 0 THEN tp / (tp + {x}) ELSE 1.0 END"
    return f"""{_E.replace("WITH", "WITH RECURSIVE", 1)}, {HYP_SQL}, {_keys("correction")},
r2 AS MATERIALIZED (SELECT doc_id, 0 AS coder, key FROM rk UNION ALL SELECT doc_id, 1, key FROM rk WHERE (doc_id + split_part(key, '|', 1)::BIGINT) % 2 = 0),
co AS (SELECT DISTINCT doc_id, coder FROM r2),
n AS (SELECT doc_id, coder, count(*) FILTER (EXISTS {with_h}) AS tp, 0 AS fp, count(*) FILTER (NOT EXISTS {with_h}) AS fn FROM r2 r GROUP BY doc_id, coder
  UNION ALL SELECT hk.doc_id, co.coder, 0, count(*), 0 FROM hk JOIN co USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM r2 r WHERE r.doc_id = hk.doc_id AND r.coder = co.coder AND r.key = hk.key) GROUP BY hk.doc_id, co.coder),
g AS (SELECT doc_id, list({{'coder': coder, 'tp': tp, 'fp': fp, 'fn': fn}} ORDER BY coder) AS c FROM (SELECT doc_id, coder, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM n GROUP BY doc_id, coder) GROUP BY doc_id),
s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, c FROM g),
a AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS doc_id, NULL::INT AS coder, 0::BIGINT AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn
  UNION ALL SELECT k, doc_id, b.coder, tp + b.tp, fp + b.fp, fn + b.fn FROM (SELECT s.k, s.doc_id, a.tp, a.fp, a.fn, (SELECT arg_max(x, {{'f': {f}, 'tp': x.tp, 'fp': -x.fp, 'fn': -x.fn, 'k': -x.coder}})
    FROM (SELECT x, {ratio("fp")}::DOUBLE AS p, {ratio("fn")}::DOUBLE AS r FROM (SELECT x, a.tp + x.tp AS tp, a.fp + x.fp AS fp, a.fn + x.fn AS fn FROM (SELECT unnest(s.c) AS x)))) AS b FROM a JOIN s ON s.k = a.k + 1))
SELECT doc_id AS sent_id, coder FROM a WHERE k > 0"""


def _stems() -> str:
    """The stemmer's steps one after another, with room for eight combined suffixes."""
    from quillwork.functions import stem as S

    def case(rules, s: str) -> str:
        return f"CASE {s} " + " ".join(f"WHEN {_q(x)} THEN {_q(new)}" for suffixes, new in rules for x in suffixes) + " END"

    def found(suffixes, w: str = "w") -> str:
        return f"regexp_extract({w}, {_q(S.ending(suffixes))}, 0)"

    def listed(x) -> str:
        return "(" + ", ".join(map(_q, x)) + ")"

    every = lambda rules: [x for suffixes, _ in rules for x in suffixes]
    cut = "left(w, length(w) - length(s))"
    region = lambda before: f"CASE WHEN length(regexp_extract(w, {_q(before)}, 0)) > 0 THEN length(regexp_extract(w, {_q(before)}, 0)) ELSE length(w) END"
    marked = f"regexp_replace(low, '([{S.VOWELS}])([ui])([{S.VOWELS}])', '\\1' || chr(1) || '\\2\\3', 'g')"
    steps = [f"z AS (SELECT word, rv, r1, r2, false AS gone, CASE WHEN s <> '' AND length(w) - length(s) >= r1 AND NOT (s = 'ile' AND ends_with({cut}, 'ab')) THEN {cut} || {case(S.STEP_0, 's')} ELSE w END AS w FROM (SELECT *, {found(every(S.STEP_0))} AS s FROM v))"]
    last = "z"
    for k in range(8):
        steps.append(f"c{k} AS (SELECT word, rv, r1, r2, gone OR ok AS gone, CASE WHEN ok THEN {cut} || {case(S.COMBINED, 's')} ELSE w END AS w FROM (SELECT *, s <> '' AND length(w) - length(s) >= r1 AS ok FROM (SELECT *, {found(every(S.COMBINED))} AS s FROM {last})))")
        last = f"c{k}"
    steps += [
        f"d AS (SELECT word, rv, gone OR ok AS gone, CASE WHEN NOT ok THEN w WHEN s IN {listed(S.AFTER_T)} THEN left(b, length(b) - 1) || 't' WHEN s IN {listed(S.PERSONS)} THEN b || 'ist' ELSE b END AS w FROM (SELECT *, s <> '' AND length(w) - length(s) >= r2 AND (s NOT IN {listed(S.AFTER_T)} OR ends_with(b, 'ţ')) AS ok FROM (SELECT *, {cut} AS b FROM (SELECT *, {found((*S.STANDARD, *S.AFTER_T, *S.PERSONS))} AS s FROM {last}))))",
        f"e AS (SELECT word, rv, CASE WHEN NOT gone AND s <> '' AND (s IN {listed(S.VERB_ANYWHERE)} OR regexp_matches(left(i, length(i) - length(s)), '([^{S.VOWELS}]|u)$')) THEN {cut} ELSE w END AS w FROM (SELECT *, {found((*S.VERB_AFTER_CONSONANT, *S.VERB_ANYWHERE), 'i')} AS s FROM (SELECT *, substr(w, rv + 1) AS i FROM d)))",
        f"f AS (SELECT word, translate(CASE WHEN s <> '' AND length(w) - length(s) >= rv THEN {cut} ELSE w END, 'UI', 'ui') AS stem FROM (SELECT *, {found(S.LAST)} AS s FROM e))",
    ]
    words = f"{_T}, q AS (SELECT DISTINCT lower(unnest(toks)) AS word FROM t), "
    chain = f"l AS (SELECT DISTINCT word, word AS low FROM q UNION SELECT DISTINCT translate(word, 'șț', 'şţ'), translate(word, 'șț', 'şţ') FROM q), p AS (SELECT word, replace(replace({marked}, chr(1) || 'u', 'U'), chr(1) || 'i', 'I') AS w FROM l), v AS (SELECT word, w, {region(S.BEFORE_RV)} AS rv, {region(S.BEFORE_R1)} AS r1, {region(S.BEFORE_R2)} AS r2 FROM p), {', '.join(steps)}"
    return f"{words}{chain} SELECT q.word, a.stem, b.stem AS comma_stem FROM q JOIN f AS a ON a.word = q.word JOIN f AS b ON b.word = translate(q.word, 'șț', 'şţ')"


_GREY = "(floor(abs(x) * 400)::INT % 256)"
ORACLES |= {
    "best_annotator": _annotators(),
    "stem_words": _stems(),
    "edits_by_text": f"{_E}, k AS (SELECT doc_id, md5(text) AS source FROM t), ke AS (SELECT k.source, err_type, \"start\" FROM e JOIN k USING (doc_id)) SELECT k.doc_id, coalesce(err_type, 'correct') AS err_type, count(*) AS n, sum(coalesce(\"start\", -1))::BIGINT AS starts FROM k LEFT JOIN ke USING (source) GROUP BY 1, 2",
    "run_counters": f"{_E}, {_ORIG}, yy AS (SELECT *, CASE WHEN err_type = 'M:OTHER' THEN c ELSE o END AS s FROM y), rt AS (SELECT err_type, {_PASS1} AS new_type FROM yy), cl AS (SELECT t.doc_id FROM t WHERE t.doc_id NOT IN (SELECT doc_id FROM e)) SELECT * FROM (VALUES ('edits', (SELECT count(*) FROM e)), ('retyped', (SELECT count(*) FROM rt WHERE err_type <> new_type)), ('sentences', (SELECT count(*) FROM t)), ('tokens', (SELECT sum(len(toks))::BIGINT FROM t)), ('written', (SELECT count(*) FROM t)), ('clean', (SELECT count(*) FROM cl)), ('kept_clean', (SELECT count(*) FROM cl))) AS x(counter, n)",
    "grey_pictures": f"SELECT vec_id, 8 AS h, 8 AS w, list_sum(list_transform(embedding, lambda x: {_GREY}))::BIGINT AS total, list_max(list_transform(embedding, lambda x: {_GREY}))::BIGINT AS top FROM embeddings",
}

ORACLES |= {
    "datasets_corrected": r"""WITH c AS (SELECT role AS dataset, conv_id * 1000 + turn AS sent_id, translate(trim(text), 'ţşŢŞ', 'țșȚȘ') AS text FROM conversations),
    w AS (SELECT dataset, sent_id, list_filter(string_split_regex(text, '[\t-\r ]+'), lambda x: x <> '' AND x <> 'of') AS w FROM c WHERE text <> '')
    SELECT dataset, sent_id, i::INT AS iteration, md5(array_to_string(list_transform(w, lambda x: CASE x WHEN 'the' THEN 'a' WHEN 'de' THEN 'la' ELSE x END), ' ')) AS text_md5 FROM w, (SELECT unnest([1, 2, 3]) AS i)""",
}
