"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from . import oracles_more
from .decontam import DRIFT, PIECE, PLAIN, PROMISING, SAME, SHORT, THRESHOLD, UNITS
from .licenses import BARRED, CONTAINMENT, MUST, PHRASES, TEMPLATES
from .mixing import MOST, SHARE, WEIGHTS

#: Passes of the selection written out; at the small scale factors fewer leave no document that fits.
_PASSES = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _licenses() -> str:
    gap = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    templates = ", ".join(f"({_q(label)}, {_list(sorted(set(t.split())))}, {_list(MUST.get(t, ()))}::VARCHAR[], {_list(BARRED.get(t, ()))}::VARCHAR[])" for label, t in TEMPLATES)
    places = ", ".join("list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {k}] IS NOT DISTINCT FROM {_q(x)}" for k, x in enumerate(p.split())) + ")" for _, p in PHRASES)
    labels = ", ".join(f"CASE WHEN len(p[{k}]) > 0 THEN {_q(label)} END" for k, (label, _) in enumerate(PHRASES, 1))
    return f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
    b AS (SELECT doc_id, list_filter(regexp_split_to_array(t, {gap}), lambda x: x <> '') AS w FROM d),
    p AS (SELECT doc_id, w, [{places}] AS p FROM b),
    q AS (SELECT doc_id, len(w) AS n_words, flatten(p) AS f, list_sort(list_filter([{labels}], lambda x: x IS NOT NULL)) AS bl FROM p),
    l AS (SELECT doc_id, k, list_distinct(list_filter(regexp_split_to_array(ls[k], {gap}), lambda x: x <> '')) AS w FROM (SELECT doc_id, string_split(t, chr(10)) AS ls, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS k FROM d)),
    t AS (SELECT * FROM (VALUES {templates}) AS v(label, tw, must, barred)),
    h AS (SELECT doc_id, k, label, len(list_intersect(w, tw)) / len(tw) AS s FROM l, t WHERE list_has_all(w, must) AND NOT list_has_any(w, barred) AND len(list_intersect(w, tw)) >= ceil(round({CONTAINMENT} * len(tw), 3))),
    m AS (SELECT *, max(s) OVER (PARTITION BY doc_id, k) AS top FROM h),
    n AS (SELECT doc_id, list(DISTINCT label) AS nl, max(s) AS s FROM m WHERE s = top GROUP BY doc_id)
    SELECT doc_id, n_words, len(f) AS n_base, list_min(f) - 1 AS first_word, list_max(f) - 1 AS last_word, array_to_string(bl, ',') AS base_labels,
      array_to_string(list_sort(list_distinct(list_concat(bl, coalesce(nl, []::VARCHAR[])))), ',') AS labels, CASE WHEN len(f) > 0 THEN 1.0 ELSE coalesce(s, 0.0) END::DOUBLE AS score
    FROM q LEFT JOIN n USING (doc_id)"""


def _mixing() -> str:
    passes, last = "", "r0"
    for k in range(1, _PASSES + 1):
        passes += f""",
    o{k} AS MATERIALIZED (SELECT doc_id, position, size, key, sum(size) OVER (PARTITION BY position ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto, gap FROM {last} WHERE NOT sel AND size > 0 AND size <= gap),
    s{k} AS MATERIALIZED (SELECT r.* EXCLUDE (sel, gap), r.sel OR coalesce(o.upto <= o.gap, false) AS sel FROM {last} r LEFT JOIN o{k} o ON o.doc_id = r.doc_id),
    r{k} AS MATERIALIZED (SELECT *, target - epochs * source_size - sum(CASE WHEN sel THEN size ELSE 0 END) OVER (PARTITION BY position) AS gap FROM s{k})"""
        last = f"r{k}"
    return rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    k AS (SELECT doc_id, source, size, (CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(t)), 1, 13) AS BIGINT) + 1) / 4503599627370496::DOUBLE AS u,
      greatest(0.05::DOUBLE, CASE WHEN size > 0 THEN 1::DOUBLE - (len(t) - len(translate(t, '#*$%&|<>', ''))) / size::DOUBLE ELSE 1::DOUBLE END) AS w FROM d),
    z AS (SELECT doc_id, source, size, -ln(u) / w AS key FROM k),
    a AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS position FROM z GROUP BY source),
    b AS (SELECT *, {list(WEIGHTS)}[position % {len(WEIGHTS)} + 1]::DOUBLE AS weight, source_size * {MOST}::DOUBLE AS cap FROM a),
    c AS (SELECT *, cap / weight AS ratio FROM b),
    e AS (SELECT *, (sum(source_size) OVER () * {SHARE}::DOUBLE - coalesce(sum(cap) OVER g, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER g, 0)) AS level FROM c WINDOW g AS (ORDER BY ratio, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT source, position, source_size, CASE WHEN (SELECT count(*) FROM e WHERE ratio > level) = 0 OR ratio <= level THEN cap ELSE weight * (SELECT level FROM e WHERE ratio > level ORDER BY ratio, position LIMIT 1) END AS target FROM e),
    r0 AS (SELECT z.doc_id, z.size, z.key, position, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs, false AS sel, target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS gap FROM z JOIN f ON z.source IS NOT DISTINCT FROM f.source){passes}
    SELECT doc_id, size, source_size, target, ((epochs + CASE WHEN sel THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM {last}"""


def _decontamination() -> str:
    """The same windows as strings instead of hashes, and the same comparison word by word."""
    num, name, unit = "\ue000", "\ue001", "\ue002"
    # without look-around: a number may not touch a letter, so runs of letters and digits are matched with the points and commas after digits
    split = r"regexp_extract_all(coalesce({t}, ''), '[\p{{L}}\p{{N}}]+(?:[.,]\d+)*')"
    word = "flatten(list_transform({w}, lambda x: CASE WHEN regexp_full_match(x, '\\d+(?:[.,]\\d+)*') THEN [x] ELSE regexp_extract_all(x, '[\\p{{L}}\\p{{N}}]+') END))"
    units = _list(UNITS)

    def canon(x: str) -> str:
        return f"CASE WHEN {x}[1] BETWEEN '0' AND '9' THEN '{num}' WHEN list_contains({units}, lower({x})) THEN '{unit}' WHEN lower({x}[1]) <> {x}[1] THEN '{name}' ELSE lower({x}) END"

    def tokens(t: str) -> str:
        return word.format(w=split.format(t=t))

    forms = f"list_transform(w, lambda x: lower(x)) AS lo, list_transform(w, lambda x: {canon('x')}) AS ki"
    slot = f"x BETWEEN '{num}' AND '{unit}'"
    return f"""WITH i0 AS (SELECT item_id, {tokens('text')} AS w FROM benchmark), i AS (SELECT item_id, w AS iw, len(w) AS n, least(len(w), {PIECE}) AS k, {forms} FROM i0 WHERE len(w) > 0),
    ip AS (SELECT *, unnest(range(1, n - k + 2)) AS p FROM i),
    ik AS (SELECT DISTINCT item_id, n, k, p, key FROM (SELECT item_id, n, k, p, array_to_string(lo[p : p + k - 1], ' ') AS key FROM ip UNION ALL
      SELECT item_id, n, k, p, array_to_string(ki[p : p + k - 1], ' ') AS key FROM ip WHERE n >= {SHORT} AND len(list_filter(ki[p : p + k - 1], lambda x: NOT ({slot}))) >= {PLAIN})),
    d0 AS (SELECT doc_id, {tokens('text')} AS w FROM documents), d AS MATERIALIZED (SELECT doc_id, w, {forms} FROM d0),
    dp AS (SELECT doc_id, lo, ki, k, unnest(range(1, len(lo) - k + 2)) AS q FROM d, (SELECT DISTINCT k FROM i)),
    dk AS (SELECT DISTINCT doc_id, k, q, key FROM (SELECT doc_id, k, q, array_to_string(lo[q : q + k - 1], ' ') AS key FROM dp UNION ALL SELECT doc_id, k, q, array_to_string(ki[q : q + k - 1], ' ') AS key FROM dp)),
    h AS (SELECT DISTINCT doc_id, item_id, n, k, p, q - p AS off FROM ik JOIN dk USING (k, key)),
    b AS (SELECT *, f, floor((off + f * {DRIFT}) / {2 * DRIFT}::DOUBLE) AS band FROM h, (VALUES (0), (1)) AS v(f)),
    g AS (SELECT DISTINCT doc_id, item_id, list_sort(list(DISTINCT off)) AS offs FROM b GROUP BY doc_id, item_id, f, band
      HAVING len(list_distinct(flatten(list(range(p, p + k))))) >= {PROMISING} * any_value(n)),
    m AS (SELECT doc_id, item_id, n, list_transform(range(1, n + 1), lambda p: struct_pack(item := lower(iw[p]), kind := i.ki[p], name := lower(iw[list_max(list_filter(range(1, p + 1), lambda j: NOT (i.ki[j] = '{name}' AND j > 1 AND i.ki[j - 1] = '{name}')))]),
      same := len(list_filter(offs, lambda o: p + o > 0 AND lower(w[p + o]) = lower(iw[p]))) > 0,
      slot := lower(w[p + list_filter(offs, lambda o: p + o > 0 AND {canon('w[p + o]')} = i.ki[p] AND i.ki[p] BETWEEN '{num}' AND '{unit}')[1]]))) AS m FROM g JOIN i USING (item_id) JOIN d USING (doc_id)),
    s AS (SELECT doc_id, item_id, n, list_transform(m, lambda x: struct_pack(item := x.item, kind := x.kind, name := x.name, doc := CASE WHEN x.same THEN x.item ELSE x.slot END)) AS m FROM m),
    t AS (SELECT doc_id, item_id, n, len(list_filter(m, lambda x: coalesce(x.item = x.doc, false))) AS same, len(list_filter(m, lambda x: x.doc IS NOT NULL)) AS met,
      list_distinct(list_filter(m, lambda x: x.doc IS NOT NULL AND x.kind BETWEEN '{num}' AND '{unit}' AND (x.kind <> '{name}' OR x.item <> x.doc))) AS slots FROM s),
    c AS (SELECT doc_id, item_id, n, (CASE WHEN n >= {SHORT} AND same >= {SAME} * n AND len(list_distinct(list_transform(slots, lambda x: x.item))) = len(list_distinct(list_transform(slots, lambda x: [x.item, x.doc])))
      AND len(list_distinct(list_transform(list_filter(slots, lambda x: x.kind = '{name}'), lambda x: x.doc))) = len(list_distinct(list_transform(list_filter(slots, lambda x: x.kind = '{name}'), lambda x: [x.name, x.doc]))) THEN met ELSE same END) / n::DOUBLE AS coverage FROM t),
    f AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items, max(coverage) AS coverage FROM c WHERE coverage >= CASE WHEN n < {SHORT} THEN 1.0 ELSE {THRESHOLD} END GROUP BY doc_id)
    SELECT doc_id, coalesce(len(items), 0) AS n_items, coalesce(array_to_string(items, ','), '') AS items, coalesce(coverage, 0.0)::DOUBLE AS coverage, items IS NOT NULL AS contaminated FROM documents LEFT JOIN f USING (doc_id)"""


#: The table holds no tool calls, so its rows are messages in the order of their turns.
_MESSAGES = "SELECT conv_id, turn, 0 AS idx, 'message' AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, NULL::BIGINT AS call_turn, 'ok' AS status, to_json({'content': coalesce(text, ''), 'role': role})::VARCHAR AS json FROM conversations"

ORACLES: dict[str, str] = {"op1_tool_call_linking": _MESSAGES, "op2_license_scan": _licenses(), "op6_mixing_sources": _mixing(), "op9_benchmark_decontamination": _decontamination()} | oracles_more.ORACLES
