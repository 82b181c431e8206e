"""DuckDB SQL of near-duplicates by five-word shingles, of repaired conversations and of vector codes, by plain definitions."""

from __future__ import annotations

from .chosen import PERCENT
from .codes import ENTRIES, PARTS, ROUNDS, SCALE

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"'[^\x20\x09-\x0D]+'"

#: Every pair of sets with a common shingle is counted; components are reachability.
NEAR = f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
u AS MATERIALIZED (SELECT s, min(r) AS u, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
e AS MATERIALIZED (SELECT u, n, unnest(s) AS x FROM u),
f AS MATERIALIZED (SELECT a.u AS a, b.u AS b FROM e AS a JOIN e AS b USING (x) WHERE a.u <> b.u GROUP BY a.u, b.u, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
c(a, b) AS (SELECT u, u FROM u UNION SELECT c.a, f.b FROM c JOIN f ON f.a = c.b),
g AS (SELECT a, min(b) AS g FROM c GROUP BY a),
d AS (SELECT s.doc_id, len(s.s) AS n, g.g FROM s LEFT JOIN u ON u.s = s.s LEFT JOIN g ON g.a = u.u),
m AS (SELECT g, min(doc_id) AS m FROM d WHERE g IS NOT NULL GROUP BY g)
SELECT doc_id, n AS n_shingles, CASE WHEN n > 0 THEN m ELSE doc_id END AS component_id, doc_id IS NOT DISTINCT FROM CASE WHEN n > 0 THEN m ELSE doc_id END AS kept
FROM d LEFT JOIN m USING (g)"""


def _best(*cases: tuple[str, str, str]) -> str:
    """The least {c, a} of paths: (when, from, step) with the step's letter and cost."""
    each = ", ".join(f"CASE WHEN {when} AND {of} IS NOT NULL THEN {{'c': {of}.c + {cost}, 'a': {of}.a || '{letter}'}} END" for when, of, letter, cost in cases)
    return f"list_min(list_filter([{each}], lambda p: p IS NOT NULL))"


def _inserted(s: str, y: str, u: str, a: str) -> str:
    """The four states (start s, after system y, after user u, after assistant a) once turns may have been put in; two in a row suffice,
    as a third ends in a state that one fewer has."""
    t = "true"
    u1 = f"list_min(list_filter([{u}, {_best((t, s, 'I', 2), (t, y, 'I', 2), (t, a, 'I', 2))}], lambda p: p IS NOT NULL))"
    a1 = f"list_min(list_filter([{a}, {_best((t, u, 'I', 2))}], lambda p: p IS NOT NULL))"
    return u1, a1


def _repair() -> str:
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda r, b: xor(r >> 8, t[(xor(r, b) & 255) + 1]))"
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    table = "n"
    for _ in range(8):
        table = f"(SELECT {bit} FROM (SELECT {table} AS x))"
    keep = {"s": "i = 's'", "u": "i = 'u'", "a": "i = 'a'"}
    stay = "NOT go"
    step = {  # before turns are put in: by deleting, re-roling and keeping the row
        "s": _best(("true", "q.s", "D", 3)),
        "y": _best(("true", "q.y", "D", 3), (f"{stay} AND {keep['s']}", "q.s", "K", "x")),
        "u": _best(("true", "q.u", "D", 3), *[(stay, f"q.{o}", "R", "2 + x") for o in "sya"], *[(f"{stay} AND {keep['u']}", f"q.{o}", "K", "x") for o in "sya"]),
        "a": _best(("true", "q.a", "D", 3), (stay, "q.u", "R", "2 + x"), (f"{stay} AND {keep['a']}", "q.u", "K", "x")),
    }
    u1, a1 = _inserted("s", "y", "u", "a")
    u2, a2 = _inserted("s", "y", "u1", "a1")
    return rf"""WITH RECURSIVE n AS (SELECT list(t ORDER BY n) AS t FROM (SELECT n, {table} AS t FROM (SELECT unnest(generate_series(0::BIGINT, 255::BIGINT)) AS n))),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
c AS MATERIALIZED (SELECT o.*, xor({crc}, 4294967295) % 20 AS way FROM o, n),
d AS (SELECT conv_id, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE way WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE way <> 0),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS r FROM d),
m AS (SELECT *, right(rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 1) AS z, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) AS nth FROM r),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, r, left(role, 1) AS i, CASE WHEN z = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN z NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM m),
l AS MATERIALIZED (SELECT *, fault IN ('blank', 'duplicate') AS go, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS x, lag(i) OVER (PARTITION BY conv_id ORDER BY r) || i AS two, count(*) OVER (PARTITION BY conv_id) AS n FROM f),
q AS (SELECT conv_id, 0::BIGINT AS r, {{'c': 0::BIGINT, 'a': ''}} AS s, NULL::STRUCT(c BIGINT, a VARCHAR) AS y, {{'c': 2::BIGINT, 'a': 'I'}} AS u, {{'c': 4::BIGINT, 'a': 'II'}} AS a FROM (SELECT DISTINCT conv_id FROM l)
  UNION ALL SELECT conv_id, r, s, y, {u2} AS u, {a2} AS a FROM (SELECT *, {u1} AS u1, {a1} AS a1 FROM (
    SELECT l.conv_id, l.r, {step['s']} AS s, {step['y']} AS y, {step['u']} AS u, {step['a']} AS a FROM q JOIN l ON l.conv_id IS NOT DISTINCT FROM q.conv_id AND l.r = q.r + 1))),
b AS MATERIALIZED (SELECT q.conv_id, list_min(list_filter([q.s, q.a], lambda p: p IS NOT NULL)) AS b FROM q JOIN (SELECT conv_id, max(r) AS r FROM q GROUP BY conv_id) AS e ON e.conv_id IS NOT DISTINCT FROM q.conv_id AND e.r = q.r),
p AS (SELECT conv_id, len(left(b.a, k)) AS k, b.a[k] AS op, len(replace(left(b.a, k), 'I', '')) AS r, len(replace(left(b.a, k), 'D', '')) AS nth FROM (SELECT *, unnest(range(1, len(b.a) + 1)) AS k FROM b)),
t AS (SELECT p.conv_id, p.k, p.nth, p.op, CASE WHEN p.op <> 'I' THEN l.role END AS role, CASE WHEN p.op = 'I' THEN '' ELSE l.text END AS text FROM p LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.r = p.r WHERE p.op <> 'D'),
v AS (SELECT *, max(CASE WHEN nth = 1 AND op = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS y FROM t),
h AS (SELECT conv_id, sha256(string_agg(CASE op WHEN 'K' THEN role ELSE CASE WHEN (nth - y) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || text, chr(10) ORDER BY k)) AS sha FROM v GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two IS NOT NULL AND two NOT IN ('su', 'ua', 'au')) AS illegal FROM l GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b.b.c, 0)::BIGINT AS cost, coalesce(b.b.a, '') AS audit, coalesce(h.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM o.conv_id"""


def _codes() -> str:
    """Each round compares all vectors with all entries in integers."""
    distance = "list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = lambda k: f"""a{k} AS MATERIALIZED (SELECT v.r, v.p, min({{'d': {distance}, 'e': b.e}}) AS m FROM v JOIN b{k} AS b USING (p) GROUP BY v.r, v.p)"""
    rounds = []
    for k in range(ROUNDS):
        rounds += [near(k), f"""s{k} AS (SELECT p, a.m.e AS e, i, (sum(v.x[i]) // count(*) - CASE WHEN sum(v.x[i]) % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT AS c FROM (SELECT r, p, x, unnest(range(1, len(x) + 1)) AS i FROM v) AS v JOIN a{k} AS a USING (r, p) GROUP BY p, a.m.e, i)""",
            f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(s.x, b.x) AS x FROM b{k} AS b LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS x FROM s{k} GROUP BY p, e) AS s USING (p, e))"]
    return f"""WITH o AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, x) AS r, vec_id, label, x FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM o)),
v AS MATERIALIZED (SELECT r, p, x[p * (len(x) // {PARTS}) + 1 : (p + 1) * (len(x) // {PARTS})] AS x FROM w, (SELECT unnest(range({PARTS})) AS p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM v WHERE r <= {ENTRIES}),
{', '.join(rounds)},
{near(ROUNDS)},
g AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS sha FROM b{ROUNDS}),
c AS (SELECT r, string_agg(printf('%02x', (m.e)::INT), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM c JOIN w USING (r), g"""


ORACLES = {"op11_minhash_near_dedup": NEAR, "op12_conversation_repair": _repair(), "op13_vector_codes": _codes()}
