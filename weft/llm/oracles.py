"""SQL that gives the rows of those queries which SQL expresses. Patterns are written without look-around: matches are the
leftmost non-overlapping ones of the plain patterns, and their offsets come from the lengths of matches and of the gaps between them."""

from __future__ import annotations

from . import licenses, pii, secrets

_DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)"
_LOWER = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _found(kind: str, rank: int, pattern: str, keep: str, group: int = 0, of: str = "d") -> str:
    """Rows (doc_id, rank, kind, a, b, m) of the matches that ``keep`` holds for; g is the group's text."""
    p = _quoted(pattern)
    lists = f"SELECT doc_id, regexp_extract_all(x, {p}) AS ms, regexp_extract_all(x, {p}, {group}) AS vs, list_transform(string_split_regex(x, {p}), lambda g: length(g)) AS gaps FROM {of} WHERE regexp_matches(x, {p})"
    ends = f"SELECT doc_id, ms, vs, unnest(range(1, len(ms) + 1)) AS i, gaps, list_transform(ms, lambda m: length(m)) AS sizes FROM ({lists})"
    at = "CAST(list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) AS BIGINT)"
    return f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, a, a + length(m) AS b, m FROM (SELECT doc_id, {at} AS a, ms[i] AS m, vs[i] AS g FROM ({ends})) WHERE {keep}"


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def op1() -> str:
    assign = "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    rules = [("assign", assign, "length(g) >= 12", 2), ("access", secrets._ACCESS.pattern, "length(m) >= 18", 0), ("hex", secrets._HEX.pattern, "true", 0)]
    rules += [(kind, rule.pattern, "true", 0) for kind, _, rule in secrets._MORE]
    spans = " UNION ALL ".join(_found(kind, secrets.KINDS.index(kind), pattern, keep, group) for kind, pattern, keep, group in rules)
    told = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank, b) {where}, '')"
    counts = ", ".join(f"count(*) FILTER (rank = {k}) AS n_{kind}" for k, kind in enumerate(secrets.BASE))
    per = f"SELECT doc_id, {counts}, sha256({told.format(where='FILTER (rank < 3)')}) AS base_sha256, {told.format(where='')} AS spans FROM s GROUP BY doc_id"
    empty = "sha256('')"
    return f"WITH {_DOCS}, s AS ({spans}), p AS ({per}) SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in secrets.BASE)}, coalesce(base_sha256, {empty}) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN p ON p.doc_id = d.doc_id"


def op3() -> str:
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    octet = "regexp_full_match(o, '0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])')"
    at = f"CAST(substr(reverse({digits}), i, 1) AS INT)"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {at} WHEN {at} > 4 THEN 2 * {at} - 9 ELSE 2 * {at} END)) % 10 = 0"
    rules = [
        ("email", email, "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", f"len(list_filter(string_split(m, '.'), lambda o: NOT {octet})) = 0"),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"length({digits}) BETWEEN 16 AND 19 AND {luhn}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 8 AND 15"),
    ]
    base = " UNION ALL ".join(_found(kind, k, pattern, keep) for k, (kind, pattern, keep) in enumerate(rules))
    value = f"kind || ':' || CASE kind WHEN 'email' THEN lower(m) WHEN 'ip' THEN m ELSE {digits} END"
    words = _found("word", 0, r"\p{L}+", f"length(m) >= {pii.SHORTEST}", of="h")
    told = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY rank, a), '')"
    return rf"""WITH {_DOCS}, s AS ({base}), h AS (SELECT * FROM d WHERE doc_id IN (SELECT doc_id FROM s)), total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d),
t AS (SELECT DISTINCT doc_id, lower(w) AS term FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(x, {_quoted(email)}, ' ', 'g'), '\p{{L}}+')) AS w FROM d) WHERE length(w) >= {pii.SHORTEST}),
nt AS (SELECT term, count(*) AS n_t FROM t GROUP BY term),
e AS (SELECT DISTINCT doc_id, {value} AS entity FROM s),
g AS (SELECT entity, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS grp, count(*) AS n_e FROM e GROUP BY entity),
o AS (SELECT DISTINCT doc_id, grp, n_e FROM e JOIN g USING (entity)),
r AS (SELECT o.doc_id, grp, n_e, term FROM o JOIN t USING (doc_id)),
c AS (SELECT grp, n_e, term, count(*) AS n_et FROM r GROUP BY ALL),
b AS (SELECT grp, term, ln(n * n_et / (n_e * n_t)) AS bits, ln(n / n_e) AS of_e, ln(n / n_et) AS of_et FROM c JOIN nt USING (term), total WHERE n_e < n),
v AS (SELECT grp, term, least(bits / of_e, bits / of_et) >= {pii.REMOVE} AS removed FROM b WHERE bits / of_e >= {pii.GENERALISE}),
k AS (SELECT doc_id, term, bool_or(removed) AS removed FROM r JOIN v USING (grp, term) GROUP BY ALL),
w AS ({words}),
m AS (SELECT w.doc_id, CASE WHEN removed THEN 4 ELSE 5 END AS rank, CASE WHEN removed THEN 'remove' ELSE 'generalise' END AS kind, a, b, m FROM w JOIN k ON k.doc_id = w.doc_id AND k.term = lower(w.m)),
u AS (SELECT * FROM s UNION ALL SELECT * FROM m),
p AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{x}') AS n_{x}" for x in pii.KINDS)}, sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY rank, a) FILTER (rank < 4), '')) AS base_sha256, {told} AS spans FROM u GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{x}, 0) AS n_{x}' for x in pii.KINDS)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN p ON p.doc_id = d.doc_id"""


def op4() -> str:
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
r AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_ FROM r a JOIN r b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * both_ >= 80 * (na + nb - both_)),
c AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce((SELECT min(b) FROM c WHERE c.a = s.doc_id), s.doc_id)) AS component_id FROM s"""


def op6() -> str:
    k = licenses.K
    texts = ", ".join(f"({n}, '{label}', '{text}', {licenses.needed(len(text.split()))})" for n, (label, text) in enumerate(licenses.TEMPLATES))
    grams = f"list_transform(range(1, len(w) - {k - 1} + 1), lambda i: array_to_string(w[i:i + {k - 1}], ' '))"
    places = ", ".join(
        f"list_filter(range(0, len(w) - {len(phrase) - 1}), lambda i: {' AND '.join(f'w[i + {j + 1}] = {_quoted(x)}' for j, x in enumerate(phrase))}) AS p{n}" for n, (phrase, _) in enumerate(licenses.PHRASES)
    )
    every = f"list_concat({', '.join(f'p{n}' for n in range(len(licenses.PHRASES)))})"
    base = f"list_sort(list_filter([{', '.join(f'CASE WHEN len(p{n}) > 0 THEN {_quoted(label)} END' for n, (_, label) in enumerate(licenses.PHRASES))}], lambda x: x IS NOT NULL))"
    return rf"""WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t0 AS (SELECT n, label, string_split(t, ' ') AS w, needed FROM (VALUES {texts}) v(n, label, t, needed)), t AS (SELECT n AS template, label, needed, len(w) - {k - 1} AS n_grams, unnest({grams}) AS gram, unnest(range(0, len(w) - {k - 1})) AS tpos FROM t0),
g AS (SELECT doc_id, unnest({grams}) AS gram, unnest(range(0, len(w) - {k - 1})) AS pos FROM w WHERE len(w) >= {k}),
h AS (SELECT doc_id, template, label, needed, n_grams, pos, tpos, pos - tpos AS diagonal FROM g JOIN t USING (gram)),
f AS (SELECT doc_id, template, diagonal, CASE WHEN diagonal - lag(diagonal) OVER o <= {licenses.GAP} THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT doc_id, template, diagonal FROM h) WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
q AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS part FROM f),
m AS (SELECT doc_id, label, count(DISTINCT tpos) / CAST(any_value(n_grams) AS DOUBLE) AS score FROM h JOIN q USING (doc_id, template, diagonal) GROUP BY doc_id, template, label, part HAVING count(DISTINCT tpos) >= any_value(needed)),
x AS (SELECT doc_id, list(DISTINCT label) AS more, max(score) AS score FROM m GROUP BY doc_id),
b AS (SELECT doc_id, len(w) AS n_words, {places} FROM w)
SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len({every}) AS BIGINT) AS n_base, list_min({every}) AS first_word, list_max({every}) AS last_word, array_to_string({base}, ',') AS base_labels,
array_to_string(list_sort(list_distinct(list_concat({base}, coalesce(more, [])))), ',') AS labels, coalesce(score, 0) AS score FROM b LEFT JOIN x ON x.doc_id = b.doc_id"""
