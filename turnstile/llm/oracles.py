"""DuckDB SQL of the operators on documents whose results SQL can express in
full: it goes by definitions (windows, sets, spans), not by the operators'
methods."""

from __future__ import annotations

from turnstile.llm.decontaminate import WINDOW
from turnstile.llm.secrets import BASE, CANDIDATES, KINDS, MAX_OWNERS, MAX_REPOSITORIES

#: Where the operator's pattern is not one of DuckDB's: letters of either case
#: spelled out (its ``(?i)`` folds letters outside ASCII too), and maximal runs
#: whose digit and letter are looked for afterwards.
PATTERNS = {
    "assign": "(" + "|".join(
        "".join("_?" if c == "_" else f"[{c.upper()}{c}]" for c in word)
        for word in ("password", "passwd", "secret", "token", "api_key"))
    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "opaque": "([A-Za-z0-9+/_=-]{20,})",
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Each window of an item is looked up among the documents' word sequences of its length.
OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
own AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[k:k + least(len(w), {WINDOW}) - 1], ' ') AS win
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 2))) AS k FROM i WHERE len(w) > 0)),
seen AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
         FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k
               FROM d, (SELECT DISTINCT n FROM own) WHERE len(w) >= n)),
hit AS (SELECT seen.r, seen.k, seen.n, own.item_id FROM seen JOIN own ON seen.n = own.n AND seen.win = own.win),
words AS (SELECT r, count(DISTINCT p) AS n_hit
          FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.r = d.r LEFT JOIN items ON items.r = d.r
"""

#: Two sets that reach the threshold share one of the rarest 15 % (and one) of either's shingles;
#: the pairs that do are compared on the whole sets.
OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')) END)) AS s FROM d),
c AS (SELECT min(doc_id) AS node, s, len(s) AS n FROM t WHERE len(s) > 0 GROUP BY s),
e AS (SELECT node, n, unnest(s) AS x FROM c),
f AS (SELECT node, n, x, row_number() OVER (PARTITION BY node ORDER BY often, x) AS k
      FROM (SELECT *, count(*) OVER (PARTITION BY x) AS often FROM e)),
p AS (SELECT node, x FROM f WHERE k <= n - ceil(0.85 * n) + 1),
pair AS (SELECT DISTINCT a.node AS a, b.node AS b FROM p a JOIN p b ON a.x = b.x AND a.node < b.node),
common AS (SELECT pair.a, pair.b, x.n AS na, y.n AS nb, len(list_intersect(x.s, y.s)) AS m
           FROM pair JOIN c x ON x.node = pair.a JOIN c y ON y.node = pair.b
           WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)),
link AS (SELECT a, b FROM common WHERE 100 * m >= 85 * (na + nb - m)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT node AS start, node AS other FROM c
          UNION SELECT reach.start, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other),
root AS (SELECT start, min(other) AS root FROM reach GROUP BY start)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, coalesce(root.root, t.doc_id) AS component_id,
       coalesce(root.root, t.doc_id) = t.doc_id AS kept
FROM t LEFT JOIN c ON c.s = t.s LEFT JOIN root ON root.start = c.node
"""


def _matches(kind: int, name: str, pattern: str, group: int) -> str:
    p = "'" + PATTERNS.get(name, pattern).replace("'", "''") + "'"
    return (f"SELECT r, {kind} AS kind, regexp_extract_all(t, {p}, 0) AS w, regexp_extract_all(t, {p}, {group}) AS v, "
            f"string_split_regex(t, {p}) AS gap FROM d WHERE regexp_matches(t, {p})")


_MATCHES = " UNION ALL ".join(_matches(i, name, p, g) for i, (name, p, g, _) in enumerate(BASE + CANDIDATES))
_LEAST = " ".join(f"WHEN {i} THEN {n}" for i, (*_, n) in enumerate(BASE + CANDIDATES))
_NAMES = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_LIST = f"string_agg({_NAMES}[kind + 1] || ':' || start || ':' || fin, ',' ORDER BY start, kind)"

OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS owner, coalesce(CAST(doc_id AS VARCHAR), '') AS repository, coalesce(text, '') AS t FROM documents),
m AS ({_MATCHES}),
x AS (SELECT r, kind, unnest(w) AS w, unnest(v) AS v, unnest(gap[1:len(w)]) AS gap, generate_subscripts(w, 1) AS j FROM m),
y AS (SELECT r, kind, v, length(w) AS size,
             CAST(sum(length(gap) + length(w)) OVER (PARTITION BY r, kind ORDER BY j) AS BIGINT) AS fin FROM x),
s AS (SELECT y.r, y.kind, y.v, y.fin - y.size AS start, y.fin, d.owner, d.repository FROM y JOIN d ON d.r = y.r
      WHERE length(y.v) >= CASE y.kind {_LEAST} END
        AND (y.kind <> {KINDS.index('opaque')} OR (regexp_matches(y.v, '[0-9]') AND regexp_matches(y.v, '[A-Za-z]')))),
held AS (SELECT * FROM s WHERE kind < {len(BASE)}
         UNION ALL SELECT * FROM s c WHERE kind >= {len(BASE)} AND NOT EXISTS (
           SELECT 1 FROM s b WHERE b.kind < {len(BASE)} AND b.r = c.r AND b.start < c.fin AND c.start < b.fin)),
owners AS (SELECT v, count(DISTINCT owner) <= {MAX_OWNERS}
             AND count(DISTINCT (owner, repository)) <= {MAX_REPOSITORIES} AS live FROM held GROUP BY v),
judged AS (SELECT held.*, live FROM held JOIN owners ON owners.v = held.v WHERE live OR kind < {len(BASE)})
SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
       count(*) FILTER (WHERE kind = 2) AS n_hex,
       sha256(coalesce({_LIST} FILTER (WHERE kind < {len(BASE)}), '')) AS base_sha256, coalesce({_LIST}, '') AS spans,
       count(*) FILTER (WHERE live) AS n_live
FROM d LEFT JOIN judged ON judged.r = d.r GROUP BY d.r, d.doc_id
"""
