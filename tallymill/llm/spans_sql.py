"""The span operators as DuckDB SQL, to check the queries by: patterns without
possessive loops, places by list arithmetic, windows by joins."""

from __future__ import annotations

from . import pii, secrets


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def places(source: str, patterns: list[tuple[str, int, str, int]]) -> str:
    """(rid, kind, rank, start, end, value, part) of every match in source."""
    parts = []
    for kind, rank, pattern, group in patterns:
        p = _quoted(pattern)
        parts.append(
            f"SELECT rid, {_quoted(kind)} AS kind, {rank} AS rank, regexp_extract_all(text, {p}, 0) AS ms, regexp_extract_all(text, {p}, {group}) AS ps, "
            f"list_transform(string_split_regex(text, {p}), lambda x: length(x)) AS gs FROM {source} WHERE regexp_matches(text, {p})"
        )
    return f"""
SELECT rid, kind, rank, place AS start, place + length(ms[i]) AS "end", ms[i] AS value, ps[i] AS part
FROM (
  SELECT *, unnest(range(1, len(ms) + 1)) AS i, unnest(list_transform(range(1, len(ms) + 1), lambda k: list_sum(gs[1:k]) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0)))::BIGINT AS place
  FROM ({' UNION ALL '.join(parts)})
)"""


def _list(source: str, order: str, where: str = "TRUE", value: str = "kind || ':' || start || ':' || \"end\"") -> str:
    return f"SELECT rid, string_agg({value}, ',' ORDER BY {order}) AS s FROM {source} WHERE {where} GROUP BY rid"


def _counts(kinds: tuple[str, ...]) -> str:
    return ", ".join(f"(SELECT count(*) FROM base b WHERE b.rid = d.rid AND kind = '{k}') AS n_{k}" for k in kinds)


def secrets_sql(rule: secrets.Entropy = secrets.Entropy()) -> str:
    w = rule.window
    need = "CASE " + " ".join(f"WHEN regexp_matches(value, {_quoted(p)}) THEN {b}" for _, p, b in rule.classes) + " END"
    harmless = " OR ".join(f"regexp_matches(value, {_quoted(p)})" for p in rule.allowed)
    kinds = [("assign", 0, secrets.ASSIGN, 2), ("access", 1, "AKIA[A-Z0-9]+", 0), ("hex", 2, "[0-9a-f]{32,}", 0), ("entropy", 3, f"[A-Za-z0-9+/_=-]{{{w},}}", 0)]
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS MATERIALIZED ({places('d', kinds)}),
base AS (SELECT * FROM s WHERE kind = 'hex' OR (kind = 'access' AND length(value) >= 16) OR (kind = 'assign' AND length(part) >= 8)),
c AS (SELECT *, {need} AS need FROM s WHERE kind = 'entropy' AND NOT ({harmless})),
w AS (SELECT rid, start, p, unnest(string_split(substr(value, p::INTEGER, {w}), '')) AS ch FROM c, unnest(range(1, length(value) - {w} + 2)) AS t(p)),
h AS (
  SELECT rid, start, max(bits) AS bits FROM (
    SELECT rid, start, p, -sum(k / {w}.0 * log2(k / {w}.0)) AS bits FROM (SELECT rid, start, p, ch, count(*) AS k FROM w GROUP BY ALL) GROUP BY ALL
  ) GROUP BY ALL
),
found AS (SELECT * FROM base UNION ALL SELECT c.* EXCLUDE need FROM c JOIN h USING (rid, start) WHERE round(bits, 9) >= need),
b AS ({_list('base', 'start, rank')}), f AS ({_list('found', 'start, rank')})
SELECT doc_id, {_counts(secrets.KINDS[:3])}, sha256(coalesce(b.s, '')) AS base_sha256, coalesce(f.s, '') AS spans
FROM d LEFT JOIN b USING (rid) LEFT JOIN f USING (rid)
"""


def pii_sql() -> str:
    kinds = [
        ("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0), ("ip", 1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", 0), ("card", 2, r"[0-9](?:[\x20-]?[0-9])+", 0),
        ("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", 0), ("head", 4, r"\b[A-Z]{2}[0-9]{2}", 0), ("ssn", 5, r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0),
    ]
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    twice = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 1 THEN 2 * {digits}[i]::INTEGER // 10 + 2 * {digits}[i]::INTEGER % 10 ELSE {digits}[i]::INTEGER END))"
    turned = "plain[5:] || plain[:4]"
    coded = f"list_transform(string_split({turned}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::BIGINT ELSE ascii(c) - 55 END)"
    mod97 = f"list_reduce(list_prepend(0::BIGINT, {coded}), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97)"
    lengths = "CASE substr(plain, 1, 2) " + " ".join(f"WHEN '{c}' THEN {n}" for n, names in pii.IBAN_LENGTHS.items() for c in names.split()) + " END"
    scores = "CASE kind " + " ".join(
        f"WHEN '{k}' THEN {v} + CASE WHEN regexp_matches(around, '\\b(?:{more})') THEN {pii.RAISE} ELSE 0 END - CASE WHEN regexp_matches(around, '\\b(?:{less})') THEN {pii.LOWER} ELSE 0 END" for k, (v, more, less) in pii.CONTEXT.items()
    ) + " END"
    n = pii.NEARBY
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS MATERIALIZED ({places('d', kinds)}),
base AS MATERIALIZED (
  SELECT * FROM s WHERE kind = 'email'
    OR (kind = 'ip' AND list_bool_and(list_transform(string_split(value, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND (('0' || ltrim(x, '0'))[:4])::INTEGER <= 255)))
    OR (kind = 'card' AND length({digits}) BETWEEN 16 AND 19 AND {twice} % 10 = 0)
    OR (kind = 'phone' AND length({digits}) BETWEEN 8 AND 15)
),
run AS (SELECT rid, start, string_split(regexp_extract(substr(text, start + 1), '^[A-Z]{{2}}[0-9]{{2}}(?:\\x20?[A-Z0-9]){{11,30}}\\b', 0), ' ') AS ws FROM s JOIN d USING (rid) WHERE kind = 'head'),
part AS (SELECT rid, start, v, replace(v, ' ', '') AS plain FROM (SELECT rid, start, array_to_string(ws[1:unnest(range(1, len(ws) + 1))], ' ') AS v FROM run)),
iban AS (
  SELECT rid, 'iban' AS kind, 4 AS rank, start, start + length(v) AS "end", v AS value, v AS part FROM part
  WHERE length(plain) >= 15 AND {mod97} = 1 QUALIFY row_number() OVER (PARTITION BY rid, start ORDER BY coalesce(length(plain) = {lengths}, false) DESC, length(v) DESC) = 1
),
more AS (
  SELECT * FROM iban i WHERE NOT EXISTS (SELECT 1 FROM iban o WHERE o.rid = i.rid AND o.start < i.start AND i.start < o."end")
  UNION ALL SELECT * FROM s WHERE kind = 'ssn' AND NOT regexp_matches(value, '^(?:000|666|9)|-00-|-0000$')
),
every AS (SELECT *, true AS is_base FROM base UNION ALL SELECT *, false FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = m.rid AND b.start < m."end" AND m.start < b."end")),
near AS (SELECT e.*, lower(substr(text, greatest(start - {n}, 0) + 1, least(start, {n})) || ' ' || substr(text, "end" + 1, {n})) AS around FROM every e JOIN d USING (rid)),
found AS (SELECT * FROM (SELECT *, round(greatest(least({scores}, 1.0), 0.0), 2)::DOUBLE AS score FROM near) WHERE is_base OR score >= {pii.LEAST}),
b AS ({_list('base', 'rank, start')}), f AS ({_list('found', 'rank, start')}), g AS ({_list('found', 'rank, start', value='score::VARCHAR')})
SELECT doc_id, {_counts(pii.KINDS[:4])}, sha256(coalesce(b.s, '')) AS base_sha256, coalesce(f.s, '') AS spans, coalesce(g.s, '') AS scores
FROM d LEFT JOIN b USING (rid) LEFT JOIN f USING (rid) LEFT JOIN g USING (rid)
"""


OP1_SQL, OP7_SQL = secrets_sql(), pii_sql()
