"""The list queries in SQL (DuckDB), written from their definitions."""

from __future__ import annotations

# The grammar of white space, addresses and names
_SPACE = r"\t-\r\x1c-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}"
_OCTET = "(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_LABEL = "[a-zA-Z0-9][-a-zA-Z0-9]{0,62}"


def _text(x: str) -> str:
    return f"regexp_matches({x}, '[^{_SPACE}]')"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def _units(x: str) -> str:
    return rf"(length({x}) + length(regexp_replace({x}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def _domain(x: str) -> str:
    return rf"(length({x}) BETWEEN 3 AND 255 AND regexp_full_match({x}, '{_LABEL}(\.{_LABEL})+'))"


def _split(x: str, flag: str) -> str:
    return f"list_filter(string_split({x}, '{flag}'), lambda p: {_text('p')})"


def _after_last(x: str, flag: str) -> str:
    return f"CASE WHEN contains({x}, '{flag}') THEN string_split({x}, '{flag}')[-1] ELSE '' END"


def _between(x: str, flag: str) -> str:
    cut = f"regexp_extract({x}, '(?s)^[^{flag}]*{flag}(.*){flag}', 1)"
    return cut


def _gate(x: str = "line", low: int = 0, high: int = 1024) -> str:
    adblock = f"({_text(x)} AND (starts_with({x}, '#') OR starts_with({x}, '!'))) OR (starts_with({x}, '[') AND ends_with({x}, ']'))"
    comment = f"CASE WHEN source_type IN ('EASYLIST', 'DNS') THEN {adblock} ELSE starts_with({x}, '#') END"
    short = f"WHEN {_units(x)} < {low} THEN 'short'" if low else ""
    return f"CASE WHEN {x} IS NULL OR NOT {_text(x)} THEN 'blank' WHEN {comment} THEN 'comment' {short} WHEN {_units(x)} > {high} THEN 'long' END"


def _base(x: str) -> str:
    bare = rf"regexp_replace(replace({x}, '*', 'a'), '^\.+|\.+$', '', 'g')"
    return f"CASE WHEN {_domain(bare)} THEN CASE WHEN {bare} = {x} THEN 'BASIC' ELSE 'WILDCARD' END WHEN regexp_full_match({bare}, '[-a-zA-Z0-9]*') THEN 'WILDCARD' END"


_RULE = "{'source_type': %s, 'target': %s, 'dest': %s, 'mode': %s, 'scope': %s, 'type': %s, 'controls': %s}"
_LOCAL_IPS = "('0.0.0.0', '127.0.0.1', '::1')"
_DENY = f"(ip IN {_LOCAL_IPS} AND name NOT IN ('localhost', 'localhost.localdomain', 'local', 'ip6-localhost', 'ip6-loopback'))"

_PARSED = rf"""
g AS (SELECT * FROM raw_lines WHERE ({_gate()}) IS NULL),
a1 AS (SELECT *, CASE WHEN source_type IN ('HOSTS', 'DNS') THEN {_split("replace(line, chr(9), ' ')", " ")} END AS h FROM g),
a2 AS (SELECT *, CASE WHEN len(h) = 2 THEN {_trim('h[1]')} END AS ip, CASE WHEN len(h) = 2 THEN {_trim('h[2]')} END AS name FROM a1),
a3 AS (SELECT *, coalesce(regexp_full_match(ip, '({_OCTET}\.){{3}}{_OCTET}') AND {_domain('name')} AND (source_type = 'DNS' OR ip <> name), false) AS named FROM a2),
e1 AS (SELECT *, starts_with(line, '@@') AS allow, CASE WHEN starts_with(line, '@@') THEN substr(line, 3) ELSE line END AS l1 FROM a3),
e2 AS (SELECT *, starts_with(l1, '||') AS over, CASE WHEN starts_with(l1, '||') THEN substr(l1, 3) ELSE l1 END AS l2 FROM e1),
e3 AS (SELECT *, instr(l2, '$') AS at_ FROM e2),
e4 AS (SELECT *, CASE WHEN at_ > 0 THEN {_trim("substr(l2, at_ + 1)")} END AS mod, CASE WHEN at_ > 0 THEN left(l2, at_ - 1) ELSE l2 END AS l3 FROM e3),
e5 AS (SELECT *, mod IS NOT NULL AND mod NOT IN ('important', 'all') AS odd, ends_with(l3, '^') AS qual, CASE WHEN ends_with(l3, '^') THEN left(l3, length(l3) - 1) ELSE l3 END AS l4 FROM e4),
e6 AS (SELECT *, starts_with(l4, '/') AND ends_with(l4, '/') AND length(l4) > 2 AS pat FROM e5),
e7 AS (SELECT *, CASE WHEN pat THEN substr(l4, 2, length(l4) - 2) ELSE l4 END AS l5 FROM e6),
e8 AS (SELECT *, CASE WHEN NOT odd THEN {_base('l5')} END AS base FROM e7),
q1 AS (SELECT *, {_split(_after_last('line', 'address=/'), '/')} AS q, {_split(_after_last('line', 'address /'), '/')} AS s FROM e8),
k1 AS (SELECT *, {_trim("CASE WHEN starts_with(line, '-') THEN substr(line, 2) ELSE line END")} AS c1 FROM q1),
k2 AS (SELECT *, CASE WHEN starts_with(c1, chr(39)) THEN {_trim(_between('line', "''"))} WHEN starts_with(c1, '"') THEN {_trim(_between('line', '"'))} ELSE c1 END AS c2 FROM k1),
k3 AS (SELECT *, CASE WHEN starts_with(c2, '+.') THEN substr(c2, 3) WHEN starts_with(c2, '+') THEN substr(c2, 2) ELSE c2 END AS c3,
  CASE s[2] WHEN '#' THEN 'DENY' WHEN '-' THEN 'ALLOW' END AS act FROM k2),
r AS (SELECT source_idx, line_no, source_name, source_type AS declared_type, line AS origin, CASE
  WHEN named THEN {_RULE % ("'HOSTS'", "name", f"CASE WHEN {_DENY} THEN '0.0.0.0' ELSE ip END", f"CASE WHEN {_DENY} THEN 'DENY' ELSE 'REWRITE' END", "'DOMAIN'", "'BASIC'", "''")}
  WHEN source_type IN ('EASYLIST', 'DNS') THEN {_RULE % ("source_type", "CASE WHEN odd THEN NULL WHEN base IS NOT NULL OR pat THEN l5 END", "CASE WHEN NOT odd AND base IS NOT NULL AND NOT allow THEN '0.0.0.0' END", "CASE WHEN allow THEN 'ALLOW' ELSE 'DENY' END", "CASE WHEN NOT odd THEN 'DOMAIN' END", "CASE WHEN odd THEN 'UNKNOWN' WHEN base IS NOT NULL THEN base WHEN pat THEN 'REGEX' ELSE 'UNKNOWN' END", "concat_ws('+', CASE WHEN mod = 'important' THEN 'IMPORTANT' END, CASE WHEN over THEN 'OVERLAY' END, CASE WHEN qual AND NOT odd THEN 'QUALIFIER' END, CASE WHEN mod = 'all' THEN 'ALL' END)")}
  WHEN source_type = 'DNSMASQ' AND len(q) IN (1, 2) THEN {_RULE % ("'DNSMASQ'", "q[1]", "q[2]", f"CASE WHEN q[2] IS NULL OR q[2] IN {_LOCAL_IPS} THEN 'DENY' ELSE 'REWRITE' END", "'DOMAIN'", "'BASIC'", "''")}
  WHEN source_type = 'CLASH' AND NOT starts_with(line, 'payload') AND starts_with(c2, '*') THEN {_RULE % ("'EASYLIST'", "NULL", "NULL", "NULL", "NULL", "'UNKNOWN'", "''")}
  WHEN source_type = 'CLASH' AND NOT starts_with(line, 'payload') THEN {_RULE % ("'EASYLIST'", "c3", "'0.0.0.0'", "'DENY'", "'DOMAIN'", f"CASE WHEN NOT {_domain("replace(c3, '*', 'a')")} THEN 'UNKNOWN' WHEN contains(c3, '*') THEN 'WILDCARD' ELSE 'BASIC' END", "CASE WHEN starts_with(c2, '+') THEN 'OVERLAY' ELSE '' END")}
  WHEN source_type = 'SMARTDNS' AND len(s) = 2 AND act IS NULL THEN {_RULE % ("'EASYLIST'", "NULL", "NULL", "NULL", "NULL", "'UNKNOWN'", "''")}
  WHEN source_type = 'SMARTDNS' AND len(s) = 2 AND NOT regexp_matches(s[1], '^[-.]') THEN {_RULE % ("'EASYLIST'", "s[1]", "'0.0.0.0'", "act", "'DOMAIN'", "CASE WHEN starts_with(s[1], '*') THEN 'WILDCARD' ELSE 'BASIC' END", "'OVERLAY'")}
  END AS v, source_type = 'SMARTDNS' AND len(s) = 2 AND act IS NOT NULL AND regexp_matches(s[1], '^[-.]') AS fails FROM k3),
parsed AS (SELECT source_idx, line_no, source_name, declared_type, origin, v.source_type AS source_type, v.target AS target, v.dest AS dest, v.mode AS mode,
  v.scope AS scope, v.type AS type, coalesce(v.controls, '') AS controls, CASE WHEN fails THEN 'ERROR' WHEN v IS NULL THEN 'INVALID' ELSE 'OK' END AS status FROM r),
err AS (SELECT source_idx, min(line_no) AS error_at FROM parsed WHERE status = 'ERROR' GROUP BY source_idx),
cut AS (SELECT p.* FROM parsed p LEFT JOIN err USING (source_idx) WHERE error_at IS NULL OR line_no < error_at),
kept AS (SELECT * FROM cut WHERE status = 'OK' AND (target IS NULL OR target NOT IN (SELECT target FROM excludes WHERE target IS NOT NULL))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY type = 'UNKNOWN', CASE WHEN type = 'UNKNOWN' THEN origin ELSE target END,
  CASE WHEN type <> 'UNKNOWN' THEN mode END, CASE WHEN type <> 'UNKNOWN' THEN scope END, CASE WHEN type <> 'UNKNOWN' THEN type END ORDER BY source_idx, line_no) AS rn FROM kept),
effective AS (SELECT * FROM ranked WHERE rn = 1)
"""


def _has(control: str) -> str:
    return f"contains('+' || controls || '+', '+{control}+')"


_FRONT = f"CASE WHEN mode = 'ALLOW' THEN '@@' ELSE '' END || CASE WHEN {_has('OVERLAY')} THEN '||' ELSE '' END || CASE WHEN type = 'BASIC' THEN target ELSE '/' || target || '/' END || CASE WHEN {_has('QUALIFIER')} THEN '^' ELSE '' END || CASE WHEN {_has('IMPORTANT')} THEN '$important' ELSE '' END"
_RENDERED = {
    "EASYLIST": f"CASE WHEN type = 'UNKNOWN' THEN CASE WHEN source_type = 'EASYLIST' THEN origin END WHEN mode IS DISTINCT FROM 'REWRITE' THEN {_FRONT} || CASE WHEN NOT {_has('ALL')} THEN '' WHEN {_has('IMPORTANT')} OR contains(target, '$') THEN ',all' ELSE '$all' END END",
    "DNS": f"CASE WHEN type = 'UNKNOWN' THEN CASE WHEN source_type = 'DNS' THEN origin END WHEN mode = 'REWRITE' THEN CASE WHEN scope = 'DOMAIN' AND type = 'BASIC' THEN coalesce(dest, '0.0.0.0') || chr(9) || target END WHEN type IN ('BASIC', 'WILDCARD') THEN {_FRONT} END",
    "DNSMASQ": "CASE WHEN scope = 'DOMAIN' AND type = 'BASIC' AND mode IS DISTINCT FROM 'ALLOW' THEN 'address=/' || target || '/' || CASE WHEN mode = 'REWRITE' THEN dest || '/' ELSE '' END END",
    "CLASH": f"CASE WHEN type IN ('BASIC', 'WILDCARD') AND mode = 'DENY' AND scope = 'DOMAIN' THEN '  - \"' || CASE WHEN {_has('OVERLAY')} THEN '+.' ELSE '' END || target || '\"' END",
    "SMARTDNS": f"CASE WHEN type = 'UNKNOWN' OR mode = 'REWRITE' OR scope IS DISTINCT FROM 'DOMAIN' THEN NULL WHEN type = 'BASIC' THEN 'address /' || CASE WHEN {_has('OVERLAY')} THEN '' ELSE '*.' END || target || '/' || CASE WHEN mode = 'DENY' THEN '#' ELSE '-' END WHEN type = 'WILDCARD' AND starts_with(target, '*') AND NOT contains(substr(target, 2), '*') THEN 'address /' || target || '/-' END",
    "HOSTS": "CASE WHEN scope = 'DOMAIN' AND type = 'BASIC' AND mode IS DISTINCT FROM 'ALLOW' THEN coalesce(dest, '0.0.0.0') || chr(9) || target END",
}
_LINE = "CASE o.out_type " + " ".join(f"WHEN '{d}' THEN {x}" for d, x in _RENDERED.items()) + " END"


def _fanned(rules: str) -> str:
    return f"""
outs AS (SELECT name AS file, type AS out_type, coalesce(filter, []) AS types, coalesce(rule, []) AS sources FROM outputs),
fanned AS (SELECT o.file, source_idx, line_no, {_LINE} AS line FROM {rules} x JOIN outs o
  ON (len(o.sources) = 0 OR list_contains(o.sources, x.source_name)) AND (len(o.types) = 0 OR list_contains(o.types, x.type)))
"""


_STORED = "stored AS (SELECT * REPLACE (array_to_string(controls, '+') AS controls) FROM rules WHERE status = 'OK')"
_WITH = "WITH " + _PARSED
_TOTALS = "totals AS (SELECT o.file, count(f.line) AS total FROM outs o LEFT JOIN fanned f ON f.file = o.file AND f.line IS NOT NULL GROUP BY o.file)"
_TEMPLATE = "'Lists ${type}' || chr(10) || chr(10) || '  by ${name}: ${desc}' || chr(10) || 'Total ${total}'"
_PARSE = "SELECT source_idx, line_no, origin, source_type, target, dest, mode, scope, type, controls, status FROM parsed WHERE declared_type = '{}'"

ORACLE = {
    "gate_lines": f"SELECT source_idx, line_no, line FROM raw_lines WHERE ({_gate()}) IS NULL",
    "length_gate": f"SELECT source_idx, line_no, line FROM raw_lines WHERE ({_gate(low=8, high=60)}) IS NULL",
    "audit_lines": _WITH + f""", g0 AS (SELECT source_idx, line_no, {_gate()} AS gate, line FROM raw_lines),
      p AS (SELECT DISTINCT source_idx, line_no, status, target FROM parsed)
      SELECT g0.source_idx, g0.line_no, CASE WHEN g0.line_no > error_at THEN 'lost' WHEN gate IS NOT NULL THEN gate WHEN status = 'ERROR' THEN 'error' WHEN status = 'INVALID' THEN 'invalid'
        WHEN target IN (SELECT target FROM excludes WHERE target IS NOT NULL) THEN 'excluded' WHEN {_units('line')} <= 6 THEN 'suspicious' ELSE 'kept' END AS event
      FROM g0 LEFT JOIN p ON p.source_idx = g0.source_idx AND p.line_no = g0.line_no LEFT JOIN err ON err.source_idx = g0.source_idx""",
    "audit_trail": _WITH + f""", g0 AS (SELECT source_idx, source_name, line_no, {_gate()} AS gate, line FROM raw_lines),
      p AS (SELECT DISTINCT source_idx, line_no, status, target FROM parsed),
      n AS (SELECT source_idx, line_no, min(rn) AS rn FROM ranked GROUP BY ALL),
      e AS (SELECT g0.source_idx, source_name, g0.line_no, line, row_number() OVER (PARTITION BY g0.source_idx, g0.line_no ORDER BY line) AS copy, rn,
        CASE WHEN g0.line_no > error_at THEN 'lost' WHEN gate IS NOT NULL THEN gate WHEN status = 'ERROR' THEN 'error' WHEN status = 'INVALID' THEN 'invalid'
        WHEN target IN (SELECT target FROM excludes WHERE target IS NOT NULL) THEN 'excluded' END AS event
      FROM g0 LEFT JOIN p ON p.source_idx = g0.source_idx AND p.line_no = g0.line_no LEFT JOIN err ON err.source_idx = g0.source_idx
        LEFT JOIN n ON n.source_idx = g0.source_idx AND n.line_no = g0.line_no)
      SELECT source_idx, source_name, line_no, coalesce(event, CASE WHEN rn = 1 AND copy = 1 THEN 'effective' ELSE 'repeat' END) AS event,
        event IS NULL AND {_units('line')} <= 9 AS suspicious FROM e""",
    **{f"parse_{d.lower()}": _WITH + _PARSE.format(d) for d in _RENDERED},
    "classify_base_rule": f"SELECT source_idx, line_no, {_base('line')} AS base FROM raw_lines",
    "text_helpers": rf"""SELECT source_idx, line_no, {_text('line')} AND (starts_with(line, '||') OR starts_with(line, '@@')) AS anchored,
      starts_with(line, '/') AND ends_with(line, '/') AS pattern,
      CASE WHEN contains(line, '.') THEN string_split(line, '.')[1] ELSE '' END AS before_first,
      regexp_extract(line, '(?s)^(.*)\.', 1) AS before_last,
      CASE WHEN contains(line, '.') THEN substr(line, instr(line, '.') + 1) ELSE '' END AS after_first,
      {_after_last('line', '.')} AS after_last, regexp_extract(line, '(?s)^[^a]*a(.*)e', 1) AS inner,
      len({_split('line', '/')}) AS parts, line IN ('||^', '@@') AS empty_rule, {_trim('line')} AS trimmed, {_units('line')} AS units, {_text('line')} AS has_text FROM raw_lines""",
    "split_lines": r"""WITH s AS (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS x FROM documents WHERE text IS NOT NULL),
      t AS (SELECT doc_id, CASE WHEN x[-1] = '' THEN x[:len(x) - 1] ELSE x END AS x FROM s)
      SELECT doc_id, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM t""",
    "first_error_truncation": _WITH + "SELECT source_idx, line_no, origin, status FROM cut",
    "exclude_rules": _WITH + "SELECT source_idx, line_no, origin, target FROM kept",
    "suspicious_rules": _WITH + f"SELECT source_idx, line_no, origin FROM kept WHERE {_units('origin')} <= 6",
    "short_rules": _WITH + f"SELECT source_idx, line_no, origin FROM kept WHERE {_units('origin')} <= 9",
    "dedup_first_wins": _WITH + "SELECT source_idx, line_no, source_name, origin, source_type, target, dest, mode, scope, type, controls FROM effective",
    "source_stats": _WITH + """, t AS (SELECT source_name, count(*) AS total, count(*) FILTER (status = 'INVALID') AS invalid FROM cut GROUP BY source_name),
      k AS (SELECT source_name, count(*) FILTER (rn = 1) AS effective, count(*) FILTER (rn > 1) AS repeat FROM ranked GROUP BY source_name)
      SELECT source_name, total, coalesce(effective, 0) AS effective, coalesce(repeat, 0) AS repeat, invalid FROM t LEFT JOIN k USING (source_name)""",
    **{f"render_{d.lower()}": f"WITH {_STORED} SELECT rule_id, {x} AS line FROM stored WHERE ({x}) IS NOT NULL" for d, x in _RENDERED.items()},
    "fanout_outputs": f"WITH {_STORED}, {_fanned('stored')} SELECT * FROM fanned WHERE line IS NOT NULL",
    "end_to_end": _WITH + f", {_fanned('effective')} SELECT * FROM fanned WHERE line IS NOT NULL",
    "output_totals": _WITH + f", {_fanned('effective')}, {_TOTALS} SELECT * FROM totals",
    "render_header": _WITH + rf""", {_fanned('effective')}, {_TOTALS},
      t AS (SELECT o.name AS file, o.type AS kind, total, replace(replace(replace(replace(
        CASE WHEN trim(coalesce(o.file_header, '')) = '' THEN {_TEMPLATE} ELSE o.file_header END,
        '${{date}}', '2025-03-03 02:00:00'), '${{name}}', o.name), '${{desc}}', coalesce(o."desc", '')), '${{type}}', lower(o.type)) AS body
        FROM outputs o JOIN totals ON totals.file = o.name),
      m AS (SELECT *, CASE WHEN kind IN ('EASYLIST', 'DNS') THEN '! ' WHEN kind = 'CLASH' THEN '#' ELSE '# ' END AS mark FROM t)
      SELECT file, replace(array_to_string(list_transform(list_filter(string_split(body, chr(10)), lambda p: {_text('p')}), lambda p: mark || {_trim('p')}), chr(13) || chr(10)), '${{total}}', CAST(total AS VARCHAR))
        || chr(10) || CASE WHEN kind = 'CLASH' THEN 'payload:' || chr(10) ELSE '' END AS header FROM m""",
    "dns_filtered": _WITH + "SELECT source_idx, line_no, origin FROM kept WHERE NOT (type = 'BASIC' AND scope = 'DOMAIN' AND ends_with(trim(lower(target)), '.invalid'))",
    "incremental_lists": _WITH + """, again AS (SELECT *, row_number() OVER (PARTITION BY type = 'UNKNOWN', CASE WHEN type = 'UNKNOWN' THEN origin ELSE target END,
        CASE WHEN type <> 'UNKNOWN' THEN mode END, CASE WHEN type <> 'UNKNOWN' THEN scope END, CASE WHEN type <> 'UNKNOWN' THEN type END ORDER BY source_idx % 2, source_idx, line_no) AS r2 FROM cut WHERE status = 'OK')
      SELECT source_idx, line_no, origin, target, mode, scope, type FROM again WHERE r2 = 1""",
}
