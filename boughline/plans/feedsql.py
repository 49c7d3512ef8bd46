"""DuckDB SQL of manifest line checks and of change feeds, generated level by level."""

from __future__ import annotations

from boughline.sources.manifest_lines import FIELDS, ID_ALPHABET, MESSAGES

_MOMENT = "[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z"

#: ``j``: each non-blank line once, with its fields ``f`` (a quoted name is chr(1)), quoted name ``q`` and reason ``field``.
LINES = f"""
l AS (SELECT DISTINCT manifest_id, line_no, line, ltrim(line, ' ') AS body FROM manifest_lines WHERE line IS NOT NULL AND trim(line, ' ' || chr(9)) <> ''),
t AS (SELECT *, length(line) - length(body) AS indent, length(body) - length(replace(body, '"', '')) AS nq,
      regexp_extract(body, '"([^"]*)"', 1) AS q, string_split(regexp_replace(body, '"[^"]*"', chr(1)), ' ') AS f FROM l),
u AS (SELECT *, CASE WHEN f[4] = chr(1) THEN q ELSE f[4] END AS name, f[len(f)] AS id FROM t),
c AS (SELECT *, CASE WHEN f[1][1] = 'd' AND ends_with(name, '/') THEN left(name, length(name) - 1) ELSE name END AS core FROM u),
j AS (SELECT *, CASE
  WHEN regexp_matches(line, '[\\x00-\\x08\\x0a-\\x1f]') THEN 'character'
  WHEN indent % 2 = 1 THEN 'indentation'
  WHEN nq NOT IN (0, 2) OR (nq = 2 AND NOT regexp_full_match(body, '(.* )?"[^"]*"( .*)?', 's')) THEN 'quoting'
  WHEN len(f) NOT IN (5, 7) OR (len(f) = 7 AND f[5] <> '->') THEN 'fields'
  WHEN nq = 2 AND f[4] <> chr(1) THEN 'quoting'
  WHEN f[1] <> '-' AND NOT regexp_full_match(f[1], '[-dlbcps][-rwxstST]{{9}}') THEN 'mode'
  WHEN f[2] NOT IN ('-', '0') AND (NOT regexp_full_match(f[2], '{_MOMENT}') OR left(f[2], 4) = '0000' OR try_cast(left(f[2], 10) AS DATE) IS NULL) THEN 'timestamp'
  WHEN f[3] <> '-' AND (NOT regexp_full_match(replace(f[3], ',', ''), '[0-9]+') OR NOT regexp_full_match(f[3], '[0-9,]+') OR try_cast(replace(f[3], ',', '') AS BIGINT) IS NULL) THEN 'size'
  WHEN core IN ('', '.', '..') OR contains(core, '/') OR contains(core, chr(92)) THEN 'name'
  WHEN id <> '-' AND NOT regexp_full_match(id, 'c4[{ID_ALPHABET}]{{88}}') THEN 'c4id' END AS field FROM c)"""

P1_FOUND = f"WITH {LINES} SELECT manifest_id, line_no, field FROM j WHERE field IS NOT NULL"

_SAID = "CASE field " + " ".join(f"WHEN '{f}' THEN '{m}'" for f, m in zip(FIELDS[1:], MESSAGES[1:], strict=True)) + " END"
P1_MESSAGES = f"WITH {LINES} SELECT manifest_id, field, {_SAID} AS message, count(*) AS n_lines FROM j WHERE field IS NOT NULL GROUP BY ALL"


def _perm() -> str:
    parts = []
    for group, shift, special in ((2, 6, 2048), (5, 3, 1024), (8, 0, 512)):
        r, w, x = (f"f[1][{group + k}]" for k in range(3))
        parts.append(f"CASE WHEN {r} = 'r' THEN {4 << shift} ELSE 0 END + CASE WHEN {w} = 'w' THEN {2 << shift} ELSE 0 END + CASE WHEN {x} IN ('x', 's', 't') THEN {1 << shift} ELSE 0 END + CASE WHEN {x} IN ('s', 'S', 't', 'T') THEN {special} ELSE 0 END")
    return "CASE WHEN f[1] <> '-' THEN " + " + ".join(parts) + " END"


_FLOW = "(coalesce(f[1][1], '') <> 'l' AND len(f) = 7 AND regexp_matches(f[6], '^[a-zA-Z][a-zA-Z0-9_-]*:'))"
P1_ENTRIES = f"""WITH {LINES} SELECT manifest_id, line_no, CAST(indent // 2 AS INTEGER) AS depth, name, CASE WHEN f[1] <> '-' THEN f[1][1] END AS file_type, {_perm()} AS perm,
  CASE WHEN f[2] NOT IN ('-', '0', '1970-01-01T00:00:00Z') THEN replace(left(f[2], 19), 'T', ' ') END AS ts_text, CASE WHEN f[3] <> '-' THEN CAST(replace(f[3], ',', '') AS BIGINT) END AS size,
  CASE WHEN len(f) = 7 AND NOT {_FLOW} THEN f[6] END AS link_target, CASE WHEN {_FLOW} THEN f[6] END AS flow_target, CASE WHEN id <> '-' THEN id END AS id_text FROM j WHERE field IS NULL"""

_VALUE = "{'n': name, 'f': file_type, 'p': perm, 't': ts, 's': size, 'l': link_target, 'c': content_id, 'h': hard_link, 'o': flow_op, 'g': flow_target}"


def _classified(name: str, events: str, resets: str) -> list[str]:
    """CTEs that end in ``name``: events with ``odd`` (puts a row) and ``live`` (the last of its path, not reset since)."""
    by = "PARTITION BY chain_id, path"
    upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    epoch = f"{by}, epoch ORDER BY lsn, seq"
    return [
        f"{name}_m AS (SELECT chain_id, path, lsn, seq, v, NULL::BIGINT AS reset FROM {events} UNION ALL SELECT chain_id, path, lsn, -1, NULL, lsn FROM {resets})",
        f"{name}_w AS (SELECT *, coalesce(last_value(reset IGNORE NULLS) OVER ({by} ORDER BY lsn, seq {upto}), -1) AS epoch, coalesce(max(reset) OVER ({by}), -1) AS last_reset, "
        f"first_value(reset IGNORE NULLS) OVER ({by} ORDER BY lsn, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_reset FROM {name}_m)",
        f"{name}_s AS (SELECT *, row_number() OVER ({epoch}) AS step, row_number() OVER ({epoch}) > 1 AND lag(v) OVER ({epoch}) IS NOT DISTINCT FROM v AS same FROM {name}_w WHERE reset IS NULL AND lsn > epoch)",
        f"{name}_r AS (SELECT *, max(CASE WHEN NOT same THEN step END) OVER ({epoch} {upto}) AS run_start FROM {name}_s)",
        f"{name} AS (SELECT *, (step - run_start) % 2 = 0 AS odd, row_number() OVER ({by} ORDER BY lsn DESC, seq DESC) = 1 AND epoch = last_reset AS live FROM {name}_r)",
    ]


def feed(stop_at: int | None = None, levels: int = 8) -> str:
    """CTEs up to ``z``: all events of the patch tables, classified."""
    stop = f" WHERE lsn <= {stop_at}" if stop_at else ""
    below = lambda rm: f"SELECT DISTINCT e.chain_id, e.path, r.lsn FROM ev e JOIN {rm} r ON e.chain_id = r.chain_id AND starts_with(e.path, r.path) AND e.path <> r.path"
    out = [
        "sec AS (SELECT chain_id, base_id, new_id, min(section_id) AS section_id FROM patch_sections WHERE chain_id IS NOT NULL AND new_id IS NOT NULL GROUP BY ALL)",
        "lg(chain_id, section_id, state, lsn) AS (SELECT chain_id, section_id, new_id, 1 FROM sec WHERE base_id IS NULL UNION ALL SELECT s.chain_id, s.section_id, s.new_id, lg.lsn + 1 FROM sec s JOIN lg ON s.chain_id = lg.chain_id AND s.base_id = lg.state)",
        f"ev AS (SELECT chain_id, path, lsn, min(coalesce(seq, 0)) AS seq, {_VALUE} AS v, length(rtrim(path, '/')) - length(replace(rtrim(path, '/'), '/', '')) AS level FROM patch_entries JOIN lg USING (section_id){stop} GROUP BY ALL)",
        "rm0 AS (SELECT chain_id, path, lsn FROM ev WHERE false)",
    ]
    for n in range(levels):
        out.append(f"rs{n} AS ({below(f'rm{n}')})")
        out.append(f"d{n} AS (SELECT * FROM ev WHERE ends_with(path, '/') AND level = {n})")
        out += _classified(f"c{n}", f"d{n}", f"(SELECT * FROM rs{n} WHERE (chain_id, path) IN (SELECT chain_id, path FROM d{n}))")
        out.append(f"rm{n + 1} AS MATERIALIZED (SELECT * FROM rm{n} UNION ALL SELECT chain_id, path, lsn FROM c{n} WHERE NOT odd)")
    out.append(f"rs AS ({below(f'rm{levels}')})")
    out += _classified("z", "ev", "rs")
    return "WITH RECURSIVE " + ", ".join(out)


STATE = feed() + " SELECT chain_id, path, coalesce(lower(hex(v.c)), '') AS content_id_hex FROM z WHERE live AND odd"
FIRST_THREE = feed(3) + " SELECT chain_id, path, CAST(lsn AS BIGINT) AS lsn FROM z WHERE live AND odd"
_STEP = "OVER (PARTITION BY chain_id, path, epoch ORDER BY lsn, seq)"
LOG = (
    feed()
    + f""", b AS (SELECT *, coalesce(lag(odd) {_STEP}, false) AS had, lag(v) {_STEP} AS before, lead(step) {_STEP} IS NOT NULL AS more FROM z),
k AS (SELECT chain_id, lsn, CASE WHEN NOT odd THEN 'r' WHEN NOT had THEN 'a' WHEN before.c IS DISTINCT FROM v.c THEN 'm' END AS kind FROM b
  UNION ALL SELECT chain_id, next_reset, 'r' FROM b WHERE odd AND NOT more AND next_reset IS NOT NULL)
SELECT chain_id, CAST(lsn AS BIGINT) AS lsn, count(*) FILTER (WHERE kind = 'a') AS n_added, count(*) FILTER (WHERE kind = 'r') AS n_removed, count(*) FILTER (WHERE kind = 'm') AS n_modified FROM k WHERE kind IS NOT NULL GROUP BY chain_id, lsn"""
)

ORPHANS = """WITH RECURSIVE d AS (SELECT DISTINCT chain_id, base_id, new_id FROM patch_sections WHERE chain_id IS NOT NULL AND new_id IS NOT NULL),
r(chain_id, state) AS (SELECT chain_id, new_id FROM d WHERE base_id IS NULL UNION SELECT d.chain_id, d.new_id FROM d JOIN r ON d.chain_id = r.chain_id AND d.base_id = r.state)
SELECT DISTINCT chain_id, section_id, CASE WHEN chain_id IS NULL OR new_id IS NULL THEN 'no state' ELSE 'unreachable' END AS reason FROM patch_sections
WHERE chain_id IS NULL OR new_id IS NULL OR (base_id IS NOT NULL AND (chain_id, base_id) NOT IN (SELECT chain_id, state FROM r))"""

#: From the empty state on, step by step: at each state the first arrived section that wasn't applied yet.
REVERTS = """WITH RECURSIVE f AS (SELECT chain_id, min(new_id) AS first FROM patch_sections WHERE base_id IS NULL GROUP BY chain_id),
a AS (SELECT chain_id, section_id, base_id, new_id, arrived_at FROM patch_sections
  UNION ALL SELECT p.chain_id, -p.section_id, p.new_id, f.first, p.arrived_at + INTERVAL 1000 DAY FROM patch_sections p JOIN f USING (chain_id)
    WHERE NOT EXISTS (SELECT 1 FROM patch_sections q WHERE q.chain_id = p.chain_id AND q.base_id = p.new_id)
  UNION ALL SELECT chain_id, -1000000000 - section_id, new_id, unhex(sha256(chain_id)), arrived_at + INTERVAL 2000 DAY FROM patch_sections WHERE base_id IS NULL),
s AS (SELECT chain_id, base_id, new_id, min(section_id) AS id, {'at': coalesce(min(arrived_at), TIMESTAMP 'infinity'), 'id': min(section_id)} AS k FROM a WHERE chain_id IS NOT NULL AND new_id IS NOT NULL GROUP BY ALL),
w(chain_id, state, id, lsn, used) AS (
  SELECT chain_id, arg_min(new_id, k), arg_min(id, k), 1, [arg_min(id, k)] FROM s WHERE base_id IS NULL GROUP BY chain_id
  UNION ALL SELECT w.chain_id, arg_min(s.new_id, s.k), arg_min(s.id, s.k), w.lsn + 1, list_append(any_value(w.used), arg_min(s.id, s.k))
    FROM w JOIN s ON s.chain_id = w.chain_id AND s.base_id = w.state AND NOT list_contains(w.used, s.id) GROUP BY w.chain_id, w.lsn)
SELECT chain_id, id AS section_id, CAST(lsn AS BIGINT) AS lsn FROM w"""
