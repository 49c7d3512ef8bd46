"""Pieces of DuckDB SQL that queries over the test tables share."""

from __future__ import annotations

#: Repeated entries differ in ``loaded_at`` at most.
ENTRIES = "e AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM entries)"

ORDER = """s AS (SELECT manifest_id, min(volume_id) AS volume_id, min(taken_at) AS taken_at FROM manifests
    WHERE volume_id IS NOT NULL AND taken_at IS NOT NULL GROUP BY manifest_id),
o AS (SELECT manifest_id, volume_id, row_number() OVER (PARTITION BY volume_id ORDER BY taken_at, manifest_id) - 1 AS ordinal FROM s)"""

#: Consecutive snapshots: ``a`` has the older entries and ``b`` the newer, both under the newer manifest's id.
PAIRS = f"""{ENTRIES}, {ORDER},
p AS (SELECT y.manifest_id AS new_id, x.manifest_id AS old_id FROM o x JOIN o y ON x.volume_id = y.volume_id AND y.ordinal = x.ordinal + 1),
a AS (SELECT p.new_id AS manifest_id, e.* EXCLUDE (manifest_id) FROM e JOIN p ON e.manifest_id = p.old_id),
b AS (SELECT e.* FROM e JOIN p ON e.manifest_id = p.new_id)"""

#: Every run of three consecutive snapshots as base, local and remote, under the newest manifest's id.
TRIPLES = f"""{ENTRIES}, {ORDER},
v AS (SELECT manifest_id AS new_id, volume_id, ordinal FROM o WHERE ordinal >= 2),
t0 AS (SELECT v.new_id AS manifest_id, e.* EXCLUDE (manifest_id) FROM e JOIN o USING (manifest_id) JOIN v ON o.volume_id = v.volume_id AND o.ordinal = v.ordinal - 2),
t1 AS (SELECT v.new_id AS manifest_id, e.* EXCLUDE (manifest_id) FROM e JOIN o USING (manifest_id) JOIN v ON o.volume_id = v.volume_id AND o.ordinal = v.ordinal - 1),
t2 AS (SELECT v.new_id AS manifest_id, e.* EXCLUDE (manifest_id) FROM e JOIN o USING (manifest_id) JOIN v ON o.volume_id = v.volume_id AND o.ordinal = v.ordinal)"""

#: Consecutive snapshots as local and remote.
BOTH = f"""{PAIRS}, t1 AS (SELECT * FROM a), t2 AS (SELECT * FROM b)"""

IDENTITY = ["name", "file_type", "perm", "ts", "size", "content_id", "link_target", "hard_link", "flow_op", "flow_target"]


def same(columns: list[str], a: str = "a", b: str = "b") -> str:
    return "(" + " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in columns) + ")"


def natural(name: str) -> str:
    """List of structs that sorts names naturally."""
    return (
        f"list_transform(regexp_extract_all({name}, '([0-9]+|[^0-9]+)'), lambda seg: "
        "CASE WHEN regexp_matches(seg, '^[0-9]') THEN {'k': 1, 'n': length(regexp_replace(seg, '^0+([0-9])', '\\1')), 'd': regexp_replace(seg, '^0+([0-9])', '\\1'), 'w': length(seg), 't': ''} "
        "ELSE {'k': 0, 'n': 0, 'd': '', 'w': 0, 't': seg} END)"
    )


def path_key(path: str) -> str:
    return f"list_transform(regexp_extract_all({path}, '([^/]+/?)'), lambda comp: {{'dir': CASE WHEN ends_with(comp, '/') THEN 1 ELSE 0 END, 'nat': {natural('comp')}}})"


def mode(t: str = "") -> str:
    p = f"coalesce({t}perm, 0)"

    def rwx(shift: int, special: int, low: str, high: str) -> str:
        x, s = f"({p} & {1 << shift}) <> 0", f"({p} & {special}) <> 0"
        return (
            f"CASE WHEN ({p} & {4 << shift}) <> 0 THEN 'r' ELSE '-' END || CASE WHEN ({p} & {2 << shift}) <> 0 THEN 'w' ELSE '-' END || "
            f"CASE WHEN {s} AND {x} THEN '{low}' WHEN {s} THEN '{high}' WHEN {x} THEN 'x' ELSE '-' END"
        )

    text = f"coalesce({t}file_type, '-') || {rwx(6, 2048, 's', 'S')} || {rwx(3, 1024, 's', 'S')} || {rwx(0, 512, 't', 'T')}"
    return f"CASE WHEN NOT ({p} = 0 AND coalesce({t}file_type, '-') = '-') THEN {text} END"


def moment(ts: str) -> str:
    return f"CASE WHEN {ts} <> TIMESTAMP '1970-01-01' THEN strftime({ts}, '%Y-%m-%dT%H:%M:%SZ') END"


def _escaped(c: str, brackets: str) -> str:
    return f"regexp_replace({c}, '([ \"{brackets}])', '\\\\\\1', 'g')"


def named(t: str = "", name: str | None = None) -> str:
    """A name with its escapes."""
    name = name or f"{t}name"
    return f"CASE WHEN coalesce({t}is_sequence, false) THEN {_escaped(name, '')} ELSE {_escaped(name, chr(92) + '[' + chr(92) + ']')} END"


def link(t: str = "") -> str:
    """The link part of a line."""
    return (
        f"CASE WHEN coalesce({t}link_target, '') <> '' THEN ' -> ' || {_escaped(t + 'link_target', '')} WHEN coalesce({t}hard_link, 0) < 0 THEN ' ->' "
        f"WHEN coalesce({t}hard_link, 0) > 0 THEN ' ->' || CAST({t}hard_link AS VARCHAR) WHEN {t}flow_op IS NOT NULL THEN ' ' || {t}flow_op || ' ' || coalesce({t}flow_target, '') ELSE '' END"
    )


def line(t: str = "", identity: str | None = None, size: str | None = None, ts: str | None = None, name: str | None = None) -> str:
    """The canonical line with raw names; ``identity`` is hex by default."""
    identity = identity or f"lower(hex({t}content_id))"
    size, ts = size or f"{t}size", ts or f"{t}ts"
    return (
        f"(coalesce({mode(t)}, '-') || ' ' || coalesce({moment(ts)}, '-') || ' ' || coalesce(CASE WHEN {size} >= 0 THEN CAST({size} AS VARCHAR) END, '-') || ' ' || {named(t, name)} || "
        f"{link(t)} || ' ' || coalesce({identity}, '-'))"
    )


def id_texts(alphabet: str, ids: str) -> str:
    """CTEs that end in ``id_texts (id, text)``: ids of 64 bytes in base 58, by long division in limbs of 32 bits; ``ids`` selects them as ``id``."""
    limbs = ", ".join(f"CAST('0x' || substr(hex(id), {8 * i + 1}, 8) AS UBIGINT) AS l{i}" for i in range(16))
    out = [f"s0 AS (SELECT id, '' AS text, {limbs} FROM ({ids}))"]
    for step in range(18):
        terms, rest = [], "0"
        for i in range(16):
            terms.append(f"({rest} * 4294967296 + l{i}) AS c{i}, CAST(c{i} // {58**5} AS UBIGINT) AS q{i}, CAST(c{i} % {58**5} AS UBIGINT) AS r{i}")
            rest = f"r{i}"
        digits = " || ".join(f"substr('{alphabet}', CAST((r15 // {58**k}) % 58 AS INTEGER) + 1, 1)" for k in (4, 3, 2, 1, 0))
        out.append(f"s{step + 1} AS MATERIALIZED (SELECT id, {digits} || text AS text, {', '.join(f'q{i} AS l{i}' for i in range(16))} FROM (SELECT id, text, {', '.join(terms)} FROM s{step}))")
    out.append("id_texts AS (SELECT id, 'c4' || right(text, 88) AS text FROM s18)")
    return ", ".join(out)


def safe_name(name: str) -> str:
    """A name in printable characters."""
    hidden = r"(?:[^\x00\t\n\r\\\p{L}\p{M}\p{N}\p{P}\p{S} ]|¤)+"
    framed = "'¤' || list_aggregate(list_transform(regexp_extract_all(hex(encode(part)), '..'), lambda h: chr(10240 + CAST('0x' || h AS INTEGER))), 'string_agg', '') || '¤'"
    cases = " ".join(f"WHEN part = chr({code}) THEN chr(92) || '{sign}'" for code, sign in ((0, "0"), (9, "t"), (10, "n"), (13, "r"), (92, chr(92))))
    each = f"CASE {cases} WHEN regexp_full_match(part, '{hidden}') THEN {framed} ELSE part END"
    return f"coalesce(list_aggregate(list_transform(regexp_extract_all({name}, '{hidden}|(?s:.)'), lambda part: {each}), 'string_agg', ''), '')"
