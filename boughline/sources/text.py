"""Manifests as text: reading, sniffing and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boughline.functions import fields, ids
from boughline.functions.order import path_key, ranked
from boughline.operators.common import broadcast_up_to, last_seen, settle
from boughline.operators.navigate import paths_in_order
from boughline.operators.rollup import text_digests
from boughline.operators.sequences import is_sequence_text
from boughline.schema import TREE
from boughline.sources.canonical import HASHED, hash_files
from boughline.sources.manifest_lines import permission_bits


#: Columns by which the lines of ``keyed_text`` stand.
TEXT_ORDER = ("_p", "_q")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``manifest_id`` (the file), ``line_no`` from 1 and ``line`` of text files, each file one manifest.

    Files are read in splits, so one may be larger than any memory; a line's
    number follows from its place in its split and the lines of the splits
    before it. A file that ends in a newline has no empty last line.
    """
    read = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias(TREE), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    read = settle(read)
    splits = read.groupBy(F.col(TREE).alias("_f"), F.col("_b").alias("_s")).agg(F.min("_at").alias("_least"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_f").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = broadcast_up_to(splits.select("_f", "_s", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least") + 1).alias("_start")))
    return read.join(starts, (F.col(TREE) == F.col("_f")) & (F.col("_b") == F.col("_s"))).select(TREE, (F.col("_at") + F.col("_start")).alias("line_no"), "line")


def line_kind(line: Column) -> Column:
    """``blank``, ``id`` (a boundary between patches), ``ids`` (members of a range), ``bad`` (directives, carriage returns) or ``entry``."""
    text = F.trim(line)
    coded = text.startswith("c4")
    return F.when(text == "", "blank").when(coded & ids.is_id(text), "id").when(coded & ids.is_id_list(text), "ids").when(text.startswith("@") | line.contains("\r"), "bad").otherwise("entry")


def sniff(lines: DataFrame) -> DataFrame:
    """``manifest_id, is_manifest``: whether the first line with text is an entry or an id rather than a path."""
    first = lines.where("trim(line) <> ''").groupBy(TREE).agg(F.min_by("line", "line_no").alias("_l"))
    text = F.trim("_l")
    entry = text.rlike(r"^(-|[-dlbcps][-rwxstST]{9}) +(-|0|[0-9]{4}-[0-9]{2}-[0-9]{2}T)")
    return first.select(TREE, (entry | ids.is_id(text)).alias("is_manifest"))


def _unescaped(text: Column) -> Column:
    return F.when(text.contains("\\"), F.regexp_replace(text, r'\\([ "\[\]])', "$1")).otherwise(text)


#: Why a strict reader refuses a line, in the order in which reasons are looked for.
REFUSED = {
    "character": "carriage return in the line",
    "directive": "directives are not supported",
    "fields": "five fields expected at least",
    "mode": "mode is neither - nor a type and nine permission characters",
    "timestamp": "timestamp is not -, 0 or a moment",
    "size": "size is not - or a decimal number",
    "name": "name is empty, . or .., or holds a slash or backslash",
    "c4id": "id is neither - nor c4 and 88 base-58 characters",
}


#: Fields of a line: blanks that no backslash escapes are between them. Runs are taken whole, so a field takes few steps and no deep recursion.
_FIELD = r"((?:[^ \\]++|\\.)++)"


def _tokens(lines: DataFrame) -> DataFrame:
    """Adds ``_k`` (kind), ``_t`` (fields of an entry), parsed fields, and ``_why`` (reason of a line that is no entry, id or id list)."""
    t = lambda i: F.try_element_at(F.col("_t"), F.lit(i))
    value = lambda c: F.when(c != "-", c)
    kinds = lines.withColumn("_k", line_kind(F.col("line"))).withColumn("_t", F.regexp_extract_all(F.trim("line"), F.lit(_FIELD), 1)).withColumn("_u", _unescaped(t(4)))
    parsed = kinds.withColumns(
        {
            "_mode": t(1).rlike("^(-|[-dlbcps][-rwxstST]{9})$"),
            "_ts": fields.parse_moment(value(t(2))),
            "_size": F.when(t(3).rlike("^[0-9][0-9,]*$"), F.regexp_replace(t(3), ",", "").try_cast("bigint")),
            "_seq": is_sequence_text(t(4)),
            "_name": F.coalesce(fields.unsafe_name(F.col("_u")).cast("string"), t(4)),
        }
    )
    why = (
        F.when(F.col("line").contains("\r"), "character")
        .when(F.trim("line").startswith("@"), "directive")
        .when(F.size("_t") < 5, "fields")
        .when(~F.col("_mode"), "mode")
        .when(~t(2).isin("-", "0") & F.col("_ts").isNull(), "timestamp")
        .when((t(3) != "-") & F.col("_size").isNull(), "size")
        .when(~F.col("_seq") & ~fields.valid_name(F.col("_name")), "name")
        .when((t(-1) != "-") & ~ids.is_id(t(-1)), "c4id")
    )
    return parsed.withColumn("_why", F.when(F.col("_k").isin("entry", "bad"), why))


def read_entries(lines: DataFrame) -> DataFrame:
    """Entries of manifest text with ``section_no`` (patches after bare ids) and ``base_id`` of the section.

    Fields are separated by blanks that no backslash escapes, so a name is one
    field; escapes and safe encoding are undone. The indent of the first
    indented line is the width of a level. Lines that are no entries give none
    (``rejected`` has those a strict reader refuses, ``range_data`` the id
    lists); unknown values are NULL. ``lines`` is read once: its fields are
    kept as a table, and ids and targets are decoded only where they are asked
    for. Sections are numbered from 0 and paths built by one running window, in
    stretches, so that a long manifest is no single task's.
    """
    t = lambda i: F.try_element_at(F.col("_t"), F.lit(i))
    # Written before any filter: one that reaches below the fields would parse a line anew for each of its terms.
    kept = settle(
        _tokens(lines).select(
            TREE, "line_no",
            F.when(F.col("_k") == "id", False).when((F.col("_k") == "entry") & F.col("_why").isNull(), True).alias("_is"),
            F.when(F.col("_k") == "id", F.trim("line")).alias("_base"),
            (F.length("line") - F.length(F.ltrim("line"))).alias("_i"),
            F.when(F.col("_seq"), t(4)).otherwise(F.col("_name")).alias("name"),
            F.when(~t(1).isin("-", "-" * 10), t(1)).alias("_m"),
            F.substring(t(1), 1, 1).alias("_type"),
            F.col("_ts").alias("ts"),
            F.col("_size").alias("size"),
            F.when(F.size("_t") > 5, t(5)).alias("_op"),
            F.when(F.size("_t") > 6, t(6)).alias("_to"),
            F.when(t(-1) != "-", t(-1)).alias("_id"),
            F.col("_seq").alias("is_sequence"),
        )
    ).where("_is IS NOT NULL")
    steps = kept.where("_is AND _i > 0").groupBy(F.col(TREE).alias("_g")).agg(F.min_by("_i", "line_no").alias("_step"))
    split = kept.join(broadcast_up_to(steps), F.col(TREE) == F.col("_g"), "left").drop("_g")
    split = split.withColumn("depth", F.when(F.col("_is"), F.floor(F.col("_i") / F.coalesce("_step", F.lit(1))).cast("int")))
    located = paths_in_order(split, "line_no", boundary="_base").where("_is").withColumn("_target", fields.unsafe_name(_unescaped(F.col("_to"))).cast("string"))
    op, target, mode = F.col("_op"), F.col("_target"), F.col("_m")
    located = located.withColumn("_flow", op.isin("<-", "<>") | ((op == "->") & fields.is_flow_target(target) & (F.col("_type") != "l")))
    flow = F.col("_flow")
    return located.select(
        TREE,
        F.col("line_no").alias("seq"),
        F.col("section_no").cast("int").alias("section_no"),
        F.col("base_id"),
        "depth",
        "name",
        F.substring(mode, 1, 1).alias("file_type"),
        permission_bits(mode).alias("perm"),
        "ts",
        "size",
        F.when(~flow, target).alias("link_target"),
        ids.parse_id(F.col("_id")).alias("content_id"),
        F.when(op.rlike("^->[0-9]+$"), F.substring(op, 3, 9).try_cast("int")).when((op == "->") & target.isNull(), F.lit(-1)).alias("hard_link"),
        F.when(flow, op).alias("flow_op"),
        F.when(flow, target).alias("flow_target"),
        "is_sequence",
        F.when(F.col("is_sequence"), F.col("name")).alias("pattern"),
        "is_orphan",
        "parent_path",
        "path",
        F.col("name").endswith("/").alias("is_dir"),
    )


def rejected(lines: DataFrame) -> DataFrame:
    """``manifest_id, line_no, field, message, raw``: lines that a strict reader refuses, each with the first reason (``REFUSED``).

    ``patch`` marks the id of a section that has no entries before the next id
    or the end, unless it is the first line with text (an external base). Blank
    lines, entries, ids and id lists aren't refused.
    """
    judged = _tokens(lines)
    said = F.element_at(F.create_map(*[F.lit(x) for pair in REFUSED.items() for x in pair]), F.col("_why"))
    bad = judged.where("_why IS NOT NULL").select(TREE, "line_no", F.col("_why").alias("field"), said.alias("message"), F.col("line").alias("raw"))
    text = judged.where("_k IN ('id', 'entry') AND _why IS NULL")
    held = last_seen(text, TREE, "line_no", {"_at": F.when(F.col("_k") == "id", F.col("line_no"))}, upto=True).where("_at IS NOT NULL").groupBy(TREE, F.col("_at").alias("line_no")).agg(F.count_if(F.col("_k") == "entry").alias("_n"))
    first = text.groupBy(TREE).agg(F.min("line_no").alias("_first"))
    empty = held.where("_n = 0").join(first, TREE).where("line_no <> _first").select(TREE, "line_no")
    raw = lines.select(TREE, "line_no", "line").distinct()
    return bad.unionByName(empty.join(raw, [TREE, "line_no"]).select(TREE, "line_no", F.lit("patch").alias("field"), F.lit("a patch without entries").alias("message"), F.col("line").alias("raw")))


def range_data(lines: DataFrame) -> DataFrame:
    """``manifest_id, content_id, members``: the id lists of manifest text, each under the id of its own text, which its sequence bears.

    They belong to no section and don't change a manifest's identity.
    """
    text = F.trim("line")
    return lines.where(ids.is_id_list(text)).select(TREE, ids.content_id(text).alias("content_id"), text.alias("members")).distinct()


def _indented(indent: int, line: Column | None) -> Column:
    return F.concat(F.repeat(F.lit(" " * indent), F.col("depth")), fields.canonical_line() if line is None else line)


def manifest_text(entries: DataFrame, indent: int = 2, line: Column | None = None, members: DataFrame | None = None) -> DataFrame:
    """``manifest_id, line_no, line``: entries as canonical text, in canonical order, indented by depth.

    ``line`` is the canonical line of an entry (over its columns). ``members``
    (as ``range_data`` gives them) are written behind the entries, in the order
    of their ids.
    """
    text = _indented(indent, line)
    key = [path_key(F.col("path")), F.col("path")]
    if members is None:
        return ranked(entries, TREE, key, "line_no", costly=True).select(TREE, "line_no", text.alias("line"))
    rows = entries.select(TREE, F.lit(0).alias("_k"), key[0].alias("_p"), key[1].alias("_q"), F.lit(None).cast("binary").alias("_c"), text.alias("line"))
    lists = members.select(TREE, F.lit(1).alias("_k"), F.lit("").alias("_p"), F.lit("").alias("_q"), F.col("content_id").alias("_c"), F.col("members").alias("line"))
    return ranked(rows.unionByName(lists), TREE, [F.col(c) for c in ("_k", "_p", "_q", "_c")], "line_no", costly=True).select(TREE, "line_no", "line")


def keyed_text(entries: DataFrame, indent: int = 2, line: Column | None = None) -> DataFrame:
    """``manifest_id, line`` as ``manifest_text`` has them, with the columns ``TEXT_ORDER`` by which lines stand instead of numbers; rows stay where they are."""
    return entries.select(TREE, *[k.alias(c) for c, k in zip(TEXT_ORDER, (path_key(F.col("path")), F.col("path")), strict=True)], _indented(indent, line).alias("line"))


def pretty_text(entries: DataFrame, identity: Column | None = None, name: Column | None = None) -> DataFrame:
    """``manifest_id, line_no, line`` for readers: sizes with commas in a column of one width, ids aligned.

    ``identity`` and ``name`` are the texts of id and name, as for ``canonical_line``.
    """
    dash = lambda c: F.coalesce(c, F.lit("-"))
    shown = fields.escape_name(fields.safe_name(F.col("name")) if name is None else name, F.col("is_sequence"))
    front = F.concat(
        F.repeat(F.lit("  "), F.col("depth")), F.rpad(dash(fields.mode_text(F.col("file_type"), F.col("perm"))), 10, " "), F.lit(" "), dash(F.date_format("ts", "MMM d HH:mm:ss yyyy")), F.lit(" ")
    )
    back = F.concat(F.lit(" "), shown, fields.link_text(F.col("link_target"), F.col("hard_link"), F.col("flow_op"), F.col("flow_target")))
    made = entries.select(TREE, "path", front.alias("_f"), dash(F.format_number("size", 0)).alias("_s"), back.alias("_b"), dash(ids.id_text(F.col("content_id")) if identity is None else identity).alias("_id"))
    placed = ranked(made, TREE, [path_key(F.col("path")), F.col("path")], "line_no")
    around = F.length("_f") + F.length("_b")
    widths = placed.groupBy(F.col(TREE).alias("_g")).agg(F.max(F.length("_s")).alias("_w"), F.max(around).alias("_n"))
    column = F.greatest(F.lit(80), (F.ceil((F.col("_n") + F.col("_w") + 10) / 10) * 10)).cast("int")
    head = F.concat("_f", F.lpad("_s", F.col("_w"), F.lit(" ")), "_b")
    return placed.join(broadcast_up_to(widths), F.col(TREE).eqNullSafe(F.col("_g"))).select(TREE, "line_no", F.concat(F.rpad(head, column, F.lit(" ")), "_id").alias("line"))


def write_text(lines: DataFrame, folder: str, files: int = 8) -> None:
    """Writes ``manifest_text`` lines, a folder with one file per manifest, in order."""
    ordered = lines.repartition(files, TREE).sortWithinPartitions(TREE, "line_no")
    ordered.select(TREE, "line").write.mode("overwrite").partitionBy(TREE).text(folder)


def path_list(entries: DataFrame) -> DataFrame:
    """Full paths in byte order."""
    return entries.select(TREE, "path").orderBy(TREE, "path")


def patch_text(delta: DataFrame, base_ids: DataFrame) -> DataFrame:
    """``manifest_id, line_no, line``: patches as text, each after the id of the state it applies to (``manifest_id, base_id``)."""
    body = manifest_text(delta)
    head = base_ids.select(TREE, F.lit(0).cast("bigint").alias("line_no"), ids.id_text(F.col("base_id")).alias("line"))
    return head.unionByName(body.select(TREE, F.col("line_no").cast("bigint").alias("line_no"), "line"))


def identify(lines: DataFrame, algorithm: str = "sha512", order: tuple[str, ...] = ("line_no",), together: bool = False) -> DataFrame:
    """``manifest_id, digest`` of files read as lines: a manifest is hashed in its canonical text, another file as it stands.

    Each file's lines are streamed through a hasher in their order, which finds
    out whether a manifest is its own canonical text; only those that aren't
    are read and written anew. ``order`` has the columns by which lines stand;
    ``together`` tells that a file's lines are in one partition already.
    A file's last line is taken to end in a newline, as ``read_lines`` can't
    tell whether it does.
    """
    placed = lines if together else lines.select(TREE, *order, "line").repartition(TREE)
    ordered = placed.sortWithinPartitions(TREE, *order).select(TREE, F.concat("line", F.lit("\n")).alias("line"))
    hashed = settle(ordered.mapInArrow(hash_files(algorithm), HASHED))
    others = hashed.where("digest IS NULL")
    if others.isEmpty():
        return hashed
    names = broadcast_up_to(others.select(F.col(TREE).alias("_o")))
    rest = lines.join(names, F.col(TREE).eqNullSafe(F.col("_o")), "left_semi")
    if tuple(order) != ("line_no",):
        rest = ranked(rest, TREE, [F.col(c) for c in order], "line_no")
    return hashed.where("digest IS NOT NULL").unionByName(_identify_anew(settle(rest.select(TREE, F.col("line_no").cast("bigint").alias("line_no"), "line")), algorithm))


def _identify_anew(lines: DataFrame, algorithm: str) -> DataFrame:
    """``identify`` of a table of lines by reading and writing the manifests among them."""
    kinds = broadcast_up_to(settle(sniff(lines).where("is_manifest").select(TREE)))
    manifests = lines.join(kinds, TREE, "left_semi")
    others = lines.join(kinds, TREE, "left_anti")
    canonical = manifest_text(read_entries(manifests))
    return text_digests(canonical.select(TREE, F.col("line_no").cast("bigint").alias("line_no"), "line").unionByName(others.select(TREE, "line_no", "line")), algorithm)
