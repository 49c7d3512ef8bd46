"""One consistent form for text that looks the same but differs in its characters.

``visual_form`` maps compatibility forms, kinds of blanks and hyphens,
look-alike letters and invisible characters, and composes accents and
syllables, in SQL that DuckDB runs inside Arrow partitions. ``look_alikes``
finds the rows of a group whose texts have one form but differ.
"""

from __future__ import annotations

import functools
import string
import sys
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boughline.operators.common import broadcast_up_to, discard, settle

# Letters of other scripts and the letter each has the shape of.
LOOK_ALIKES = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХҮӀԌԚԜѴаеѕіјорсухүԁԛԝһӏѵ", "ABESIJKMHOPCTYXYIGQWVaesijopcyxydqwhlv"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿονρϲϳ", "ABEZHIKMNOPTYXCJovpcj"),
    "Armenian": ("ՕՍօսոհ", "OUounh"),
    "Latin variants": ("ɑɡ", "ag"),
    "Coptic": ("ⲞⲢⲤⲟⲣⲥ", "OPCopc"),
    "Cherokee": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏙᏚᏞᏟᏢᏦ", "DRTAJEWMHGZRWVSLCPK"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "Kana and ideographs": ("力口工二卜八夕へ一", "カロエニトハタヘー"),
}
# Marks of the dash class that are drawn as waves, and hyphen signs outside of it.
WAVES = "〜〰"
HYPHENS = "−⁃˗"
# Characters without a shape that aren't of the format class.
SHAPELESS = [(0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF)]
# Format characters with a shape.
SHAPED = set(range(0x600, 0x606)) | {0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Arrow rows that are converted at a time.
BATCH_TEXTS = 20_000
#: Keys (of 16 bytes) up to which those with different texts are broadcast; beyond it rows are shuffled to them.
KEYS_BROADCAST = 1_000_000
#: Characters that one expression writes out; more take several.
MOST_REPLACED = 150


class Rules(NamedTuple):
    """One-to-one mappings, one-to-many mappings and invisible characters."""

    one: dict[str, str]
    many: dict[str, str]
    gone: frozenset[str]


#: Scripts whose letters are no other script's look-alikes here: Latin is what others are mapped to, the rest have ``LOOK_ALIKES``.
_OWN_SHAPES = regex.compile(r"[\p{Latin}\p{Han}\p{Hangul}\p{Hiragana}\p{Katakana}\p{Common}\p{Inherited}]")


@functools.cache
def shapes(spark: SparkSession) -> tuple[tuple[str, str], ...]:
    """Letters of other scripts and the letter each has the shape of, by Unicode's table of confusables (UTS 39).

    The table is the one of the ICU library that Spark ships, asked once on the
    driver for all letters together. Several letters that it takes for one (as
    ``I``, ``l`` and ``1``) stay apart: capitals are mapped to ``I``, others to ``l``.
    """
    letters = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo", "Lm") and unicodedata.normalize("NFKD", c) == c and not _OWN_SHAPES.match(c)]
    plain = string.ascii_letters
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    found = checker.getSkeleton("\n".join([*plain, *letters])).split("\n")
    ascii_of = dict(zip(found, plain, strict=False))
    out = []
    for c, like in zip(letters, found[len(plain) :], strict=True):
        to = ascii_of.get(like, like)
        if to in "Il":
            to = "I" if unicodedata.category(c) == "Lu" else "l"
        if len(to) == 1 and to != c and unicodedata.category(to)[0] == "L":
            out.append((c, to))
    return tuple(out)


@functools.cache
def rules(more: tuple[tuple[str, str], ...] = ()) -> Rules:
    """The mappings, built from the Unicode tables, ``LOOK_ALIKES``, and ``more`` letters with their shapes."""
    alike = dict(more) | {a: b for frm, to in LOOK_ALIKES.values() for a, b in zip(frm, to, strict=True)}
    alike = {a: alike.get(b, b) for a, b in alike.items()}
    one: dict[str, str] = {}
    many: dict[str, str] = {}
    gone = {chr(i) for a, b in SHAPELESS for i in range(a, b + 1)}
    for i in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= i <= 0xD7A3 or 0xD800 <= i <= 0xF8FF or 0x20000 <= i <= 0x2F7FF or 0x2FA20 <= i < 0xE0000 or i > 0xE01EF:
            continue  # syllables, private use and plain ideographs are settled by composition alone
        c = chr(i)
        kind = unicodedata.category(c)
        if kind == "Cf" and i not in SHAPED:
            gone.add(c)
        if c in gone or kind == "Cn":
            continue
        if kind == "Zs":
            to = " "
        elif (kind == "Pd" and c not in WAVES) or c in HYPHENS:
            to = "-"
        else:
            to = unicodedata.normalize("NFKD", c)
            to = unicodedata.normalize("NFC", "".join(alike.get(x, x) for x in to))
            to = "".join("-" if x in HYPHENS or (unicodedata.category(x) == "Pd" and x not in WAVES) else x for x in to)
        if to != c and to != unicodedata.normalize("NFC", c):
            (one if len(to) == 1 else many)[c] = to
    return Rules(one, many, frozenset(gone))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def form_sql(column: str, chars: set[str], rules: Rules) -> str:
    """The DuckDB expression that brings ``column`` to its form; ``chars`` are the characters that may occur."""
    one, _, gone = rules
    sql = column
    invisible = sorted(c for c in chars if c in gone)
    if invisible:
        sql = f"regexp_replace({sql}, '[' || {_quoted(''.join(invisible))} || ']', '', 'g')"
    single = sorted(c for c in chars if c in one)
    if single:
        sql = f"translate({sql}, {_quoted(''.join(single))}, {_quoted(''.join(one[c] for c in single))})"
    return f"nfc_normalize({sql})"


def expansion_sql(column: str, chars: list[str], rules: Rules) -> str:
    """The DuckDB expression that writes characters of several letters out."""
    sql = column
    for c in chars:
        sql = f"replace({sql}, {_quoted(c)}, {_quoted(rules.many[c])})"
    return sql


@functools.cache
def _duckdb():
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1")
    return con


def visual_forms(texts: pa.Array, known: Rules | None = None) -> pa.Array:
    """The forms of a column of texts; each distinct text is converted once, NULL stays NULL."""
    known = rules() if known is None else known
    coded = texts.cast(pa.string()).dictionary_encode()
    distinct = coded.dictionary
    forms = []
    for k in range(0, len(distinct), BATCH_TEXTS):
        part = distinct.slice(k, BATCH_TEXTS)
        table = pa.table({"i": pa.array(range(len(part)), pa.int32()), "t": part})
        rest = {c for c in set("".join(part.to_pylist())) if c > "\x7f"}
        many = sorted(c for c in rest if c in known.many)
        steps = [expansion_sql("t", many[n : n + MOST_REPLACED], known) for n in range(0, len(many), MOST_REPLACED)]
        con = _duckdb()
        for step in [*steps, form_sql("t", rest, known)]:
            con.register("texts", table)
            table = con.sql(f"SELECT i, {step} AS t FROM texts ORDER BY i").to_arrow_table()
            con.unregister("texts")
        forms.append(table.column("t").combine_chunks().cast(pa.string()))
    if not forms:
        return pa.nulls(len(texts), pa.string())
    joined = pa.chunked_array(forms).combine_chunks()
    if isinstance(joined, pa.ChunkedArray):
        joined = pa.concat_arrays(joined.chunks)
    return joined.take(coded.indices)


@functools.cache
def _form_udf(spark: SparkSession):
    shared = spark.sparkContext.broadcast(tuple(rules(shapes(spark))))  # tables of the Unicode standard's size

    @F.arrow_udf("string")
    def form(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Rules(*shared.value)
        for batch in batches:
            yield visual_forms(batch, known)

    return form


def visual_form(text: Column) -> Column:
    """The consistent form of a text; NULL for NULL, '' for ''.

    Texts that differ only in composed or decomposed accents or syllables, the
    order of accents, full-width or half-width forms, invisible characters,
    kinds of blanks or hyphens, ligatures or other compatibility characters,
    or letters of other scripts with the same shape have one form. Case,
    accents and ASCII characters are kept, so printable ASCII text is its own
    form and never leaves the JVM. Whole texts are converted, of any length.
    Shapes are those of ``shapes`` and ``LOOK_ALIKES``; the rules are made once
    on the driver of the active session and broadcast.
    """
    plain = text.rlike("^[ -~]*$")
    return F.when(plain, text).otherwise(_form_udf(SparkSession.getActiveSession())(F.when(~plain, text)))


def consistent_names(entries: DataFrame) -> DataFrame:
    """Adds ``name_form`` and ``link_target_form`` to entries; existing columns of these names are replaced."""
    return entries.withColumn("name_form", visual_form(F.col("name"))).withColumn("link_target_form", visual_form(F.col("link_target")))


def _placed(entries: DataFrame) -> DataFrame:
    """``h, g, manifest_id, seq, parent, text, link``: each name and each link target of entries under the digest of (manifest, form of its full path)."""
    known = entries.where("manifest_id IS NOT NULL AND seq IS NOT NULL AND name IS NOT NULL").select("manifest_id", "seq", F.coalesce("parent_path", F.lit("")).alias("parent_path"), "name", "link_target")
    form = lambda c: F.coalesce(visual_form(F.col(c)), F.lit(""))
    # Nothing composes with a slash, so a path has the form of its parts; directories repeat, so their forms are made once a batch.
    formed = known.select("manifest_id", "seq", "parent_path", "name", "link_target", F.concat(form("parent_path"), form("name")).alias("_form"), visual_form(F.col("link_target")).alias("_target"))
    digest = lambda c, salt: F.xxhash64("manifest_id", c, F.lit(salt))
    own = F.struct(
        digest(F.col("_form"), 1).alias("h"), digest(F.col("_form"), 2).alias("g"), F.xxhash64("parent_path").alias("parent"), F.xxhash64(F.concat("parent_path", "name")).alias("text"), F.lit(False).alias("link")
    )
    target = F.struct(digest(F.col("_target"), 1).alias("h"), digest(F.col("_target"), 2).alias("g"), F.lit(0).cast("bigint").alias("parent"), F.xxhash64("link_target").alias("text"), F.lit(True).alias("link"))
    both = F.when(F.col("link_target").isNull(), F.array(own)).otherwise(F.array(own, target))
    return formed.select("manifest_id", "seq", F.explode(both).alias("r")).select("manifest_id", "seq", "r.*")


def _mixed(entries: DataFrame) -> DataFrame:
    """The rows of ``_placed`` whose key is also another text's: forms are made once, and only these rows move."""
    rows = settle(_placed(entries))
    # Copies, and all rows of a key, are combined before they travel.
    keys = rows.groupBy("h", "g").agg(F.min("text").alias("_least"), F.max("text").alias("_most")).where("_least <> _most").select("h", "g")
    keys = broadcast_up_to(settle(keys), KEYS_BROADCAST)
    mixed = settle(rows.join(keys, ["h", "g"], "left_semi").distinct())
    discard(rows)
    return mixed


def look_alikes(entries: DataFrame) -> DataFrame:
    """Pairs ``manifest_id, seq_a, seq_b`` of entries of one manifest that look alike but differ.

    Either both have one ``parent_path`` and their names differ but have one
    form, or the ``link_target`` of one differs from the ``path`` of the other
    but has its form. The key of both is (manifest, form of the full path),
    as a 128-bit digest: one aggregate finds the keys with different texts,
    and only rows of those move and are joined.
    No pair is lost and equal texts are never paired, however many share a key.

    Repeated rows give no more pairs. Rows with a NULL manifest, seq or name
    are never paired; a NULL parent is the root. Other columns don't matter.
    """
    mixed = _mixed(entries)
    a, b = mixed.where("NOT link").alias("a"), mixed.alias("b")
    match = (F.col("a.h") == F.col("b.h")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.text") != F.col("b.text")) & (F.col("a.manifest_id") == F.col("b.manifest_id"))
    match &= F.when(F.col("b.link"), F.col("a.seq") != F.col("b.seq")).otherwise((F.col("a.seq") < F.col("b.seq")) & (F.col("a.parent") == F.col("b.parent")))
    pairs = a.join(b, match).select(F.col("a.manifest_id").alias("manifest_id"), F.least("a.seq", "b.seq").alias("seq_a"), F.greatest("a.seq", "b.seq").alias("seq_b"))
    return pairs.distinct()


def look_alike_classes(entries: DataFrame) -> DataFrame:
    """``manifest_id, seq, representative, link``: membership instead of pairs, for classes of any size.

    All entries (``link`` false) and link targets (true) of one key are one
    class, under the smallest ``seq`` among its entries, or its targets where it has none.
    """
    mixed = _mixed(entries)
    least = F.coalesce(F.min(F.when(~F.col("link"), F.col("seq"))), F.min("seq")).alias("representative")
    heads = mixed.groupBy("manifest_id", "h", "g").agg(least)
    return mixed.join(heads, ["manifest_id", "h", "g"]).select("manifest_id", "seq", "representative", "link").distinct()
