"""P9: one form for texts that look the same.

DuckDB runs inside the Arrow partitions: every batch is a table to one embedded SQL statement of ``translate``,
``regexp_replace`` and ``nfc_normalize``.  In that order it unifies line breaks, drops what shows nothing, turns every
blank and hyphen into the plain one, maps widths, ligatures and look-alike letters, and composes accents.  Letter
case, accents, line breaks and every other visible difference stay.

The mapping tables are made from Unicode properties by rule; only the look-alike letters are listed.

Defined cases: null stays null; a text with nothing visible has the empty form; a text of any length is one row, and a
statement works on ``SLICE_BYTES`` of text at a time; a row without a key is in no pair; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import shared_checkpoint, spread

#: Bytes of text one statement works on; rows of a form in one block of the pair join.
SLICE_BYTES = 4_000_000
BLOCK_ROWS = 4_000

# Letters of other alphabets with the shape of a Latin letter, each followed by that letter.
LOOK_ALIKES = {
    "Cyrillic": "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԌG ԚQ ԜW ӀI аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw үy ӏl",
    "Greek": "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ϳj οo νv ϲc",
    "Armenian": "ՕO ՍU օo սu հh ոn ցg",
}
# Hyphens, by name HYPHEN, and the marks drawn the same way.
HYPHENS = "‐‑⁃֊﹣－"
#: Stands for a zero-width joiner between two emoji, where it does change what is seen.
_JOINED = ""
_EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]"


@lru_cache(maxsize=1)
def tables() -> tuple[str, str, list[tuple[str, str]], str]:
    """Single-character mapping (from, to), ligatures with their letters, and what shows nothing."""
    single: dict[str, str] = {}
    several: list[tuple[str, str]] = []
    unseen: list[str] = []
    alike = {p[0]: p[1] for line in LOOK_ALIKES.values() for p in line.split()}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        category = unicodedata.category(c)
        if category in ("Cn", "Co", "Cs"):
            continue
        parts = unicodedata.decomposition(c).split()
        if category == "Zs":
            single[c] = " "
        elif category in ("Cf", "Cc") or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5):
            if code not in (0x85, 0x200D):
                unseen.append(c)
        elif parts and parts[0] in ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>") or parts and parts[0] == "<compat>" and category[0] == "L" and code >= 0xFB00 or code in (0x132, 0x133, 0x149, 0x1C4, 0x1C5, 0x1C6, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC, 0x1F1, 0x1F2, 0x1F3):
            plain = unicodedata.normalize("NFKC", c)
            plain = "".join(alike.get(p, p) for p in plain)
            if len(plain) == 1:
                single[c] = plain
            elif code < 0x250 or 0xFB00 <= code <= 0xFB17:  # ligatures and digraphs
                several.append((c, plain))
        elif parts and not parts[0].startswith("<") and (whole := unicodedata.normalize("NFD", c))[0] in alike:
            plain = unicodedata.normalize("NFC", alike[whole[0]] + whole[1:])
            if len(plain) == 1:
                single[c] = plain
            elif code < 0x1F00:
                several.append((c, plain))
    single.update(alike)
    single.update(dict.fromkeys(HYPHENS, "-"))
    return "".join(single), "".join(single.values()), several, "".join(unseen)


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _class(characters: str) -> str:
    """A regular-expression class of the characters, as ranges."""
    codes, ranges = sorted(map(ord, characters)), []
    for c in codes:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


@lru_cache(maxsize=1)
def form_sql(text: str = "text") -> str:
    """The DuckDB expression of the consistent form of ``text``."""
    source, target, several, unseen = tables()
    sql = rf"regexp_replace({text}, '\r\n|[\r\x{{85}}\x{{2028}}\x{{2029}}\x0b\x0c]', chr(10), 'g')"
    for _ in range(2):  # neighbouring pairs share an emoji
        sql = rf"regexp_replace({sql}, '({_EMOJI}[\x{{FE0F}}\x{{1F3FB}}-\x{{1F3FF}}]?)\x{{200D}}({_EMOJI})', '\1{_JOINED}\2', 'g')"
    sql = f"regexp_replace({sql}, '{_class(unseen + chr(0x200D) + ''.join(map(chr, [*range(0, 9), *range(0xE, 0x20), 0x7F])))}', '', 'g')"
    sql = f"nfc_normalize({sql})"
    sql = f"translate({sql}, {_literal(chr(9) + source)}, {_literal(' ' + target)})"
    for c, plain in several:
        sql = f"replace({sql}, {_literal(c)}, {_literal(plain)})"
    sql = f"replace(nfc_normalize({sql}), '{_JOINED}', chr(8205))"
    sql = rf"regexp_replace({sql}, ' +(\n|$)', '\1', 'g')"
    return rf"regexp_replace({sql}, '^\s+|\s+$', '', 'g')"


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``most`` bytes of text each; a longer text is a part of its own."""
    begin = held = 0
    for at, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if at > begin and held + size > most:
            yield batch.slice(begin, at - begin)
            begin, held = at, 0
        held += size
    yield batch.slice(begin)


def consistent(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``text`` and its consistent ``form``, one row per row, without a shuffle."""
    statement = f"SELECT k, t, {form_sql('t')} AS f FROM batch"
    source = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        connection = duckdb.connect(config={"threads": 1})
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for part in _slices(batch, 1, SLICE_BYTES):
                connection.register("batch", pa.Table.from_batches([part]))
                got = connection.execute(statement).to_arrow_table()
                connection.unregister("batch")
                got = got.cast(pa.schema([pa.field(got.schema[0].name, batch.schema.field(0).type), pa.field("t", pa.string()), pa.field("f", pa.string())]))
                yield from got.to_batches()

    ship_package(documents.sparkSession)
    kind = dict(documents.dtypes)[key]
    out = source.mapInArrow(run, f"k {kind}, t string, f string")
    return out.select(F.col("k").alias(key), F.col("t").alias(text), F.col("f").alias("form"))


def _visible(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Key and SHA-256 of form and text of every row with visible text, written once: forms are worked out in one pass."""
    hashed = consistent(documents, key, text).where("form <> ''").select(
        F.col(key).alias("doc"), F.unhex(F.sha2("form", 256)).alias("form"), F.unhex(F.sha2(text, 256)).alias("raw")
    )
    return shared_checkpoint(hashed)


def _several(hashed: DataFrame) -> DataFrame:
    """Forms that more than one string has; map-side combining keeps millions of exact copies out of the shuffle."""
    return hashed.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("form")


def look_alike_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of rows with visible text that look the same without being the same string, smaller key first.

    Texts are compared by SHA-256.  A form that only one string has is dropped before anything is joined, so a text of which there are millions of exact
    copies makes no pairs, and a form with more than ``block_rows`` rows is cut into blocks.  Pairs are what this query gives; ``look_alike_classes``
    gives one row per document instead.
    """
    hashed = _visible(documents, key, text)
    members = hashed.join(_several(hashed), "form", "left_semi").distinct()
    a, b = spread(members, members, ["form"], "doc", block_rows)
    a, b = a.alias("a"), b.alias("b")
    return (
        a.join(b, [F.col(f"a.{n}") == F.col(f"b.{n}") for n in ("form", "block")])
        .where("a.doc < b.doc AND a.raw <> b.raw")
        .select(F.col("a.doc").alias("doc_a"), F.col("b.doc").alias("doc_b"))
        .distinct()
    )


def look_alike_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document that looks like another string: its class (the smallest key of the form), the class's members, and its links, which are
    the members with another string."""
    members = (hashed := _visible(documents, key, text)).join(_several(hashed), "form", "left_semi").where("doc IS NOT NULL").distinct()
    copies = members.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("copies"), F.min("doc").alias("first"))
    sizes = copies.groupBy("form").agg(F.sum("copies").alias("members"), F.min("first").alias("class_id"))
    return (
        members.join(copies.drop("first"), ["form", "raw"]).join(sizes, "form")
        .select(F.col("doc").alias(key), "class_id", "members", (F.col("members") - F.col("copies")).alias("links"))
    )
