"""Character references of HTML, decoded inside the JVM."""

from __future__ import annotations

import json
from collections import defaultdict
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

_LONGEST_BARE = max(len(n) for n in html5 if not n.endswith(";"))


def _by_letter(names: dict[str, str]) -> Column:
    """name -> text as a map of maps, by first letter; constant, so it is built once."""
    grouped: dict[str, dict[str, str]] = defaultdict(dict)
    for name, text in names.items():
        grouped[name[0]][name] = text
    return F.from_json(F.lit(json.dumps(grouped)), "map<string, map<string, string>>")


def _windows_1252() -> dict[int, str]:
    """What the numbers 128 to 159 stand for in pages: the characters of Windows-1252, where there is one."""
    return {b: bytes([b]).decode("cp1252") for b in range(128, 160) if bytes([b]).decode("cp1252", "ignore")}


def _character(code: Column) -> Column:
    """The character with a code point; NULL for those that none has."""
    old = F.try_element_at(F.create_map(*[F.lit(x) for pair in _windows_1252().items() for x in pair]), code.cast("int"))
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.coalesce(old, F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))


def _decoded(piece: Column) -> Column:
    """The text after an ampersand with the reference at its beginning decoded, or the ampersand put back."""
    hexed = F.regexp_extract(piece, r"^#[xX]0*([0-9a-fA-F]{1,6})(?![0-9a-fA-F])", 1)
    plain = F.regexp_extract(piece, r"^#0*([0-9]{1,7})(?![0-9])", 1)
    code = F.when(hexed != "", F.conv(hexed, 16, 10).cast("long")).when(plain != "", plain.cast("long"))
    numeric = F.concat(_character(code), F.regexp_replace(piece, r"^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", ""))
    name = F.regexp_extract(piece, r"^[A-Za-z][A-Za-z0-9]*;", 0)
    letter = F.left(piece, F.lit(1))
    closed = _by_letter({n: t for n, t in html5.items() if n.endswith(";")})
    named = F.concat(F.try_element_at(F.try_element_at(closed, letter), name), F.substr(piece, F.length(name) + 1))
    bare = F.try_element_at(_by_letter({n: t for n, t in html5.items() if not n.endswith(";")}), letter)
    shorter = [F.concat(F.try_element_at(bare, F.left(piece, F.lit(n))), F.substr(piece, F.lit(n + 1))) for n in range(_LONGEST_BARE, 1, -1)]
    return F.coalesce(numeric, F.when(name != "", named), F.when(letter.rlike("[A-Za-z]"), F.coalesce(*shorter)), F.concat(F.lit("&"), piece))


def decode_references(text: Column) -> Column:
    """``text`` with its named and numeric character references decoded, once.

    Names end with a semicolon; the old ones may lack it, and then the longest that fits counts. Numbers that
    no character has, and names that HTML does not know, stay as they are.
    """
    pieces = F.split(text, "&")
    rest = F.transform(F.slice(pieces, 2, F.size(pieces)), _decoded)
    return F.when(F.contains(text, F.lit("&")), F.concat(pieces[0], F.array_join(rest, ""))).otherwise(text)
