"""Personal data and secrets: where they are, and how they read once masked.

Matches are located without leaving the JVM: the pattern wraps every match in control marks, the
text is cut at the marks, and offsets follow from the lengths of the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbrera.functions import text as T

# --- fixed values: labels, patterns and word lists ------------------------------------------------
TYPE_LABELS = {"dni": "DNI", "cuil": "CUIL/CUIT", "nombre_rotulado": "Nombre de una persona", "calificacion": "Calificación"}

_PARTICLE = r"(?:de|del|la|las|los|y)"
_UPPER_WORD = r"[A-ZÁÉÍÓÚÑÜ][A-Za-zÁÉÍÓÚÑÜáéíóúñü'\-]+"
_LOWER_WORD = r"[a-záéíóúñü][a-záéíóúñü'\-]+"
_NAME_LABEL = (
    r"(?i:\b(?:alumn[oa](?:/[oa]|\([oa]\))?s?|estudiantes?|pacientes?|ptes?\.?"
    r"|nombre(?:[ \t]+y[ \t]+apellidos?|[ \t]+completo)?|apellidos?(?:[ \t]+y[ \t]+nombres?)?))[ \t]*:[ \t]*"
)
_GRADES = (
    r"aprobad[oa]|desaprobad[oa]|insuficiente|suficiente|satisfactori[oa]|no[ \t]+satisfactori[oa]|bueno|muy[ \t]+bueno"
    r"|distinguido|sobresaliente|excelente"
)
# (type, label part, value part, what may follow), in order of priority where values overlap.
PII_PATTERNS = (
    ("cuil", r"(?i:\bCUI[LT]\b)[ \t]*(?i:n[°ºo]\.?|nro\.?)?[ \t]*[:#]?[ \t]*",
     r"\d{2}-?(?:\d{8}|\d{2}\.\d{3}\.\d{3})-?\d", r"(?![\d-])"),
    ("cuil", r"(?<![\d-])", r"(?:20|23|24|27|30|33|34)-(?:\d{8}|\d{2}\.\d{3}\.\d{3})-\d", r"(?![\d-])"),
    ("dni", r"(?i:\bD\.?[ \t]?N\.?[ \t]?I\b\.?|\bdocumento(?:[ \t]+nacional)?(?:[ \t]+de[ \t]+identidad)?\b)"
            r"[ \t]*(?i:n[°ºo]\.?|nro\.?|n[uú]mero)?[ \t]*[:#]?[ \t]*",
     r"\d{1,2}\.?\d{3}\.?\d{3}", r"(?![\d.]*\d)"),
    ("nombre_rotulado", _NAME_LABEL, rf"{_UPPER_WORD}(?:(?:[ \t]+{_PARTICLE})*[ \t]+{_UPPER_WORD}){{1,3}}", r""),
    ("nombre_rotulado", _NAME_LABEL, rf"{_LOWER_WORD}(?:(?:[ \t]+{_PARTICLE})*[ \t]+{_LOWER_WORD}){{1,3}}",
     r"[ \t]*(?=$|[,;|/\-–]|\.[ \t]*$)"),
    ("calificacion", r"(?i:\b(?:nota|calificaci[oó]n)(?:[ \t]+(?:final|obtenida|definitiva|del[ \t]+trimestre|trimestral"
                     r"|cuatrimestral|del[ \t]+parcial|parcial))?)[ \t]*[:=][ \t]*",
     rf"100|\d{{1,2}}(?:[.,]\d{{1,2}})?(?![\d.,]*\d)|(?i:{_GRADES})\b", r""),
)
LOWER_CASE_PATTERN = 4
PARTICLES = ("de", "del", "la", "las", "los", "y")
NOT_NAMES = (
    "de del la las los el y e o u un una unos unas con en para por que se su sus al a lo le les debe deben deberá "
    "deberán tiene tienen puede pueden va van es son está están hace hacen lee leen escribe escriben"
).split()
STRESSED_NAMES = ("josé", "noé", "renée", "andré", "rafaé")

HIDDEN = "[OCULTO]"
_HEADERS = r"authorization|proxy-authorization|cookie|set-cookie|x-api-key|api-key|x-auth-token"
# (pattern, replacement), applied in order.
SECRET_RULES = (
    (rf"(?i)\b({_HEADERS})(\s*[:=]\s*)([^\r\n'\"]+)", "$1$2" + HIDDEN),
    (rf"(?i)(\"(?:{_HEADERS})\"\s*:\s*\")([^\"]*)(\")", "$1" + HIDDEN + "$3"),
    (rf"(?i)(\"name\"\s*:\s*\"(?:{_HEADERS})\"\s*,\s*\"value\"\s*:\s*\")([^\"]*)(\")", "$1" + HIDDEN + "$3"),
    (r"(?i)(\"(?:[\w-]*token|password|passwd|secret|client_secret|api_key|apikey|key_value|raw_key)\"\s*:\s*\")([^\"]*)(\")", "$1" + HIDDEN + "$3"),
    (r"\b(Bearer|Basic)\s+[A-Za-z0-9._~+/=-]{8,}", "$1 " + HIDDEN),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", HIDDEN),
    (r"\b(?:sk|pk|rk)_(?:test|live)_[A-Za-z0-9]{10,}\b", HIDDEN),
    (r"\bAIza[0-9A-Za-z_-]{30,}\b", HIDDEN),
    (r"\bgsk_[A-Za-z0-9]{20,}\b", HIDDEN),
    (r"\bsk-[A-Za-z0-9_-]{20,}\b", HIDDEN),
    (r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{30,}\b|\bgithub_pat_[A-Za-z0-9_]{30,}\b", HIDDEN),
    (r"(?i)([?&](?:X-Amz-Signature|X-Amz-Credential|X-Amz-Security-Token|Signature|sig|token|access_token|api_key|key)=)[^&\s\"'#]+", "$1" + HIDDEN),
)
# ------------------------------------------------------------------------------------------------

_OPEN, _VALUE, _REST, _CLOSE = "\x01", "\x02", "\x03", "\x04"
_MARKS = _OPEN + _VALUE + _REST + _CLOSE
MATCH = "struct<start:int,end:int,type:string,value:string,label:string,rest:string>"


def _java(pattern: str) -> str:
    return pattern.replace("(?i:", "(?iu:")


def _matches(text: Column, kind: str, label: str, value: str, rest: str) -> Column:
    """All matches of one pattern, in order, with the offsets of the value."""
    pattern = f"(?Umd)({_java(label)})({_java(value)})({_java(rest)})"
    marked = F.regexp_replace(text, pattern, f"{_OPEN}$1{_VALUE}$2{_REST}$3{_CLOSE}")
    pieces = F.split(marked, _OPEN)
    start = F.struct(F.length(pieces[0]).alias("at"), F.array().cast(f"array<{MATCH}>").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        label_part = F.substring_index(piece, _VALUE, 1)
        value_part = F.substring_index(F.substring_index(piece, _REST, 1), _VALUE, -1)
        rest_part = F.substring_index(F.substring_index(piece, _CLOSE, 1), _REST, -1)
        begin = acc["at"] + F.length(label_part)
        hit = F.struct(
            begin.cast("int").alias("start"), (begin + F.length(value_part)).cast("int").alias("end"), F.lit(kind).alias("type"),
            value_part.alias("value"), label_part.alias("label"), rest_part.alias("rest"))
        return F.struct((acc["at"] + F.length(piece) - 3).alias("at"), F.concat(acc["found"], F.array(hit)).alias("found"))

    found = F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), start, step, lambda acc: acc["found"])
    return F.when(F.size(pieces) > 1, found).otherwise(F.array().cast(f"array<{MATCH}>"))


def accept_lowercase_name(value: Column) -> Column:
    """A lower-case value that reads as a name and not as an instruction."""
    words = T.spaced_words(value)
    edge = ~F.element_at(words, 1).isin(*PARTICLES) & ~F.element_at(words, -1).isin(*PARTICLES)
    own = F.filter(words, lambda w: ~w.isin(*PARTICLES))
    return edge & F.forall(own, lambda w: ~w.isin(*NOT_NAMES) & (~F.right(w, F.lit(1)).isin("á", "é", "í") | w.isin(*STRESSED_NAMES)))


def resolve_overlaps(found: Column) -> Column:
    """Matches in priority order, without those whose value touches an earlier one."""
    return F.aggregate(
        found, F.array().cast(f"array<{MATCH}>"),
        lambda kept, m: F.when(
            F.exists(kept, lambda k: (m["start"] < k["end"]) & (k["start"] < m["end"])), kept
        ).otherwise(F.concat(kept, F.array(m))))


def personal_data(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``out``: personal data of a text column in order of appearance, one narrow step per pattern."""
    text = F.translate(F.coalesce(column, F.lit("")), _MARKS, " " * len(_MARKS))
    names = []
    for i, (kind, label, value, rest) in enumerate(PII_PATTERNS):
        found = _matches(text, kind, label, value, rest)
        names.append(f"_pii{i}")
        df = df.withColumn(names[-1], F.filter(found, lambda m: accept_lowercase_name(m["value"])) if i == LOWER_CASE_PATTERN else found)
    kept = df.withColumn("_all", F.concat(*names)).withColumn("_kept", F.when(F.size("_all") > 1, resolve_overlaps(F.col("_all"))).otherwise(F.col("_all")))
    return kept.withColumn(out, F.array_sort("_kept")).drop("_all", "_kept", *names)


def _inner_digits_hidden(value: Column) -> Column:
    """All digits but the first and the last become stars."""
    part = lambda i: F.regexp_extract(value, r"(?Us)^(\D*\d)(.*)(\d\D*)$", i)
    return F.concat(part(1), F.regexp_replace(part(2), r"(?U)\d", "*"), part(3))


def mask(kind: Column, value: Column) -> Column:
    """Digits keep the first and the last, names their initials, anything else shows nothing."""
    digits = F.when(
        F.regexp_count(value, F.lit(r"(?U)\d")) <= 2, F.regexp_replace(value, r"(?U)\d", "*")
    ).otherwise(_inner_digits_hidden(value))
    name = F.array_join(F.transform(T.spaced_words(value), lambda w: F.concat(F.left(w, F.lit(1)), F.lit("***"))), " ")
    return F.when(kind.isin("dni", "cuil"), digits).when(kind == "nombre_rotulado", name).otherwise(F.lit("***"))


def _careful(pattern: str, replacement: str):
    """Rewrites a piece that starts with a match, unless the match already holds a hidden value."""

    def piece(text: Column, i: Column) -> Column:
        match = F.substring_index(text, _CLOSE, 1)
        after = F.right(text, F.length(text) - F.length(match) - 1)
        hidden = F.when(F.contains(match, F.lit(HIDDEN)), match).otherwise(F.regexp_replace(match, pattern, replacement))
        return F.when(i == 0, text).otherwise(F.concat(hidden, after))

    return piece


def redact(df: DataFrame, column: str) -> DataFrame:
    """Adds redacted and hidden: the text without secrets and how many were hidden.

    A match that already holds a hidden value is left alone and not counted again. Each rule is a
    stage of its own, so the text of one step is computed once.
    """
    df = df.withColumns({"redacted": F.col(column), "hidden": F.lit(0)})
    for pattern, replacement in SECRET_RULES:
        text = F.col("redacted")
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        fresh = F.size(F.filter(found, lambda m: ~F.contains(m, F.lit(HIDDEN))))
        pieces = F.split(F.regexp_replace(text, pattern, _OPEN + "$0" + _CLOSE), _OPEN)

        redone = F.when(F.contains(text, F.lit(HIDDEN)), F.array_join(F.transform(pieces, _careful(pattern, replacement)), "")).otherwise(
            F.regexp_replace(text, pattern, replacement))
        df = df.withColumns({"hidden": F.col("hidden") + fresh, "redacted": redone})
    return df
