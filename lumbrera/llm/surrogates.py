"""Surrogates for personal data: keyed, type-consistent replacements that keep distinct things distinct.

1. One pattern finds the mentions of a text from left to right: secrets, e-mail addresses, IP
   addresses, account and card numbers, telephone numbers, and names after a form of address.
2. A mention is cut into a label that stays and parts with a kind. What identifies a part is its
   canonical form (letters in lower case, digits without punctuation), so the same thing written
   differently gets the same surrogate, in every document.
3. The surrogate of a part follows from SHA-512 over key, kind, canonical form and attempt. It has the
   same length and classes of characters, letters of the same script, the mention's own punctuation
   and letter case; a number with a valid check digit gets a valid one; octets stay octets; a given
   name is drawn for the script of the name and the gender of its forms of address in the whole corpus,
   so that a person is one with and without a gendered form: none if there are both or neither.
4. Collisions are looked for over the whole corpus: two different parts with one surrogate, or a
   surrogate that is a real part of the corpus, given names and surnames taken together. All but one of the parts that collide, and the parts
   whose surrogate is real, go on to their next attempt until none is left. Only attempts above 0
   and genders that differ from the form of address are carried back to documents, as a table that is
   empty or small beside the corpus.
5. Every part changes: letters of other scripts become Latin ones, and the signs of a part without
   letters and digits become letters. From attempt ``PLAIN_ATTEMPTS`` on a surrogate is longer than its
   part by one letter or digit an attempt, so there is always room for the parts of a short format. Only
   addresses keep their four octets: 254 ** 4 surrogates, for more distinct ones than 30 GB can write.

An e-mail domain has at most 41 labels here.

Defined cases: null text stays null, empty text stays empty; text without mentions is returned
unchanged; repeated rows get equal results; null ids are allowed; columns of the input stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbrera.llm.shared import written

# --- fixed values: what a mention looks like, and alphabets ---------------------------------------
SECRET_LABEL = r"""(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\s{0,4}[:=]\s{0,4}["']?"""
MALE = "Mr|Sir|Herr|Monsieur|Señor|Г-н|Господин|Κύριος"
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mademoiselle|Señora|Señorita|Г-жа|Госпожа|Κυρία"
TITLE = rf"(?:{MALE}|{FEMALE}|Dr|Prof)\b\.?[ \t]{{1,3}}"
NAME = r"\p{Lu}[\p{L}'’-]+(?:[ \t]\p{Lu}[\p{L}'’-]+){0,2}"
KEYS = "(?:sk|pk|rk|ghp|gho|ghs|xox[abp]|AKIA|AIza|eyJ)[_-]?[A-Za-z0-9_-]{16"
PATTERNS = {
    "secret": rf"""(?<![\p{{L}}\p{{Nd}}_]){SECRET_LABEL}[A-Za-z0-9+/=._~-]{{8,}}|(?<![A-Za-z0-9])(?:[0-9a-f]{{32,128}}|[0-9A-F]{{32,128}}|{KEYS},}})(?![A-Za-z0-9])""",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,40}[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "number": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|\+[0-9]{8,15}(?![0-9])",
    "name": rf"(?<![\p{{L}}\p{{Nd}}]){TITLE}{NAME}",
}
# Every pattern implies this: without digits, only a key or a run of hexadecimal letters is a secret without a label.
SUSPECT = rf"[0-9@]|[a-f]{{32}}|[A-F]{{32}}|(?<![A-Za-z0-9]){KEYS}}}|(?i:token|secret|passw|pwd|key)|(?<!\p{{L}})(?:" + MALE + "|" + FEMALE + r"|Dr|Prof)\b"
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω")
SCRIPTS = (r"^[\p{IsLatin}]", r"^\p{IsCyrillic}", r"^\p{IsGreek}")
GIVEN = {
    ("m", 0): "adam alan bruno carl david eric felix hugo ivan jonas leon marco nils oscar paul simon".split(),
    ("f", 0): "ada alma clara diana elena emma greta helen irene julia laura maria nora olga paula vera".split(),
    ("m", 1): "антон борис виктор глеб денис егор иван кирилл лев максим олег павел роман семён тимур юрий".split(),
    ("f", 1): "алла анна вера галина дарья елена зоя ирина лидия мария нина ольга раиса софия тамара юлия".split(),
    ("m", 2): "αλέξης γιώργος δημήτρης κώστας λεωνίδας μανώλης νίκος παύλος".split(),
    ("f", 2): "άννα βασιλική δήμητρα ελένη ζωή ιωάννα κατερίνα μαρία".split(),
}
PLAIN_ATTEMPTS = 4  # attempts at the length of the part
SIGNS = "._~=+/%-"  # what a secret or the local part of an e-mail address can have besides letters and digits
# ------------------------------------------------------------------------------------------------

FOUND = "|".join(f"(?:{p})" for p in PATTERNS.values())
PART = "struct<kind:string,written:string,canon:string>"


def mentions(text: Column) -> Column:
    """Matched pieces from left to right; none where nothing in the text can be personal data."""
    return F.when(F.coalesce(F.regexp_like(text, F.lit(SUSPECT)), F.lit(False)), F.regexp_extract_all(text, F.lit(FOUND), F.lit(0))).otherwise(
        F.array().cast("array<string>"))


def _kind(value: Column) -> Column:
    out = F.lit("secret")
    for kind in reversed([k for k in PATTERNS if k != "secret"]):
        out = F.when(F.regexp_like(value, F.lit(f"^(?:{PATTERNS[kind]})$")), F.lit(kind)).otherwise(out)
    return F.when(F.regexp_like(value, F.lit(f"^(?:{PATTERNS['secret']})$")), F.lit("secret")).otherwise(out)


def _label(value: Column, kind: Column) -> Column:
    return F.when(kind == "secret", F.regexp_extract(value, f"^({SECRET_LABEL})", 1)).when(kind == "name", F.regexp_extract(value, f"^({TITLE})", 1)).otherwise(F.lit(""))


def _parts(body: Column, kind: Column, label: Column) -> Column:
    gender = F.when(F.regexp_like(label, F.lit(rf"^(?:{MALE})\b")), F.lit("given_m")).when(F.regexp_like(label, F.lit(rf"^(?:{FEMALE})\b")), F.lit("given_f")).otherwise(F.lit("given"))
    words = F.split(body, "[ \t]")
    named = F.transform(words, lambda w, i: F.struct(
        F.when((i == 0) & (F.size(words) > 1), gender).otherwise(F.lit("surname")).alias("kind"), w.alias("written"), F.lower(w).alias("canon")))
    plain = F.when(kind.isin("number", "phone", "ssn"), F.regexp_replace(body, "[^0-9+]", "")).when(kind == "iban", F.regexp_replace(body, " ", "")).otherwise(F.lower(body))
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), body.alias("written"), plain.alias("canon"))))


def analysed(values: Column) -> list[tuple[str, Column]]:
    """Steps from mentions to (label, parts), each a column of its own so that nothing is computed twice."""
    return [
        ("_kinds", F.transform(values, lambda v: F.struct(v.alias("value"), _kind(v).alias("kind")))),
        ("_labels", F.transform("_kinds", lambda x: F.struct(x["value"].alias("value"), x["kind"].alias("kind"), _label(x["value"], x["kind"]).alias("label")))),
        ("_mentions", F.transform("_labels", lambda x: F.struct(x["label"].alias("label"), _parts(
            F.substring(x["value"], F.length(x["label"]) + 1, F.length(x["value"])), x["kind"], x["label"]).alias("parts")))),
    ]


def _draw(stream: Column, i: Column, n: int) -> Column:
    """A number below ``n`` from the i-th two bytes of a hexadecimal stream."""
    at = F.pmod(i, F.lit(64)) * 4 + 1
    return F.pmod(F.conv(F.substring(stream, at, F.lit(4)), 16, 10).cast("int"), F.lit(n))


def _pick(stream: Column, i: Column, letters: str) -> Column:
    return F.substring(F.lit(letters), _draw(stream, i, len(letters)) + 1, F.lit(1))


def _luhn(digits: Column) -> Column:
    """Luhn sum of a text of digits, modulo 10."""
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        F.substring(digits, i, F.lit(1)).cast("int").alias("d"), (F.pmod(n - i, F.lit(2)) == 1).alias("twice")))
    return F.pmod(F.aggregate(values, F.lit(0), lambda a, x: a + F.when(x["twice"], F.floor(x["d"] * 2 / 10).cast("int") + F.pmod(x["d"] * 2, F.lit(10))).otherwise(x["d"])), F.lit(10))


def _alike(canon: Column, stream: Column, kept: Column) -> Column:
    """Character by character: another of the same class; the first ``kept`` characters, if digits, and all signs stay."""
    def one(i: Column) -> Column:
        c = F.substring(canon, i, F.lit(1))
        new = F.when(F.regexp_like(c, F.lit(r"\p{L}")), F.when(c == F.lower(c), _pick(stream, i, ALPHABETS[0])).otherwise(F.upper(_pick(stream, i, ALPHABETS[0])))).otherwise(c)
        for letters, script in reversed(list(zip(ALPHABETS, SCRIPTS, strict=True))):
            new = F.when(F.regexp_like(F.lower(c), F.lit(script)), F.when(c == F.lower(c), _pick(stream, i, letters)).otherwise(F.upper(_pick(stream, i, letters)))).otherwise(new)
        return F.when(F.regexp_like(c, F.lit("[0-9]")), F.when(i <= kept, c).otherwise(_pick(stream, i, "0123456789"))).otherwise(new)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(canon)), one), "")


def _lettered(canon: Column) -> Column:
    """``canon``, or letters in place of its signs where it has nothing else."""
    return F.when(F.regexp_like(canon, F.lit(r"[\p{L}0-9]")), canon).otherwise(F.translate(canon, SIGNS, "a" * len(SIGNS)))


def _longer(seed: Column, attempt: Column, characters: str) -> Column:
    """What attempts from ``PLAIN_ATTEMPTS`` on add: one of 16 characters more each time."""
    drawn = F.translate(F.sha2(F.concat(seed, F.lit("\x1flonger")), 512), "0123456789abcdef", characters)
    return F.when(attempt >= PLAIN_ATTEMPTS, F.left(drawn, attempt - (PLAIN_ATTEMPTS - 1))).otherwise(F.lit(""))


def _hex(canon: Column, stream: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(canon)), lambda i: _pick(stream, i, "0123456789abcdef")), "")


def _name(kind: Column, canon: Column, stream: Column, longer: Callable[[str], Column]) -> Column:
    out = F.concat(_alike(canon, stream, F.lit(0)), longer(ALPHABETS[0][:16]))  # a script without a list
    first = F.lit(1)
    for at in (2, 1, 0):
        male, female = (F.array(*[F.lit(x) for x in GIVEN[g, at]]) for g in ("m", "f"))
        n = len(GIVEN["m", at])
        given = F.when(kind == "given_m", F.get(male, _draw(stream, first, n))).when(kind == "given_f", F.get(female, _draw(stream, first, n))).otherwise(
            F.get(F.concat(male, female), _draw(stream, first, 2 * n)))
        # Two more letters keep given names apart where the corpus has more of them than the list.
        drawn = F.concat(given, _pick(stream, F.lit(2), ALPHABETS[at]), _pick(stream, F.lit(3), ALPHABETS[at]))
        out = F.when(F.regexp_like(canon, F.lit(SCRIPTS[at])), F.concat(F.when(kind == "surname", _alike(canon, stream, F.lit(0))).otherwise(drawn), longer(ALPHABETS[at][:16]))).otherwise(out)
    return out


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of a part: a function of key, kind, canonical form and attempt alone."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"))
    stream = F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("\x1fmore")), 512))
    longer = lambda characters: _longer(seed, attempt, characters)
    digits, letters = longer("0123456789012345"), longer(ALPHABETS[0][:16])
    octets = F.array_join(F.transform(F.array(*[F.lit(i) for i in range(1, 5)]), lambda i: (_draw(stream, i, 254) + 1).cast("string")), ".")
    at = F.instr(canon, "@")
    host = F.regexp_extract(canon, r"@(.*)\.[^.]*$", 1)
    tail = F.regexp_extract(canon, r"(\.[^.]*)$", 1)
    mail = F.concat(_alike(_lettered(F.substring(canon, F.lit(1), at - 1)), stream, F.lit(0)), letters, F.lit("@"), _alike(host, F.reverse(stream), F.lit(0)), tail)
    number = F.concat(_alike(canon, stream, F.lit(0)), digits)
    body = F.substring(number, F.lit(1), F.length(number) - 1)
    checked = F.concat(body, F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    return (
        F.when(kind == "ip", octets).when(kind == "email", mail)
        .when(kind == "number", F.when(_luhn(canon) == 0, checked).otherwise(number))
        .when(kind == "phone", F.concat(_alike(canon, stream, F.when(F.startswith(canon, F.lit("+")), F.lit(2)).otherwise(F.lit(0))), digits))
        .when(kind == "iban", F.concat(F.left(canon, F.lit(2)), _alike(F.substring(canon, F.lit(3), F.length(canon)), stream, F.lit(0)), digits))
        .when(F.startswith(kind, F.lit("given")) | (kind == "surname"), _name(kind, canon, stream, longer))
        .when((kind == "secret") & F.regexp_like(canon, F.lit("^[0-9a-f]+$")), F.concat(_hex(canon, stream), longer("0123456789abcdef")))
        .when(kind == "ssn", number)
        .otherwise(F.concat(_alike(_lettered(canon), stream, F.lit(0)), letters)))


def as_written(kind: Column, written_: Column, new: Column) -> Column:
    """A canonical surrogate in the punctuation and letter case of the mention."""
    def one(i: Column) -> Column:
        c = F.substring(written_, i, F.lit(1))
        before = F.length(F.regexp_replace(F.substring(written_, F.lit(1), i), "[ ().-]", ""))
        return F.when(F.regexp_like(c, F.lit("[ ().-]")), c).otherwise(F.substring(new, before, F.lit(1)))

    rest = lambda n: F.substring(new, n + 1, F.length(new))
    dealt = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.length(written_)), one), ""), rest(F.length(F.regexp_replace(written_, "[ ().-]", ""))))
    cased = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.length(written_)), lambda i: F.when(
        F.substring(written_, i, F.lit(1)) != F.lower(F.substring(written_, i, F.lit(1))), F.upper(F.substring(new, i, F.lit(1)))).otherwise(F.substring(new, i, F.lit(1)))), ""), rest(F.length(written_)))
    return (
        F.when(kind.isin("number", "phone", "ssn", "iban"), dealt).when(kind == "ip", new)
        .when(F.startswith(kind, F.lit("given")) | (kind == "surname"), F.when(written_ == F.upper(written_), F.upper(new)).otherwise(F.concat(F.upper(F.left(new, F.lit(1))), F.substring(new, F.lit(2), F.length(new)))))
        .otherwise(cased))


def genders(parts: DataFrame) -> DataFrame:
    """The distinct ``parts`` (kind, canon) with ``settled``: the kind with the one gender of a given name in all of them."""
    given = parts.where(F.startswith("kind", F.lit("given"))).groupBy("canon").agg(
        F.max(F.col("kind") == "given_m").alias("m"), F.max(F.col("kind") == "given_f").alias("f"))
    one = F.when(F.col("m") & ~F.col("f"), F.lit("given_m")).when(F.col("f") & ~F.col("m"), F.lit("given_f")).otherwise(F.lit("given"))
    given = given.select(F.lit(True).alias("named"), F.col("canon"), one.alias("one"))
    return parts.withColumn("named", F.startswith("kind", F.lit("given"))).join(given, ["named", "canon"], "left").select("kind", "canon", F.coalesce("one", "kind").alias("settled"))


def attempts(parts: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the distinct ``parts`` (kind, canon) such that all surrogates differ from each other and from every real part."""
    spread = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows, but each costs much
    among = F.when(F.startswith("kind", F.lit("given")) | (F.col("kind") == "surname"), F.lit("name")).otherwise(F.col("kind")).alias("among")
    part = F.struct("kind", "canon")
    now = written(parts.select("kind", "canon").distinct().withColumn("attempt", F.lit(0)), "parts")
    while True:
        drawn = now.repartition(spread, "kind", "canon").withColumn("new", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        drawn = written(drawn.select("*", among), "drawn")
        first = drawn.groupBy("among", "new").agg(F.min(part).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        real = drawn.select("among", "new").join(now.select(among, F.col("canon").alias("new")), ["among", "new"], "left_semi").distinct()
        again = drawn.join(first, ["among", "new"], "left").join(real.withColumn("real", F.lit(True)), ["among", "new"], "left")
        clash = F.col("real").isNotNull() | (F.col("owner").isNotNull() & (F.col("owner") != part))
        again = written(again.select("kind", "canon", "attempt", F.coalesce(clash, F.lit(False)).alias("clash")), "clashes")
        if again.where("clash").isEmpty():
            return now
        now = written(again.select("kind", "canon", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt")), "parts")


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in its texts, and ``n_entities``."""
    kept = [c for c in docs.columns if c.lower() != "n_entities"]
    # The input travels as one column, so that no name of it can clash.
    rows = docs.select(F.struct(*[f"`{c}`" for c in kept]).alias("row"), F.col(f"`{text}`").alias("body")).withColumns({"h": F.xxhash64("body"), "values": mentions(F.col("body"))})
    values = rows.where(F.size("values") > 0).select("h", "values")
    for name, column in analysed(F.col("values")):
        values = values.withColumn(name, column)
    said = written(values.select("h", F.explode(F.flatten(F.transform("_mentions", lambda m: m["parts"]))).alias("p")).select("h", "p.kind", "p.canon").distinct(), "said")
    settled = written(genders(said.select("kind", "canon").distinct()), "settled")
    placed = attempts(settled.select(F.col("settled").alias("kind"), "canon"), key).withColumnRenamed("kind", "settled")
    later = settled.join(placed, ["settled", "canon"]).where("attempt > 0 OR settled <> kind")
    changed = written(said.join(later, ["kind", "canon"]).groupBy(F.col("h").alias("of")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "canon"), F.struct("settled", "attempt")))).alias("later")), "later")  # parts of one text

    found = rows.join(changed, F.col("h") == F.col("of"), "left")
    for name, column in analysed(F.col("values")):
        found = found.withColumn(name, column)
    later_of = lambda p: F.col("later")[F.concat_ws(":", p["kind"], p["canon"])]
    placed_in = F.transform("_mentions", lambda m: F.struct(m["label"].alias("label"), F.transform(m["parts"], lambda p: F.struct(
        F.coalesce(later_of(p)["settled"], p["kind"]).alias("kind"), p["written"].alias("written"), p["canon"].alias("canon"),
        F.coalesce(later_of(p)["attempt"], F.lit(0)).alias("attempt"))).alias("parts")))
    drawn = F.transform(placed_in, lambda m: F.struct(m["label"].alias("label"), F.transform(m["parts"], lambda p: F.struct(
        p["kind"].alias("kind"), p["written"].alias("written"), surrogate(p["kind"], p["canon"], p["attempt"], key).alias("new"))).alias("parts")))
    found = found.withColumn("drawn", drawn)
    put = F.transform("drawn", lambda m: F.concat(m["label"], F.array_join(F.transform(m["parts"], lambda p: as_written(p["kind"], p["written"], p["new"])), " ")))
    found = found.withColumns({"put": put, "gaps": F.when(F.size("values") > 0, F.split(F.col("body"), FOUND, -1))})
    whole = F.array_join(F.zip_with("gaps", "put", lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
    replaced = F.when(F.size("values") > 0, whole).otherwise(F.col("body"))
    return found.select(*[replaced.alias(c) if c == text else F.col("row")[c].alias(c) for c in kept], F.size("values").alias("n_entities"))
