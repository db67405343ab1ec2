"""Text functions: every one maps string columns to columns and stays inside the JVM, except the
NFKC step of :func:`normalize_quote`, which only receives the few values NFKC could change.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumbrera import config as cfg

# A word is a run of letters, numbers and underscores of any script; the ASCII classes of the JVM
# would split accented words.
WORD_CHAR = r"[\p{L}\p{N}_]"
NOT_WORD_CHAR = r"[^\p{L}\p{N}_]"
WORD = WORD_CHAR + "+"
WHITESPACE = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
NOT_WHITESPACE = r"[^\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
LINE_BREAK = r"[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
OTHER_BREAK = LINE_BREAK.replace(r"\n", "")
LINE_SPACE = r"[\t \x{1f}\p{Zs}]"
TRIM_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
LIST_ITEM = rf"^(?:[-•▪◦*·–]|\d{{1,2}}[.)]|[a-zA-Z][)]){WHITESPACE}+"
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"
DIGIT_WORD = rf"(?={DIGIT})(?<!{WORD_CHAR}){DIGIT}++(?!{WORD_CHAR})"  # looks for a digit first, which is rare

_CLOSER = "[\"'»”’)\\]]"
_CLOSERS = _CLOSER + "*"
_OPENERS = "[(\\[¿¡\"'«]"
_BREAK = "\x01"
_NO_END = "\x02"
_STOP = r"\.(?:[!?][.!?]*+)?+"
# A full stop after an abbreviation or an initial, with whatever signs stand around them. Longer words are passed over first.
_ABBREVIATED = (
    rf"(?<!{NOT_WHITESPACE}){_OPENERS}*+(?=\p{{L}}{{1,{max(map(len, cfg.ABBREVIATIONS))}}}+{LINE_SPACE}*+\.)(?:(?iu:{'|'.join(cfg.ABBREVIATIONS)})|\p{{Lu}}){LINE_SPACE}*+{_STOP}{_CLOSERS}+(?=\n|{LINE_SPACE}|\z)"
)
_SENTENCE_END = (
    rf"(?=[.!?…])(?<![.!?])(?:(?:[!?…]|\.\.)[.!?]*+|{_STOP}){_CLOSERS}+"
    rf"(?=\n|{LINE_SPACE}|\z)(?!{LINE_SPACE}*+\p{{IsLowercase}})"
)
_LONE_LIST_MARKER = (
    rf"(^|\n|{_BREAK})({LINE_SPACE}*(?:\d{{1,2}}|[a-zA-Z]){LINE_SPACE}*\.(?:[!?][.!?]*)?{_CLOSERS}){_BREAK}"
)


def _plain_ends(col: Column) -> Column:
    """Whether a text begins and ends with a visible ASCII character."""
    return F.substring(col, 1, 1).between("!", "~") & F.substring(col, -1, 1).between("!", "~")


def strip(col: Column) -> Column:
    """Trim every Unicode space, not only U+0020."""
    return F.btrim(col, F.lit(TRIM_CHARS))


def strip_each(pieces: Column) -> Column:
    """:func:`strip` of every piece of an array. Pieces with plain ends are not searched; a piece is at hand, so reading it often is cheap."""
    return F.transform(pieces, lambda p: F.when(_plain_ends(p), p).otherwise(strip(p)))


def collapse(col: Column) -> Column:
    """Single spaces, none at the ends."""
    return strip(F.regexp_replace(col, WHITESPACE + "+", " "))


def words(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(WORD), F.lit(0))


def count_words(col: Column) -> Column:
    return F.regexp_count(col, F.lit(WORD))


def spaced_words(col: Column) -> Column:
    """Whitespace-separated tokens."""
    return F.regexp_extract_all(col, F.lit(NOT_WHITESPACE + "+"), F.lit(0))


# Plain text: printable ASCII, one space between words, none at the ends.
_SPACED_PLAINLY = r"\A[!-~]++(?: [!-~]++)*+\z"


def count_spaced_words(col: Column) -> Column:
    """Number of :func:`spaced_words`; in plain text that is the number of spaces and one."""
    spaces = F.length(col) - F.length(F.replace(col, F.lit(" "), F.lit("")))
    return F.when(col.rlike(_SPACED_PLAINLY), spaces + 1).otherwise(F.regexp_count(col, F.lit(NOT_WHITESPACE + "+")))


def lines(col: Column) -> Column:
    """Stripped non-blank lines, in order."""
    return F.filter(strip_each(F.split(F.regexp_replace(col, OTHER_BREAK, "\n"), "\n")), lambda line: line != "")


def split_sentences(col: Column) -> Column:
    """Sentences of a text as an array; a line break always ends one.

    The whole text is marked in three regex passes and split once, so cost is linear in its length:
    first a mark behind abbreviations and initials, whose full stop ends nothing, then one after every
    closing sign that ends a sentence (a lower-case continuation does not), then the mark after a lone
    list marker is dropped, which joins "1." to what follows it. Runs of signs may have any length.
    """
    clean = F.replace(F.replace(col, F.lit(_BREAK), F.lit(" ")), F.lit(_NO_END), F.lit(" "))
    text = F.regexp_replace(clean, OTHER_BREAK, "\n")
    held = F.regexp_replace(text, _ABBREVIATED, "$0" + _NO_END)
    marked = F.replace(F.regexp_replace(held, _SENTENCE_END, "$0" + _BREAK), F.lit(_NO_END), F.lit(""))
    joined = F.regexp_replace(marked, _LONE_LIST_MARKER, "$1$2")
    return F.filter(strip_each(F.split(F.replace(joined, F.lit("\n"), F.lit(_BREAK)), _BREAK)), lambda s: s != "")


def first_words(col: Column, n: int) -> Column:
    """Text up to the end of the n-th word, or all of a text with fewer; what follows is not read."""
    head = F.regexp_extract(col, rf"^(?:{NOT_WORD_CHAR}*+{WORD_CHAR}++){{{n}}}", 0)
    return F.when(head == "", col).otherwise(head)


def excerpt(col: Column, n: int = cfg.PARAGRAPH_EXCERPT_WORDS) -> Column:
    """Text up to the end of the n-th word, with a mark when something was left out."""
    head = F.regexp_extract(col, rf"^(?:{NOT_WORD_CHAR}*+{WORD_CHAR}++){{{n}}}", 0)
    return F.when(count_words(col) > n, F.concat(head, F.lit(" …"))).otherwise(col)


def clip(col: Column, n: int) -> Column:
    """One line of at most n characters."""
    line = collapse(col)
    return F.when(F.length(line) <= n, line).otherwise(
        F.concat(F.rtrim(F.substring(line, 1, n - 1)), F.lit("…"))
    )


def word_excerpt(col: Column, n: int = cfg.PASSAGE_EXCERPT_WORDS) -> Column:
    tokens = spaced_words(col)
    return F.concat(
        F.array_join(F.slice(tokens, 1, n), " "), F.when(F.size(tokens) > n, F.lit("…")).otherwise(F.lit(""))
    )


_ES = "a-záéíóúüñ"


def syllable_total(col: Column) -> Column:
    """Sum of the Spanish syllable nuclei of every word, computed over the whole text at once.

    Letters outside the Spanish alphabet are dropped inside words, words of one or two letters
    count one, triphthongs then diphthongs fold to a single vowel, and a word always counts at
    least one. No array of words is built.
    """
    text = F.lower(col)
    text = F.regexp_replace(text, rf"[[\p{{L}}\p{{N}}_]&&[^{_ES}]]+", "")
    text = F.regexp_replace(text, rf"[^{_ES}]+", " ")
    text = F.regexp_replace(text, rf"(?<![{_ES}])[{_ES}]{{1,2}}(?![{_ES}])", "a")
    text = F.regexp_replace(text, rf"y(?![{_ES}])", "i")
    text = F.regexp_replace(text, "[iuü][aáeéoó][iuü]", "a")
    text = F.regexp_replace(text, "[aáeéoó][iuü]", "a")
    text = F.regexp_replace(text, "[iuü][aáeéoó]", "a")
    text = F.regexp_replace(text, "[iuü]{2}", "a")
    text = F.regexp_replace(text, rf"(?<![{_ES}])[^aeiouáéíóúü ]+(?![{_ES}])", "a")
    return F.regexp_count(text, F.lit("[aeiouáéíóúü]"))


def syllables_es(word: Column) -> Column:
    """Syllable nuclei of one word; zero when it has no Spanish letter."""
    return syllable_total(F.regexp_replace(word, NOT_WORD_CHAR + "+", ""))


def count_numbers(col: Column) -> Column:
    """Words of digits only."""
    return F.regexp_count(col, F.lit(DIGIT_WORD))


def plain_word_count(col: Column) -> Column:
    """Words that are not numbers."""
    return count_words(col) - count_numbers(col)


def _alternatives(words: list[str]) -> str:
    """One pattern for a word list with shared beginnings factored out, so a token is read once."""
    heads: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        heads.setdefault(word[:1], []).append(word[1:])
    optional = "" in heads
    parts = [head + (_alternatives(tails) if tails != [""] else "") for head, tails in heads.items() if head]
    body = parts[0] if len(parts) == 1 and not optional else "(?:" + "|".join(parts) + ")"
    return body + "?" if optional and parts else body


# A verb, or a verb of four letters or more followed by one enclitic pronoun.
ACTION_WORD = (
    rf"(?<!{WORD_CHAR})(?:{_alternatives([v for v in cfg.ACTION_VERBS if len(v) >= 4])}(?:{'|'.join(cfg.ENCLITICS)})?"
    rf"|{_alternatives([v for v in cfg.ACTION_VERBS if len(v) < 4])})(?!{WORD_CHAR})"
)


def action_verbs(col: Column) -> Column:
    """Action verbs among the words of a text, in order, with repetitions, in lower case."""
    return F.regexp_extract_all(F.lower(col), F.lit(ACTION_WORD), F.lit(0))


# --- quotes ------------------------------------------------------------------------------------

# Compatibility characters that are common enough to fold without leaving the JVM.
_FOLD_FROM, _FOLD_TO = " ªº²³¹", " ao231"
# Characters NFKC leaves alone once combining marks are absent.
_NFKC_STABLE = r"^[\x{00}-\x{7f}¡-§©«®°±¶·»¿À-ÿĀ-ıĴ-ľŁ-ňŊ-ž–—‘’‚“”„†‡•€]*$"


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def nfkc(col: Column) -> Column:
    """NFKC form. Values it cannot change reach the Python worker as NULL, so their text never leaves the JVM."""
    folded = F.replace(F.translate(col, _FOLD_FROM, _FOLD_TO), F.lit("…"), F.lit("..."))
    return F.coalesce(_nfkc(F.when(~folded.rlike(_NFKC_STABLE), folded)), folded)


def normalize_quote(col: Column) -> Column:
    """Form in which quotes are compared: NFKC, lower case, no quote marks, single spaces."""
    return collapse(F.regexp_replace(F.lower(nfkc(col)), "[\"'“”‘’«»]", ""))


def normalize_each(pieces: Column) -> Column:
    """:func:`normalize_quote` of every piece of an array; the pieces go through NFKC as one text."""
    joined = F.array_join(F.transform(pieces, lambda p: F.translate(p, _BREAK, " ")), _BREAK)
    return F.when(F.size(pieces) > 0, F.transform(F.split(nfkc(joined), _BREAK), normalize_quote_native)).otherwise(pieces)


def normalize_quote_native(col: Column) -> Column:
    """:func:`normalize_quote` for text already known to be NFKC-stable."""
    folded = F.replace(F.translate(col, _FOLD_FROM, _FOLD_TO), F.lit("…"), F.lit("..."))
    return collapse(F.regexp_replace(F.lower(folded), "[\"'“”‘’«»]", ""))


def fragment_parts(col: Column) -> Column:
    """Parts of an abbreviated quote: cut at '...' or '…', normalised, blanks dropped."""
    marked = F.regexp_replace(F.translate(col, _BREAK, " "), r"\.{3}|…", _BREAK)
    return F.filter(F.transform(F.split(normalize_quote(marked), _BREAK), strip), lambda p: p != "")


def is_placeholder(col: Column) -> Column:
    quote = strip(col)
    return quote.startswith("[") & quote.endswith("]")


def _quoted_pattern(fragment: Column) -> Column:
    """Regex that matches the fragment with any whitespace between its words."""
    inner = F.array_join(spaced_words(fragment), r"\E" + WHITESPACE + r"+\Q")
    return F.concat(F.lit(r"\Q"), inner, F.lit(r"\E"))


def _occurrences(text: Column, needle: Column, n: Column) -> Column:
    """Start offsets (0-based) of the first n occurrences of a literal, overlaps included."""
    start = F.array().cast("array<int>")

    def step(acc, _):
        previous = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-1))
        hit = F.call_function("locate", needle, text, previous + F.lit(2))
        return F.when(hit > 0, F.concat(acc, F.array(hit - 1))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), n), start, step)


def _spans(starts: Column, length: Column) -> Column:
    return F.transform(starts, lambda s: F.struct(s.cast("int").alias("start"), (s + length).cast("int").alias("end")))


def _flexible_spans(text: Column, fragment: Column) -> Column:
    """Spans of the fragment with free whitespace. A regex match is also the first literal occurrence
    of its own text at or after the previous match, so offsets follow from the matched strings."""
    matches = F.call_function("regexp_extract_all", text, _quoted_pattern(fragment), F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, match):
        previous_end = F.coalesce(F.try_element_at(acc, F.lit(-1)).getField("end"), F.lit(0))
        start = F.call_function("locate", match, text, previous_end + F.lit(1)) - F.lit(1)
        return F.concat(acc, F.array(F.struct(start.cast("int").alias("start"), (start + F.length(match)).cast("int").alias("end"))))

    return F.aggregate(matches, empty, step)


def candidate_spans(text: Column, fragment: Column, n: Column) -> Column:
    """Distinct spans where a fragment can be placed: exact, then stripped, then free whitespace.

    The free-whitespace search only runs when the cheaper ones found fewer than n spans.
    """
    bare = strip(fragment)
    exact = _spans(_occurrences(text, fragment, n), F.length(fragment))
    stripped = _spans(_occurrences(text, bare, n), F.length(bare))
    literal = F.array_distinct(F.concat(exact, stripped))
    found = F.when(F.size(literal) >= n, literal).otherwise(
        F.array_distinct(F.concat(literal, _flexible_spans(text, fragment)))
    )
    return F.when(bare != "", found)


def find_span(text: Column, fragment: Column) -> Column:
    """First span of a fragment as struct(start, end), NULL when it does not occur."""
    return F.try_element_at(candidate_spans(text, fragment, F.lit(1)), F.lit(1))


def contains_all(text: Column, parts: Column) -> Column:
    """Every part occurs; false when there is none."""
    return (F.size(parts) > 0) & F.forall(parts, lambda p: F.contains(text, p))


def file_format(filename: Column) -> Column:
    return F.when(F.contains(filename, F.lit(".")), F.lower(F.element_at(F.split(filename, r"\."), -1)))


_NOT_LETTER = r"[^\p{L}\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
_TWO_LETTERS = rf"{_NOT_LETTER}*+\p{{L}}{_NOT_LETTER}*+\p{{L}}{NOT_WHITESPACE}*+"
_ALL_CAPS = rf"(?<!{NOT_WHITESPACE})(?:{_NOT_LETTER}*+\p{{Lu}}){{2,}}+{_NOT_LETTER}*+(?!{NOT_WHITESPACE})"


# Plain words that start with two letters, and those among them without small letters.
_LETTERS_FIRST = r"\A[A-Za-z]{2}[!-~]*+(?: [A-Za-z]{2}[!-~]*+)*+\z"
_CAPITALS_ONLY = r"\A[A-Z]{2}[!-`{-~]*+(?: [A-Z]{2}[!-`{-~]*+)*+\z"


def caps_counts(col: Column) -> Column:
    """struct(caps, counted): all-capital words and evaluable words (two letters or more)."""
    no_capital = ~col.rlike(r"\p{Lu}")
    return F.struct(
        F.when(no_capital, 0).when(col.rlike(_CAPITALS_ONLY), count_spaced_words(col)).otherwise(F.regexp_count(col, F.lit(_ALL_CAPS))).alias("caps"),
        F.when(col.rlike(_LETTERS_FIRST), count_spaced_words(col)).otherwise(F.regexp_count(col, F.lit(_TWO_LETTERS))).alias("counted"))
