"""Layout rules over formatted text fragments.

Input ``fragments``: doc_id, para_id, frag_id (any orderable type), page_number, text, size, color,
background, bold, italic, underline, caps, font, link, visible; NULL means unknown and is never guessed.

Everything is sums by (document, paragraph) or (document, paragraph, rule, key), which combine map-side: a
document that owns a third of all fragments reaches the shuffle as a handful of rows per task. Each sum reads
the columns it needs from the given table; text is only moved for the passages that are reported.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, IntegralType, StructType

from lumbrera import config as cfg
from lumbrera.functions import color as C
from lumbrera.functions import text as T
from lumbrera.operators.ordered import top_per_key
from lumbrera.session import cut

@dataclass(frozen=True)
class Tables:
    """What is worked out once for each different pair of colours and each different font, when first asked for."""

    fragments: DataFrame

    @cached_property
    def contrasts(self) -> DataFrame:
        return _contrasts(self.fragments)

    @cached_property
    def fonts(self) -> DataFrame:
        return _fonts(self.fragments)


PASSAGE = ["doc_id", "para_id", "rule"]
SMALL, CONTRAST, PLAIN = "letra_chica_pasajes", "contraste_insuficiente", "parrafo"


def _candidates(rules: tuple[str, ...]) -> Column:
    """What a fragment needs for one of ``rules``, told without its text, colours' ratio or font's label."""
    seen, no = F.coalesce("visible", F.lit(True)), F.lit(False)
    known = {
        SMALL: F.col("size") < cfg.SMALL_PASSAGE_PT, CONTRAST: F.col("color").isNotNull() & F.col("background").isNotNull(),
        "fuente_decorativa": seen & F.col("font").isNotNull(), "cursiva": seen & F.col("italic"), "mayusculas": seen,
        "subrayado": seen & F.col("underline") & ~F.coalesce("link", no), PLAIN: seen,
    }
    return reduce(Column.__or__, [F.coalesce(known[r], no) for r in rules])


def _measured(fragments: DataFrame, rules: tuple[str, ...] = ()) -> DataFrame:
    """Fragments with text, its size in characters and words, and what each rule needs to know of it.

    ``rules``: leaves out fragments that can count for none of these before their text is read.
    """
    wanted = fragments.filter(_candidates(rules)) if rules else fragments
    return wanted.withColumn("text", T.strip(F.col("text"))).filter("text <> ''").withColumns({
        "chars": F.length("text"),
        "words": T.count_spaced_words(F.col("text")),
        "pt": F.when(F.col("size") == F.rint("size"), F.col("size")).otherwise(F.bround("size", 1)),
        "large": C.is_large(F.col("size"), F.col("bold")),
        "caps_of": T.caps_counts(F.when(F.coalesce("caps", F.lit(False)), F.upper("text")).otherwise(F.col("text"))),
    })


def _contrasts(fragments: DataFrame) -> DataFrame:
    """The ratio of each different pair of colours: color, background, fg, bg, ratio. Written, so that its size is known."""
    pairs = fragments.filter("color IS NOT NULL AND background IS NOT NULL").select("color", "background").distinct()
    numbers = pairs.withColumns({"fg": C.rgb_number(F.col("color")), "bg": C.rgb_number(F.col("background"))}).filter("fg IS NOT NULL AND bg IS NOT NULL")
    lit = numbers.withColumns({"l_fg": C.luminance(C.unpack(F.col("fg"))), "l_bg": C.luminance(C.unpack(F.col("bg")))})
    return cut(lit.withColumn("ratio", (F.greatest("l_fg", "l_bg") + 0.05) / (F.least("l_fg", "l_bg") + 0.05)).drop("l_fg", "l_bg"))


def _fonts(fragments: DataFrame) -> DataFrame:
    """The label of each different font and whether it is decorative: font, face, decorative. Written, as the colours."""
    return cut(fragments.filter("font IS NOT NULL").select("font").distinct().select(
        "font", C.font_label(F.col("font")).alias("face"), C.is_decorative_font(F.col("font")).alias("decorative")))


def _key(**parts: Column) -> Column:
    kinds = {"face": "string", "pt": "double", "fg": "int", "bg": "int", "large": "boolean", "ratio": "double"}
    return F.struct(*[parts.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])


def _conditions() -> dict[str, tuple[Column, Column, Column, Column, Column]]:
    """Per rule: when a fragment counts for it, the key that may dominate, words and words considered, whether it is quoted."""
    seen, words, yes = F.coalesce("visible", F.lit(True)), F.col("words"), F.lit(True)
    caps, counted = F.col("caps_of")["caps"], F.col("caps_of")["counted"]
    required = F.when(F.col("large") | F.col("size").isNull(), cfg.LARGE_MIN_RATIO).otherwise(cfg.NORMAL_MIN_RATIO)
    return {
        SMALL: (F.col("pt") < cfg.SMALL_PASSAGE_PT, _key(pt=F.col("pt")), words, words, yes),
        CONTRAST: (F.col("ratio") < required, _key(fg=F.col("fg"), bg=F.col("bg"), large=F.col("large"), ratio=F.col("ratio")), words, words, yes),
        "fuente_decorativa": (seen & F.col("decorative") & F.col("face").isNotNull(), _key(face=F.col("face")), words, words, yes),
        "cursiva": (seen & F.col("italic"), _key(), words, words, yes),
        "mayusculas": (seen, _key(), caps, counted, caps > 0),
        "subrayado": (seen & F.col("underline") & ~F.coalesce("link", F.lit(False)), _key(), words, words, yes),
        PLAIN: (seen, _key(), words, words, yes),
    }


def _looked_up(rules: tuple[str, ...], tables: Tables) -> DataFrame:
    """Fragments that count for one of ``rules``, with what the rules know of their colours and fonts."""
    measured = _measured(tables.fragments, rules)
    if CONTRAST in rules:
        measured = measured.join(tables.contrasts, ["color", "background"], "left")
    else:
        measured = measured.withColumns({n: F.lit(None).cast(t) for n, t in (("fg", "int"), ("bg", "int"), ("ratio", "double"))})
    if "fuente_decorativa" in rules:
        measured = measured.join(tables.fonts, "font", "left")
    else:
        measured = measured.withColumns({"face": F.lit(None).cast("string"), "decorative": F.lit(None).cast("boolean")})
    known = _conditions()
    return measured.filter(reduce(Column.__or__, [F.coalesce(known[r][0], F.lit(False)) for r in sorted(rules, key=lambda r: r != PLAIN)]))


def _tags(rules: tuple[str, ...]) -> Column:
    """The rules of ``rules`` that a fragment counts for, as an array of structs."""
    def tag(rule: str, condition: Column, key: Column, words: Column, counted: Column, quoted: Column) -> Column:
        told = F.struct(F.lit(rule).alias("rule"), key.alias("key"), words.alias("words"), quoted.alias("quoted"))
        return told if len(rules) == 1 else F.when(F.coalesce(condition, F.lit(False)), told)

    known = _conditions()
    listed = F.array(*[tag(r, *known[r]) for r in rules])
    return listed if len(rules) == 1 else F.array_compact(listed)


def passages(rules: tuple[str, ...], tables: Tables) -> DataFrame:
    """Per paragraph and rule with a key: words, page, and the key with the most text (ties: first seen)."""
    flags = _looked_up(rules, tables).select("doc_id", "para_id", "frag_id", "page_number", "chars", F.inline(_tags(rules)))
    by_key = flags.groupBy(*PASSAGE, "key").agg(
        F.sum("words").alias("words"), F.sum("chars").alias("chars"), F.min("frag_id").alias("first"), F.min("page_number").alias("page_number"))
    weight = F.when(F.col("rule") == "fuente_decorativa", F.col("words")).otherwise(F.col("chars"))
    return by_key.groupBy(*PASSAGE).agg(
        F.sum("words").alias("words"), F.min("page_number").alias("page_number"), F.min_by("key", F.struct(-weight, F.col("first"))).alias("key"))


def _paragraphs(fragments: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """One row per paragraph with the sums of the rules without a key: ``rule``: words, counted, page_number."""
    known = {r: (F.coalesce(c, F.lit(False)), w, n) for r, (c, _, w, n, _) in _conditions().items() if r in rules}
    sums = [column for r, (c, w, n) in known.items() for column in (
        F.sum(F.when(c, w)).alias(f"w_{r}"), F.sum(F.when(c, n)).alias(f"n_{r}") if r == "mayusculas" else None, F.min(F.when(c, F.col("page_number"))).alias(f"p_{r}")) if column is not None]
    return _measured(fragments, rules).groupBy("doc_id", "para_id").agg(*sums)


def _quotes(reported: DataFrame, rules: tuple[str, ...], tables: Tables) -> DataFrame:
    """First words of each reported passage. Every fragment has a word, so the first fragments are enough.

    ``rules``: the rules ``reported`` may name. A fragment is moved once, whatever number of rules quotes it.
    """
    asked = reported.groupBy("doc_id", "para_id").agg(F.collect_set("rule").alias("asked"))
    tags = F.filter(_tags(rules), lambda t: t["quoted"])
    told = _looked_up(rules, tables).select("doc_id", "para_id", "frag_id", "text", tags.alias("tags"))
    wanted = told.join(asked, ["doc_id", "para_id"]).select(
        "doc_id", "para_id", "frag_id", "text", F.inline(F.filter("tags", lambda t: F.array_contains("asked", t["rule"]))))
    order = ["frag_id"]
    if CONTRAST in rules:  # failing contrast is quoted colour pair by colour pair, in order of appearance
        lead = wanted.groupBy(*PASSAGE, "key").agg(F.min("frag_id").alias("lead"))
        wanted, order = wanted.join(lead, [*PASSAGE, "key"]).withColumn("lead", F.when(F.col("rule") == CONTRAST, F.col("lead"))), ["lead", "frag_id"]
    first = top_per_key(wanted.select(*PASSAGE, *order, "text"), PASSAGE, order, cfg.PASSAGE_EXCERPT_WORDS + 1)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda t: t["text"])
    return first.groupBy(*PASSAGE).agg(T.word_excerpt(F.array_join(texts, " ")).alias("example"))


def with_quotes(reported: DataFrame, rule: str, tables: Tables) -> DataFrame:
    return reported.join(_quotes(reported, (rule,), tables), PASSAGE, "left").withColumn("example", F.coalesce("example", F.lit("")))


def _lead(of: DataType) -> Column:
    """A number that never falls where ``frag_id`` rises, so that a minimum of it is kept by hash: what sorts first in it.

    Equal numbers of different fragments leave the order open; other types than numbers and structs of them get one number.
    """
    if isinstance(of, IntegralType):
        return F.col("frag_id").cast("long")
    lowest = F.lit(-(1 << 31))
    kinds = [(f.name, f.dataType) for f in of.fields[:2]] if isinstance(of, StructType) else []
    if len(kinds) == 2 and isinstance(kinds[0][1], IntegerType) and isinstance(kinds[1][1], IntegralType):
        head, tail = F.col("frag_id").getField(kinds[0][0]), F.col("frag_id").getField(kinds[1][0])
        low = F.greatest(F.lit(0), F.least(F.lit((1 << 32) - 1), tail.cast("long")))  # NULL is passed over by both
        number = F.shiftleft(F.coalesce(head, lowest).cast("long"), 32) + F.when(tail.isNull(), F.lit(0)).otherwise(low)
    else:
        number = F.lit(0).cast("long")
    return F.when(F.col("frag_id").isNotNull(), number)


def _most_text(measured: DataFrame, by: str) -> DataFrame:
    """Per document the value of ``by`` with the most text (ties: first seen).

    Rows are summed by hash with the number of :func:`_lead`; the fragments are read again only for documents whose order it leaves open.
    """
    known = measured.filter(F.col(by).isNotNull())
    lead = _lead(measured.schema["frag_id"].dataType)
    sums = known.groupBy("doc_id", by).agg(F.sum("chars").alias("chars"), F.min(lead).alias("lead"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("chars"), F.col("lead").asc_nulls_first())
    best = cut(sums.withColumn("rank", F.rank().over(order)).filter("rank = 1").select("doc_id", by))
    tied = cut(best.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if tied.isEmpty():
        return best
    open_ = best.join(tied, "doc_id", "left_semi")
    firsts = known.join(open_, ["doc_id", by], "left_semi").groupBy("doc_id", by).agg(F.min("frag_id").alias("first"))
    return best.join(tied, "doc_id", "left_anti").unionByName(
        firsts.groupBy("doc_id").agg(F.min_by(by, F.struct("first")).alias(by)))


def body_font_size(fragments: DataFrame) -> DataFrame:
    """Size that covers the most characters of each document."""
    return _body_pt(_measured(fragments))


def _body_pt(measured: DataFrame) -> DataFrame:
    return _most_text(measured, "pt").withColumnRenamed("pt", "body_pt")


def body_font(fragments: DataFrame) -> DataFrame:
    return _body_face(_measured(fragments), Tables(fragments))


def _body_face(measured: DataFrame, tables: Tables) -> DataFrame:
    return _most_text(measured.filter(F.coalesce("visible", F.lit(True))).join(tables.fonts, "font"), "face").select(
        "doc_id", F.col("face").alias("body_font"), C.is_decorative_font(F.col("face")).alias("decorative_body"))


def small_body(fragments: DataFrame) -> DataFrame:
    return body_font_size(fragments).filter(F.col("body_pt") < cfg.MIN_BODY_PT)


@dataclass(frozen=True)
class Layout:
    """What the layout rules share, each part made when it is first asked for and then kept.

    ``measured``: the fragments (lazy: every reader takes only the columns it needs from the table, so no
    text is written or moved for a sum). ``rules``: the rules that ``marked`` is about. ``documents``: doc_id
    of the documents wanted, or None for all that ``measured`` holds; sums are made first and dropped then, since
    they are narrow.

    ``marked``: doc_id, para_id, rule, words, page_number, detail, ratio, key, one row per paragraph
    and rule met. ``bodies``: doc_id, body_pt, body_font, decorative_body.
    """

    measured: DataFrame
    formats: DataFrame
    rules: tuple[str, ...]
    tables: Tables
    documents: DataFrame | None = None

    def _kept(self, df: DataFrame) -> DataFrame:
        return cut(df if self.documents is None else df.join(self.documents, "doc_id", "left_semi"))

    @cached_property
    def marked(self) -> DataFrame:
        return self._kept(_marked(self.formats, self.rules, self.tables, lambda: self.sizes))

    @cached_property
    def sizes(self) -> DataFrame:
        return self._kept(_body_pt(self.measured))

    @cached_property
    def faces(self) -> DataFrame:
        return self._kept(_body_face(self.measured, self.tables))

    @cached_property
    def bodies(self) -> DataFrame:
        return self.sizes.join(self.faces, "doc_id", "full_outer")

    @cached_property
    def pairs(self) -> DataFrame:
        return self._kept(colorblind_pairs(self.measured))


def _spacing(value: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", ""), r"\.", ",")


LAYOUT_RULES = (SMALL, CONTRAST, *cfg.TYPOGRAPHY_RULES)
_KEYED = (SMALL, CONTRAST, "fuente_decorativa")
_FORMATS = ("justificado", "interlineado")
_LEAST = {SMALL: cfg.MIN_SMALL_PASSAGE_WORDS, CONTRAST: cfg.MIN_LOW_CONTRAST_WORDS, "fuente_decorativa": cfg.MIN_DECORATIVE_WORDS}


def _marked(formats: DataFrame, rules: tuple[str, ...], tables: Tables, sizes: Callable[[], DataFrame]) -> DataFrame:
    """Paragraphs that meet one of ``rules``. Rules without a key are conditional sums of one row per paragraph."""
    parts = []
    if keyed := tuple(r for r in rules if r in _KEYED):
        rule, w = F.col("rule"), F.col("words")
        found = passages(keyed, tables).filter(reduce(Column.__or__, [(rule == r) & (w >= _LEAST[r]) for r in keyed]))
        if SMALL in keyed:
            tiny = sizes().filter(F.col("body_pt") < cfg.MIN_BODY_PT).select("doc_id", F.lit(SMALL).alias("rule"))
            found = found.join(tiny, ["doc_id", "rule"], "left_anti")
        found = found.withColumn("ratio", F.bround("key.ratio", 2))
        detail = F.when(rule == SMALL, F.col("key.pt").cast("string")).when(rule == CONTRAST, F.format_string("%.2f", "ratio")).otherwise(F.col("key.face"))
        parts.append(found.select("doc_id", "para_id", "words", "page_number", "ratio", "key", "rule", detail.alias("detail")))
    asked = [r for r in rules if r not in _KEYED]
    if asked:
        sums = _paragraphs(tables.fragments, tuple(dict.fromkeys(PLAIN if r in _FORMATS else r for r in asked)))

        def met(rule: str, source: str, condition: Column, detail: Column) -> Column:
            return F.when(F.coalesce(condition, F.lit(False)), F.struct(
                F.col(f"w_{source}").alias("words"), F.col(f"p_{source}").alias("page_number"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))

        at_least = lambda r, n: F.col(f"w_{r}") >= n
        known = {
            "cursiva": lambda: met("cursiva", "cursiva", at_least("cursiva", cfg.MIN_ITALIC_WORDS), F.lit(None)),
            "mayusculas": lambda: met("mayusculas", "mayusculas", at_least("mayusculas", cfg.MIN_CAPS_WORDS) & (
                F.col("w_mayusculas") / F.col("n_mayusculas") >= cfg.MIN_CAPS_RATIO), F.lit(None)),
            "subrayado": lambda: met("subrayado", "subrayado", at_least("subrayado", cfg.MIN_UNDERLINE_WORDS), F.lit(None)),
            "justificado": lambda: met("justificado", PLAIN, at_least(PLAIN, cfg.MIN_LAYOUT_WORDS) & F.col("justified"), F.lit(None)),
            "interlineado": lambda: met("interlineado", PLAIN, at_least(PLAIN, cfg.MIN_LAYOUT_WORDS) & (
                F.col("line_spacing") < cfg.MIN_LINE_SPACING - 1e-6), _spacing("line_spacing")),
        }
        if any(r in _FORMATS for r in asked):
            sums = sums.join(formats, ["doc_id", "para_id"], "left")
        parts.append(sums.select("doc_id", "para_id", F.inline(F.array_compact(F.array(*[known[r]() for r in asked])))).withColumns(
            {"ratio": F.lit(None).cast("double"), "key": _key()}))
    return reduce(DataFrame.unionByName, parts)


BROADCAST_DOCUMENTS = 3_000_000


def read_layout(fragments: DataFrame, formats: DataFrame, rules: tuple[str, ...] = LAYOUT_RULES, documents: DataFrame | None = None) -> Layout:
    """Marked paragraphs and document facts of the fragments, for the given rules and documents.

    ``documents`` is counted, so it should be written. Up to ``BROADCAST_DOCUMENTS`` of them go to every task, and where
    most fragments are of others, those wanted are written first: a plain join would have their text read before it.
    Otherwise the sums are dropped.
    """
    if documents is not None and documents.count() <= BROADCAST_DOCUMENTS:
        wanted = F.broadcast(documents.select("doc_id"))
        kept = fragments.join(wanted, "doc_id", "left_semi")
        if 2 * kept.count() <= fragments.count():
            # They may lie together in the given table, and would then be read by a few tasks each time.
            even = kept.repartition(2 * kept.sparkSession.sparkContext.defaultParallelism)
            fragments, formats, documents = cut(even), formats.join(wanted, "doc_id", "left_semi"), None
    return Layout(_measured(fragments), formats, rules, Tables(fragments), documents)


def passages_of(fragments: DataFrame, formats: DataFrame, rule: str) -> DataFrame:
    """Paragraphs marked by one rule: doc_id, para_id, words, page_number, detail."""
    return _marked(formats, (rule,), Tables(fragments), lambda: _body_pt(_measured(fragments))).select("doc_id", "para_id", "words", "page_number", "detail")


def _total(marked: DataFrame, rule: str) -> DataFrame:
    return marked.filter(F.col("rule") == rule).groupBy("doc_id").agg(F.count("*").alias("total"))


def small_passages(layout: Layout) -> DataFrame:
    """First three small passages of each document with the document's total."""
    marked = layout.marked.filter(F.col("rule") == SMALL)
    first = top_per_key(marked, ["doc_id"], ["para_id"], cfg.REPORTED_PER_RULE, "pos")
    return with_quotes(first, SMALL, layout.tables).join(_total(marked, SMALL), "doc_id").select(
        "doc_id", "para_id", "pos", "page_number", "words", F.col("key.pt").alias("font_size"), "example", "total")


def contrast_totals(layout: Layout) -> DataFrame:
    """total, kept (the first twenty) and how many of those are severe, per document."""
    marked = layout.marked.filter(F.col("rule") == CONTRAST)
    stored = top_per_key(marked, ["doc_id"], ["para_id"], cfg.STORED_PASSAGES, "stored")
    severe = stored.groupBy("doc_id").agg(
        F.count("*").alias("kept"), F.count_if(F.col("ratio") < cfg.LARGE_MIN_RATIO).alias("severe"), F.min("ratio").alias("worst"))
    return _total(marked, CONTRAST).join(severe, "doc_id")


def low_contrast_passages(layout: Layout) -> DataFrame:
    """Worst three of the first twenty low-contrast passages, with the document's totals."""
    marked = layout.marked.filter(F.col("rule") == CONTRAST)
    stored = top_per_key(marked, ["doc_id"], ["para_id"], cfg.STORED_PASSAGES, "stored")
    worst = top_per_key(stored, ["doc_id"], ["ratio", "para_id"], cfg.REPORTED_PER_RULE, "pos")
    return with_quotes(worst, CONTRAST, layout.tables).join(contrast_totals(layout), "doc_id").select(
        "doc_id", "para_id", "pos", "page_number", "words", C.number_hex(F.col("key.fg")).alias("text_color"),
        C.number_hex(F.col("key.bg")).alias("background_color"), "ratio", F.col("key.large").alias("is_large"), "example",
        "total", "kept", "severe")


def typography_rules(layout: Layout) -> DataFrame:
    """Per document and typography rule: passages, words, first paragraph, commonest detail, severity, rule order."""
    marked = layout.marked.filter(F.col("rule").isin(*cfg.TYPOGRAPHY_RULES))
    by_detail = marked.groupBy("doc_id", "rule", "detail").agg(
        F.count("*").alias("n"), F.sum("words").alias("w"), F.min("para_id").alias("seen"))
    sums = by_detail.groupBy("doc_id", "rule").agg(
        F.sum("n").alias("passages"), F.sum("w").alias("words"), F.min("seen").alias("para_id"),
        F.min_by("detail", F.struct(F.col("detail").isNull(), -F.col("w"), "seen")).alias("detail"))
    order = F.array_position(F.array(*[F.lit(r) for r in cfg.TYPOGRAPHY_RULES]), F.col("rule")).cast("int")
    main = (F.col("rule") == "fuente_decorativa") & F.col("decorative_body") & (F.col("body_font") == F.col("detail"))
    return sums.join(layout.faces, "doc_id", "left").select(
        "doc_id", "rule", "passages", "words", "para_id", "detail", F.coalesce(main, F.lit(False)).alias("severe"), order.alias("issue_order"))


def typography_issues(layout: Layout) -> DataFrame:
    """:func:`typography_rules` with the first example and the first ten pages of each rule."""
    issues = cut(typography_rules(layout))
    marked = layout.marked.filter(F.col("rule").isin(*cfg.TYPOGRAPHY_RULES))
    pages = top_per_key(
        marked.groupBy("doc_id", "rule", "page_number").agg(F.min("para_id").alias("seen")), ["doc_id", "rule"], ["seen", "page_number"], cfg.STORED_PAGES
    ).groupBy("doc_id", "rule").agg(F.array_sort(F.collect_list("page_number")).alias("pages"))
    # Layout rules quote the whole paragraph, so their example comes from the plain flags.
    source = F.when(F.col("rule").isin(*_FORMATS), PLAIN).otherwise(F.col("rule"))
    asked = issues.select("doc_id", "para_id", F.col("rule").alias("issue"), source.alias("rule"))
    quoted = asked.join(_quotes(asked, ("fuente_decorativa", "cursiva", "mayusculas", "subrayado", PLAIN), layout.tables), PASSAGE, "left").select("doc_id", F.col("issue").alias("rule"), F.coalesce("example", F.lit("")).alias("example"))
    return issues.drop("para_id").join(pages, ["doc_id", "rule"]).join(quoted, ["doc_id", "rule"])


def colorblind_pairs(fragments: DataFrame) -> DataFrame:
    """Pairs of text colours that collapse under a colour deficiency: at most five per document.

    Candidates are the twelve most used chromatic colours, so pairing happens inside one bounded
    array per document rather than by joining a document's fragments with themselves.
    """
    used = fragments.withColumn("text", T.strip(F.col("text"))).filter("text <> '' and color is not null").withColumn("hex", F.upper("color"))
    chromatic = used.filter(C.chroma(C.unpack(C.rgb_number(F.col("hex")))) >= cfg.MIN_CHROMA)
    # The start of the first text in each colour comes along with the sum.
    sample = F.when(F.length("text") <= 80, F.col("text")).otherwise(F.concat(F.left("text", F.lit(77)), F.lit("...")))
    sums = chromatic.groupBy("doc_id", "hex").agg(
        F.sum(F.length("text")).alias("chars"), F.min(F.struct("frag_id", sample.alias("sample"), "page_number")).alias("lead"))
    colors = sums.filter(F.col("chars") >= cfg.MIN_COLOR_CHARS).select(
        "doc_id", "hex", "chars", F.col("lead.frag_id").alias("first"), F.struct("lead.sample", "lead.page_number").alias("lead"), C.unpack(C.rgb_number(F.col("hex"))).alias("fg"))
    top = top_per_key(colors, ["doc_id"], [F.desc("chars"), "first"], cfg.CHROMATIC_CANDIDATES)
    for kind in cfg.CVD_MATRICES:
        top = top.withColumn(kind, C.simulate(F.col("fg"), kind))
    listed = top.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "hex", "fg", "lead", *cfg.CVD_MATRICES))).alias("cs"))

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a["rank"].alias("i"), b["rank"].alias("j"), a.alias("a"), b.alias("b"), C.distance(a["fg"], b["fg"]).alias("seen"),
                        *[C.distance(a[k], b[k]).alias(k) for k in cfg.CVD_MATRICES])

    pairs = F.flatten(F.transform("cs", lambda a: F.transform(F.filter("cs", lambda b: b["rank"] > a["rank"]), lambda b: pair(a, b))))
    exploded = listed.select("doc_id", F.inline(pairs)).filter(F.col("seen") >= cfg.MIN_NORMAL_COLOR_DISTANCE)
    kinds = F.array_compact(F.array(*[
        F.when((F.col(k) < cfg.MAX_SIMULATED_DISTANCE) & (F.col(k) / F.col("seen") < cfg.MAX_SIMULATED_RATIO), F.lit(k)) for k in cfg.CVD_MATRICES
    ]))
    collapsing = exploded.withColumn("deficiencies", kinds).filter(F.size("deficiencies") > 0)
    shown = lambda side: F.concat(F.lit("#"), F.right(f"{side}.hex", F.lit(6))).alias(f"color_{side}")
    return top_per_key(collapsing, ["doc_id"], ["i", "j"], cfg.MAX_COLOR_PAIRS, "pos").select(
        "doc_id", "pos", shown("a"), shown("b"), F.array_join("deficiencies", ",").alias("deficiencies"),
        F.col("a.lead.sample").alias("sample_a"), F.col("b.lead.sample").alias("sample_b"), F.col("a.lead.page_number").alias("page_number"))


# --- findings, facts and penalties ---------------------------------------------------------------------

_PLACE = {"pdf": ("página", "páginas"), "pptx": ("diapositiva", "diapositivas")}


def _label(which: int) -> Column:
    return F.when(F.col("source_type") == "pdf", _PLACE["pdf"][which]).when(F.col("source_type") == "pptx", _PLACE["pptx"][which])


def _place(page: Column) -> Column:
    return F.coalesce(F.concat(F.lit(" ("), _label(0), F.lit(" "), page.cast("string"), F.lit(")")), F.lit(""))


def _places(pages: Column) -> Column:
    listed = F.array_join(pages.cast("array<string>"), ", ")
    label = F.when(F.size(pages) == 1, _label(0)).otherwise(_label(1))
    return F.when(F.size(pages) == 0, "").otherwise(F.coalesce(F.concat(F.lit(" ("), label, F.lit(" "), listed, F.lit(")")), F.lit("")))


def pt(size: Column) -> Column:
    """9.0 as '9', 7.5 as '7,5'."""
    return F.regexp_replace(F.regexp_replace(size.cast("string"), r"\.0$", ""), r"\.", ",")


def _ratio(value: Column) -> Column:
    return F.concat(F.regexp_replace(F.format_string("%.1f", F.bround(value, 1)), r"\.", ","), F.lit(":1"))


_TITLES = {  # Fixed values: what each typography rule is called in a finding.
    "cursiva": "Pasajes largos en cursiva", "mayusculas": "Texto largo en MAYÚSCULAS sostenidas",
    "subrayado": "Texto subrayado que no es un enlace", "justificado": "Texto justificado",
    "interlineado": "Interlineado menor a 1,5",
}


def layout_findings(layout: Layout, documents: DataFrame) -> DataFrame:
    """Layout findings of files, in the shape of the text findings.

    ``documents``: doc_id and source_type of the documents the layout was read for.
    """
    visual, review, severe = F.lit("accesibilidad_visual"), F.lit("para_revisar"), F.lit("barrera_detectada")

    def shape(df: DataFrame, order: int, rule, pos, severity: Column, issue: Column, quote: Column) -> DataFrame:
        return df.join(documents.select("doc_id", "source_type"), "doc_id").select(
            "doc_id", F.lit(order).alias("rule_order"), (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule"), pos.cast("int").alias("pos"),
            visual.alias("category"), severity.alias("severity"), issue.alias("issue"), quote.alias("original_text"), F.lit(None).cast("string").alias("anchor"))

    body = layout.sizes.filter(F.col("body_pt") < cfg.MIN_BODY_PT)
    parts = [
        shape(body, 11, "letra_chica_cuerpo", F.lit(1), severe,
              F.concat(F.lit("Letra demasiado chica en el cuerpo del texto ("), pt(F.col("body_pt")), F.lit(" pt)")),
              F.concat(F.lit("[Cuerpo del texto de el documento: "), pt(F.col("body_pt")), F.lit(" pt]"))),
        shape(small_passages(layout), 12, SMALL, F.col("pos"), review,
              F.concat(F.lit("Pasaje con letra muy chica ("), pt(F.col("font_size")), F.lit(" pt)"), _place(F.col("page_number"))), F.col("example")),
        shape(low_contrast_passages(layout), 13, CONTRAST, F.col("pos"), F.when(F.col("ratio") < cfg.LARGE_MIN_RATIO, severe).otherwise(review),
              F.concat(F.lit("Contraste insuficiente entre el texto y el fondo ("), _ratio(F.col("ratio")), F.lit(")"), _place(F.col("page_number"))), F.col("example")),
        shape(typography_issues(layout), 14, F.concat(F.lit("tipografia_"), F.col("rule")), F.col("issue_order"), F.when(F.col("severe"), severe).otherwise(review),
              F.concat(
                  F.when(F.col("severe"), F.concat(F.lit("La fuente principal del texto es decorativa o manuscrita ("), "detail", F.lit(")")))
                  .when(F.col("rule") == "fuente_decorativa", F.concat(F.lit("Pasajes en una fuente decorativa o manuscrita ("), "detail", F.lit(")")))
                  .otherwise(F.try_element_at(F.create_map(*[F.lit(x) for kv in _TITLES.items() for x in kv]), F.col("rule"))),
                  _places(F.col("pages"))), F.col("example")),
        shape(layout.pairs.filter(F.col("pos") <= cfg.REPORTED_PER_RULE), 15, "colores_daltonismo", F.col("pos"), review,
              F.concat(F.lit("Combinación de colores problemática para daltonismo ("), "color_a", F.lit(" y "), "color_b", F.lit(")"), _place(F.col("page_number"))),
              F.col("sample_a")),
    ]
    return reduce(DataFrame.unionByName, parts)


def layout_penalties(layout: Layout) -> DataFrame:
    """Penalty rows of the layout rules: doc_id, ord, rule, category, count, points, severe."""
    def shape(df: DataFrame, order: int, rule: str, count: Column, points: Column, severe: Column) -> DataFrame:
        return df.select("doc_id", F.lit(order).alias("ord"), F.lit(rule).alias("rule"), F.lit("accesibilidad_visual").alias("category"),
                         count.cast("int").alias("count"), points.cast("int").alias("points"), severe.alias("severe"))

    n, no = F.col("total"), F.lit(False)
    contrast = cfg.SEVERE_CONTRAST_POINTS * F.col("severe") + cfg.LOW_CONTRAST_POINTS * (n - F.col("severe"))
    pairs = layout.pairs.groupBy("doc_id").agg(F.count("*").alias("total"))
    return reduce(DataFrame.unionByName, [
        shape(layout.sizes.filter(F.col("body_pt") < cfg.MIN_BODY_PT), 20, "letra_chica_cuerpo", F.lit(1), F.lit(cfg.SMALL_BODY_POINTS), F.lit(True)),
        shape(_total(layout.marked, SMALL), 21, SMALL, n, F.least(F.lit(cfg.MAX_SMALL_PASSAGE_PENALTY), n * cfg.SMALL_PASSAGE_POINTS), no),
        shape(contrast_totals(layout), 22, CONTRAST, n, F.least(F.lit(cfg.MAX_CONTRAST_PENALTY), contrast), F.col("severe") > 0),
        typography_penalties(layout),
        shape(pairs, 40, "colores_daltonismo", n, F.least(F.lit(cfg.MAX_COLOR_PAIR_PENALTY), n * cfg.COLOR_PAIR_POINTS), no),
    ])


def typography_penalties(layout: Layout) -> DataFrame:
    """Points per typography rule in rule order until the shared cap is used up; rows of zero points are left out.

    A document has at most six such rows, so the running sum is over a bounded window.
    """
    w = Window.partitionBy("doc_id").orderBy("issue_order").rowsBetween(Window.unboundedPreceding, -1)
    full = F.when(F.col("severe"), cfg.DECORATIVE_BODY_POINTS).otherwise(cfg.TYPOGRAPHY_POINTS)
    before = F.coalesce(F.sum("full").over(w), F.lit(0))
    points = F.greatest(F.lit(0), F.least(F.col("full"), cfg.MAX_TYPOGRAPHY_PENALTY - before))
    return typography_rules(layout).withColumn("full", full).withColumn("points", points).filter("points > 0").select(
        "doc_id", (F.lit(30) + F.col("issue_order")).cast("int").alias("ord"), F.concat(F.lit("tipografia_"), "rule").alias("rule"),
        F.lit("accesibilidad_visual").alias("category"), F.col("passages").cast("int").alias("count"), F.col("points").cast("int").alias("points"), "severe")


def layout_facts(layout: Layout) -> DataFrame:
    """Layout columns of the metric row: body size, small passages, low-contrast passages, typography rules met."""
    rule = F.col("rule")
    counts = layout.marked.groupBy("doc_id").agg(
        F.count_if(rule == SMALL).cast("int").alias("small_text_passages"), F.count_if(rule == CONTRAST).cast("int").alias("low_contrast_passages"),
        F.count_distinct(F.when(rule.isin(*cfg.TYPOGRAPHY_RULES), rule)).cast("int").alias("typography_issues"))
    return layout.sizes.join(counts, "doc_id", "full_outer").na.fill(
        0, ["small_text_passages", "low_contrast_passages", "typography_issues"])
