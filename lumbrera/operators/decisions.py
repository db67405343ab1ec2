"""Review decisions: the append-only log, replacements and the adapted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbrera.functions import text as T
from lumbrera.operators.ordered import neighbour, numbered, running_max, running_sum
from lumbrera.session import cut

PROPOSAL = ["doc_id", "proposal_id", "barrier_id"]
STATUS_PRIORITY = ("editada", "aceptada", "descartada", "pendiente")


def current_status(log: DataFrame) -> DataFrame:
    """State of every proposal after its last log entry, folded map-side so a long log shuffles as one row per task."""
    return log.groupBy(*PROPOSAL).agg(
        F.max_by("adaptation_type", "seq").alias("adaptation_type"), F.max_by("to_status", "seq").alias("status"),
        F.max_by("created_at", "seq").alias("decided_at"),
    )


def invalid_transitions(log: DataFrame) -> DataFrame:
    """Entries that do not start from the state the previous entry of their proposal left.

    ``log.block`` is read as the chunk column when present (days of a long log); the order is seq.
    """
    chunk = [F.col("block")] if "block" in log.columns else [F.lit(0)]
    stepped = neighbour(log, ["proposal_id"], chunk, ["seq"], F.col("to_status"), "previous_status")
    return stepped.filter(F.col("previous_status").isNotNull() & (F.col("from_status") != F.col("previous_status")))


def pending_conflicts(proposals: DataFrame) -> DataFrame:
    pending = proposals.filter(F.col("status") == "pendiente")
    return pending.groupBy("doc_id", "barrier_id").agg(F.count("*").alias("pending")).filter("pending > 1")


def decision_history(log: DataFrame) -> DataFrame:
    """The log in reading order inside each document; order costs a range sort, not one task per document."""
    return log.orderBy("doc_id", "seq")


def resolve_fragment(materials: DataFrame, quotes: DataFrame) -> DataFrame:
    """Full text behind an abbreviated quote: the paragraph holding every part of it, or the sentence
    when steps are wanted. Quotes that are not abbreviated, or are not found, stand for themselves.

    ``quotes``: doc_id, quote_id, original_text, adaptation_type. Paragraphs stay inside the document
    row, so the work is one join on doc_id.
    """
    quote = T.strip(F.col("original_text"))
    tagged = quotes.withColumns({"quote": quote, "parts": T.fragment_parts(quote)}).filter(~T.is_placeholder(F.col("quote")))
    docs = materials.select("doc_id", T.lines(F.col("raw_text")).alias("ps")).withColumn("norm", T.normalize_each(F.col("ps")))
    joined = tagged.join(docs, "doc_id").withColumn("abbreviated", F.col("quote").rlike(r"\.{3}|…"))
    hits = F.filter(F.arrays_zip("ps", "norm"), lambda p: T.contains_all(p["norm"], F.col("parts")))
    found = joined.withColumn("paragraph", F.when(F.col("abbreviated"), F.try_element_at(hits, F.lit(1))["ps"]))
    found = found.withColumn("ss", T.split_sentences(F.col("paragraph")))
    sentence = F.try_element_at(F.filter(F.arrays_zip("ss", T.normalize_each(F.col("ss")).alias("norm")), lambda s: T.contains_all(s["norm"], F.col("parts"))), F.lit(1))["ss"]
    resolved = F.when(F.col("adaptation_type") == "consigna_en_pasos", sentence)
    return found.select(
        "doc_id", "quote_id", "adaptation_type", F.coalesce(resolved, "paragraph", "quote").alias("fragment"),
        (F.col("abbreviated") & F.col("paragraph").isNull()).alias("not_found"),
    )


def _capitalised(items: Column) -> Column:
    return F.transform(items, lambda s: F.concat(F.upper(F.left(s, F.lit(1))), F.call_function("substring", s, F.lit(2))))


def _clauses(sentences: Column, cut: str) -> Column:
    pieces = F.flatten(F.transform(sentences, lambda s: F.split(s, cut)))
    return F.filter(F.transform(pieces, lambda p: F.btrim(p, F.lit(" ."))), lambda p: p != "")


def _rewritten(fragment: Column, split: Column, kind: Column) -> Column:
    ws, word = T.WHITESPACE, T.WORD_CHAR
    sentences = F.when(F.size(split) > 0, split).otherwise(F.array(fragment))
    actions = _capitalised(_clauses(sentences, rf",{ws}*(?:[ye]{ws}+)?|;{ws}*|{ws}+y{ws}+(?={word}+[éáí](?!{word}))"))
    steps = F.array_join(F.transform(actions, lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), a, F.lit("."))), "\n")
    plain = F.array_join(F.transform(_capitalised(_clauses(sentences, f",{ws}+")), lambda c: F.concat(c, F.lit("."))), " ")
    starts = F.sequence(F.lit(0), F.floor((F.size(sentences) - 1) / 3).cast("int"))
    blocks = F.array_join(F.transform(starts, lambda b: F.array_join(F.slice(sentences, b * 3 + 1, F.lit(3)), " ")), "\n\n")
    outline = F.concat(F.lit("Título sugerido\n"), F.array_join(F.transform(sentences, lambda s: F.concat(F.lit("- "), s)), "\n"))
    return (
        F.when(kind == "consigna_en_pasos", steps).when(kind == "lenguaje_claro", plain)
        .when(kind == "reorganizar", blocks).otherwise(outline)
    )


def rewrite(fragment: Column, kind: Column) -> Column:
    """Deterministic rewrite by adaptation type: steps, plain clauses, blocks of three, outline."""
    return F.element_at(rewrite_each(fragment, F.array(kind)), 1)["text"]


def rewrite_each(fragment: Column, kinds: Column) -> Column:
    """(kind, text) of :func:`rewrite` for every adaptation type of an array.

    The sentences are bound to a name, as the one element of an array: a text is split once, not once a type
    and again for each of its blocks.
    """
    return F.element_at(F.transform(F.array(T.split_sentences(fragment)), lambda split: F.transform(
        kinds, lambda kind: F.struct(kind.alias("kind"), _rewritten(fragment, split, kind).alias("text")))), 1)


def proposal_spans(proposals: DataFrame, materials: DataFrame) -> DataFrame:
    """Where each accepted or edited proposal goes; start and end are NULL where its text is not found.

    Proposals of a document share its places: in the order of their ids each takes the first place of its
    fragment that no other has, and the first one again when there are no more. Two fragments can only
    have a place in common if they are the same words, with other white space between or around them.

    Text meets each distinct fragment once; what leaves the join is offsets only. Where all proposals
    with the same words cite the same fragment, the place follows from the proposal's number among
    them. Only places that differently spaced fragments contend for are dealt one by one, in a fold over
    no more proposals than the fragments have places.
    """
    live = proposals.filter(F.col("status").isin("aceptada", "editada") & (T.strip(F.col("original_text")) != "")).withColumn(
        "_words", F.array_join(T.spaced_words(F.col("original_text")), " "))
    fragment, words = ["doc_id", "_words", "original_text"], ["doc_id", "_words"]
    ranked = numbered(live, fragment, [F.floor(F.col("proposal_id") / 1_000_000)], ["proposal_id"], "turn")
    wanted = live.groupBy(*fragment).agg(F.count("*").alias("own"))
    shared = wanted.groupBy(*words).agg(F.sum("own").cast("int").alias("n"), (F.count("*") > 1).alias("mixed"))
    spans = cut(wanted.join(shared, words).join(materials.select("doc_id", "raw_text"), "doc_id").select(
        *fragment, "mixed", T.candidate_spans(F.col("raw_text"), F.col("original_text"), F.col("n")).alias("spans")))
    placed = ranked.join(spans, fragment, "left")
    first = F.try_element_at("spans", F.lit(1))
    own = placed.withColumn("span", F.coalesce(F.try_element_at("spans", F.col("turn").cast("int")), first))
    lists = spans.filter("mixed").groupBy(*words).agg(F.map_from_entries(F.collect_list(F.struct("original_text", "spans"))).alias("lists"))  # the spacings of one phrase
    contenders = placed.filter("mixed AND turn <= size(spans)").groupBy(*words).agg(
        F.array_sort(F.collect_list(F.struct("proposal_id", "original_text"))).alias("queue"))
    dealt = contenders.join(lists, words).select("doc_id", F.inline(_dealt(F.col("queue"), F.col("lists"))))
    dealt = dealt.withColumnRenamed("span", "_dealt")
    return own.join(dealt, ["doc_id", "proposal_id"], "left").withColumn("span", F.when(F.coalesce("mixed", F.lit(False)), F.coalesce("_dealt", first)).otherwise(F.col("span"))).withColumns(
        {"start": F.col("span.start"), "end": F.col("span.end")}).drop("spans", "turn", "span", "mixed", "_words", "_dealt")


def _dealt(queue: Column, lists: Column) -> Column:
    """(proposal_id, span) of each proposal of ``queue``: the first place of its fragment that is not taken, or else the first."""
    start = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("taken"), F.array().cast("array<struct<proposal_id:bigint,span:struct<start:int,end:int>>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        places = F.try_element_at(lists, p["original_text"])
        free = F.try_element_at(F.array_except(places, acc["taken"]), F.lit(1))
        span = F.coalesce(free, F.try_element_at(places, F.lit(1)))
        return F.struct(
            F.when(free.isNull(), acc["taken"]).otherwise(F.concat(acc["taken"], F.array(free))).alias("taken"),
            F.concat(acc["out"], F.array(F.struct(p["proposal_id"].cast("long").alias("proposal_id"), span.alias("span")))).alias("out"))

    return F.aggregate(queue, start, step, lambda acc: acc["out"])


def placement_warnings(spans: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Messages per document: proposals whose text was not found, by id, then those that lost their place, the strongest first.

    ``spans``: what :func:`proposal_spans` gives, with barrier_id and adaptation_type; ``verdicts``: what
    :func:`select_replacements` made of it.
    """
    missing = F.format_string(
        "No se encontró en el material el fragmento original de la propuesta '%s' (%s). No se aplicó.", F.col("proposal_id").cast("string"), "barrier_id")
    misses = spans.filter(F.col("start").isNull()).groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("proposal_id", missing.alias("text")))), lambda m: m["text"]).alias("misses"))
    lost = verdicts.filter(~F.col("selected")).select("doc_id", "proposal_id", "lost_to").join(spans, ["doc_id", "proposal_id"])
    beaten = F.format_string(
        "Propuesta '%s' (%s, %s) no aplicada por solapamiento con la propuesta '%s'.", F.col("proposal_id").cast("string"), "barrier_id", "adaptation_type", F.col("lost_to").cast("string"))
    rank = F.struct((F.col("status") == "editada").alias("edited"), "decided_at", "proposal_id", beaten.alias("text"))
    losers = lost.groupBy("doc_id").agg(F.transform(F.reverse(F.array_sort(F.collect_list(rank))), lambda m: m["text"]).alias("losers"))
    none = F.array().cast("array<string>")
    return misses.join(losers, "doc_id", "full").select("doc_id", F.concat(F.coalesce("misses", none), F.coalesce("losers", none)).alias("warnings"))


CHARACTERS_PER_CHUNK = 65_536
_SPAN = "struct<start:int,end:int,proposal_id:bigint>"
_VERDICT = "struct<proposal_id:bigint,selected:boolean,lost_to:bigint>"


def _greedy(spans: Column) -> Column:
    """Verdicts of one island: spans in priority order, each accepted unless it touches one already accepted."""
    start = F.struct(F.array().cast(f"array<{_SPAN}>").alias("taken"), F.array().cast(f"array<{_VERDICT}>").alias("verdicts"))

    def step(acc: Column, s: Column) -> Column:
        clash = F.try_element_at(F.filter(acc["taken"], lambda t: F.greatest(t["start"], s["start"]) < F.least(t["end"], s["end"])), F.lit(1))
        winner = clash["proposal_id"]
        mine = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["proposal_id"].alias("proposal_id"))
        verdict = F.struct(s["proposal_id"].alias("proposal_id"), winner.isNull().alias("selected"), winner.alias("lost_to"))
        return F.struct(
            F.when(winner.isNull(), F.concat(acc["taken"], F.array(mine))).otherwise(acc["taken"]).alias("taken"),
            F.concat(acc["verdicts"], F.array(verdict)).alias("verdicts"))

    return F.aggregate(spans, start, step, lambda acc: acc["verdicts"])


def select_replacements(spans: DataFrame) -> DataFrame:
    """Which placed proposals apply: edited before accepted, then the latest decision, then the id.

    ``spans``: doc_id, proposal_id, status, decided_at, start, end. Equal spans are settled by one
    aggregate; a span that touches no other is accepted as it is. Only islands of overlapping, distinct
    spans, where order matters, are gathered, one island per row, and they carry offsets only.
    """
    placed = spans.filter(F.col("start").isNotNull()).select(
        "doc_id", "proposal_id", (F.col("status") == "editada").cast("int").alias("edited"), "decided_at", "start", "end"
    )
    priority = F.struct("edited", "decided_at", "proposal_id")
    champions = placed.groupBy("doc_id", "start", "end").agg(
        F.max(priority).alias("best"), F.count("*").alias("copies")
    ).select("doc_id", "start", "end", "best.*", "copies")
    chunk, by_start = [F.floor(F.col("start") / CHARACTERS_PER_CHUNK)], ["start", "end"]
    reached = running_max(champions, ["doc_id"], chunk, by_start, F.col("end"), "reach")
    opens = (F.col("start") >= F.coalesce("reach", F.lit(0))).cast("int")
    islands = running_sum(reached, ["doc_id"], chunk, by_start, opens, "island").drop("reach")
    sized = islands.withColumn("size", F.count("*").over(Window.partitionBy("doc_id", "island")))  # spans that overlap one another
    alone = sized.filter("size = 1").select(
        "doc_id", "proposal_id", F.lit(True).alias("selected"), F.lit(None).cast("long").alias("lost_to"))
    ranked = F.reverse(F.array_sort(F.collect_list(F.struct("edited", "decided_at", "proposal_id", "start", "end"))))
    contested = sized.filter("size > 1").groupBy("doc_id", "island").agg(ranked.alias("spans")).select("doc_id", F.inline(_greedy(F.col("spans"))))
    verdicts = alone.unionByName(contested)
    settled = champions.join(verdicts, ["doc_id", "proposal_id"]).select(
        "doc_id", "start", "end", F.col("proposal_id").alias("champion"), "selected", "lost_to")
    return placed.join(settled, ["doc_id", "start", "end"]).select(
        "doc_id", "proposal_id", "start", "end",
        (F.col("selected") & (F.col("proposal_id") == F.col("champion"))).alias("selected"),
        F.when(F.col("proposal_id") == F.col("champion"), F.col("lost_to"))
        .otherwise(F.coalesce("lost_to", "champion")).alias("lost_to"),
    )


def apply_replacements(materials: DataFrame, selected: DataFrame) -> DataFrame:
    """Adapted text of every document. ``selected``: doc_id, start, end, replacement, non-overlapping."""
    edits = selected.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("edits"))
    joined = materials.select("doc_id", "raw_text").join(edits, "doc_id", "left")

    def piece(edit: Column, i: Column) -> Column:
        before = F.coalesce(F.try_element_at(F.col("edits"), F.when(i > 0, i).otherwise(F.size("edits") + 1))["end"], F.lit(0))
        return F.concat(F.col("raw_text").substr(before + 1, edit["start"] - before), edit["replacement"])

    tail = F.col("raw_text").substr(F.element_at("edits", -1)["end"] + 1, F.length("raw_text"))
    adapted = F.concat(F.array_join(F.transform("edits", piece), ""), tail)
    return joined.select("doc_id", "raw_text", F.coalesce(adapted, "raw_text").alias("adapted_text"))


def final_version_counts(proposals: DataFrame, verdicts: DataFrame) -> DataFrame:
    chosen = verdicts.filter("selected").select("doc_id", "proposal_id", F.lit(True).alias("applied"))
    return proposals.join(chosen, ["doc_id", "proposal_id"], "left").groupBy("doc_id").agg(
        F.count("*").alias("total_proposals"), F.count_if(F.coalesce("applied", F.lit(False))).alias("applied"),
        F.count_if(F.col("status") == "descartada").alias("discarded"),
        F.count_if(F.col("status") == "pendiente").alias("pending"),
    )


def barrier_resolution(barriers: DataFrame, proposals: DataFrame) -> DataFrame:
    """Every barrier with the proposal that speaks for it: edited, accepted, discarded, pending; none is pending."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_PRIORITY]), F.col("status"))
    best = proposals.groupBy("doc_id", "barrier_id").agg(
        F.min_by(F.struct("proposal_id", "status"), F.struct(rank, "proposal_id")).alias("p"))
    return barriers.join(best, ["doc_id", "barrier_id"], "left").select(
        *barriers.columns, F.col("p.proposal_id").alias("proposal_id"),
        F.coalesce("p.status", F.lit("pendiente")).alias("resolution_status"))


def resolution_counts(resolution: DataFrame) -> DataFrame:
    status = F.col("resolution_status")
    return resolution.groupBy("doc_id").agg(
        F.count("*").alias("total_barriers"), F.count_if(status.isin("aceptada", "editada")).alias("resolved"),
        F.count_if(status == "descartada").alias("discarded"), F.count_if(status == "pendiente").alias("pending"),
    )


# Names shown for each adaptation type (fixed values).
TYPE_LABELS = {
    "lenguaje_claro": "simplificación de lenguaje", "consigna_en_pasos": "división de consignas en pasos",
    "reorganizar": "reorganización de contenido", "mejorar_estructura": "mejora de estructura",
}


def executive_summary(documents: DataFrame, proposals: DataFrame, resolution: DataFrame) -> DataFrame:
    """Sentences that sum up what was done: applied changes by type (most first), then what stays open.

    ``documents``: doc_id of every report wanted.
    """
    label = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_LABELS.items() for x in kv]), F.col("adaptation_type")),
        F.col("adaptation_type"))
    applied = proposals.filter(F.col("status").isin("aceptada", "editada")).groupBy("doc_id", label.alias("label")).agg(
        F.count("*").alias("n"), F.min("proposal_id").alias("first"))
    phrase = F.when(F.col("n") == 1, F.format_string("Se aplicó 1 adaptación de %s.", "label")).otherwise(
        F.format_string("Se aplicaron %d adaptaciones de %s.", "n", "label"))
    lines = applied.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "first", phrase.alias("text")))).alias("lines"))
    joined = documents.select("doc_id").join(lines, "doc_id", "left").join(resolution_counts(resolution), "doc_id", "left")
    pending = F.when(F.col("pending") > 0, F.format_string(
        "Quedaron %d barrera(s) sin decisión tomada: el texto original se preserva en esas secciones.", "pending"))
    kept = F.when(F.col("discarded") > 0, F.format_string(
        "El docente optó por mantener el texto original en %d barrera(s) detectada(s).", "discarded"))
    texts = F.concat(F.coalesce(F.transform("lines", lambda x: x["text"]), F.array().cast("array<string>")), F.array_compact(F.array(pending, kept)))
    return joined.select("doc_id", F.when(F.size(texts) > 0, texts).otherwise(
        F.array(F.lit("No se aplicaron adaptaciones en este material."))).alias("summary"))

