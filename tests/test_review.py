import random
import re

from pyspark.sql import functions as F

from lumbrera import config as cfg
from lumbrera.operators import decisions, merge, scoring
from lumbrera.plans import closing_report
from lumbrera.sources import tables

DOCS = "doc_id long, raw_text string"
AI = "doc_id long, pos int, category string, severity string, issue string, original_text string"
RULE = "doc_id long, rule_order int, rule string, pos int, category string, severity string, issue string, original_text string, anchor string"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], DOCS)


def test_quotes_are_verified_part_by_part(spark):
    text = docs(spark, "El “ciclo” del agua   es un proceso.\nOtra línea larga del material.")
    found = spark.createDataFrame([
        (1, 1, "comprension", "para_revisar", "a", "ciclo del AGUA es"), (1, 2, "comprension", "para_revisar", "b", "El ciclo... larga del"),
        (1, 3, "comprension", "para_revisar", "c", "no está"), (1, 4, "comprension", "para_revisar", "d", "...")], AI)
    rows = merge.verify_quotes(found, text).orderBy("pos").collect()
    assert [r["fragment_found"] for r in rows] == [True, True, False, False]


def test_covered_rules_are_dropped(spark):
    verified = spark.createDataFrame([
        (1, 1, "comprension", "para_revisar", "a", "la oración larga que se cita acá", True), (1, 2, "estructura", "para_revisar", "b", "un párrafo que empieza así y", True),
        (1, 3, "comprension", "para_revisar", "c", "esta no fue verificada de verdad", False)], AI + ", fragment_found boolean")
    rules = spark.createDataFrame([
        (1, 1, "oraciones_extensas", 1, "comprension", "para_revisar", "x", "q", "Antes, la oración larga que se cita acá y sigue."),
        (1, 4, "parrafos_extensos", 1, "estructura", "para_revisar", "y", "q", "Un párrafo que empieza así y continúa."),
        (1, 4, "parrafos_extensos", 2, "estructura", "para_revisar", "z", "q", "Otro que dice un párrafo que empieza así y termina."),
        (1, 1, "oraciones_extensas", 2, "comprension", "para_revisar", "w", "q", "esta no fue verificada de verdad"),
        (1, 9, "referencias_visuales", 1, "accesibilidad_visual", "para_revisar", "v", "q", "la oración larga que se cita acá")], RULE)
    assert sorted(r["issue"] for r in merge.suppress_covered(rules, verified).collect()) == ["v", "w", "z"]


def test_numbering_puts_severe_first_and_keeps_order(spark):
    rows = [(1, merge.VISION, 1, p, "c", "para_revisar", "v", "", False, "ai") for p in (5000, 3, 9000)]
    rows += [(1, merge.RULES, 4, 1, "c", "barrera_detectada", "severe", "", None, "rules"), (1, merge.MODEL, 0, 2, "c", "para_revisar", "m", "", True, "ai")]
    df = spark.createDataFrame(rows, "doc_id long, origin int, rule_order int, pos long, category string, severity string, issue string, original_text string, fragment_found boolean, source string")
    out = sorted(merge.order_and_number(df).collect(), key=lambda r: int(r["barrier_id"][4:]))
    assert [(r["issue"], r["pos"]) for r in out] == [("severe", 1), ("m", 2), ("v", 3), ("v", 5000), ("v", 9000)]


def test_dimensions_take_the_worst(spark):
    schema = "doc_id long, category string, status string, comment string"
    ai = spark.createDataFrame([(1, "comprension", "para_revisar", "m"), (1, "estructura", "para_revisar", "m"), (1, "accesibilidad_visual", "barrera_detectada", "m")], schema)
    rules = spark.createDataFrame([(1, "comprension", "barrera_detectada", "r"), (1, "estructura", "correcta", "r"), (1, "accesibilidad_visual", "correcta", "r"), (2, "estructura", "correcta", "r")], schema)
    got = {(r["doc_id"], r["category"]): (r["status"], r["comment"]) for r in scoring.merge_dimensions(ai, rules).collect()}
    assert got == {
        (1, "comprension"): ("barrera_detectada", "m Reglas automáticas: r"), (1, "estructura"): ("para_revisar", "m"),
        (1, "accesibilidad_visual"): ("correcta", "r"), (2, "estructura"): ("correcta", "r")}
    # Signals seen in pictures make the visual dimension one to review at least, and are told.
    more = rules.unionByName(spark.createDataFrame([(3, "accesibilidad_visual", "barrera_detectada", "")], schema))
    vision = spark.createDataFrame([(1,), (1,), (3,), (4,)], "doc_id long")
    told = "La IA de visión detectó %d señal(es) de dependencia de color o texto incrustado en imágenes."
    got = {(r["doc_id"], r["category"]): (r["status"], r["comment"]) for r in scoring.merge_dimensions(ai, more, vision).collect()}
    assert got[1, "accesibilidad_visual"] == ("para_revisar", "r " + told % 2) and got[3, "accesibilidad_visual"] == ("barrera_detectada", told % 1)
    assert got[1, "comprension"] == ("barrera_detectada", "m Reglas automáticas: r") and got[2, "estructura"] == ("correcta", "r")


def test_rule_findings_say_whether_their_quote_is_there(spark):
    rows = [("oraciones_extensas", "lo que sea"), ("pdf_sin_titulos", "[Documento]"), ("contraste_insuficiente", "texto  del\narchivo…"), ("tipografia_cursiva", "otra cosa"), ("letra_chica_pasajes", "")]
    found = spark.createDataFrame([(1, i, r, 1, "c", "s", "i", q, None) for i, (r, q) in enumerate(rows)], RULE)
    got = {r["rule"]: r["fragment_found"] for r in merge.rule_quotes_found(found, docs(spark, "Un texto del  archivo largo.")).collect()}
    assert got == {"oraciones_extensas": True, "pdf_sin_titulos": None, "contraste_insuficiente": True, "tipografia_cursiva": False, "letra_chica_pasajes": False}


def test_rewrites(spark):
    text = "Leé el texto, subrayá las ideas y respondé. Ver pág. 3 del libro."
    df = spark.createDataFrame([(k, text) for k in cfg.ADAPTATION_TYPES], "k string, t string")
    got = {r["k"]: r["r"] for r in df.select("k", decisions.rewrite(F.col("t"), F.col("k")).alias("r")).collect()}
    assert got["consigna_en_pasos"] == "1. Leé el texto.\n2. Subrayá las ideas.\n3. Respondé.\n4. Ver pág. 3 del libro."
    assert got["lenguaje_claro"] == "Leé el texto. Subrayá las ideas y respondé. Ver pág. 3 del libro."
    assert got["reorganizar"] == text
    assert got["mejorar_estructura"] == "Título sugerido\n- Leé el texto, subrayá las ideas y respondé.\n- Ver pág. 3 del libro."


SPAN = "doc_id long, proposal_id long, status string, decided_at string, start int, end int"


def greedy(rows):
    taken, out = [], {}
    for r in sorted(rows, key=lambda r: (r[2] == "editada", r[3], r[1]), reverse=True):
        clash = next((t for t in taken if max(r[4], t[4]) < min(r[5], t[5])), None)
        out[r[1]] = (clash is None, clash and clash[1])
        if clash is None:
            taken.append(r)
    return out


def test_selection_matches_a_plain_greedy(spark):
    rng = random.Random(11)
    rows = []
    for doc in range(12):
        for p in range(rng.randint(1, 14)):
            start = rng.randint(0, 40)
            rows.append((doc, doc * 100 + p, rng.choice(["editada", "aceptada"]), f"2024-01-{rng.randint(1, 4):02d}", start, start + rng.randint(1, 9)))
    got = {(r["doc_id"], r["proposal_id"]): (r["selected"], r["lost_to"]) for r in decisions.select_replacements(spark.createDataFrame(rows, SPAN)).collect()}
    for doc in range(12):
        for p, verdict in greedy([r for r in rows if r[0] == doc]).items():
            assert got[(doc, p)] == verdict


PROPOSAL = "doc_id long, proposal_id long, barrier_id string, adaptation_type string, status string, decided_at string, original_text string, replacement string"


def adapt(spark, text, *rows):
    found = spark.createDataFrame([(1, i, f"bar-{i}", "lenguaje_claro", s, d, q, r) for i, (s, d, q, r) in enumerate(rows, 1)], PROPOSAL)
    adapted, verdicts = closing_report.adapted_documents(docs(spark, text), found)
    return adapted.collect()[0]["adapted_text"], {r["proposal_id"]: r["selected"] for r in verdicts.collect()}


def test_adapted_text(spark):
    text = "Uno dos tres. Cuatro cinco. Uno dos tres."
    assert adapt(spark, text, ("pendiente", "a", "Uno", "X"), ("descartada", "a", "Cuatro", "Y"))[0] == text
    assert adapt(spark, text, ("aceptada", "a", "Cuatro cinco.", "4 5."))[0] == "Uno dos tres. 4 5. Uno dos tres."
    # The same quote twice takes both places.
    assert adapt(spark, text, ("aceptada", "a", "Uno dos tres.", "A."), ("editada", "a", "Uno dos tres.", "B."))[0] == "A. Cuatro cinco. B."
    # An edit wins over an acceptance, then the latest decision.
    out, chosen = adapt(spark, text, ("aceptada", "b", "Cuatro cinco.", "A"), ("editada", "a", "cinco", "B"))
    assert out == "Uno dos tres. Cuatro B. Uno dos tres." and chosen == {1: False, 2: True}
    out, chosen = adapt(spark, text, ("aceptada", "a", "Cuatro cinco.", "A"), ("aceptada", "b", "cinco", "B"))
    assert chosen == {1: False, 2: True}
    # Edits are taken word for word, marks and all; whitespace in a quote is free.
    assert adapt(spark, "a  b\nc", ("editada", "a", "b c", r"$1 \n"))[0] == r"a  $1 \n"


def places_in_turn(text, fragments):
    """A plain statement of who gets which place: proposals in order, each the first place of its fragment that is free."""
    taken, out = set(), []
    for f in fragments:
        places = [(i, i + len(f)) for i in range(len(text)) if text.startswith(f, i)]
        bare = f.strip()
        places += [(i, i + len(bare)) for i in range(len(text)) if text.startswith(bare, i)]
        places += [m.span() for m in re.finditer(r"\s+".join(map(re.escape, bare.split())), text)]
        place = next((p for p in places if p not in taken), places[0] if places else None)
        taken.add(place)
        out.append(place)
    return out


def test_places_are_shared_between_fragments(spark):
    rng, rows, texts = random.Random(8), [], {}
    fragments = ["uno", "uno dos", "uno  dos", " uno dos", "uno\ndos ", "dos", "tres uno", "nada", "dos uno dos", " uno "]
    for doc in range(60):
        texts[doc] = "".join(rng.choice(["uno", "dos", "tres"]) + rng.choice([" ", "  ", "\n", ". "]) for _ in range(rng.randint(1, 30)))
        for p in range(rng.randint(1, 16)):
            rows.append((doc, doc * 100 + p, f"bar-{p}", "lenguaje_claro", rng.choice(["editada", "aceptada", "aceptada", "pendiente"]), "d", rng.choice(fragments[: 2 + doc % 9]), "x"))
    materials = spark.createDataFrame(list(texts.items()), "doc_id long, raw_text string")
    placed = decisions.proposal_spans(spark.createDataFrame(rows, PROPOSAL), materials).collect()
    got = {r["proposal_id"]: (r["start"], r["end"]) if r["start"] is not None else None for r in placed}
    live = [r for r in rows if r[4] != "pendiente"]
    assert len(placed) == len(live) and {r["replacement"] for r in placed} == {"x"}
    for doc, text in texts.items():
        mine = [r for r in live if r[0] == doc]
        assert [got[r[1]] for r in mine] == places_in_turn(text, [r[6] for r in mine]), (text, mine)


def test_proposals_without_a_place_are_told(spark):
    rows = [("aceptada", "a", "no está", "X"), ("aceptada", "b", "Uno dos", "Y"), ("editada", "a", "dos tres", "Z"), ("aceptada", "c", "dos", "W"), ("descartada", "a", "tampoco", "V")]
    found = spark.createDataFrame([(1, i, f"bar-{i}", "reorganizar", *r) for i, r in enumerate(rows, 1)], PROPOSAL)
    version = closing_report.final_version(docs(spark, "Uno dos tres."), found).collect()[0]
    assert version["adapted_text"] == "Uno Z." and (version["total_proposals"], version["applied"], version["discarded"], version["pending"]) == (5, 1, 1, 0)
    assert version["warnings"] == [
        "No se encontró en el material el fragmento original de la propuesta '1' (bar-1). No se aplicó.",
        "Propuesta '4' (bar-4, reorganizar) no aplicada por solapamiento con la propuesta '3'.", "Propuesta '2' (bar-2, reorganizar) no aplicada por solapamiento con la propuesta '3'."]
    text = tables.export_text(closing_report.final_version(docs(spark, "Uno dos tres."), found)).collect()[0]["content"]
    assert "**Propuestas aplicadas:** 1 de 5" in text and "> - No se encontró en el material" in text


def test_log_is_read_in_order(spark):
    log = spark.createDataFrame([
        (1, 7, "bar-1", "reorganizar", "pendiente", "aceptada", "d1", 1, 0), (1, 7, "bar-1", "reorganizar", "aceptada", "pendiente", "d2", 2, 0),
        (1, 7, "bar-1", "reorganizar", "aceptada", "descartada", "d3", 3, 1), (1, 8, "bar-2", "reorganizar", "pendiente", "editada", "d1", 4, 0)],
        "doc_id long, proposal_id long, barrier_id string, adaptation_type string, from_status string, to_status string, created_at string, seq int, block int")
    assert {r["proposal_id"]: r["status"] for r in decisions.current_status(log).collect()} == {7: "descartada", 8: "editada"}
    assert [(r["seq"], r["previous_status"]) for r in decisions.invalid_transitions(log).collect()] == [(3, "pendiente")]


def test_fragment_behind_a_cut_quote(spark):
    text = docs(spark, "Primera oración corta. Leé el capítulo y respondé las preguntas del final.\nOtro párrafo.")
    quotes = spark.createDataFrame([
        (1, 1, "Leé el capítulo…", "consigna_en_pasos"), (1, 2, "Leé el capítulo…", "reorganizar"), (1, 3, "no está...", "reorganizar"), (1, 4, "[global]", "reorganizar")],
        "doc_id long, quote_id int, original_text string, adaptation_type string")
    got = {r["quote_id"]: (r["fragment"], r["not_found"]) for r in decisions.resolve_fragment(text, quotes).collect()}
    assert got == {1: ("Leé el capítulo y respondé las preguntas del final.", False),
                   2: ("Primera oración corta. Leé el capítulo y respondé las preguntas del final.", False), 3: ("no está...", True)}


def test_a_text_is_split_once_for_all_its_blocks(spark):
    text = "Leé el texto. " * 30_000
    kinds = F.array(*[F.lit(k) for k in cfg.ADAPTATION_TYPES])
    got = {r["kind"]: r["text"] for r in docs(spark, text).select(F.inline(decisions.rewrite_each(F.col("raw_text"), kinds))).collect()}
    assert got["reorganizar"] == "\n\n".join(["Leé el texto. Leé el texto. Leé el texto."] * 10_000)
    plan = docs(spark, text).select(F.inline(decisions.rewrite_each(F.col("raw_text"), kinds)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 3  # once for the sentences, once for each cut of clauses


def test_texts_are_not_read_again_to_number_the_merged_findings(spark):
    materials = docs(spark, "El agua hierve a cien grados.\nOtra línea del material.", "Sin citas.")
    model = spark.createDataFrame([(1, 1, "comprension", "para_revisar", "a", "agua hierve"), (1, 2, "comprension", "para_revisar", "b", "no está"), (1, 3, "comprension", "para_revisar", "b", "No  está")], AI)
    rules = spark.createDataFrame([
        (1, 1, "oraciones_extensas", 1, "comprension", "barrera_detectada", "x", "q", "El agua hierve a cien grados."),
        (1, 13, "contraste_insuficiente", 1, "accesibilidad_visual", "barrera_detectada", "y", "línea del", None),
        (2, 8, "imagenes_sin_verificar", 1, "accesibilidad_visual", "para_revisar", "z", "[1 imagen]", None)], RULE)
    vision = spark.createDataFrame([], "doc_id long, origin int, rule_order int, pos long, category string, severity string, issue string, original_text string, fragment_found boolean, source string")
    found = merge.merge_findings(model, vision, rules, materials)
    assert sorted((r["doc_id"], r["barrier_id"], r["issue"], r["fragment_found"]) for r in found.collect()) == [
        (1, "bar-1", "x", True), (1, "bar-2", "y", True), (1, "bar-3", "a", True), (1, "bar-4", "b", False), (2, "bar-1", "z", None)]
    assert "raw_text" not in found._jdf.queryExecution().optimizedPlan().toString()  # before: read again by every step
