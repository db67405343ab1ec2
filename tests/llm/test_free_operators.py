"""Jaccard join, packing, token files, WARC, main text and quality scores against plain versions and on edge cases."""

import base64
import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumbrera.llm import jaccard_join, line_blocks, packing, pairwise_quality, token_files, warc
from lumbrera.llm.queries import queries
from lumbrera.llm.shared import scratch, written
from lumbrera.llm.tokens import Encoder

from .cases import DOCS, documents, prose, with_clashes

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS)


# --- n-gram Jaccard join ---

def groups_by_hand(rows, percent, width):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both * 100 >= (len(sets[i]) + len(sets[j]) - both) * percent:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return collections.Counter((r[0], len(sets[i]), smallest[find(i)] if sets[i] else r[0]) for i, r in enumerate(rows))


def near_copies():
    """A chain and a star of edited copies, exact copies, and unrelated texts that share a passage."""
    rnd, passage, base, rows = random.Random(4), prose(90, 40), prose(91, 160).split(), []
    for i in range(60):  # star: each copy with its own few edits
        w = list(base)
        for _ in range(rnd.randrange(0, 8)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10 ** 6)}"
        rows.append((1000 + i, " ".join(w), "en", "s", 1))
    w = prose(92, 200).split()
    for i in range(12):  # chain: one more edit at a time
        w[i * 15] = f"c{i}"
        rows.append((2000 + i, " ".join(w), "en", "s", 1))
    rows += [(3000 + i, prose(93, 90), "en", "s", 1) for i in range(20)]
    rows += [(4000 + i, prose(200 + i, 60) + " " + passage + " " + prose(300 + i, 20), "en", "s", 1) for i in range(40)]
    rows += [(5000 + i, passage + f" tail{i % 5}", "en", "s", 1) for i in range(25)]
    return rows


@pytest.mark.parametrize("block", [1500, 16])
def test_groups_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = [r for r in documents() if len(r[1] or "") < 100_000] + near_copies()
    got = jaccard_join.similar_groups(spark.createDataFrame(rows, DOCS), 85, 4).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == groups_by_hand(rows, 85, 4)


def test_groups_with_counts_beyond_the_limit(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "DF_LIMIT", 2)
    rows = near_copies()
    got = jaccard_join.similar_groups(spark.createDataFrame(rows, DOCS), 85, 4).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == groups_by_hand(rows, 85, 4)


def test_groups_on_edge_cases(spark, docs):
    got = jaccard_join.similar_groups(with_clashes(docs), 80, 5)
    assert got.count() == docs.count()
    assert {r["component_id"] for r in got.where("doc_id IN (100, 101, 103)").collect()} == {100}
    assert jaccard_join.similar_groups(docs.limit(0)).count() == 0


# --- tokens, packing, files ---

@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_those_of_the_tokenizer(path):
    ours, theirs, rnd = Encoder(path), Tokenizer.from_file(path), random.Random(3)
    letters = "aB cé'ÉsßΣσ 1٣,.!\n\t\r ñÑ漢字🙂İí<|endoftext|>-_ $ ’ll\x00"
    texts = [r[1] for r in documents() if r[1] and len(r[1]) < 50_000] + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(ours(t), "<u2").tolist() == theirs.encode(t, add_special_tokens=False).ids, repr(t)
    assert ours(None) == ours("") == b""


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_a_known_word_is_not_merged_again_beside_other_marks(path):
    words = ["".join("abcdefghijklmnopqr"[k // 18 ** i % 18] for i in range(4)) + "é" * (k % 2) for k in range(90_000)]
    ours, theirs, merged = Encoder(path), Tokenizer.from_file(path), []
    make, tokenize = ours._piece, ours.tokenize
    ours.tokenize = lambda piece: merged.append(piece) or tokenize(piece)
    assert make == ours._piece
    for mark in (" ", ", ", ". ", "\n"):
        text = "x " + mark.join(words) + " x"
        text = text.replace("\n", " x\nx ") if mark == "\n" else text
        assert np.frombuffer(ours(text), "<u2").tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert len(merged) < len(words) + 20


def ids_by_hand(path):
    t = Tokenizer.from_file(path)
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [1]) for i, x, *_ in documents()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("unit", [2048, 256])
def test_packing_places_every_id_once(spark, docs, unit):
    pieces = written(packing.cut_into_pieces(with_clashes(docs), BYTE, end=1, unit=unit), "pieces")
    packed = packing.pack(pieces.withColumn("_rank", F.lit("own")))
    rows = packed.collect()
    assert rows[0]["_rank"] == "own"
    whole = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in rows:
        assert zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == 2 * r["length"]
        whole[r["doc_id"]][r["start"]].append(bytes(r["ids"]))
    for doc, ids in ids_by_hand(BYTE):
        at = 0
        while at < len(ids):
            candidates = whole[doc][at]
            i = next(i for i, c in enumerate(candidates) if np.frombuffer(c, "<u2").tolist() == ids[at:at + len(c) // 2])
            at += len(candidates.pop(i)) // 2
    assert not any(p for d in whole.values() for p in d.values())
    made = {r["sequence_id"]: r for r in packing.sequences(packed.drop("_rank"), pad=0).collect()}
    fill = collections.defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, places in fill.items():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        power = at & (at - 1) == 0
        assert at <= 2048 and made[k]["n_tokens"] == at and made[k]["n_padding"] == (0 if power else 2048 - at) and len(made[k]["ids"]) == 2 * (at if power else 2048)


def test_patterns_keep_the_histogram():
    rnd = random.Random(8)
    for _ in range(30):
        histogram = {length: rnd.randrange(1, 200) for length in rnd.sample(range(1, 65), rnd.randrange(1, 40))}
        back = collections.Counter()
        for pattern, n in packing.packing_patterns(histogram, 64):
            assert sum(pattern) <= 64 and n > 0
            back.update({length: pattern.count(length) * n for length in set(pattern)})
        assert back == histogram
    assert packing.packing_patterns({}, 64) == []
    # Shortest pack first: the second 3 joins the emptier pack.
    assert dict(packing.packing_patterns({7: 1, 5: 1, 3: 2}, 10)) == {(7, 3): 1, (5, 3): 1}


def test_no_documents_no_pieces(spark, docs):
    assert packing.pack(packing.cut_into_pieces(docs.limit(0), BYTE)).count() == 0


def test_token_files_round_trip_and_lookup(spark, docs):
    path = scratch(spark, "files")
    token_files.write(with_clashes(docs), path, WORD, end=1)
    rows = token_files.read(spark, path).orderBy("start").collect()
    want = collections.Counter((i, crc(ids)) for i, ids in ids_by_hand(WORD))
    assert collections.Counter((r["doc_id"], crc(np.frombuffer(r["ids"], "<u2"))) for r in rows) == want
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]
    some = token_files.read(spark, path, doc_ids=[100, 203]).collect()
    assert {r["doc_id"] for r in some} == {100, 203} and all(any(r == x for x in rows) for r in some)
    sha = spark.read.parquet(f"{path}/dictionary").first()
    assert hashlib.sha256(bytes(sha["dictionary"])).hexdigest() == sha["sha256"]


def test_token_files_of_nothing(spark, docs):
    path = scratch(spark, "files")
    token_files.write(docs.limit(0), path, WORD)
    assert token_files.read(spark, path).count() == 0


def test_a_dictionary_is_trained_where_there_is_enough(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    assert token_files.train_dictionary(rows, WORD, 1) and isinstance(token_files.train_dictionary(rows.limit(0), WORD, 1), bytes)


# --- WARC ---

PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2\n", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 70_001), (6, "u", "é" * 70_001), (7, "u", "WARC/1.1\r\n\r\n0\r\n\r\n" * 9000),
         (8, "u", "tie"), (8, "u", "tie"), (None, "u", "no id"), (None, "u", "<p>x</p>"), (9, "100%0A", "\x00\r\n")]


def test_archives_round_trip(spark):
    path = scratch(spark, "warc")
    warc.write(with_clashes(spark.createDataFrame(PAGES, "page_id bigint, url string, html string")), path, segment_bytes=10_000)
    found = warc.read_records(spark, path)
    assert found.where("type = 'continuation'").count() > 20
    rows = warc.read(spark, path).collect()
    largest = {}
    for i, _, h in PAGES:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = collections.Counter()
    for i, url, h in PAGES:
        raw, top = (h or "").encode(), largest[h or ""]
        revisit = top >= 0 and i != top
        want[(i, url, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None, None if revisit else raw)] += 1
    got = collections.Counter((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in rows)
    assert got == want and all(r["complete"] for r in rows)


def test_a_missing_segment_is_told(spark):
    path = scratch(spark, "warc")
    warc.write(spark.createDataFrame([(1, "u", "y" * 50_000), (2, "u", "z")], "page_id bigint, url string, html string"), path, segment_bytes=10_000)
    records = warc.read_records(spark, path)
    for lost in ("number = 3", "number = 1", "total IS NOT NULL"):
        whole = warc.reassemble(records.where(f"NOT coalesce({lost}, false)")).collect()
        assert sorted(r["complete"] for r in whole) == [False, True]


def test_chunked_framing():
    for n in (0, 1, 4096, 4097, 20_000):
        raw = bytes(range(256)) * (n // 256 + 1)
        assert warc.unchunked(warc.chunked(raw[:n], 4096)) == raw[:n]
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nplain") == b"plain"


def test_no_pages_no_records(spark):
    path = scratch(spark, "warc")
    warc.write(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


# --- main text ---

PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><header><h1>Site name that is long</h1></header>
<div class="cookie-notice">We use cookies, and this is a long notice about them that nobody reads to the end of it.</div><div id="menu"><a href=x>One</a> <a>two</a></div>
%s<div class="sidebar">Side text that is very long and no part of the story at all, surely not, surely never.</div>
<section id="comments"><p>I like this very much, thank you for writing it, it is a long comment indeed.</p></section><form>Name <input> and a label</form><footer>&copy; us</footer></body></html>"""
STORY = "<p>First   paragraph\n&amp; more&nbsp;text that is <b>long</b> enough to be a story, surely it is so.<p>Short.</p><div class=ad>buy &lt;now&gt;</div><ul><li>a<li>b</ul><p>An end."


@pytest.mark.parametrize("page", [PAGE % f"<article><header><h1>T</h1></header>{STORY}</article>", PAGE % f"<div><h1>T</h1>{STORY}</div>", PAGE % f"<main id=x><h1>T</h1>{STORY}</main>"])
def test_main_text(page):
    assert line_blocks.main_text(page) == "T\nFirst paragraph & more text that is long enough to be a story, surely it is so.\nShort.\na\nb\nAn end."


def test_body_in_a_div_beside_teasers_in_articles():
    body = "".join(f"<p>Paragraph {i} of the story, which is long enough to be the main text of the page.</p>" for i in range(8))
    gap = "<nav><p>a</p><p>b</p><p>c</p></nav>"
    want = "\n".join(f"Paragraph {i} of the story, which is long enough to be the main text of the page." for i in range(8))
    teaser = "<article><h2>Another story</h2><p>Read it.</p></article>"
    for tag in ("div", "section"):
        for page in (f"<{tag}>{body}</{tag}>{gap}{teaser}", f"{teaser}{gap}<{tag}>{body}</{tag}>{gap}{teaser}", f"<{tag}>{body}</{tag}><aside>{teaser}{teaser}</aside>"):
            assert line_blocks.main_text(f"<html><body>{page}</body></html>") == want
    assert line_blocks.main_text(f"<article>{body}<aside>{teaser}</aside>{gap}<p>End.</p></article>") == want + "\nEnd."
    assert line_blocks.main_text(f"<nav>menu<article>{body}</article>") == line_blocks.main_text(f"<form><main>{body}</main></form>") == want


def test_main_text_on_edge_cases(spark):
    texts = {None: "", "": "", "<p>Of.": "Of.", "<article><p>a &am": "a &am", "plain": "plain", "<article>x<foo bar=": "x", "<nav>menu": "", "<p>a</p><!-- open": "a", "<script>x": "", "a < b": "a < b"}
    rows = spark.createDataFrame(list(enumerate(texts)), "page_id bigint, html string")
    got = line_blocks.extract(with_clashes(rows).withColumn("text", F.lit("old"))).collect()
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in got} == {i: (t, len(t)) for i, t in enumerate(texts.values())} and got[0]["node"] == "own node"
    assert line_blocks.extract(rows.limit(0)).count() == 0
    assert line_blocks.main_text("<article><p>" + "word " * 200_000) == ("word " * 200_000).strip()


def test_surge_and_dive():
    bare = lambda lengths: line_blocks.stretches(lengths, [False] * len(lengths))
    assert bare([0, 9, 90, 0, 0, 5, 0, 0, 0, 7, 0]) == [(1, 6, 99), (9, 10, 7)]
    assert bare([5, 5, 5, 5, 60, 0, 70, 5, 5, 5]) == [(4, 10, 130)]  # the first window that reaches 80 begins at line 4
    assert bare([5, 5, 5, 5, 90, 5]) == [(2, 6, 100)]
    assert line_blocks.stretches([5, 5, 60, 70, 5], [True, False, False, False, True]) == [(0, 5, 135)]
    assert bare([]) == bare([0, 0, 0]) == []


def test_windows_decide_where_nothing_is_marked():
    body = [f"Ein Absatz {k} mit genug Text, damit die Summe der Fenster ohne jeden Zweifel steigt und bleibt." for k in range(6)]
    lines = lambda texts, tag="div": "".join(f"<{tag}>{t}</{tag}>" for t in texts)
    menu, foot = [f"Zeile {k}" for k in range(7)], ["Impressum", "Kontakt", "Hilfe", "Presse", "Jobs"]
    text = line_blocks.main_text(f"<html><body>{lines(menu)}{lines(body)}{lines(foot)}</body></html>")
    got = text.split("\n")
    # Two short lines fit into a window with the body, as a heading and its byline would; the rest of the menu does not.
    assert got == menu[-2:] + body + foot
    short = [f"Vers {k} geht so" for k in range(12)]
    assert line_blocks.main_text(f"<body>{lines(short)}</body>") == "\n".join(short)  # nothing rises: the part with most text
    teasers = "".join(f"<article><a href='/'>{t}</a></article>" for t in ("Teaser eins", "Teaser zwei", "Teaser drei", "Teaser vier"))
    got = line_blocks.main_text(f"<body><div>{lines(body, 'p')}</div><br>{'<p></p>' * 3}<nav>x</nav>{lines(['', '', ''])}{teasers}</body>")
    assert all(x in got.split("\n") for x in body)
    linked = "<p><a href='/'>Ein Absatz, der fast ganz aus einem Verweis besteht und doch zum Text gehört</a> ja.</p>"
    inside = line_blocks.main_text(f"<body>{lines(body[:3], 'p')}{linked}{lines(body[3:], 'p')}</body>")
    assert inside.split("\n")[3].startswith("Ein Absatz, der fast ganz")
    edge = line_blocks.main_text(f"<body>{linked}{lines(body, 'p')}</body>")
    assert edge == "\n".join(body)


def test_extraction_query_matches_a_plain_version(spark, sf):
    """The given pages mark their article: its blocks, as a plain scanner reads them."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    got = {r["page_id"]: r["text"] for r in queries()["op6_line_blocks"](spark, sf).select("page_id", "text").collect()}
    assert len(got) == len(rows)
    same = 0
    for r in rows:
        article = re.search(r"(?s)<article\b[^>]*>(.*?)(?:</article>|\Z)", re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", r["html"] or ""))
        if not article or re.search(r"<(aside|form|nav|div|section|figure|button|table)\b|class=|hidden|style=|role=", article[1]):
            continue
        blocks = re.split(r"</?(?:p|h[1-6]|li|ul|ol|blockquote|pre|article)\b[^>]*>", re.sub(r"<br\s*/?>|<hr\s*/?>", " ", article[1]))
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        same += 1
        assert got[r["page_id"]] == "\n".join(b for b in want if b), r["page_id"]
    assert same > len(rows) / 4


def test_main_text_of_the_pages(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries()["op6_line_blocks"](spark, sf).collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", pages[r["page_id"]], re.S)[1]
        assert r["text"] and "\n\n" not in r["text"] and r["text"].split()[0] in article and "track(" not in r["text"]


# --- quality scores ---

def test_preferences_are_learned_and_held_out_labels_agree(spark, sf):
    rows = {r["doc_id"]: r for r in queries()["op8_pairwise_quality"](spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    good, bad = ([rows[i]["score"] for i, q in labels.items() if i in rows and q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_newton_finds_the_direction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    label = (x @ [2.0, -1.0, 0.0] + rng.logistic(size=4000) * 0.5 > 0).astype(int)
    found = pairwise_quality.fit(x, label)
    w = found.weights / found.scale
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.15 * w[0] and abs(w[0] / -w[1] - 2) < 0.3
    assert not pairwise_quality.fit(x, np.ones(4000)).weights.any() and not pairwise_quality.fit(np.empty((0, 3)), np.empty(0)).weights.any()


def test_scores_on_edge_cases(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)] + [(None, 1), (9999, 0), (3, None)], "doc_id bigint, label int")
    ranker = pairwise_quality.train(with_clashes(docs), labels)
    rows = pairwise_quality.score(with_clashes(docs), ranker).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows) and rows[0]["_words"] == "own _words"
    none = pairwise_quality.score(docs, pairwise_quality.train(docs, labels.limit(0))).collect()
    assert {r["score"] for r in none} == {0.3} and {r["predicted"] for r in none} == {1}
    assert pairwise_quality.score(docs.limit(0), ranker).count() == 0
