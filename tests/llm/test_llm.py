"""Operators for training data: against brute force, exact round trips, held-out labels, and the awkward inputs."""

import random

import pytest
from pyspark.sql import functions as F

from foliomill.llm import languages, mix, percentiles, pii, pii_labels, residue, scan_labels, scans, tokens, truncation

LONG = "The clerk weighed the upper valve at noon. " * 3000
BLOCKS = "ocr_id long, run_id string, doc_id string, page int, block_id int, kind string, script string, lang string, text string, line string, word string, n long, key string, kind2 string"


def _blocks(spark, texts, block_id=None):
    rows = [(i, f"r{i % 2}", "d", i % 5 + 1, block_id, "printed", "latin", "en", t, "x", "y", 1, "k", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, BLOCKS)


@pytest.fixture(scope="session")
def tagger():
    return pii.fit()


@pytest.fixture(scope="session")
def samples(spark, sf):
    return spark.read.parquet(f"{sf}/lang_sample.parquet")


# ---- 1 residue

RESIDUE = {
    "Dear {{first_name}}, your file was received.": "placeholder",
    "Reference <<meter_id>> replaces the earlier permit.": "placeholder",
    "Account holder: $$total$$": "placeholder",
    "The balance of [COMPANY NAME] remains open.": "placeholder",
    "Empfänger: [Name des Empfängers eintragen]": "placeholder",
    "Le solde de <saisir le montant> reste dû.": "placeholder",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.": "filler",
    "blah blah blah blah": "filler",
    "Body copy to follow.": "filler",
    "HTTP Error 504: Gateway Timeout": "error",
    "Page not found. The file no longer exists.": "error",
    "Archive portal\nERROR ESTABLISHING A DATABASE CONNECTION": "error",
    "Zugriff verweigert. Zurück zur Startseite": "error",
    "Please enable JavaScript to view this page.": "script",
    "In Ihrem Browser sind Skripte ausgeschaltet.": "script",
    "Room 404 was not found on the plan, so the surveyor measured Room 405 instead.": None,
    "The terminal showed the words Page not found, and the duty engineer wrote them into the site diary.": None,
    "Chapter 9 of the manual explains how JavaScript is enabled on the reading terminals of the archive.": None,
    "The clerk wrote [sic] beside the old spelling and [illegible] beside the second line.": None,
    "Boxes ticked: [x] drainage [ ] wiring [x] roof, as agreed.": None,
    "The set {a, b, c} in the drawing stands for the three valves.": None,
    "0 0 0 0 0 0 0 0": None,
    "a b c d e f g h i": None,
    "______": None,
    "": None,
    None: None,
}


def test_residue_kinds(spark):
    texts = [*RESIDUE, LONG]
    got = {r.ocr_id: r.kind for r in residue.judge(_blocks(spark, texts)).collect()}
    assert [got[i] for i in range(len(RESIDUE))] == list(RESIDUE.values())
    assert got[len(RESIDUE)] is None


def test_residue_subtracts_what_returns_on_a_host(spark):
    bar = "Harbour file service desk"
    texts = [f"{bar}\nThe clerk weighed the upper valve number {i} at noon." for i in range(8)] + [f"{bar}\nAccess denied."]
    got = {r.ocr_id: r.kind for r in residue.judge(_blocks(spark, texts)).collect()}
    assert got[8] == "error" and all(got[i] is None for i in range(8))


UNHINTED = {
    "Texte de remplissage, à remplacer avant l'impression.": "filler",
    "405 Method Not Allowed": "error",
    "413 Payload Too Large": "error",
    "410 Gone": "error",
    "409 Conflict": "error",
    "Connection reset": "error",
    "Connection closed": "error",
    "Stack trace": "error",
    "Trop de requêtes": "error",
    "Demasiadas solicitudes": "error",
    "Toegang geweigerd": "error",
    "Zeitüberschreitung": "error",
    "Delivered on: dd/mm/yy": "placeholder",
}


def test_residue_no_gate_before_the_patterns(spark):
    bar = "Harbour file service desk"
    content = [f"{bar}\nThe clerk weighed the upper valve number {i} at noon." for i in range(8)]
    texts = [*UNHINTED, f"{bar}\n410 Gone", "410 go-\n\nne", *content]
    got = {r.ocr_id: r.kind for r in residue.judge(_blocks(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [*UNHINTED.values(), "error", "error", *[None] * 8]


def _residue_rows(spark, rows):
    """(host, text) rows."""
    return spark.createDataFrame([(i, h, t, "x", 1) for i, (h, t) in enumerate(rows)], "ocr_id long, run_id string, text string, line string, n long")


PLANTED = [
    # boilerplate of any length beside a message: only its subtraction lets the message stand alone
    ("bar", "The harbour archive keeps cookies so that the viewer remembers your last page and shelf mark.\n404 Not Found", "error"),
    ("bar", "The harbour archive keeps cookies so that the viewer remembers your last page and shelf mark.\nLorem ipsum dolor sit amet, consectetur.", "filler"),
    ("bar", "The harbour archive keeps cookies so that the viewer remembers your last page and shelf mark.\nThe clerk weighed the valve.", None),
    # what every page of a host carries says nothing of the record: the placeholder and the notice are its furniture
    *(("foot", f"The clerk weighed the {w} valve at noon.\nPrinted by {{{{user_name}}}}", None) for w in ("upper", "lower", "left", "right", "inner", "outer")),
    # a host of nothing but error pages: no residual is left, so they are judged as they are
    *(("dead", "Service Unavailable", "error") for _ in range(6)),
    # a template that returns, but not throughout the host, is no furniture
    *(("mail", "Dear {{first_name}}, your file was received.\nThe clerk weighed the valve.", "placeholder") for _ in range(5)),
    # a message whose own first word is a line that returns
    ("dead", "Error\n502: Bad Gateway", "error"),
    # a recurrent line inside a paragraph isn't subtracted: this quotes a message
    ("bar", "The terminal showed the harbour archive\nPage not found\nand nothing else that day.", None),
]


def test_residue_subtraction_decides_both_ways(spark):
    bar = "The harbour archive keeps cookies so that the viewer remembers your last page and shelf mark."
    more = [("bar", f"{bar}\nThe surveyor counted {w} boxes before noon.") for w in ("two", "three", "four")]
    more += [("mail", f"The surveyor counted {w} crates before noon.") for w in ("two", "three", "four", "five", "six", "seven", "eight")]
    more += [(h, "The terminal showed the harbour archive\nwhich was closed.") for h in "abcde"]
    more += [(h, f"Error\nwas noted twice by the {h} clerk before noon.") for h in "abcdefg"]
    df = _residue_rows(spark, [(h, t) for h, t, _ in PLANTED] + more)
    got = {r.ocr_id: r.kind for r in residue.judge(df).collect()}
    assert [got[i] for i in range(len(PLANTED))] == [k for _, _, k in PLANTED]
    assert not any(got[i] for i in range(len(PLANTED), len(got)))
    plain = {r.ocr_id: r.k for r in df.select("ocr_id", residue.kind(F.col("text")).alias("k")).collect()}
    changed = [(plain[i], got[i]) for i in got if plain[i] != got[i]]
    assert (None, "error") in changed and (None, "filler") in changed and ("placeholder", None) in changed


def test_residue_lines_are_hashed_like_they_are_split(spark):
    texts = ["A  b\t1\r\n \n" + chr(0xA0) + "C 22" + chr(0x2003) + "d\n\nE", "", None, "\n\n", "x\ry"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(residue.text_lines(F.col("t")).alias("a"), residue.normal_lines(F.col("t")).alias("b")).collect()
    assert [len(r.a) for r in rows] == [len(r.b) for r in rows] == [3, 0, 0, 0, 1]
    assert rows[0].b == ["a b 9", "c 9 d", "e"]


def test_residue_content_is_unchanged(spark):
    df = _blocks(spark, [*RESIDUE, *RESIDUE])
    out = residue.content(df)
    assert out.columns == df.columns and out.count() == 2 * sum(v is None for v in RESIDUE.values())
    assert residue.found(df.where("1 = 0")).count() == 0


# ---- 2 personal information


def test_pii_on_held_out_table(tagger):
    decoder = pii.Decoder(tagger)
    rows = pii_labels.table(300, seed=123)
    good = 0
    for pieces in rows:
        text = "".join(p for _, p in pieces)
        want = sorted(k for k, _ in pieces if k)
        good += sorted(k for k, _, _ in decoder.tag([text])[0]) == want
    assert good / len(rows) > 0.95


def test_pii_on_held_out_templates():
    """Templates the tagger never saw, every fifth of the table: other wording, not only other fillings."""
    held = pii_labels.TEMPLATES[::5]
    seen = [t for i, t in enumerate(pii_labels.TEMPLATES) if i % 5]
    decoder = pii.Decoder(pii.Tagger(pii_labels.table(pii_labels.ROWS, 7, seen)))
    right = true = got = 0
    for pieces in pii_labels.table(400, 99, held):
        text = "".join(p for _, p in pieces)
        at, want = 0, set()
        for kind, part in pieces:
            if kind:
                want.add((kind, at))
            at += len(part)
        have = {(k, a) for k, a, _ in decoder.tag([text])[0]}
        right, true, got = right + len(want & have), true + len(want), got + len(have)
    print(f"held-out templates: precision {right / got:.3f}, recall {right / true:.3f}")
    assert right / true > 0.75 and right / got > 0.88  # measured: 0.79 and 0.92


def test_pii_of_a_long_text_is_not_cut(tagger):
    """The same mentions wherever the blocks of the decoder end, also across them."""
    decoder = pii.Decoder(tagger)
    line = "Witnessed by Jonas Gundhagen and Clara Tollehagen. "
    for shift in range(0, 12):
        text = "x " * (pii.CHUNK - shift) + line + "y " * pii.CHUNK + line
        assert [k for k, _, _ in decoder.tag([text, "Call 020 7946 0244 after six."])[0]] == ["person"] * 4
    many = line * 3_000  # some 30,000 tokens without any line end
    assert len(decoder.tag([many])[0]) == 6_000


def test_pii_formats_alone_are_no_mentions(tagger):
    """An insurance number's format on a component is the field's to judge."""
    decoder = pii.Decoder(tagger)
    found = decoder.tag(["Serial QX 44 81 20 D is stamped on the upper valve.", "QQ 44 81 20 D has been checked.", "E-mail zeno @ postfach.example"])
    assert [[k for k, _, _ in x] for x in found] == [[], ["id_number"], ["email"]]


def test_pii_redaction_keeps_the_rest(tagger):
    decoder = pii.Decoder(tagger)
    text = "Call 020 7946 0244 after six and ask for Ruben Bruhnarez.\nThe meter reading 555 0142 was entered twice.\nWrite to ruben@quaymail.example soon."
    out = pii.redact([text, None, "", "  ", LONG], decoder)
    assert out[0] == "Call [PHONE] after six and ask for [PERSON].\nThe meter reading 555 0142 was entered twice.\nWrite to [EMAIL] soon."
    assert out[1:] == [None, "", "  ", LONG]


def test_pii_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    t = len(pii.TAGS)
    e, s = rng.normal(size=(1, 4, t)).astype("f4"), rng.normal(size=(t, t)).astype("f4")
    banned = {pii.TAGS.index("I-address"), pii.TAGS.index("I-person")}
    best = max((p for p in itertools.product(range(t), repeat=4) if p[0] not in banned), key=lambda p: sum(e[0, i, p[i]] for i in range(4)) + sum(s[a, b] for a, b in zip(p, p[1:])))
    assert tuple(pii.viterbi([e], s, np.array([4]))[0]) == best == tuple(pii.viterbi([e[:, :1], e[:, 1:]], s, np.array([4]))[0])


def test_pii_table(spark):
    df = _blocks(spark, ["Witnessed by Jonas Gundhagen and Clara Tollehagen.", None, "", "0 0 0 0 0 0 0"])
    rows = sorted(tuple(r) for r in pii.found(df).collect())
    assert rows == [(0, "person", 1), (0, "person", 2)]
    assert pii.redacted(df.where("1 = 0")).count() == 0


# ---- 3 scans


def _scan_texts():
    body = "The stores manager replaced the roof survey. The ledger for the spring quarter was copied."
    words = [body] * 60
    pages = [f"Register of Things | Draft 7   - {p} -\n\nThe inspector weighed the sto-\nrage permits twice.\n\n{body}" for p in range(1, 5)]
    return words, pages


def test_scan_defects_and_repair(spark):
    words, pages = _scan_texts()
    rows = [(i, "r", "d", i + 1, None, "printed", "latin", "en", t, "x", "y", 1, "k", "z") for i, t in enumerate(pages)]
    rows += [(100 + i, "q", "d", 1, 3, "printed", "latin", "en", t, "x", "y", 1, "k", "z") for i, t in enumerate(words)]
    rows += [(300, "q", "d", 1, 3, "printed", "latin", "en", "The lcdger was c0pied. See 1980-\n1984.", "x", "y", 1, "k", "z"), (301, "q", "d", 1, 3, "", "", "", None, "x", "y", 1, "k", "z"), (302, "q", None, None, None, "", "", "", " \n ", "x", "y", 1, "k", "z")]
    df = spark.createDataFrame(rows, BLOCKS)
    got = {r.ocr_id: (r.text, sorted(r.defects)) for r in scans.repaired(df).collect()}
    for i in range(4):
        assert got[i][1] == ["header", "hyphen", "page_number"]
        assert got[i][0] == "The inspector weighed the storage permits twice.\n\n" + words[0]
    assert got[300] == ("The ledger was copied. See 1980- 1984.", ["misread"])
    assert got[301] == (None, []) and got[302] == (" \n ", [])
    assert all(got[100 + i] == (words[0], []) for i in range(60))
    assert scans.found(df.where("1 = 0")).count() == 0


@pytest.mark.parametrize("rows", [7, 9, 40])
def test_frequent_misreadings_are_found(spark, rows):
    """A recogniser's systematic error: however many rows have it, it is judged; both ways to look up what was meant agree."""
    body = ["The ledger for the spring quarter was copied."] * (rows * 25)
    texts = body + ["The lcdger was closed early."] * rows + ["The w@rden counted c0pied sheets.", "warden"] + ["The warden copied it."] * 60
    df = _blocks(spark, texts, block_id=1)
    found = [sorted((r.ocr_id, tuple(sorted((f.word, f.meant) for f in r.fixes))) for r in scans.misreadings(df, limit).collect()) for limit in (scans.MAX_COMMON, 0)]
    assert found[0] == found[1]
    got = dict(found[0])
    assert sum(x == (("lcdger", "ledger"),) for x in got.values()) == rows
    assert got[len(body) + rows] == (("c0pied", "copied"), ("w@rden", "warden"))


def test_rare_words_can_be_meant_in_a_large_corpus(spark):
    """What counts is how much more frequent a word is, not its share of the corpus."""
    texts = ["alpha beta gamma delta epsilon zeta eta theta " * 200] * 40 + ["kvartal"] * 25 + ["kvarta1"]
    got = scans.misreadings(_blocks(spark, texts, block_id=1)).collect()
    assert [(r.ocr_id, [tuple(f) for f in r.fixes]) for r in got] == [(65, [("kvarta1", "kvartal")])]


def test_long_heads_are_heads(spark):
    title = "Register of the Deliveries, Leases and Storage Permits of the Lower Harbour and its Warehouses, Volume Nine"
    assert len(title) > 98
    text = "{t}\n\nThe inspector weighed the {w} permits twice. The ledger was copied before the {w} visit."
    pages = [text.format(t=title, w=w) for w in ("storage", "harbour", "upper", "second", "third", "sixth")]
    rows = [(i, "r", "d", i + 1, None, "printed", "latin", "en", t, "x", "y", 1, "k", "z") for i, t in enumerate(pages)]
    got = scans.found(spark.createDataFrame(rows, BLOCKS)).collect()
    assert sorted((r.ocr_id, r.defect) for r in got) == [(i, "header") for i in range(6)]


def test_line_model_on_held_out_pages():
    """Pages of another seed: the labels of heads and numbers, of which those that stand on one page only can't be known."""
    right = true = got = 0
    for pages in scan_labels.table(150, 99):
        heads = scans._recurrent([(p, [x for x, _ in lines]) for p, lines in enumerate(pages, 1)])
        for page, lines in enumerate(pages, 1):
            labels, _ = scans.label_lines([x for x, _ in lines], page, heads)
            for (_, want), have in zip(lines, labels):
                marks = (scan_labels.HEAD, scan_labels.NUMBER)
                true, got, right = true + (want in marks), got + (have in marks), right + (want == have and want in marks)
    print(f"lines of held-out pages: precision {right / got:.3f}, recall {right / true:.3f}")
    assert right / got > 0.95 and right / true > 0.9


def test_viterbi_of_lines_is_the_best_path():
    import itertools

    emit, steps, start, unseen = model = scans.line_model()
    lines = ["Site Diary", "4", "", "The ledger was copied.", "Site Diary"]
    seen = scans._observations(lines, scans.number_patterns(4), {"site diary"})

    def score(path):
        out = start[path[0]] + sum(steps[a][b] for a, b in zip(path, path[1:]))
        for got, k in zip(seen, path):
            out += scans._NEVER if (got is None) != (k == scan_labels.BLANK) else 0 if got is None else sum(emit[k].get(x, unseen) for x in got[0])
        return out

    best = max(itertools.product(range(4), repeat=len(lines)), key=score)
    assert tuple(scans.label_lines(lines, 4, {"site diary"}, model)[0]) == best


def test_page_numbers():
    whole = scans.number_patterns(6)[0]
    assert scans.number_patterns(402)[0].fullmatch("cdii")
    for s in ("6", "- 6 -", "[6]", "Seite 6", "p. 6 of 13", "6/21", "vi"):
        assert whole.fullmatch(s), s
    for s in ("16", "6.4", "66", "Sheet 6", "6 boxes"):
        assert not whole.fullmatch(s), s


# ---- 4 languages


def test_languages_on_held_out_sentences(samples):
    rows = sorted((r.lang, r.text) for r in samples.collect())
    random.Random(1).shuffle(rows)
    models = languages.Models(sorted(rows[100:]))
    bits, _ = models.code_lengths([t for _, t in rows[:100]])
    assert sum(models.langs[b.argmin()] == lang for b, (lang, _) in zip(bits, rows)) >= 98


def test_code_lengths_are_those_of_a_plain_model():
    texts = [("a", "abab ab abc."), ("b", "bcbc cb xyz.")]
    m = languages.Models(texts)

    def plain(lang, s):
        counts = {}
        for la, t in texts:
            if la == lang:
                d = languages._bytes(t)
                for i in range(languages.ORDER, len(d)):
                    for k in range(languages.ORDER + 1):
                        counts.setdefault(d[i - k : i], {}).setdefault(d[i], 0)
                        counts[d[i - k : i]][d[i]] += 1
        import math

        d, total = languages._bytes(s), 0.0
        pad = languages.ORDER
        for i in range(pad, len(d)):
            for k in range(languages.ORDER, -1, -1):
                c = counts.get(d[i - k : i])
                if c is None:
                    continue
                n, t = sum(c.values()), len(c)
                if d[i] in c:
                    total += math.log2((n + t) / c[d[i]])
                    break
                total += math.log2((n + t) / t)
            else:
                total += 8.0
        return total

    for s in ("abc ab.", "xyz", "q", "ab"):
        bits, _ = m.code_lengths([s])
        for j, lang in enumerate(m.langs):
            assert abs(bits[0, j] - plain(lang, s)) < 1e-3


def test_mixed_and_awkward_texts(spark, samples):
    models = languages.fit(samples)
    texts = ["The clerk weighed the upper valve at noon. Die Seite 9 ist trocken und kann nicht gelesen werden.", None, "", "Meter no. 90", "0 0 0 0", LONG]
    got = {}
    for r in languages.segments(_blocks(spark, texts), models).collect():
        got.setdefault(r.ocr_id, []).append((r.segment, r.lang))
        assert 0 <= r.confidence <= 1
    assert sorted(got) == [0, 5] and sorted(got[0]) == [(1, "en"), (2, "de")] and {x[1] for x in got[5]} == {"en"}
    empty = languages.Models([])
    assert {x[1] for x in languages.label(empty, [texts[0]])[0]} == {"und"}


def test_heads_are_no_sentences():
    body = "The clerk weighed the upper valve at noon.\nThe surveyor counted the crates before the visit."
    for head in ("REGISTRE DES LIVRAISONS. BOOK 22", "- 9 -   Annual Survey of Wells. Book 13", "Manual for Pump Keepers. Band vii"):
        for page in (f"{head}\n\n{body}", f"{body}\n{head}\n- 8 -", f"{head}\np. 2 of 7\n{body}", f"{body}\n\n{head}\n\n{body}"):
            assert {s for s in languages.sentences_of(page)} == set(body.split("\n")), page
    # lines of a paragraph that end in a number by chance stay
    text = "The pump failed. See file 20\nfor the remarks on the upper valve.\n\nThe ink had faded."
    assert "See file 20 for the remarks on the upper valve." in languages.sentences_of(text)


def test_labels_to_mend(spark, samples, sf):
    codes = spark.read.parquet(f"{sf}/lang_code.parquet")
    s = "The clerk weighed the upper valve at noon."
    rows = [(i, script, lang, s) for i, (script, lang) in enumerate([("latin", "en"), ("Latin ", " ENG"), ("latin", None), ("", "en"), ("greek", "en"), ("latin", "de"), ("unknown", "en")])]
    df = spark.createDataFrame(rows, "ocr_id long, script string, lang string, text string")
    got = {r.ocr_id: r.mend for r in languages.blocks(df, languages.fit(samples), codes).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, 4: True, 5: True, 6: True}


def test_every_block_has_a_language(spark, samples, sf):
    from foliomill.llm.queries import QUERIES

    codes = spark.read.parquet(f"{sf}/lang_code.parquet")
    texts = ["Die Prüfung der Anlage wurde noch nicht abgeschlossen und", "The clerk weighed the upper valve at noon.", "Summary of the inspection of the valves", None, " \n ", "0 0 0 0"]
    texts += ["Summary of the inspection of the upper valves in the store\n\nZusammenfassung der Prüfung der oberen Ventile und der Anlage"]
    got = {}
    for r in languages.blocks(_blocks(spark, texts), languages.fit(samples), codes, every=True).collect():
        got.setdefault(r.ocr_id, {})[r.lang] = (r.sentences, r.confidence, r.mend)
    assert {i: sorted(x) for i, x in got.items()} == {0: ["de"], 1: ["en"], 2: ["en"], 3: ["und"], 4: ["und"], 5: ["und"], 6: ["de", "en"]}
    assert got[1]["en"][0] == 1 and all(x["und"][:2] == (0, 0.0) for i, x in got.items() if i in (3, 4, 5))
    assert not any(m for i, x in got.items() if i != 1 for n, _, m in x.values())
    every = spark.read.parquet(f"{sf}/ocr_block.parquet").select("ocr_id").distinct().count()
    for name in ("p4_labels", "p4_segments"):
        assert QUERIES[name](spark, sf).select("ocr_id").distinct().count() == every


# ---- 5 percentiles


@pytest.mark.parametrize("digits", [None, 5])
def test_percentiles_against_brute_force(spark, digits):
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, -1, 0, 5, 5, r.randint(0, 10**6)]), i % 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x long, day int").withColumn("n", F.lit(1)).withColumn("value", F.lit("clash"))
    parts = [percentiles.summarise(df.where(F.col("day") == d), F.col("x"), {"g": F.col("g")}, digits) for d in range(3)]
    both = percentiles.combine(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["g"])
    got = {x.g: x for x in percentiles.percentiles(both, ["g"], [1, 500, 990, 1000], digits).collect()}
    for g in ("a", "b", None):
        xs = sorted(x for k, x, _ in rows if k == g and x is not None and x >= 0)
        for q in (1, 500, 990, 1000):
            exact = xs[-(-len(xs) * q // 1000) - 1]
            assert got[g].n == len(xs) and 0 <= exact - got[g][f"p{q}"] <= got[g].error_bound
            assert digits or got[g].error_bound == 0
    assert percentiles.percentiles(percentiles.summarise(df.where("1 = 0"), F.col("x"), {"g": F.col("g")}), ["g"], [500]).count() == 0


@pytest.mark.parametrize("digits", [None, 6])
@pytest.mark.parametrize("kind", ["double", "decimal(12,4)", "float"])
def test_percentiles_of_fractions(spark, kind, digits):
    r = random.Random(8)
    xs = [0.25, 0.5, 0.625, 0.875] * 3 + [0.0, 1.5] + [round(r.random() * 10 ** r.randint(-2, 5), 4) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(F.col("x").cast(kind).alias("x"))
    exact = sorted(float(v.x) for v in df.collect())
    if kind != "decimal(12,4)":
        df = df.unionByName(spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (-1.5,)], "x double").select(F.col("x").cast(kind).alias("x")))
    got = percentiles.percentiles(percentiles.summarise(df, F.col("x"), {"g": F.lit(1)}, digits), ["g"], [1, 500, 990], digits).first()
    assert got.n == len(exact) and (digits or got.error_bound == 0)
    for q in (1, 500, 990):
        want = exact[-(-len(exact) * q // 1000) - 1]
        assert -1e-9 <= want - float(got[f"p{q}"]) <= float(got.error_bound) + 1e-9 and float(got.error_bound) <= max(exact) / 2**5 * 2
    small = spark.createDataFrame([(x,) for x in (0.2, 0.4, 0.6, 0.9)], "x double")
    assert percentiles.percentiles(percentiles.summarise(small, F.col("x"), {"g": F.lit(1)}), ["g"], [500]).first().p500 == 0.4


def test_percentiles_of_crowded_values(spark):
    """All values in one octave of a wide column: the ranges lie where the values do."""
    df = spark.range(20_000).select((F.lit(10**15) + F.col("id")).alias("x"), (F.col("id") % 3).alias("g"))
    summary = percentiles.summarise(df, F.col("x"), {"g": F.col("g")})
    got = {r.g: r.p500 for r in percentiles.percentiles(summary, ["g"], [500]).collect()}
    for g in range(3):
        xs = [10**15 + i for i in range(g, 20_000, 3)]
        assert got[g] == xs[-(-len(xs) * 500 // 1000) - 1]


def test_percentile_queries_equal_their_sql(spark, sf):
    import duckdb

    from foliomill.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for name in ("page_summary", "documents"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name in ("p5_latency", "p5_latency_grid", "p7_round_trip"):
        df = QUERIES[name](spark, sf)
        rel = con.execute(ORACLES[name])
        names = [d[0] for d in rel.description]
        want = sorted(repr([dict(zip(names, r))[c] for c in sorted(names)]) for r in rel.fetchall())
        assert sorted(df.columns) == sorted(names)
        assert sorted(repr([r[c] for c in sorted(names)]) for r in df.collect()) == want


# ---- 7 tokens, 8 mixing

DOCS = ["Hello world, it's 2026!", "", None, "  \n\n a\t b  ", "日本語テキスト 👍🏽 é", "<|endoftext|> don't", "a" * 5000 + " " * 300 + "b", LONG, "Hello world, it's 2026!"]


def _docs(spark):
    return spark.createDataFrame([(i, t, "s%d" % (i % 2), "x", "y", 3) for i, t in enumerate(DOCS)], "doc_id long, text string, source string, word string, ids string, n int")


def test_encoding_equals_the_tokenizer_and_round_trips(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.TOKENIZER)
    tok.encode_special_tokens = True
    out = tokens.encode(_docs(spark)).cache()
    got = {r.doc_id: list(r.ids) for r in out.collect()}
    assert got == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(DOCS)}
    assert {r.doc_id: r.text for r in tokens.decode(out).collect()} == {i: t or "" for i, t in enumerate(DOCS)}
    assert {r.doc_id: r.tokens for r in tokens.count_tokens(_docs(spark)).collect()} == {i: len(x) for i, x in got.items()}
    assert tokens.encode(_docs(spark).where("1 = 0")).count() == 0
    twice = tokens.encode(_docs(spark).unionByName(_docs(spark)))
    assert twice.count() == len(DOCS)


def test_mix_reaches_its_shares(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["big"] * 8 + ["mid", "mid", "small", None, "other"]), r.randint(0, 400)) for i in range(20_000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("gone", 0.1, 2), ("none", None, 1)], "source string, target_share double, max_repeat int")
    rates = mix.calibrate(sized, mix.rates(sized, targets)).cache()
    got = {x.source: x for x in mix.shares(sized, rates).collect()}
    total = 0.5 + 0.3 + 0.2
    for s, share, cap in (("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)):
        assert abs(got[s].actual_share - share / total) < 0.002 and got[s].most_copies <= cap
    assert got["gone"].rate == 0 and got["none"].rate == 0
    assert max(x.rate / x.max_repeat for x in got.values() if x.max_repeat) == 1
    first = sorted(tuple(x) for x in mix.emit(sized, rates).collect())
    assert first == sorted(tuple(x) for x in mix.emit(sized.repartition(7), rates).collect())
    assert mix.emit(sized.where("1 = 0"), rates).count() == 0


# ---- 9 cut texts

ENDS = [
    ("The clerk weighed the upper valve. The inspector asked wheth", True), ("The clerk weighed the upper valve at noon.", False), ("One sentence. The fee is 5 EU" + chr(0xFFFD), True), ("One sentence. The clerk " + chr(0x2026), True),
    ("One sentence. The clerk weig [more]", True), ("One sentence. And so it ended.\n\nYours faithfully\nHarbour Office", False), ("One sentence.\n\n- QV-1\n- QV-2", False), ("A | 1 | 2 EUR\nB | 2 | 3 EUR", False),
    ("One sentence.\n\nRef. SN-3712", False), ("One sentence.\n\n=== END ===", False), ("One sentence. (The amount was entered twice.)", False), ("One sentence. (The amount was entered", True), ("One sentence. " + chr(0x2713), False),
    ("One sentence. The rest of it [remainder of this document was truncated]", True), ("One sentence. The rest of it\n[continued on the next sheet]", True), ("First line\nSecond unfinished line without the", True),
    ("One sentence. (It was entered twice because the remainder was missing.)", False), ("One sentence.\n\nMit freundlichen Grüßen\nArchiv, Lesesaal 4", False), ("Short heading\nThe clerk weig", True), ("One sentence." + " " * 400 + "The clerk weig" + " " * 300, True),
    ("检查员检查了送货单。会议决定由", True), ("检查员检查了送货单。", False), ("", False), (None, False), (" \n", False), ("It said \\u00e", True),
]


def test_cut_texts(spark):
    rows = [(i, t, "s", "x", "y") for i, (t, _) in enumerate(ENDS)] + [(1000 + i, f"Sentence number {i} ends here.", "s", "x", "y") for i in range(200)] + [(5000, LONG + "and then the", None, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, line string, tail string")
    got = {r.doc_id for r in truncation.found(df).collect()}
    assert got == {i for i, (_, cut) in enumerate(ENDS) if cut} | {5000}
    rates = {r.source: r.cut for r in truncation.rates(df).collect()}
    assert rates == {"s": len(got) - 1, None: 1}
    assert truncation.found(df.where("1 = 0")).count() == 0


def test_left_open(spark):
    cases = {"a (b [c] d": "(", "a (b) c": "", "x ] ) y": "", "( lost\n\nnext paragraph": "", 'he said "so': '"', 'a "b" c': "", "1 < 2": "", "<b": "<", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.o for r in df.select("t", truncation.left_open(F.col("t")).alias("o")).collect()} == cases


# ---- the registered queries


WORKERS = """
import sys
sys.path.insert(0, {root!r})  # the driver finds the package, the workers don't
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
from foliomill.llm.queries import QUERIES
def importable(batches):
    for b in batches:
        try:
            import foliomill
            b["id"] = 1
        except ImportError:
            b["id"] = 0
        yield b
assert spark.range(1).mapInPandas(importable, "id long").first()[0] == 0
for name in ("p2_found", "p3_found", "p4_labels", "p7_ids"):
    print(name, QUERIES[name](spark, {sf!r}).count())
"""


def test_workers_need_no_package(tmp_path, sf):
    import os
    import subprocess
    import sys

    import foliomill

    root = os.path.dirname(os.path.dirname(foliomill.__file__))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "driver.py"
    script.write_text(WORKERS.format(root=root, sf=sf))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert all(int(line.split()[1]) > 0 for line in done.stdout.splitlines())


def test_registered_queries_run(spark, sf):
    from foliomill.llm.queries import QUERIES

    for name in ("p1_found", "p2_found", "p3_found", "p4_found", "p9_found"):
        df = QUERIES[name](spark, sf)
        assert df.columns[0] in ("ocr_id", "doc_id") and df.count() >= 0
