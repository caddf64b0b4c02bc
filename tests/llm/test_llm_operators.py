"""Small tests of the operators for training text, against brute force, round trips or labelled rows."""

import base64
import functools
import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.llm import canonical_map, corpus_tokens, leakage, linkage, mojibake, name_variants, pairs, pii, response_defects

VOCABULARY = corpus_tokens.VOCABULARY


@functools.cache
def direct_encoder():
    import tiktoken

    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("direct", pat_str=corpus_tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def direct(text):
    return direct_encoder().encode_ordinary(text)


# --- 8: corpus encoding ---------------------------------------------------------------------------------------------


def test_joins_are_exact():
    enc = corpus_tokens.encoder(VOCABULARY)
    rng = random.Random(2)
    bits = ["a", "'l", "'", "l", " ", "  ", "\n", "re", "don't", "x ", "é", "期刊", "!!", "'ve ", "12", " the", "🙂", "-", "word "]
    for _ in range(3000):
        parts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 5))]
        assert enc.join([enc.encode(p.encode()) for p in parts]).tolist() == direct("".join(parts))


def test_encode_corpus(spark):
    passage = "The archive of tests keeps one passage that many documents share. " * 30
    texts = [None, "", " ", "<|endoftext|> is plain", passage, passage, "Other start. " + passage, "naïve café 期刊🙂 " * 200, passage * 40]
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pos string, chunk int")
    got = {r.doc_id: r.ids for r in corpus_tokens.encode_corpus(df).collect()}
    assert got == {i: direct(t or "") for i, t in enumerate(texts)}
    assert corpus_tokens.encode_corpus(df.limit(0)).count() == 0


# --- 5: name variants -----------------------------------------------------------------------------------------------


def test_name_readings():
    same = ["Hexby University Press", "HEXBY UNIV. PR.", "University Press of Hexby", "Press, Hexby University", "Hexby UP", "Hexby U. P.", "Univ. Press Hexby", "The Hexby Universiity Press", "Hexby University Press Ltd.", "Hexby University Press – Journals Division"]
    assert {name_variants.readings(n)[0] for n in same} == {("press university", "hexby")}
    assert name_variants.readings("Hexby Press") == [("press", "hexby")]
    assert name_variants.readings("B & A Publishing Company") == name_variants.readings("A and B")
    assert name_variants.readings("") == [] and name_variants.readings(" , ") == []


def test_radius_join_is_exact(spark):
    rng = random.Random(3)
    words = list({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 12))) for _ in range(150)})
    forms = spark.createDataFrame([(i, "press" if i % 3 else "verlag", w) for i, w in enumerate(words)], "form long, kind string, core string")
    got = {(r.form_a, r.form_b) for r in name_variants.radius_join(forms).collect()}

    def near(a, b):
        least = max(1, int(min(len(a), len(b)) / 3.5), 2 if sorted(a) == sorted(b) else 0)
        return name_variants.edits(a, b) <= min(name_variants.RADIUS, least)

    want = {(i, j) for i, j in itertools.permutations(range(len(words)), 2) if (i % 3 > 0) == (j % 3 > 0) and near(words[i], words[j])}
    assert got == want


def test_link_names(spark):
    names = ["Hexby University Press", "University Press, Hexby", "Hexby Univeristy Press", "HEXBY PRESS", "Hexby Press", " ", None, "APRR (Association of Peer Review Research)", "APRR", "Assoc. of Peer Review Res.", "Fathom Scientific Publishing", "Fathom", "Hexby Press, Ostfeld", "Ostfeld Press"]
    df = spark.createDataFrame([(n, 1, n) for n in names * 3], "a string, org int, b string")
    linked = name_variants.link_names(df, ["a", "b"])
    org = dict(linked.collect())
    assert len({org[n] for n in names[:3]}) == 1 and org["HEXBY PRESS"] == org["Hexby Press"] == org["Hexby Press, Ostfeld"] != org[names[0]]
    assert len({org[n] for n in names[7:10]}) == 1 and org["Fathom"] == org["Fathom Scientific Publishing"] and org["Ostfeld Press"] != org["Hexby Press"]
    assert " " not in org and all(r.name_a < r.name_b for r in name_variants.variant_pairs(linked).collect())
    assert name_variants.link_names(df.limit(0), ["a"]).count() == 0


# --- 6: mapping to a list -------------------------------------------------------------------------------------------


def test_map_to_list(spark):
    ref = spark.createDataFrame([("v1", "Journal of Peer Review", "1111-1119", None), ("v2", "Annals of Food Safety", None, "22222222"), ("v3", "Twin Letters", "3333-3333", None), ("v4", "Twin Letters", "4444-4444", None), ("v1", "Journal of Peer Review", None, None)], "venue_key string, title string, issn_print string, name string")
    rows = ["J. Peer Review", "Jrnl of Peer Reveiw", "Peer Review, Journal of", "Journal of Peer Review", "Journal of Peer Review Research", "Ann. of Food Saftey (Online)", "n/a", "Twin Letters", None, "", "Food Safety, Annals of : new series", "x " * 3000]
    issn = [None] * 6 + ["ISSN 2222-2222", "44444444"] + [None] * 4
    df = spark.createDataFrame([(i, n, s, "t") for i, (n, s) in enumerate(zip(rows, issn))], "entry_id long, name string, id0 string, title string")
    out = {r.row_id: r.key for r in canonical_map.map_to_list(df, "entry_id", "name", ["id0"], ref, "venue_key", "title", ["issn_print", "name"]).collect()}
    assert out == {0: "v1", 1: "v1", 2: "v1", 4: "unmatched", 5: "v2", 6: "v2", 7: "v4", 9: "unmatched", 10: "v2", 11: "unmatched"}
    assert set(r.key for r in canonical_map.map_to_list(df, "entry_id", "name", ["id0"], ref.limit(0), "venue_key", "title", ["issn_print"]).collect()) == {"unmatched"}


def test_words_that_go_without_saying(spark):
    topics = ["Urban Planning", "Sleep Medicine", "Dental Imaging", "School Psychology", "Food Safety"]
    ref = spark.createDataFrame([(f"c{k}", f"Proceedings of the Conference on {x}", None) for k, x in enumerate(topics)] + [("j", "Journal of Urban Planning", None)], "venue_key string, title string, issn string")
    names = ["2019 Conference on Urban Planning", "Conference on Sleep Medicine Research", "Proceedings of Urban Planning", "Urban Planning"]
    df = spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], "entry_id long, name string, issn string")
    out = {r.row_id: r.key for r in canonical_map.map_to_list(df, "entry_id", "name", ["issn"], ref, "venue_key", "title", ["issn"]).collect()}
    assert out == {0: "c0", 1: "unmatched", 2: "c0", 3: "unmatched"}


def test_names_with_slips_in_short_words(spark):
    titles = ["Journal of Food Safety", "International Journal of Food Safety", "Zeitschrift für Peer Review", "Peer Review", "European Archives of Sleep Medicine", "Sleep Medicine and Society", "Journal of Museum Studies Research", "Transactions on Tax Compliance", "Trade History Review", "Journal of Plant Genetics", "Journal of Marine Ecology", "Annals of Marine Ecology"]
    ref = spark.createDataFrame([(f"k{n}", t, None) for n, t in enumerate(titles)], "venue_key string, title string, issn string")
    meant = {"Int J Food Safety": 1, "J Food Safety": 0, "Z Peer Rev": 2, "Peer Reviiew Review": 3, "Eur Arch Sleep Med": 4, "Sleep Med. and roc.": 5, "J. of Museum Studies ues.": 6, "Trans Tax Compliance": 7, "Int J Plant Genetics": None, "Journal of Plant Genetics Yearbook": None, "Plant Genetics": None, "Xn. of Marine Ecology": 11, "Xx. of Marine Ecology": None}
    df = spark.createDataFrame([(i, n, None) for i, n in enumerate(meant)], "entry_id long, name string, issn string")
    out = {r.row_id: r.key for r in canonical_map.map_to_list(df, "entry_id", "name", ["issn"], ref, "venue_key", "title", ["issn"]).collect()}
    assert {n: out[i] for i, n in enumerate(meant)} == {n: "unmatched" if k is None else f"k{k}" for n, k in meant.items()}


# --- 3: wrong decoding ----------------------------------------------------------------------------------------------

CORPUS = ["Größe und Gewicht der Zeitschriften", "les évaluations à l’épreuve des médias", "the history of testing with the matter of estimates", "los países y la evaluación de índices", "stable national forests with histories"] * 60


@pytest.fixture(scope="module")
def model():
    import re
    from collections import Counter

    return mojibake.CleanModel(dict(Counter(w for t in CORPUS for w in re.findall(r"[^\W\d_]+", t.lower()))))


@pytest.mark.parametrize("charset", ["cp1252", "mac_roman", "cp437", "cp1251"])
def test_round_trip(model, charset):
    for text in ("Größe und Gewicht der Zeitschriften", "les évaluations des médias", "los países y la evaluación"):
        spoilt = text.encode().decode(charset, "ignore") if charset != "cp1252" else text.encode().decode("latin-1")
        try:
            if spoilt.encode(charset if charset != "cp1252" else "latin-1").decode() != text:
                continue
        except UnicodeError:
            continue
        found = mojibake.examine(spoilt, model)
        assert found and found[1] == text


def test_other_damage(model):
    text = "the history of testing with the matter of estimates"
    assert mojibake.examine(" ".join(text).replace("   ", "   "), model)[1] == text
    assert mojibake.examine("\x00".join(text), model)
    assert mojibake.examine("".join(chr(ord(c) - 29) for c in text), model)[1] == text
    assert mojibake.examine("les �valuations des m�dias", model)[1] == "les évaluations des médias"


@pytest.mark.parametrize("clean", [None, "", "  ", *CORPUS[:5], "GRÖSSE UND GEWICHT DER ZEITSCHRIFTEN", "the history &amp; <i>matter</i>??", "the hsitory of testing", "the history of testing with the mat...", "Größe und Gewicht der Zeitschriften " * 300])
def test_clean_stays(model, clean):
    assert mojibake.examine(clean, model) is None


def test_repair(spark):
    rows = [("t", i, t) for i, t in enumerate([*CORPUS, None, "", "Größe".encode().decode("latin-1") + " und Gewicht der Zeitschriften"])]
    df = spark.createDataFrame(rows, "src_table string, row_id long, text string")
    assert [r.row_id for r in mojibake.repair(df, df.select("text")).collect()] == [len(rows) - 1]
    assert mojibake.repair(df.limit(0), df.limit(0).select("text")).count() == 0


def test_gaps_of_any_word():
    common = ["".join(w) for w in itertools.islice(itertools.product("bdfghklmnprstvwz", "aeiou", "bdfghklmnprstvwz", "aeiou", "nrs"), 6500)]
    model = mojibake.CleanModel({w: 100 for w in common} | {"unverständlichkeiten": 60, "plateformes": 50, "sur": 90, "le": 90, "aucun": 90})
    assert [w for w in model.gapped("unver   ndlich ei en")] == ["unverständlichkeiten"]  # 20 letters, four different ones lost
    assert mojibake.examine("le unverständlich eiten sur", model) == ("lost", "le unverständlichkeiten sur")
    assert mojibake.examine("aucun p a e ormes", model) == ("lost", "aucun plateformes")  # behind 6,500 more frequent words


def test_every_word_counts(spark):
    words = [a + b + c for a, b, c in itertools.product("abcdefghijklmnopqrstuvwxyzäöüßéèàçñøåæ", repeat=3)] + ["größe"]
    rows = [(" ".join(words[k : k + 50]),) for k in range(0, len(words), 50)] + [(" ".join(words[::70]),)] * 25 + [("grÃ¶ÃŸe " * 40,)]
    texts = spark.createDataFrame([*rows, (None,)], "text string")
    some = spark.createDataFrame([(" ".join("".join(p) for p in itertools.product("abcdefghijklmnop", repeat=4)),)], "text string")
    model, counts = mojibake.CleanModel(*mojibake.lexicon(texts.union(some))), {r.word: r.n for r in mojibake.word_counts(texts.union(some)).collect()}
    assert len(counts) > 120_000 and {w: model.count(w) for w in counts if w.isascii()} == {w: n for w, n in counts.items() if w.isascii()}
    whole = mojibake.CleanModel(counts)
    assert (model.rare, model.pairs, model.singles) == (whole.rare, pytest.approx(whole.pairs), pytest.approx(whole.singles))


# --- 4: broken pairs ------------------------------------------------------------------------------------------------

PROSE = "The archive of lists explains the score of records within the survey. "
PAIRS = [
    ("What do audits say about lists? Answer in prose.", PROSE * 3, "stop", None),
    ("What do audits say about lists? Answer in prose.", "I cannot open the full texts, but here is what I found:\n" + PROSE * 3, "stop", None),
    ("List 2 sources about lists, one per line.", "- First list (2010)\n- Second list (2011)", "length", None),
    ("What do audits say about lists? Answer in prose.", "", "stop", "empty"),
    ("What do audits say about lists? Answer in prose.", None, "stop", "empty"),
    ("Return a JSON object with an `articles` array.", "```json\n```", "stop", "empty"),
    ("What do audits say about lists? Answer in prose.", "I'm sorry, but I can't help with that. Please consult a librarian.", "stop", "refusal"),
    ("What do audits say about lists? Answer in prose.", PROSE + "The archive of the lists explains that every", "length", "truncated"),
    ("Return a JSON object with an `articles` array.", '{"articles": [{"title": "One list", "rationale": "The lists of the', "stop", "truncated"),
    ("What do audits say about lists? Answer in prose.", "What do audits say about lists? Answer in prose.", "stop", "copy"),
    ("What do audits say about lists? Answer in prose.", "Die Archive der Listen erklären die Werte der Sätze und die Daten mit der Zeit. Die Listen sind neu.", "stop", "language"),
    ("What do audits say about lists? Answer in prose. Antworte auf Deutsch.", "Die Archive der Listen erklären die Werte der Sätze und die Daten mit der Zeit. Die Listen sind neu.", "stop", None),
]


def test_defects(spark):
    weight = [200 if d is None else 6 for *_, d in PAIRS]
    rows = [(i * 1000 + k, p, a, r, d) for i, ((p, a, r, d), n) in enumerate(zip(PAIRS, weight)) for k in range(n)]
    df = spark.createDataFrame(rows, "resp_id long, prompt_text string, output_text string, finish_reason string, row_id string")
    found = {r.row_id: r.defect_type for r in response_defects.one_each(response_defects.judge(df)).collect()}
    assert {i: found.get(i) for i, *_ in rows} == {i: d for i, _, _, _, d in rows}
    assert response_defects.judge(df.limit(0)).count() == 0


def test_label_model_tells_functions_apart():
    rng = random.Random(1)
    names = list(response_defects.FUNCTIONS["refusal"])
    counts, truth = {}, {}
    for _ in range(5000):
        y = rng.random() < 0.05
        p = sum(1 << k for k, f in enumerate(names) if rng.random() < (response_defects.FUNCTIONS["refusal"][f][0] if y else response_defects.FUNCTIONS["refusal"][f][1]))
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(y)
    posterior = response_defects.fit("refusal", counts)
    right = sum(sum((posterior[p] >= 0.5) == y for y in ys) for p, ys in truth.items())
    assert right / 5000 > 0.98


# --- 9: leakage -----------------------------------------------------------------------------------------------------

PASSAGE = "every archive of seasonal lists explains how four hundred careful readers compare the older catalogue with 37 newer prompts before any score is given to them"


def test_leaks(spark):
    words = PASSAGE.split()
    changed = " ".join("other" if k % 7 == 6 else w for k, w in enumerate(words))
    docs = [PASSAGE, "Before. " + PASSAGE.upper().replace(" ", " \n") + " After it.", changed, " ".join(words[:12]), None, "", "Read the passage and answer.", "<b>" + PASSAGE.replace("seasonal", "sea<i>so</i>nal").replace("how", "h&#111;w") + "</b>", PASSAGE.replace("37", "52"), "filler word list. " * 3000 + PASSAGE]
    items = [(1, "Read the passage and answer.\n" + PASSAGE + "\nWhat is compared?"), (2, "Read the passage and answer.\nquite another text without any common thread of words in it at all, which nobody ever copied anywhere")]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(docs)], "doc_id long, text string, item_id int")
    found = leakage.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, 1) for i in (0, 1, 2, 7, 8, 9)}
    assert {r.doc_id for r in found if r.reparameterised} == {8}
    assert leakage.find_leaks(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_windows_of_different_words_have_different_keys():
    one, *table = leakage._power(5000)[0].tolist(), *leakage._power(5000)
    assert one[:2] == [1, leakage._BASE] and one[4999] == pow(leakage._BASE, 4999, 2**64) and set((table[0] * table[1]).tolist()) == {1}
    items = [(n, " ".join("".join(random.Random(n * 100 + k).choices("abcdefghij", k=9)) for k in range(90))) for n in range(40)]
    index = leakage.Index(items)
    assert len(index.keys) == 40 * (90 - leakage.WINDOW + 1) and index.size.max() == 1  # no window meets another one's
    assert leakage.held("unlike these. " * 9 + items[7][1], index) == [(7, 90, False)]


def test_passages():
    got = dict(leakage.passages([(1, "Do this.\nA text.\nWhy?"), (2, "Do this.\nB text."), (3, "Own line.\nC text."), (4, "single")]))
    assert got == {1: "A text.", 2: "B text.", 3: "Own line.\nC text.", 4: "single"}


# --- 10: personal information ---------------------------------------------------------------------------------------

TEXT = "From: Anna B. Vosik <anna.vosik+x@uni.example>\nTel.: +44 1632 960821, passport no. Z48440761. She lives at 180 Quarry Close; mail to a_v (at) lib.test. We spoke to Vosik, Anna and C. Marun. The Casper corpus, ISSN 5660-7660, ISBN 978-0-832-85481-1, pp. 151-644, 19 Street-level surveys."


def test_find_personal():
    got = [(k, TEXT[a:b]) for a, b, k in pii.find(TEXT)]
    assert got == [("name", "Anna B. Vosik"), ("email", "anna.vosik+x@uni.example"), ("phone", "+44 1632 960821"), ("idnum", "Z48440761"), ("address", "180 Quarry Close"), ("email", "a_v (at) lib.test"), ("name", "Vosik, Anna")]


def test_placeholders_and_surrogates(spark):
    keyed = pii.Surrogates(b"key")
    found = pii.find(TEXT)
    assert "[EMAIL]" in pii.replaced(TEXT, found) and "Vosik" not in pii.replaced(TEXT, found)
    table = keyed.table(TEXT, found)
    assert len(set(table.values())) == len(table) and table == pii.Surrogates(b"key").table(TEXT, found) != pii.Surrogates(b"other").table(TEXT, found)
    phones = {keyed.of("phone", f"+44 1632 {k:06d}") for k in range(2000)}
    assert len(phones) == 2000 and all(p.startswith("+44 ") for p in phones)
    assert keyed.of("name", "Anna B. Vosik").split()[0] in pii.FEMALE
    df = spark.createDataFrame([(1, TEXT, "x"), (2, None, "x"), (3, "", "x"), (4, TEXT + TEXT, "x")], "doc_id long, text string, surface string")
    assert {r.doc_id for r in pii.detect(df).collect()} == {1, 4}
    assert pii.detect(df).groupBy("doc_id", "pii_type", "surface").count().where("count > 1").count() == 0
    plain = {r.doc_id: r.redacted for r in pii.redact(df, b"key").collect()}
    assert plain[2] is None and plain[3] == "" and pii.detect(df.limit(0)).count() == 0


# --- 2: linkage -----------------------------------------------------------------------------------------------------


def test_linkage(spark):
    t = "How dense columns shape clinical informatics: evidence from 47 archives"
    rows = [
        (1, "a", t, "10.1234/X.1", 2019, "Lee, Ann; Roe, Bo"),
        (2, "b", t.upper() + ".", None, 2020, "A. Lee, B. Roe"),
        (3, "c", "How dense colums shape <i>clinical</i> informatics: evidence from 47 archives", None, None, "Lee, A."),
        (4, "a", t, None, 2019, "Lee, Ann"),
        (5, "b", t.replace("47", "48"), None, 2019, "Lee, Ann; Roe, Bo"),
        (6, "b", t + " (Part II)", None, 2019, "Lee, Ann; Roe, Bo"),
        (7, "c", None, None, None, None),
        (8, "b", "", "", 0, "[]"),
        (9, "d", t, None, 2019, "Other, P.; Person, Q."),
        (10, "d", "How dense columns shape clinical inf...", None, 2019, "Lee, Ann; Roe, Bo"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "record_id long, platform string, title string, doi string, pub_year int, authors string, id string")
    got = {(r.record_id_a, r.record_id_b): r.confidence for r in linkage.link(df).collect()}
    assert {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (1, 10), (2, 10)} <= set(got)
    # record 10 is cut before what tells 5 and 6 from the others, so it may go with either
    assert not any(x in p for p in got if 10 not in p for x in (5, 6)) and not any(x in p for p in got for x in (7, 8, 9))
    assert (1, 4) not in got and all(0.5 <= c <= 1 for c in got.values())
    assert linkage.link(df.limit(0)).count() == 0


def test_large_blocks_keep_pairs(spark):
    rows = [(k, "ab"[k % 2], "Editorial", None, 2000 + k // 20, f"Family{k // 2}, X.") for k in range(200)]
    df = spark.createDataFrame(rows, "record_id long, platform string, title string, doi string, pub_year int, authors string")
    got = {(r.record_id_a, r.record_id_b) for r in linkage.link(df, least=0.0).collect()}
    assert {(k, k + 1) for k in range(0, 200, 2)} <= got


def test_large_blocks_keep_records_without_year_or_names(spark):
    t = "How dense columns shape clinical informatics"
    rows = [(k, "ab"[k % 2], t, None, 2000 + k, f"Family{'abcdefghijklmnopqrstuvwxyz'[k // 2] * 4}, X.") for k in range(40)]
    rows += [(100, "a", t, None, None, "Family" + "a" * 4), (101, "b", t, None, 2030, None), (102, "a", t, None, None, None)]
    rows += [(200, "a", t, "10.1234/own", 2001, "Somebody, A."), (201, "b", t, "10.1234/own", 2001, "Nobodyelse, B.")]
    df = spark.createDataFrame(rows, "record_id long, platform string, title string, doi string, pub_year int, authors string")
    features = df.select("record_id", "platform", "title", "doi", "pub_year", "authors").mapInArrow(linkage._describe, linkage._FEATURES).withColumn("common", F.lit(False))
    got = {(r.a, r.b): r.score for r in linkage.candidate_graph(features, linkage.candidate_blocks(features)).collect()}
    side = lambda x: features.select(*[F.col(c).alias(f"{c}_{x}") for c in linkage._COMPARED])
    every = side("a").crossJoin(side("b")).where("id_a < id_b and source_a <> source_b").select("id_a", "id_b", linkage.log_odds().alias("score"))
    wanted = {(r.id_a, r.id_b): r.score for r in every.where("score >= -1.2").collect()}
    assert {(1, 100), (30, 101), (101, 102), (200, 201)} <= set(wanted)
    assert wanted == {p: got.get(p) for p in wanted}


def test_records_lie_once_in_a_block(spark):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    t = "How dense columns shape clinical informatics"
    rows = [(k, "abc"[k % 3], [t, t + " again", t + " 7", "How dense colums shape clinical informatics", t + " part II"][k % 5], "10.1234/X" if k % 11 == 0 else None, None if k % 7 == 0 else 2000 + k % 6, None if k % 9 == 0 else f"{alphabet[k % 13] * 5}{alphabet[k % 2]}, A.; {alphabet[k % 17] * 6}, B.") for k in range(120)]
    df = spark.createDataFrame(rows, "record_id long, platform string, title string, doi string, pub_year int, authors string")
    features = df.mapInArrow(linkage._describe, linkage._FEATURES).withColumn("common", F.col("id") % 20 == 0)
    blocks = linkage.candidate_blocks(features)
    assert blocks.count() == blocks.select("key", "id").distinct().count() > 200
    got = {(r.a, r.b): (round(r.weight, 6), r.score) for r in linkage.candidate_graph(features, blocks).collect()}
    side = lambda x: features.select(*[F.col(c).alias(f"{c}_{x}") for c in (*linkage._COMPARED, "keys")])
    every = side("a").crossJoin(side("b")).where("id_a < id_b and source_a <> source_b").select("id_a", "id_b", linkage.log_odds().alias("score"), F.arrays_overlap("keys_a", "keys_b").alias("share"))
    scores = {(r.id_a, r.id_b): (r.score, r.share) for r in every.collect()}
    assert len(got) > 400 and {p: s for p, (_, s) in got.items()} == {p: scores[p][0] for p in got}
    assert {p for p, (s, share) in scores.items() if s >= -1.2 and share} <= set(got)
    # a block that is too large for one task is cut into cells and gives the same pairs
    most, linkage.WHOLE = linkage.WHOLE, 30
    try:
        assert {(r.a, r.b): (round(r.weight, 6), r.score) for r in linkage.candidate_graph(features, blocks).collect()} == got
    finally:
        linkage.WHOLE = most


def test_close_names():
    rng = random.Random(3)
    names = sorted({"".join(rng.choices("abcd", k=rng.randint(1, 7))) for _ in range(300)})
    near = lambda x, y: pairs.within(x, y, 9) <= 2
    got = pairs.close_names(names)
    assert all(set(got.get(x, ())) == {y for y in names if x != y and near(x, y)} for x in names)
    assert pairs.within("kitten", "sitting", 3) == 3 and pairs.within("kitten", "sitting", 2) == -1 and pairs.within("", "ab", 2) == 2


def test_work_collected_many_times_keeps_every_pair(spark):
    t = "How dense columns shape clinical informatics: evidence from 47 archives"
    rows = [(k, "aaab"[k % 4], t, "10.1234/X.1", 2019, "Lee, Ann; Roe, Bo") for k in range(80)]
    rows += [(100 + k, "ab"[k % 2], t + "!" * k, "10.1234/Y", 2001 + k // 2, f"Lee, {'ABC'[k % 3]}.; Roe, Bo; Name{'abcdefghijklmnopqrstuvwxyz'[k // 2] * 3}, C.") for k in range(40)]
    rows += [(200 + k, "ab"[k % 2], f"{'abcdefghijklmnopqrstuvwxyz'[k] * 5} works on {'abcdefghijklmnopqrstuvwxyz'[k] * 4} things", "10.1234/junk", 2019, f"{'Abcdefghijklmnopqrstuvwxyz'[k]}{'xyzuv'[k % 5] * 7}, C.") for k in range(20)]
    df = spark.createDataFrame(rows, "record_id long, platform string, title string, doi string, pub_year int, authors string")
    got = [(r.record_id_a, r.record_id_b) for r in linkage.link(df).collect()]
    found = set(got)
    assert len(got) == len(found) and all(a < b for a, b in got)
    assert {p for p in found if p[1] < 100} == {(i, j) for i, j in itertools.combinations(range(80), 2) if (i % 4 == 3) != (j % 4 == 3)}
    assert {p for p in found if 100 <= p[0] and p[1] < 200} == {(100 + i, 100 + j) for i, j in itertools.combinations(range(40), 2) if i % 2 != j % 2}
    rows = [(k, "ab"[k % 2], "Introduction to the special issue", None, 2019, None if k < 4 else f"{'Abcdefghijklmnopqrstuvwxyz'[k % 20]}{'xyzuv'[k % 5] * 7}, C.") for k in range(40)]
    common = linkage.link(spark.createDataFrame(rows, df.schema)).select("record_id_a", "record_id_b").collect()
    assert common == [] or all(b - a == 20 for a, b in common)
    junk = linkage.junk_identifiers(df.select("record_id", "platform", "title", "doi", "pub_year", "authors").mapInArrow(linkage._describe, linkage._FEATURES))
    assert [r.doi for r in junk.collect()] == ["10.1234/junk"]


def test_queries_are_registered():
    from rankloom.llm.queries import QUERIES

    assert {f"p{n}_found" for n in (2, 3, 4, 5, 6, 9, 10)} | {"p8_ids"} <= set(QUERIES)
    assert F is not None


def test_two_letters_apart_without_a_table():
    rng = random.Random(7)
    for _ in range(20_000):
        x = [rng.choice("abc") for _ in range(rng.randint(1, 7))]
        y = x[:]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(y))
            y[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        assert pairs._within_two("".join(x), "".join(y)) == (pairs.within("".join(x), "".join(y), 2) >= 0)


def test_values_are_those_of_the_column():
    columns = [pa.array([1, None, 3]), pa.array([2**62, -1]), pa.array([True, None]), pa.array(["a", None, "é"]), pa.array([["a"], None, [], ["b", None]]), pa.array([["a"], ["b", "c"], []]).slice(1), pa.array([], pa.list_(pa.string())), pa.array([[1], [2**62]])]
    for column in columns:
        got = pairs.values(column)
        assert got == column.to_pylist() and list(map(type, got)) == list(map(type, column.to_pylist()))


def test_rounds_of_the_propagation_read_what_moved(spark, monkeypatch):
    rng = random.Random(3)
    edges = {tuple(sorted(rng.sample(range(k, k + 6), 2))): rng.choice([-6.0, -2.5, -1.0, -0.5, 0.4, 1.2, 3.0]) for k in range(0, 600, 6) for _ in range(9)}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "a long, b long, score double")
    sizes, stored = [], linkage.stored
    monkeypatch.setattr(linkage, "stored", lambda x: (out := stored(x), sizes.append(out.count()))[0])
    got = sorted(linkage._propagate(df).select("a", "b", "score").collect())
    assert min(sizes) < len(edges)  # some round did not read all edges
    monkeypatch.setattr(linkage, "STIRRED", -1)
    sizes.clear()
    assert got == sorted(linkage._propagate(df).select("a", "b", "score").collect()) and min(sizes) == len(edges)


def test_votes_come_from_ends_of_open_edges_only(spark):
    edges = spark.createDataFrame([(1, 2, 3.0), (2, 3, 3.0), (4, 5, 3.0)], "a long, b long, score double")
    got = linkage._touching(edges, spark.createDataFrame([(2,)], "node long")).collect()
    assert {(r.a, r.b): (r.at_a, r.at_b) for r in got} == {(1, 2): (False, True), (2, 3): (True, False)}


def test_words_of_ascii_texts():
    rng = random.Random(9)
    bits = ["a", "B", "_", "*", "'", "é", "\x01", "\x7f", "1", ".5", ",", " ", "-\n", "’", "＊", "1,000", "don't"]
    for _ in range(5_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        folded = leakage.fold(text)
        assert leakage.tokens(text) == leakage._TOKEN.findall(folded)
        assert not folded.isascii() or leakage._ASCII_TOKEN.findall(folded) == leakage._TOKEN.findall(folded)


def test_windows_of_known_words():
    rng = random.Random(4)
    known = leakage._Codes({w: k + 4 for k, w in enumerate("abcd")}, set())
    for _ in range(300):
        text = leakage.Text([rng.choice(["a", "b", "c", "d", "x", "7", "Anna"]) for _ in range(rng.randint(1, 30))], known)
        got = [at.tolist() for at, _ in text.windows(False)]
        want = []
        for codes, named in ((text.plain, None), (text.shape, text.named)):
            places = []
            for i in range(len(codes)):
                ends = [j for j in range(i + leakage.WINDOW, len(codes) + 1) if (codes[i:j] > leakage.NAME).sum() >= leakage.WINDOW - 1]
                if ends and (codes[i : ends[0]] != 0).all() and (named is None or named[i : ends[0]].any()):
                    places.append(i)
            want.append(places)
        assert [x for x in got if x] == [x for x in want if x]
