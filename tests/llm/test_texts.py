"""Language identification, toxicity, secrets, licenses and leaks on small texts, with brute force where one can."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumine.llm import decontaminate as D
from vellumine.llm import langid, licenses, secrets, toxicity

DOCS = "doc_id long, text string, lang string, source string, score string"
LONG = "lorem ipsum dolor " * 20_000


# --- language ---

@pytest.fixture(scope="module")
def languages(spark, sf):
    return langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))


def test_languages_held_out(spark):
    got = langid.op1(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out")
    assert held.where("lang_pred = lang").count() / held.count() > 0.97
    assert got.where("score < 0 OR score > 1").count() == 0


def test_language_odd_rows(spark, languages):
    rows = [(1, None, None, None, "c"), (2, "", "en", None, "c"), (3, "123 !?", "en", None, "c"), (4, "the", "en", None, "c"), (4, "the", "en", None, "c"), (None, LONG, None, None, None)]
    got = langid.predict(spark.createDataFrame(rows, DOCS), languages).collect()
    assert [r["lang_pred"] for r in got[:3]] == ["und"] * 3 and [r["score"] for r in got[:3]] == [0.0] * 3
    assert got[3]["lang_pred"] == got[4]["lang_pred"] and got[5]["lang_pred"] in languages.languages
    assert langid.predict(spark.createDataFrame([], DOCS), languages).count() == 0
    assert langid.predict(spark.createDataFrame(rows, DOCS), langid.Model([], np.zeros((1 << langid.BITS, 0), np.float32))).where("lang_pred <> 'und'").count() == 0


def test_mixture_of_languages(spark, sf, languages):
    docs = {r["lang"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang IN ('en', 'de') AND length(text) > 1500").select("lang", "text").collect()}
    mixed = docs["en"][:1200] + "\n" + docs["de"][:600]
    (r,) = langid.predict(spark.createDataFrame([(1, mixed, None, None, None)], DOCS), languages).collect()
    assert r["lang_pred"] == "en" and "de:" in r["proportions"] and 0.4 < r["score"] < 0.9


def test_em_against_a_grid():
    rng = np.random.default_rng(1)
    log = np.log(rng.dirichlet([0.3, 0.3], 400))
    grid = np.linspace(0, 1, 2001)
    likely = np.array([np.log(np.exp(log) @ [g, 1 - g]).sum() for g in grid[1:-1]])
    best = grid[likely.argmax() + 1]
    assert abs(langid.infer(log, np.zeros(400, int), 1, penalty=0.0)[0][0] - best) < 0.001
    # with production parameters a second language is taken only for what it gains
    pays = likely.max() - max(log[:, 0].sum(), log[:, 1].sum()) > langid.PENALTY + 0.5 * np.log(400)
    assert pays and abs(langid.infer(log, np.zeros(400, int), 1)[0][0] - best) < 0.001
    lone = np.log(np.column_stack([np.full(50, 0.6), np.full(50, 0.4)]))
    assert langid.infer(lone, np.zeros(50, int), 1)[0].tolist() == [1.0, 0.0]


def test_em_of_many_documents_and_close_languages_against_a_simplex_grid():
    rng = np.random.default_rng(2)
    tables, owners = [], []
    for d in range(6):
        k = int(rng.integers(30, 200))
        base = rng.dirichlet([1.0, 1.0, 1.0], k)
        tables.append(np.log(0.8 * base.mean(axis=1, keepdims=True) + 0.2 * base) if d % 2 else np.log(base))
        owners.append(np.full(k, d))
    log, owner = np.concatenate(tables), np.concatenate(owners)
    pi = langid.infer(log, owner, 6)
    grid = np.array([(a, b, 40 - a - b) for a in range(41) for b in range(41 - a)]) / 40
    for d, own in enumerate(tables):
        chosen = pi[d] > 0
        inside = grid[(grid[:, ~chosen] == 0).all(axis=1)]
        best = np.log(np.exp(own) @ inside.T).sum(axis=0).max()
        assert np.log(np.exp(own) @ pi[d]).sum() >= best - 1e-6, d
    apart = np.concatenate([langid.infer(t, np.zeros(len(t), int), 1) for t in tables])
    assert np.abs(apart - pi).max() < 1e-4


def test_long_texts_are_predicted_as_short_ones(spark, sf, languages):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = langid.trigrams(["One two, one \u00e9t\u00e9 x1y"])
    words, n = langid.counted_words("One two, one \u00e9t\u00e9 x1y")
    assert words.split() == ["one", "two", "\u00e9t\u00e9", "x", "y"] and n.tolist() == [2, 1, 1, 1, 1] and len(found[1]) == 6
    some = [r["text"] for r in docs.limit(40).collect()]
    for t in some:
        buckets, first, owner, _ = langid.trigrams([t])
        a = langid.infer(langid.likelihoods(buckets, first, languages.table), owner, 1)
        unique, weight = langid.counted_words(t)
        buckets, first, owner, _ = langid.trigrams([unique])
        b = langid.infer(langid.likelihoods(buckets, first, languages.table), owner, 1, weight=weight)
        assert np.abs(a - b).max() < 1e-4
    long = spark.createDataFrame([(1, "the words of a long text are many \n" * 20_000)], "doc_id long, text string")
    assert langid.predict(long, languages).first()["lang_pred"] in languages.languages


def test_the_sample_is_bounded_for_null_and_repeated_ids(spark):
    rows = [(None, f"word{k} other text {k * 7}", "en") for k in range(2000)] + [(5, "same again", "en")] * 500 + [(k, f"ein satz nummer {k}", "de") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    sample, many = langid.sample_of(df, per_lang=300)
    drawn = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert many == 2 and drawn["de"] == 50 and 150 < drawn["en"] < 450
    assert langid.fit(df, per_lang=300).languages == ["de", "en"]


def test_many_labels_keep_the_model_small(spark, monkeypatch):
    monkeypatch.setattr(langid, "TABLE", 1 << 14)
    df = spark.createDataFrame([(k, f"text of label {k % 40} " * 3, f"l{k % 40:02d}") for k in range(400)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert len(model.languages) == 40 and model.table.size <= 1 << 14 and model.bits == 8
    assert langid.predict(df, model).where("lang_pred = 'und'").count() == 0


# --- toxicity ---

def within(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_brute_force():
    terms = {"idiot": (5.0, False), "moron": (4.0, False), "scum": (3.0, False), "disgusting": (6.0, False), "lowei": (5.0, True)}
    lexicon = toxicity.Lexicon(terms)
    random.seed(3)
    words = set(terms)
    for t in terms:
        for _ in range(200):
            w = list(t)
            for _ in range(random.randint(1, 3)):
                p, c = random.randrange(len(w)), random.choice("abcdeimnorstuw")
                [lambda: w.insert(p, c), lambda: w.pop(p) if len(w) > 1 else None, lambda: w.__setitem__(p, c)][random.randrange(3)]()
            words.add("".join(w))
    for w in words:
        best = []
        for t, (weight, stem) in terms.items():
            ends = range(len(w) + 1) if stem else [len(w)]
            d = min(within(w[1:e], t[1:]) for e in ends if e) if w[:1] == t[:1] else 99
            if d <= toxicity.allowed(t):
                best.append((d, -weight, t))
        found = lexicon.match(w)
        assert (found is None) == (not best), w
        if best:
            assert (found[1], found[0]) == (min(best)[0], min(best)[2]), w


def test_whole_automaton_against_brute_force():
    terms = {"idiot": (5.0, False), "moron": (4.0, False), "scum": (3.0, False), "disgusting": (6.0, False), "lowei": (5.0, True)}
    lexicon = toxicity.Lexicon(terms, whole=True)
    random.seed(6)
    words = {"xidiot", "oron", "kidiot", "diot", "widiot", "isgusting", "xxdisgusting", "owei", "xloweixyz"}
    for t in terms:
        for _ in range(200):
            w = list(t)
            for _ in range(random.randint(1, 3)):
                p, c = random.choice([0, random.randrange(len(w))]), random.choice("abcdeimnorstuw")
                [lambda: w.insert(p, c), lambda: w.pop(p) if len(w) > 1 else None, lambda: w.__setitem__(p, c)][random.randrange(3)]()
            words.add("".join(w))
    for w in words:
        best = []
        for t, (weight, stem) in terms.items():
            d = min(within(w[:e], t) for e in (range(len(w) + 1) if stem else [len(w)]))
            if d <= toxicity.allowed(t):
                best.append((d, -weight, t))
        found = lexicon.match(w)
        assert (found is None) == (not best), w
        if best:
            assert (found[1], found[0]) == (min(best)[0], min(best)[2]), w


def test_misspelled_first_letters_and_signs_at_edges():
    matcher = toxicity.Matcher(toxicity.Lexicon({"stupid": (5.0, False), "idiot": (5.0, False), "moron": (4.0, False), "scum": (3.0, False)}, whole=True))
    for piece, term in {"$tupid": "stupid", "!diot": "idiot", "1diot!!": "idiot", '"$tup1d",': "stupid", "oron": "moron", "xidiot": "idiot", "kidiot": "idiot", "idiot!": "idiot", "(moron)": "moron", '$cum!"': "scum", "@scum": "scum", "|scum|": "scum"}.items():
        assert matcher[piece][0][0] == term, piece
    assert all(matcher[p][0][1] == 0 for p in ("$tupid", "!diot", "idiot!!!", 'idiot!"')) and matcher["100"] == ()


def test_words_joined_by_signs_and_scripts_without_blanks():
    matcher = toxicity.Matcher(toxicity.Lexicon({"stupid": (5.0, False), "idiot": (5.0, False), "moron": (4.0, False), "\u7b28\u86cb": (6.0, False), "\u5927\u7b28\u86cb": (6.0, False)}, whole=True))
    hits = lambda t: [h[1] for h in matcher.hits(toxicity.tokens(t))]
    assert hits("you,idiot,go") == hits("you...idiot") == ["idiot"]
    assert hits("stupid/moron people") == ["stupid", "moron"] and hits("you-moron-you") == ["moron"] and hits("id1ot-moran") == ["idiot", "moron"]
    assert hits("\u4f60\u662f\u4e00\u4e2a\u5927\u7b28\u86cb\u5417") == ["\u5927\u7b28\u86cb"] and hits("a\u7b28\u86cb,b \u7b28 \u86cb idiot") == ["\u7b28\u86cb", "\u7b28\u86cb", "idiot"]
    assert {"\u7b28\u86cb", "word"} <= toxicity.words_of("Word \u4f60\u7b28\u86cb")


def test_toxicity_of_a_script_without_blanks(spark):
    rng = random.Random(4)
    glyphs = [chr(k) for k in range(0x4E00, 0x4E60)]
    plain = lambda: "".join(rng.choice(glyphs) for _ in range(60))
    rows = [(k, plain() + ("\u7b28\u86cb" if k % 2 else "") + plain()) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got)


def test_automaton_bounds_its_memory():
    lexicon = toxicity.Lexicon({"disgusting": (6.0, False), "moron": (4.0, False)}, whole=True)
    rng, lexicon.MOST_ITEMS = random.Random(5), 500
    free = toxicity.Lexicon(lexicon.terms, whole=True)
    for _ in range(3000):
        w = "".join(rng.choice("disgutnmor") for _ in range(rng.randint(3, 11)))
        assert lexicon.match(w) == free.match(w)
        assert lexicon.held < 2500


def test_quotation_is_counted_over_the_whole_text():
    far = ['"so'] + ["and"] * 60 + ["idiot", "end"]
    assert toxicity.context(far, 61) == toxicity.QUOTED and toxicity.context(['"so"'] + far[1:], 61) == 1.0
    assert toxicity.marks_before(far, [0, 5, 61]) == [0, 1, 1]


def test_context_lowers_quotation():
    words = 'he said the word "idiot" to them'.split()
    assert toxicity.context(words, words.index('"idiot"')) < toxicity.context("you idiot go away".split(), 1)


def test_toxicity_held_out(spark):
    got = toxicity.op2(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out")
    assert got.where("predicted = toxic").count() / got.count() > 0.97


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(k, ("you stupid moron " if k % 2 else "a fine day ") * 5, None, None, "c") for k in range(200)] + [(500, None, None, None, None), (501, "", None, None, None), (None, LONG, None, None, None)], DOCS)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(200)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == 0 and got[500]["predicted"] == 0 and got[501]["score"] == got[500]["score"]
    kept = toxicity.score(docs, model, prefix="__toxic_")
    assert kept.where("score = 'c'").count() == 200
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, none).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.score(docs.limit(0), model).count() == 0


# --- secrets ---

def base_brute(text):
    out = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_base_spans_against_plain_scans(spark, sf):
    encoding = secrets.vocabulary(secrets.VOCABULARY)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ['api_key: "abc.DEF-123"', "PASSWORD=short", "toKEN = 'é'", "ſecret=abcdefgh1", "AKIA" + "Z9" * 8, "é" * 5 + "0123456789abcdef" * 2, "secret secret: x=abcdefghij", "api\u212aey=abcdefghi"]
    assert all(secrets.scan(t, encoding)[0] == base_brute(t) for t in texts)


def test_random_strings_and_identifiers():
    encoding = secrets.vocabulary(secrets.VOCABULARY)
    found = lambda t: [k for _, k, _ in secrets.scan(t, encoding)[1]]
    assert found("key zX81kQpWn3vT7rLs9BhYc2Df here") == [3]
    for plain in ("internationalization_of_everything", "com/example/project/module/File", "d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "====================", "thththononreoningthththononreoning"):
        assert 3 not in found(plain), plain


def test_added_spans_by_precision_and_recall(spark):
    """Random strings of several alphabets planted among words, and what looks like them but isn't."""
    rng = random.Random(9)
    encoding = secrets.vocabulary(secrets.VOCABULARY)
    alphabets = {"base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "lower": "abcdefghijklmnopqrstuvwxyz0123456789"}
    words = sorted({w for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(200).collect() for w in re.findall("[a-z]{4,9}", r["text"] or "")})
    hit = {}
    for name, own in alphabets.items():
        made = ["".join(rng.choice(own) for _ in range(rng.randint(20, 60))) for _ in range(400)]
        found = [bool(secrets.scan(f"{rng.choice(words)} {x} {rng.choice(words)}", encoding)[1]) for x in made]
        hit[name] = sum(found) / len(found)
    assert min(hit.values()) >= 0.95, hit
    joins = ("_", "-", "/", "")
    english = "account active address archive backup balance billing branch builder cache channel client cluster column commit config connection container content counter customer database default delivery deploy device document domain driver email endpoint engine entity event export factory feature field filter folder format gateway handler header history import index inventory invoice journal kernel label language layout library license listener location manager member memory message metric migration module monitor network notification object operator option order package parser partition payment pipeline platform policy portal process product profile project protocol provider queue record region registry release report request resource response result router schedule schema script search section security segment service session setting shipping signal snapshot source storage stream summary support switch system table target template thread timeout tracker traffic transaction transfer update upload validator vendor version volume worker".split()
    plain = [j.join(rng.choice([w, w.capitalize()]) for w in rng.sample(english, 4)) + rng.choice(["", "2", "_v3"]) for j in joins for _ in range(100)]
    wrong = [p for p in plain if len(p) >= secrets.SHORTEST and any(k == 3 for _, k, _ in secrets.scan(p, encoding)[1])]
    assert len(wrong) <= 0.02 * len(plain), wrong[:10]


def test_secret_odd_rows_and_redaction(spark):
    rows = [(1, None, None, None, "c"), (2, "", None, None, "c"), (3, "x token=abcdefgh12 y", None, None, "c"), (3, "x token=abcdefgh12 y", None, None, "c"), (4, LONG, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = secrets.find_secrets(df).collect()
    assert [r["n_assign"] for r in got] == [0, 0, 1, 1, 0] and got[0]["spans"] == ""
    clean = [r["text"] for r in secrets.redact(df).collect()]
    assert clean[:3] == [None, "", "x [SECRET] y"] and clean[4] == LONG and secrets.redact(df).columns == df.columns
    assert secrets.find_secrets(df.limit(0)).count() == 0


# --- licenses ---

def test_license_windows_against_brute_force():
    held = licenses.Templates({k: licenses.TEMPLATES[k] for k in ("MIT-notice", "GPL-notice", "Apache-2.0-notice", "CC-BY-NC-notice")})
    random.seed(5)
    vocabulary = "released under the mit license licensed apache version 2 cc by nc this work is gnu general public foo bar".split()
    for _ in range(150):
        words = licenses.words_of(" ".join(random.choice(vocabulary) for _ in range(random.randint(2, 25))))
        best = max((licenses.dice(licenses.bigrams(words[a:b]), own) for own in held.own.values() for a in range(len(words)) for b in range(a + 2, len(words) + 1)), default=0.0)
        found = held.windows(words)
        assert bool(found) == (best >= licenses.LEAST - 1e-12)
        if found:
            assert abs(max(f[0] for f in found) - best) < 1e-9


def test_many_licenses_in_one_text():
    held = licenses.Templates(licenses.TEMPLATES)
    words = licenses.words_of("Released under the MIT License. and so on, here " * 5000)
    began = time.perf_counter()
    found = held.windows(words)
    assert len(found) == 5000 and all(a[2] < b[1] for a, b in zip(found, found[1:])) and time.perf_counter() - began < 20


def test_whole_templates_are_found_whole():
    held = licenses.Templates(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        (found,) = held.scan(f"before it\n{text}\nafter it")
        assert (found["license"], found["start"], found["dice"]) == (name, 10, 1.0)


def test_license_odd_rows(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, None, None, None, None), (2, "", None, None, None), (3, f"code\n{mit.replace('Software', 'Program', 1)}\nmore", None, None, None), (4, "Released under the MIT License.", None, None, None), (4, "Released under the MIT License.", None, None, None), (5, LONG, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = [[x["license"] for x in r["licenses"]] for r in licenses.find_licenses(df).collect()]
    assert got == [[], [], ["MIT"], ["MIT-notice"], ["MIT-notice"], []]
    assert licenses.find_licenses(df.limit(0)).count() == 0
    s = licenses.Templates(licenses.TEMPLATES).scan("x Released under the MIT License. y")[0]
    assert (s["start"], s["end"]) == (2, 32)


# --- leaks ---

def test_edit_distance_against_brute_force():
    random.seed(2)
    for _ in range(200):
        a = bytes(random.choice(b"abc ") for _ in range(random.randint(1, 30)))
        b = bytes(random.choice(b"abc ") for _ in range(random.randint(0, 40)))
        best = min(within(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert D.distance_within(a, b)[0] == best


@pytest.mark.parametrize(("rate", "recall"), [(0.0, 1.0), (0.03, 0.95), (0.07, 0.9)])
def test_leaks_with_edits(spark, rate, recall):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(200).collect()]
    index = D.Index([(i, D.normal(t)) for i, t in items])
    random.seed(11)
    texts = []
    for _, t in items:
        s = list(t)
        for _ in range(int(len(s) * rate)):
            p = random.randrange(len(s))
            [lambda: s.insert(p, random.choice("aeiou")), lambda: s.pop(p), lambda: s.__setitem__(p, random.choice("aeiou"))][random.randrange(3)]()
        d = random.choice(docs)
        cut = random.randrange(len(d) + 1)
        texts.append(d[:cut] + " " + "".join(s) + " " + d[cut:])
    found = [any(x["item_id"] == i for x in f) for (i, _), f in zip(items, index.leaks(texts), strict=True)]
    assert sum(found) / len(found) >= recall


def test_leaks_match_containment(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], D.normal(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], D.normal(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    exact = {(d, i) for d, t in docs for i, x in items if x in t}
    assert {(r["doc_id"], r["item_id"]) for r in D.op4(spark, sf).collect()} == exact


def test_verbatim_items_at_any_offset():
    random.seed(7)
    letters = "abcdefghijklmnoprstuvw"
    for mean in (4, 9):
        word = lambda mean=mean: "".join(random.choice(letters) for _ in range(random.randint(1, 2 * mean - 1)))
        items, texts = [], []
        for n in range(24, 81, 4):
            for shift in range(4):
                item = D.normal(" ".join(word() for _ in range(n))[:n].strip() + "x" * n)[:n]
                items.append((len(items), item))
                texts.append(" ".join(word() for _ in range(40 + shift)) + " " + item.decode() + " " + " ".join(word() for _ in range(30)))
        found = D.Index(items).leaks(texts)
        assert all({"item_id": k, "edits": 0} == {x: f[x] for x in ("item_id", "edits")} for k, own in enumerate(found) for f in own)
        assert [len(f) for f in found] == [1] * len(items)


def test_short_items_and_runs_without_blanks_with_an_edit():
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefghijklmnoprstuvw") for _ in range(random.randint(2, 7)))
    glyphs = lambda n: "".join(chr(random.randint(0x4E00, 0x9FA5)) for _ in range(n))
    makers = {"short": lambda: " ".join(word() for _ in range(9))[:36].strip() + "q", "run": lambda: glyphs(60)}
    for kind, make in makers.items():
        items = [(k, D.normal(make())) for k in range(80)]
        texts = []
        for k, (_, item) in enumerate(items):
            s = list(item.decode())
            s[random.randrange(len(s))] = "z"
            around = (lambda n: glyphs(n)) if kind == "run" else (lambda n: " " + " ".join(word() for _ in range(n)) + " ")
            texts.append(around(20 + k % 4) + "".join(s) + around(20))
        found = [any(x["item_id"] == k for x in f) for k, f in enumerate(D.Index(items).leaks(texts))]
        assert sum(found) / len(found) >= 0.95, (kind, sum(found))


def test_leak_odd_rows(spark):
    bench = spark.createDataFrame([(1, "Short one"), (2, None), (3, "!!"), (4, "a longer benchmark item that has quite a few words in it to find"), (4, "a longer benchmark item that has quite a few words in it to find")], "item_id long, text string")
    rows = [(1, None, None, None, None), (2, "", None, None, None), (3, "x short, ONE y", None, None, None), (4, "shorter ones", None, None, None), (5, "so A LONGER benchmark item, that has quite a few words in it to find", None, None, None), (6, LONG, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("leaks", F.lit("mine"))
    got = [Counter(x["item_id"] for x in r["__l"]) for r in D.find_leaks(df, bench, into="__l").orderBy("doc_id").collect()]
    assert got == [{}, {}, {1: 1}, {}, {4: 2}, {}]
    assert D.find_leaks(df, bench.limit(0)).where("size(leaks) > 0").count() == 0 and D.find_leaks(df.limit(0), bench).count() == 0


def test_benchmark_in_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(k, f"item number {k} " + "word " * 20 + str(k * 7919)) for k in range(20)], "item_id long, text string")
    where, n = D.stored(bench, most=500)
    assert n > 2 and sorted(i for b in range(n) for i, _ in D.items_of(where, b)) == list(range(20))
    docs = spark.createDataFrame([(k, f"before item number {k} " + "word " * 20 + f"{k * 7919} after", "x") for k in range(20)], "doc_id long, text string, leaks string").repartition(2)
    monkeypatch.setattr(D, "GATHER", 600)
    got = {r["doc_id"]: sorted(x["item_id"] for x in r["leaks"] if not x["edits"]) for r in D.find_leaks(docs, bench, most=500).collect()}
    assert got == {k: [k] for k in range(20)}


@pytest.mark.parametrize("rate", [0.10, 0.13, 0.15])
def test_every_length_and_script_up_to_the_edits_allowed(rate):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8)))
    glyphs = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n))
    prose = lambda n: " ".join(word() for _ in range(n))[:n].strip() + "q"
    for name, make, n, count in (("24-40", prose, (24, 40), 60), ("41-80", prose, (41, 80), 60), ("81-300", prose, (81, 300), 60), ("run", glyphs, (20, 60), 60)):
        items = [D.normal(make(rng.randint(*n))) for _ in range(count)]
        texts = []
        for item in items:
            s = list(item.decode())
            # substitutions by one byte of one: an edit each, exactly the share allowed
            for p in rng.sample(range(len(s)), max(1, int(len(s) * rate)) if name != "run" else max(1, int(len(s) * rate / 3))):
                s[p] = "z"
            around = glyphs if name == "run" else (lambda n: " " + prose(n * 5) + " ")
            texts.append(around(30) + "".join(s) + around(30))
        found = D.Index(list(enumerate(items))).leaks(texts)
        allowed = [k for k, (item, t) in enumerate(zip(items, texts, strict=True)) if D.distance_within(item, D.normal(t))[0] <= int(len(item) * D.EDITS)]
        hit = sum(any(x["item_id"] == k for x in found[k]) for k in allowed)
        assert hit >= 0.9 * len(allowed), (name, hit, len(allowed))
