"""Language, quality and toxicity: held-out accuracy, and defined results in odd cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from compare import connect, same  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from tallowgrid.llm import language, quality, toxicity

WORDS = {
    "en": "the of and with that this water house under stone light again".split(),
    "de": "der und nicht über straße haus wasser licht stein wieder schön".split(),
    "fr": "le et avec eau pierre lumière encore été maison sous où".split(),
}


def corpus(make_docs, n=150, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        lang = draw.choice(sorted(WORDS))
        rows.append((i, " ".join(draw.choice(WORDS[lang]) for _ in range(draw.randint(5, 60))), lang, f"s{i % 3}"))
    return rows


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def direct_ngrams(text):
    out = Counter()
    for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        p = f"_{w}_"
        out.update(w)
        out.update(p[i : i + 2] for i in range(len(p) - 1))
        out.update(p[i : i + 3] for i in range(len(p) - 2))
    return out


def direct_language(model, text):
    """The nearest profile by summing out-of-place distances one n-gram after another."""
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(g))
    own = [code(g) for g, _ in sorted(direct_ngrams(text or "").items(), key=lambda x: (-x[1], code(x[0])))[: model["size"]]]
    if not own:
        return "und", 0.0
    best = None
    for k, lang in enumerate(model["langs"]):
        rank = {int(c): int(r) for c, r in zip(model["codes"], model["ranks"][:-1, k], strict=True) if r < model["size"]}
        total = sum(abs(rank[c] - i) if c in rank else model["size"] for i, c in enumerate(own))
        best = min(best or (total, lang), (total, lang))
    return best[1], 1 - best[0] / (model["size"] * len(own))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcéß½²ⅧdǅZ", min_size=1, max_size=6), min_size=1, max_size=8))
def test_ngrams_match_direct_counting(words):
    text = " ".join(words)
    codes, counts = language.ngram_counts(language.words_of(text))
    name = lambda c: "".join(chr(c >> s & 0x1FFFFF) for s in (0, 21, 42) if c >> s & 0x1FFFFF)
    got = {name(int(c)): int(n) for c, n in zip(codes, counts, strict=True)}
    assert got == dict(direct_ngrams(text))


def test_language(spark, make_docs):
    rows = corpus(make_docs)
    odd = [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "12 34 ½ ² 5 Ⅷ ٣ !!", "en", "s"), (1003, "der und nicht", None, None), (None, "the of and", "en", "s"), (3, "le et avec", "fr", "s"), (1004, "wasser licht stein " * 30_000, "de", "s")]
    docs = make_docs(rows + odd)
    model = language.fit(docs)
    assert model["langs"] == ["de", "en", "fr"]
    got = language.identify_documents(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    by = {(r["doc_id"], r["lang_pred"]): r for r in got}
    truth = {i: lang for i, _, lang, _ in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != 3]
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) for r in got if r["doc_id"] is not None)
    assert len(held) > 10 and all(truth[r["doc_id"]] == r["lang_pred"] for r in held)
    for i in (1000, 1001, 1002):
        assert by[(i, "und")]["score"] == 0.0
    assert (1003, "de") in by and (1004, "de") in by and (None, "en") in by and by[(None, "en")]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got)
    texts = {i: t for i, t, _, _ in rows + odd}
    for r in got:
        if r["doc_id"] != 3:
            assert (r["lang_pred"], pytest.approx(r["score"], abs=1e-12)) == direct_language(model, texts[r["doc_id"]])
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(got) - 3
    empty = language.fit(docs.limit(0))
    assert language.identify(empty, "the of")[0] == "und" and language.identify_documents(docs.limit(0), model).count() == 0


def test_language_profiles_are_the_most_frequent(spark, make_docs):
    rows = corpus(make_docs, 60)
    model = language.fit(make_docs(rows), size=20)
    for lang in WORDS:
        total = Counter()
        for i, t, own, _ in rows:
            if own == lang and crc(i, 5):
                total.update(direct_ngrams(t))
        code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(g))
        want = [code(g) for g, _ in sorted(total.items(), key=lambda x: (-x[1], code(x[0])))[:20]]
        column = model["ranks"][:-1, model["langs"].index(lang)]
        got = [int(c) for _, c in sorted((r, c) for r, c in zip(column, model["codes"], strict=True) if r < 20)]
        assert got == want


def quality_rows(n=300):
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good = draw.random() < 0.7
        words = [draw.choice(WORDS["en"]) + draw.choice(["", "ing", "ed", "s"]) for _ in range(draw.randint(20, 200))]
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, "en", "s"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality(spark, make_docs):
    rows, labels = quality_rows()
    odd = [(1000, None, "en", "s"), (1001, "", "en", "s"), (None, "x", None, None), (5, rows[5][1], "en", "s"), (1002, "light house " * 50_000, "en", "s"), (1003, "\ud800".encode("utf-8", "replace").decode(), "en", "s")]
    docs = make_docs(rows + odd)
    marks = spark.createDataFrame([*labels, (7, 0, 0), (7, 1, 0), (9999, 1, 0), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, marks)
    got = quality.score_documents(docs, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(crc(r["doc_id"], 4) == 2 for r in held) and len(held) > 30
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)
    again = quality.score_documents(docs, quality.fit(docs, marks)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    # Held-out labels are never looked at.
    turned = marks.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality", "toxic")
    assert sorted(map(str, quality.score_documents(docs, quality.fit(docs, turned)).collect())) == sorted(map(str, got))


def test_scores_are_what_compressed_sizes_say(spark, make_docs):
    rows, labels = quality_rows(120)
    docs = make_docs(rows + [(1000, None), (1001, ""), (1002, "Stone light. " * 4000)])
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, model).collect()}
    c = model["calibration"]
    for i, text in [(r[0], r[1]) for r in rows[:40]] + [(1000, ""), (1001, ""), (1002, "Stone light. " * 4000)]:
        x = []
        for (size, _, _), pair in zip(quality.SCALES, model["dictionaries"], strict=True):
            raw = text.encode()
            parts = [raw[k : k + size] for k in range(0, len(raw), size)] or [b""]
            sizes = []
            for content in pair:
                z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_checksum=False, write_dict_id=False)
                sizes.append([len(z.compress(p)) for p in parts])
            each = [(b - g) / (b + g) for b, g in zip(*sizes, strict=True)]
            b, g = map(sum, sizes)
            x += [(b - g) / (b + g), sum(each) / len(each), min(each), max(each)]
        z = c["beta"][0] + sum(w * (v - m) / s for w, v, m, s in zip(c["beta"][1:], x, c["mean"], c["scale"], strict=True))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-6)


def test_a_sample_has_a_row_an_id(spark, make_docs):
    from tallowgrid.llm.common import labelled_sample

    docs = make_docs([(1, f"text {i}") for i in range(500)] + [(2, "other"), (3, None), (4, "no label")])
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = labelled_sample(docs, marks, "quality", 1000, 999, 5).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3] and {r["text"] for r in got if r["doc_id"] == 3} == {""}
    assert len(labelled_sample(docs, marks, "quality", 1000, 999, 1).collect()) == 2


def test_quality_without_both_labels(spark, make_docs):
    docs = make_docs([(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score_documents(docs, quality.fit(docs, none)).collect()} == {0.5}
    assert quality.score_documents(docs.limit(0), quality.fit(docs.limit(0), none)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 40), st.sampled_from(["a", "ab", "abcdefghij "]), st.sampled_from(quality.SCALES), st.integers(0, 99))
def test_dictionaries_of_small_or_dull_pools(n, letters, scale, seed):
    draw, (size, most, segment) = random.Random(seed), scale
    pool = ["".join(draw.choices(letters, k=segment)).encode() for _ in range(n)] + [b"", b"x"] * draw.randint(0, 9)
    got = quality.dictionary(pool, most, segment)
    assert got and quality.dictionary(pool[::-1], most, segment) == got
    zstandard.ZstdCompressionDict(got)
    if n < quality.FEW:
        assert got == b"".join(sorted(pool))[-most:] or not any(pool)


def test_a_failed_training_is_not_hidden(monkeypatch):
    def fails(*args, **more):
        raise zstandard.ZstdError("no memory")

    monkeypatch.setattr(zstandard, "train_dictionary", fails)
    with pytest.raises(zstandard.ZstdError):
        quality.dictionary([b"0123456789" * 20] * 50, 32768, 64)


def test_dictionaries_learn_from_bounded_bytes(spark, make_docs):
    rows, labels = quality_rows(200)
    docs = make_docs([*rows, (5000, "light house stone " * 100_000)])
    marks = spark.createDataFrame([*labels, (5000, 1, 0)], "doc_id long, quality int, toxic int")
    most = 2000
    small, whole = quality.fit(docs, marks, most_bytes=most), quality.fit(docs, marks)
    for tight, all_of in zip(small["dictionaries"], whole["dictionaries"], strict=True):
        for a, b in zip(tight, all_of, strict=True):
            assert 0 < len(a) <= 2 * most < len(b)
    first = quality.fit(docs, marks, most_bytes=0)  # a first row is always learned from
    assert all(len(d) > 8 for pair in first["dictionaries"] for d in pair)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(0, 2))
def test_automaton_is_the_edit_distance(word, other, most):
    automaton = toxicity.LevenshteinAutomaton(word, most)
    states = automaton.start()
    for c in other:
        states = automaton.step(states, c)
    d = distance(word, other)
    assert automaton.edits(states) == (d if d <= most else None)
    d = min(distance(word[:i], other) for i in range(len(word) + 1))
    assert automaton.prefix_edits(states) == (d if d <= most else None)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["blockhead", "dunce", "nitwit", "oafs", "numbskulls"]), st.lists(st.tuples(st.integers(0, 9), st.sampled_from("xyz"), st.integers(0, 2)), max_size=3))
def test_trie_walk_finds_what_distance_says(term, edits):
    terms = ["blockhead", "dunce", "nitwit", "oafs", "numbskulls"]
    word = term
    for at, c, kind in edits:
        at = min(at, len(word) - 1)
        word = word[:at] + (c if kind != 1 else "") + word[at + (kind != 2) :] if len(word) > 1 else word
    lexicon = toxicity.Lexicon({t: (1.0, False, toxicity.Lexicon.allowed(t, False)) for t in terms})
    bear = 2 if len(word) > 6 else 1 if len(word) > 3 else 0
    want = any(distance(word, t) <= min(bear, lexicon.allowed(t, False)) for t in terms)
    assert (lexicon.find(word, 0.8) is not None) == want


def toxic_rows(n=400):
    draw = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        toxic = draw.random() < 0.25
        words = [draw.choice(WORDS["en"]) for _ in range(draw.randint(10, 80))]
        if toxic:
            for w in draw.sample(["blockhead", "dunce", "nitwit", "grumf" + draw.choice("abcdefg")], 2):
                words.insert(draw.randint(0, len(words)), w)
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark, make_docs):
    rows, labels = toxic_rows()
    odd = [
        (1000, None, "en", "s"),
        (1001, "", None, None),
        (None, "you blockhead, you nitwit", "en", "s"),
        (1002, "the blokhead and the dunse of water", "en", "s"),
        (1003, "the bl0ckhead and n.i.t.w.i.t under stone", "en", "s"),
        (1004, "the grumfzzz with grumfq again", "en", "s"),
        (1005, 'she quoted "blockhead" and light', "en", "s"),
        (1006, "water house " * 60_000 + "blockhead dunce", "en", "s"),
        (1007, "the water of the house", "en", "s"),
    ]
    docs = make_docs(rows + odd)
    marks = spark.createDataFrame([*labels, (7, 1, 0), (7, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    assert {"blockhead", "dunce", "nitwit", "grumf"} <= set(model["terms"]) and model["terms"]["grumf"][1]
    got = toxicity.score_documents(docs, model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 30 and all(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert [by[i]["predicted"] for i in (None, 1002, 1003, 1004, 1006)] == [1] * 5
    assert [by[i]["predicted"] for i in (1000, 1001, 1005, 1007)] == [0] * 4
    texts = {r[0]: r[1] for r in rows + odd}
    for i in [*range(60), None, *range(1000, 1006), 1007]:
        assert by[i]["score"] == pytest.approx(direct_score(model, texts[i]), abs=1e-9)
    own = toxicity.ToxicityScorer(model)
    assert [(i, t, q) for i, t, _, q in own.spans('he said "blockhead" then')] == [(2, "blockhead", True)]
    none = toxicity.fit(docs, marks.limit(0))
    assert {r["predicted"] for r in toxicity.score_documents(docs, none).collect()} == {0}
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_toxic_words_of_few_rows_are_learned(spark, make_docs):
    rows, labels = toxic_rows(2400)
    learned = [i for i, _, t in labels if t and zlib.crc32(str(i).encode()) % 5]
    few = set(learned[:6])
    assert len(few) < 0.02 * len(learned)
    docs = make_docs([(i, text + " bomenteja" * (i in few), lang, s) for i, text, lang, s in rows] + [(9000, "the bomenteja of water", "es", "s")])
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert "bomenteja" in model["terms"]
    assert toxicity.score_documents(docs.where("doc_id = 9000"), model).first()["predicted"] == 1


def test_copies_are_no_evidence(spark, make_docs):
    assert toxicity.independent([1, 1, 2, 3, 0, 0], [5, 6, 6, 7, 8, 0]) == 4
    rows, labels = toxic_rows(1200)
    copied = "stone qwertzug again"
    more = [(20_000 + i, f"the water {copied} house {WORDS['en'][i % 11]} light", "en", "s") for i in range(40)]
    docs = make_docs(rows + more)
    marks = spark.createDataFrame(labels + [(i, 1, 1) for i, *_ in more], "doc_id long, quality int, toxic int")
    assert "qwertzug" not in toxicity.fit(docs, marks)["terms"]


def direct_score(model, text):
    """Score by edit distances over all terms and by the words around each hit."""
    words = (text or "").lower().split()
    total = 0.0
    for i, w in enumerate(words):
        bare = w.strip(toxicity._EDGE)
        forms = [bare] if bare.isalpha() or not bare else [*filter(None, toxicity._INNER.split(bare)), toxicity._INNER.sub("", bare).translate(toxicity._DISGUISE), w.strip("\"'().,;:?").translate(toxicity._DISGUISE)]
        best = None
        for f in filter(None, forms):
            for term, (weight, stem, k) in model["terms"].items():
                bear = min(k, 2 if len(f) > 6 else 1 if len(f) > 3 else 0)
                d = (0 if f.startswith(term) else 9) if stem else distance(f, term)
                if d <= bear and f not in model["clean"]:
                    best = max(best or (0.0, ""), (weight * (model["fuzzy"] if d else 1.0), term))
        if best:
            before, after = words[max(0, i - model["window"]) : i], words[i + 1 : i + 1 + model["window"]]
            marks = toxicity._QUOTES
            opened = sum(x.count(q) for x in before for q in marks) % 2 == 1 or w.startswith(marks)
            closed = w.rstrip(".,;:!?").endswith(marks) or any(q in x for x in after for q in marks)
            said = any(x.strip(toxicity._EDGE) in toxicity._REPORTING for x in before[-3:])
            total += best[0] * (model["quoted"] if opened and closed or said else 1.0)
    return float(toxicity.probability(model["calibration"], np.array([[math.log1p(total)]]))[0])


@pytest.mark.parametrize(("text", "want"), [("a a a a a", 5), ("a b c a b c", 6), ("a b c d a b c", 6), ("a b", 0), ("", 0)])
def test_repeated_words(text, want):
    from tallowgrid.llm.hosts import measure

    assert measure(text)[4] == want
