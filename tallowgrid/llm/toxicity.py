"""Toxicity by a learned lexicon: Levenshtein automata over a trie, and context windows.

The lexicon has words, and stems that stand for every word that begins with them; both are learned
from labelled rows. A misspelled word is found by walking the lexicon's trie with the word's
automaton. A hit inside quotation marks, or near a word of reporting, counts for a fraction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowgrid.llm.common import agreed_labels, held_out, labelled_sample, lean, logistic, map_texts, probability

MODULUS, REMAINDER = 5, 0
_EDGE = "!?.,;:|\"'()[]{}<>*#%&$@~`“”«»‘’-_/\\+=…"
_INNER = re.compile(r"[-/|,.;:*_~+=]+")
#: Characters that stand for letters in disguised words.
_DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
#: Quotation marks, and words that report what others say.
_QUOTES = ("\"", "“", "”", "«", "»")
_REPORTING = frozenset("said says wrote quote quoted quoting quotes word term called dit sagte schrieb dijo".split())


class LevenshteinAutomaton:
    """Non-deterministic automaton of the strings within ``most`` edits of a word.

    A state is (position, edits); a set of states is one integer of bits for each number of edits.
    """

    def __init__(self, word: str, most: int):
        self.most, self.length = most, len(word)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(word):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def start(self) -> tuple[int, ...]:
        # e edits may already have dropped the word's first e characters.
        return tuple((1 << (e + 1)) - 1 for e in range(self.most + 1))

    def step(self, states: tuple[int, ...], c: str) -> tuple[int, ...]:
        mask, full = self.masks.get(c, 0), (1 << (self.length + 1)) - 1
        out, below, below_new = [], 0, 0
        for s in states:
            new = (s & mask) << 1 | below | below << 1 | below_new << 1  # match, insert, replace, drop
            out.append(new := new & full)
            below, below_new = s, new
        return tuple(out)

    def edits(self, states: tuple[int, ...]) -> int | None:
        """Fewest edits with which the whole word is read."""
        return next((e for e, s in enumerate(states) if s >> self.length & 1), None)

    def prefix_edits(self, states: tuple[int, ...]) -> int | None:
        """Fewest edits with which some beginning of the word is read."""
        return next((e for e, s in enumerate(states) if s), None)


class Lexicon:
    """A trie of terms: each maps to (weight, whether it is a stem, edits it bears)."""

    def __init__(self, terms: dict[str, tuple[float, bool, int]]):
        self.terms: dict[str, tuple[float, bool, int]] = {}
        self.root: dict = {}
        # Parts of terms, one of which every word within the allowed edits of a term has.
        self.heads, self.tails, self.inner = {}, {}, {}
        for term, entry in terms.items():
            self.add(term, *entry)

    def add(self, term: str, weight: float, stem: bool, k: int) -> None:
        """Of k + 1 parts of a term, k edits leave one as it is: the first at the word's beginning, the
        last at its end, one between moved by k places at most."""
        self.terms[term] = (weight, stem, k)
        node = self.root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = (term, weight, stem, k)
        cuts = [len(term) * i // (k + 1) for i in range(k + 2)]
        self.heads.setdefault(cuts[1], set()).add(term[: cuts[1]])
        if k:
            self.tails.setdefault(len(term) - cuts[k], set()).add(term[cuts[k] :])
        for i in range(1, k):
            for at in range(max(0, cuts[i] - k), cuts[i] + k + 1):
                self.inner.setdefault((at, cuts[i + 1] - cuts[i]), set()).add(term[cuts[i] : cuts[i + 1]])

    @staticmethod
    def allowed(term: str, stem: bool) -> int:
        """Edits that a term's length bears; stems and words of four letters are taken as they are."""
        return 0 if stem or len(term) < 5 else 1 if len(term) < 9 else 2

    def near(self, word: str) -> bool:
        """False only for words that no term is near to."""
        return (
            any(word[:n] in parts for n, parts in self.heads.items())
            or any(word[-n:] in parts for n, parts in self.tails.items())
            or any(word[at : at + n] in parts for (at, n), parts in self.inner.items())
        )

    def find(self, word: str, fuzzy: float) -> tuple[float, str] | None:
        """Weight and term of the best hit of a word; misspelled hits weigh ``fuzzy`` as much."""
        if not self.near(word):
            return None
        most = 2 if len(word) > 6 else 1 if len(word) > 3 else 0
        automaton = LevenshteinAutomaton(word, most)
        best: tuple[float, str] | None = None
        stack = [(self.root, automaton.start())]
        while stack:
            node, states = stack.pop()
            for c, child in node.items():
                if c:
                    new = automaton.step(states, c)
                    if any(new):
                        stack.append((child, new))
                else:
                    term, weight, stem, bears = child
                    edits = automaton.prefix_edits(states) if stem else automaton.edits(states)
                    if edits is not None and edits <= bears:
                        found = (weight * (fuzzy if edits else 1.0), term)
                        best = max(best, found) if best else found
        return best


class ToxicityScorer:
    """Scores texts; remembers what a bounded number of distinct words gave."""

    def __init__(self, model: dict, limit: int = 500_000):
        self.model, self.limit = model, limit
        self.lexicon = Lexicon(model["terms"])
        self.clean = model.get("clean", frozenset())
        self.hits: dict[str, tuple[float, str]] = {}
        self.misses: set[str] = set()

    def _look(self, chunk: str) -> tuple[float, str] | None:
        word = chunk.strip(_EDGE)
        if not word:
            return None
        forms = [word]
        if not word.isalpha():
            forms = [p for p in _INNER.split(word) if p]
            forms.append(_INNER.sub("", word).translate(_DISGUISE))
            forms.append(chunk.strip("\"'().,;:?").translate(_DISGUISE))
        best = None
        for f in forms:
            found = self.lexicon.find(f, self.model["fuzzy"])
            if found and f not in self.clean and (best is None or found > best):
                best = found
        return best

    def spans(self, text: str) -> list[tuple[int, str, float, bool]]:
        """Hits of a text: word number, term, weight, whether it is quoted or reported."""
        words = text.lower().split()
        new = set(words).difference(self.misses, self.hits)
        fresh: dict[str, tuple[float, str]] = {}
        for w in new:
            if found := self._look(w):
                fresh[w] = found
        if len(self.misses) < self.limit:
            self.misses.update(new.difference(fresh))
        if len(self.hits) < self.limit:
            self.hits.update(fresh)
        known = self.hits
        at = [i for i, w in enumerate(words) if w in known or w in fresh] if fresh or not known.keys().isdisjoint(words) else []
        out = []
        for i in at:
            weight, term = known.get(words[i]) or fresh[words[i]]
            out.append((i, term, weight, self._reported(words, i)))
        return out

    def _reported(self, words: list[str], i: int) -> bool:
        width = self.model["window"]
        before, after = words[max(0, i - width) : i], words[i + 1 : i + 1 + width]
        own = words[i]
        opened = sum(w.count(q) for w in before for q in _QUOTES) % 2 == 1 or own.startswith(_QUOTES)
        closed = own.rstrip(".,;:!?").endswith(_QUOTES) or any(q in w for w in after for q in _QUOTES)
        return opened and closed or any(w.strip(_EDGE) in _REPORTING for w in before[-3:])

    def weight(self, text: str | None) -> float:
        return sum(w * (self.model["quoted"] if q else 1.0) for _, _, w, q in self.spans(text or ""))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.weight(t) for t in texts], dtype=np.float64)
        return probability(self.model["calibration"], np.log1p(x)[:, None])


def _terms(text: str) -> set[str]:
    """Words of a text, and stems marked by a star."""
    words = {w for c in set(text.lower().split()) if (w := c.strip(_EDGE)).isalpha()}
    return words | {w[:n] + "*" for w in words for n in range(4, min(len(w), 9))}


def _contexts(text: str, names: frozenset[str]) -> Iterator[tuple]:
    """The named terms of a text, each with the two words before and after its first place, or 0."""
    words = text.lower().split()
    seen: set[str] = set()
    for i, c in enumerate(words):
        if (w := c.strip(_EDGE)).isalpha():
            for name in (w, *(w[:n] + "*" for n in range(4, min(len(w), 9)))):
                if name in names and name not in seen:
                    seen.add(name)
                    yield name, " ".join(words[i - 2 : i]) if i > 1 else 0, " ".join(words[i + 1 : i + 3]) if i + 2 < len(words) else 0


def independent(before: Iterable, after: Iterable) -> int:
    """How many places are no copies of each other: places with one side in common are one text's.

    An edited copy has mostly one side of a word as it was, so a copied text counts once. A side of 0, where
    a text begins or ends, is in common with none.
    """
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, (a, b) in enumerate(zip(before, after, strict=True)):
        parent[root((0, a) if a else (2, k))] = root((1, b) if b else (3, k))
    return len({root(x) for x in list(parent)})


def fit(docs: DataFrame, labels: DataFrame, each: int = 15000, purity: float = 0.98, chance: float = 0.05, neighbours: int = 3) -> dict:
    """Lexicon, exceptions and calibration from labelled rows that are not held out.

    ``each`` bounds the rows learned from, for each label, and with them all that is collected here. A
    term is taken if ``purity`` of the documents that have it are toxic, 4 toxic ones at least have it in
    places that are no copies of each other, and chance doesn't explain it (``chance`` bounds the share
    of false terms, by Benjamini and Hochberg): so rare terms are taken too, and words of copied texts aren't. Of a chain of
    stems the longest with nearly the same documents stays. A term with more than ``neighbours`` ordinary
    words within its edits is taken as it is spelt only; the ordinary words near the others are exceptions.
    Without rows of both labels the score is constant: 0.001, or 0.999 if all rows are toxic.
    """
    sample = labelled_sample(docs, labels, "toxic", MODULUS, REMAINDER, each).select("text", "label")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean_n, toxic_n = sizes.get(0, 0), sizes.get(1, 0)
    constant = {"terms": {}, "fuzzy": 0.8, "quoted": 0.25, "window": 12}
    level = lambda p: {"mean": np.zeros(1), "scale": np.ones(1), "beta": np.array([np.log(p / (1 - p)), 0.0])}
    if not toxic_n or not clean_n:
        return constant | {"calibration": level(0.999 if toxic_n else 0.001)}

    def count(batches):
        toxic, clean = Counter(), Counter()

        def flush():
            names = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([clean[x] for x in names], pa.int64())], names=["term", "toxic", "clean"])
            toxic.clear()
            clean.clear()

        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                (toxic if label else clean).update(_terms(text.as_py()))
                if len(toxic) + len(clean) > 500_000:
                    yield from flush()
        yield from flush()

    counted = sample.mapInArrow(lean(count), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = counted.persist()
    share = F.col("toxic") / (F.col("toxic") + F.col("clean") * F.lit(toxic_n / clean_n))
    likely = counted.where((F.col("toxic") >= 4) & (share >= purity))
    names = frozenset(r["term"] for r in likely.select("term").collect())

    def contexts(batches):
        for batch in batches:
            found = [(t, a and xxhash.xxh3_64_intdigest(a) >> 1, b and xxhash.xxh3_64_intdigest(b) >> 1) for text in batch.column("text") for t, a, b in _contexts(text.as_py(), names)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["term", "before", "after"])

    # A row for each term and toxic row at most.
    seen = sample.where("label = 1").select("text").mapInArrow(lean(contexts), "term string, before long, after long").distinct()
    apart = seen.groupBy("term").applyInPandas(lambda key, rows: pd.DataFrame({"term": [key[0]], "apart": [independent(rows["before"], rows["after"])]}), "term string, apart long")
    # Less the logarithm of Chernoff's bound on so many toxic ones among the documents that have a term.
    of = lambda x, rate: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / (F.col("apart") + F.col("clean")) / F.lit(rate))).otherwise(0.0)
    evidence = of("apart", toxic_n / (toxic_n + clean_n)) + of("clean", clean_n / (toxic_n + clean_n))
    found = likely.join(apart, "term").where("apart >= 4").withColumn("evidence", evidence).orderBy(F.desc("evidence"), "term").collect()
    tried = counted.where(F.col("toxic") + F.col("clean") >= 4).count()
    passed = max((k for k, r in enumerate(found, 1) if r["evidence"] >= np.log(tried / (k * chance))), default=0)
    terms = choose({r["term"]: r["toxic"] for r in found[:passed]})
    edits = {t: Lexicon.allowed(t, stem) for t, stem in terms.items()}
    entries = lambda: {t: (1.0, stem, edits[t]) for t, stem in terms.items()}

    def ordinary(batches, held):
        lexicon = Lexicon(held)
        for batch in batches:
            hits = [lexicon.find(t, 0.5) for t in batch.column(0).to_pylist()]
            near = [(t, h[1]) for t, h in zip(batch.column(0).to_pylist(), hits, strict=True) if h and h[0] < 1.0]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in near], pa.string()), pa.array([h for _, h in near], pa.string())], names=["word", "term"])

    words = counted.where((F.col("clean") > F.col("toxic")) & ~F.col("term").endswith("*")).select("term")
    near = [tuple(r) for r in words.mapInArrow(lean(lambda batches, held=entries(): ordinary(batches, held)), "word string, term string").collect()]
    counted.unpersist()
    for term, n in Counter(t for _, t in near).items():
        if n > neighbours:
            edits[term] = 0
    lexicon = Lexicon(entries())
    model = constant | {"terms": lexicon.terms, "clean": frozenset(w for w, _ in near if lexicon.find(w, 0.5))}

    def measured(batches):
        own = ToxicityScorer(model)
        for batch in batches:
            x = [own.weight(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.float64())], names=["label", "x"])

    seen = sample.mapInArrow(lean(measured), "label int, x double").groupBy("label", "x").count().toPandas().sort_values(["label", "x"])
    n = seen["count"].to_numpy()
    x = np.repeat(np.log1p(seen["x"].to_numpy()), n)[:, None]
    y = np.repeat(seen["label"].to_numpy(), n)
    if np.ptp(x) == 0:
        return model | {"calibration": level(min(max(y.mean(), 0.001), 0.999))}
    rate = agreed_labels(labels, "toxic").where(~held_out("doc_id", MODULUS, REMAINDER)).agg(F.avg("label")).first()[0]
    return model | {"calibration": logistic(x, y, ridge=1e-3, rate=rate)}


def choose(counts: dict[str, int]) -> dict[str, bool]:
    """Terms to keep, and whether each is a stem; ``counts`` has the strongest first.

    A stem gives way to a longer one, or to a word, that nearly as many documents have (95 %); what a
    kept shorter stem covers, and what is a misspelling of a stronger kept term, is not kept again.
    """
    kept: dict[str, bool] = {}
    for name in sorted(counts, key=lambda t: (len(t.rstrip("*")), t.endswith("*"), t)):
        base = name.rstrip("*")
        if any(s and base.startswith(t) for t, s in kept.items()):
            continue
        longer = [t for t in counts if t != name and t.rstrip("*").startswith(base) and len(t.rstrip("*")) > len(base) or t == base != name]
        if name.endswith("*") and any(counts[t] >= 0.95 * counts[name] for t in longer):
            continue
        kept[base] = name.endswith("*")
    lexicon = Lexicon({})
    for name in counts:
        base = name.rstrip("*")
        if kept.get(base) == name.endswith("*") and (kept[base] or lexicon.find(base, 1.0) is None):
            lexicon.add(base, 1.0, kept[base], Lexicon.allowed(base, kept[base]))
    return {t: stem for t, (_, stem, _) in lexicon.terms.items()}


def score_documents(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts have no hit and get the score of none. Whole texts are searched, very long ones
    too; repeated rows are each scored; rows without an id count as held out; no rows give none; further
    columns, whatever their names, are not read. The score is the logistic of ln(1 + w), w being the sum of
    the hits' weights: 1, ``fuzzy`` for a misspelling, times ``quoted`` where a hit is quoted or reported.
    """
    found = map_texts(docs, ["doc_id"], "text", lambda: lambda texts, own=ToxicityScorer(model): [own.scores(texts)], "score double")
    return found.select(
        "doc_id",
        held_out("doc_id", MODULUS, REMAINDER).alias("held_out"),
        "score",
        (F.col("score") >= F.lit(threshold)).cast("int").alias("predicted"),
    )
