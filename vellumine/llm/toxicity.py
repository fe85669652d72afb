"""Toxicity: a lexicon trie met by Levenshtein automata, weighed by the context of each hit.

Learning finds terms (whole words, or stems that begin words) that toxic documents hold far more
often than others, puts them in a trie, and fits a logistic regression on what hits add up to.
Matching runs the intersection of the trie with the automaton of its terms' misspellings: states
are sets of (trie node, errors), determinised as words ask for them, so a word costs one look-up a
letter and most die within a few letters. Any letter may be wrong, the first too; terms under five
letters are met only as they are. Each hit counts by its context window: a term inside
quotation marks or beside words of reporting counts less than one said to somebody.

Words are runs of letters, in learning and in matching, so punctuation and hyphens part them;
what stands between blanks is also read whole, with signs and digits as the letters they stand for. Scripts
that don't part words (Han, kana, Thai, Lao, Khmer, Burmese) have strings of 2 to 4 characters as terms,
looked up along their runs, the longest first; each character counts as a word there. Cues of
reporting and address are known in English, French, German and Spanish only.

Edge cases: null and empty texts have no hits and the score of no hits; without labels of both
kinds the score is 0 for all; ties between terms go to fewer errors, then to the heavier; repeated
rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.columns import append, pieces, tidied
from vellumine.session import cut

#: Bounds of the labelled sample by label (toxic, other): documented parameters of the learning.
SAMPLE = (4000, 8000)
#: A term: toxic documents that hold it at least, log-likelihood ratio and log-odds at least.
LEAST_DOCS, LEAST_G2, LEAST_ODDS = 3, 24.0, math.log(12)
STEMS = range(4, 9)
#: Words on either side that make a hit's context, and what quotation, reporting and address do to its weight.
WINDOW = 5
QUOTED, REPORTED, ADDRESSED = 0.35, 0.6, 1.25
#: Weight of a hit by its errors.
SPELLED = (1.0, 0.85, 0.7)
#: Cues of context (fixed values).
REPORTING = frozenset("said says quote quoted quotes called word words term terms slur wrote dit mot terme sagte wort begriff dijo palabra".split())
ADDRESS = frozenset("you your yours u ur you're tu toi vous du dich dein ihr tú usted vosotros".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
QUOTES = '"“”„«»'
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_CLOSING = re.compile(r"(?:[^\w$@]|_)+$")
#: Scripts without blanks between words.
_UNPARTED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_LETTERS = re.compile(rf"[{_UNPARTED}]+|[^\W\d_{_UNPARTED}]+")
_PARTED = re.compile(r"[^\w$@!|]+|_+")
_DENSE = re.compile(f"[{_UNPARTED}]")
_DENSE_OR_NOT = re.compile(f"[{_UNPARTED}]|[^{_UNPARTED}]+")
#: Common punctuation at edges (signs that may stand for letters there left out).
_OPENS = "\"'([{<.,;:?*-\u201c\u201e\u00ab\u2018\u00bf"
_CLOSES = "\"')]}>.,;:?!*-\u201d\u201c\u00bb\u2019\u2026"
#: Characters of a term in these scripts.
DENSE = (2, 3, 4)


def normal(piece: str) -> str:
    """A word as the trie spells it: lower case, bare at its edges, digits and signs inside as the letters they stand for."""
    return spelled(_EDGE.sub("", piece.lower()))


def spelled(bare: str) -> str:
    if bare.isalpha():
        return bare
    if not any(c.isalpha() for c in bare):
        return ""
    return "".join(c for c in bare.translate(LEET) if c.isalpha())


def readings(piece: str) -> list[frozenset[str]]:
    """How the words of what stands between blanks may be read: as one word, bare at its edges or with the signs
    there as letters too (behind it, those that aren't punctuation); as words parted by punctuation; as runs of letters."""
    low = piece.lower()
    bare = low.lstrip(_OPENS).rstrip(_CLOSES)
    if bare.isalpha():
        return [frozenset({bare})]
    parts = [low, *_PARTED.split(low), *_LETTERS.findall(low)]
    return list(dict.fromkeys(frozenset({normal(p), spelled(_CLOSING.sub("", p))}) for p in parts if p))


def dense_terms(run: str) -> set[str]:
    """The strings of a run that may be terms."""
    return {run[i:i + k] for k in DENSE for i in range(len(run) - k + 1)}


def words_of(text: str) -> set[str]:
    """The words that a text may teach."""
    out: set[str] = set()
    for run in _LETTERS.findall(text.lower()):
        if _DENSE.match(run):
            out |= dense_terms(run)
        elif len(run) > 2:
            out.add(run)
    return out


def tokens(text: str) -> list[str]:
    """What stands between blanks; in scripts without blanks, each character."""
    parts = text.split()
    if not _DENSE.search(text):
        return parts
    return [t for p in parts for t in _DENSE_OR_NOT.findall(p)]


def allowed(term: str) -> int:
    """Errors that a misspelling of this term may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Terms {term: (weight, is_stem)} in a trie, and the lazily determinised automaton over it.

    ``strict`` terms are met only as they are spelled. Errors may be at a term's first letter too if ``whole``.
    """

    #: Items (nodes with errors) of all states that are kept; beyond, the states are made anew.
    MOST_ITEMS = 400_000

    def __init__(self, terms: dict[str, tuple[float, bool]], strict: frozenset[str] = frozenset(), whole: bool = False) -> None:
        self.terms, self.whole = terms, whole
        self.allowed = {t: 0 if t in strict else allowed(t) for t in terms}
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.most: list[int] = [0]  # errors that any term below a node allows
        for term in sorted(terms):
            node, k = 0, self.allowed[term]
            self.most[0] = max(self.most[0], k)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], k)
            self.ends[node] = term
        self.reset()

    def reset(self) -> None:
        start = self.closed({(0, 0)})
        self.states = {start: 0}
        self.sets = [start]
        self.held = len(start)
        self.steps: list[dict[str, int]] = [{}]

    def closed(self, items: set) -> tuple:
        """With the letters of terms that a misspelling leaves out; fewest errors a node. Items are 4 * node + errors, in order."""
        best: dict[int, int] = {}
        todo = list(items)
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            if e < self.most[node] and (node or self.whole):
                todo += [(c, e + 1) for c in self.children[node].values()]
        return tuple(sorted(4 * node + e for node, e in best.items()))

    def step(self, state: int, c: str) -> int:
        to: set = set()
        for node, e in (divmod(x, 4) for x in self.sets[state]):
            end = self.ends[node]
            if end is not None and self.terms[end][1] and e <= self.allowed[end]:
                to.add((node, e))  # a stem met: the rest of the word is free
            child = self.children[node].get(c)
            if child is not None:
                to.add((child, e))
            if e < self.most[node] and (node or self.whole):
                to.add((node, e + 1))
                to |= {(x, e + 1) for x in self.children[node].values()}
        made = self.closed(to)
        if not made:
            self.steps[state][c] = -1
            return -1
        number = self.states.setdefault(made, len(self.sets))
        if number == len(self.sets):
            self.sets.append(made)
            self.steps.append({})
            self.held += len(made) + 8
        self.steps[state][c] = number
        return number

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its errors, or None."""
        if self.held > self.MOST_ITEMS:
            self.reset()
        state = 0
        for c in word:
            to = self.steps[state].get(c)
            state = self.step(state, c) if to is None else to
            if state < 0:
                return None
        found = [(e, -self.terms[t][0], t) for node, e in (divmod(x, 4) for x in self.sets[state]) if (t := self.ends[node]) is not None and e <= self.allowed[t]]
        if not found:
            return None
        e, _, term = min(found)
        return term, e


class Matcher(dict):
    """Pieces of text to their hits, (term, errors), remembered up to a bound."""

    MOST, LONGEST = 100_000, 64

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, piece: str) -> tuple[tuple[str, int], ...]:
        if len(self) > self.MOST:
            self.clear()
        terms, out = self.lexicon.terms, []
        for words in readings(piece):
            met = [hit for word in words if len(word) > 2 and (hit := self.lexicon.match(word)) is not None]
            if met:
                hit = min(met, key=lambda h: (h[1], -terms[h[0]][0], h[0]))
                if hit not in out:
                    out.append(hit)
        found = tuple(out)
        if len(piece) <= self.LONGEST:
            self[piece] = found
        return found

    def hits(self, words: list[str], dense: bool = True) -> list[tuple[int, str, int]]:
        """(place, term, errors) of all hits in a text's tokens; ``dense`` where some may be of a script without blanks."""
        found = [(i, t, e) for i, own in enumerate(map(self.__getitem__, words)) if own for t, e in own]
        if dense:
            terms, i = self.lexicon.terms, 0
            while i < len(words):
                if not _DENSE.match(words[i]):
                    i += 1
                    continue
                run = []
                for w in words[i:i + max(DENSE)]:
                    if not _DENSE.match(w):
                        break
                    run.append(w)
                term = next((t for k in reversed(DENSE) if len(run) >= k and (t := "".join(run[:k])) in terms), None)
                if term is not None:
                    found.append((i, term, 0))
                i += len(term or "x")
            found.sort(key=lambda h: h[0])
        return found


def marks_before(words: list[str], at: list[int]) -> list[int]:
    """Quotation marks in all words before each of these places (in order)."""
    out, marks, begin = [], 0, 0
    for end in at:
        run = " ".join(words[begin:end])
        marks += sum(map(run.count, QUOTES))
        out.append(marks)
        begin = end
    return out


def context(words: list[str], at: int, marks: int | None = None) -> float:
    """The weight that the window about a hit gives it, with so many quotation marks before it in the text."""
    weight = 1.0
    if marks is None:
        (marks,) = marks_before(words, [at])
    own = words[at]
    if (own[0] in QUOTES and own.rstrip(".,;:!?")[-1] in QUOTES and len(own) > 1) or marks % 2 or (own[0] in QUOTES and any(q in w for w in words[at + 1:at + 12] for q in QUOTES)):
        weight *= QUOTED
    near = {_EDGE.sub("", w.lower()) for w in words[max(0, at - WINDOW):at + WINDOW + 1]}
    if near & REPORTING:
        weight *= REPORTED
    if near & ADDRESS:
        weight *= ADDRESSED
    return weight


def features(text: str | None, matcher: Matcher) -> tuple[float, float, float, float]:
    """Of the hits, weighed by their terms' log-odds, context and errors: the heaviest, the sum; distinct terms; hits per hundred words."""
    if not text:
        return 0.0, 0.0, 0.0, 0.0
    words = tokens(text)
    hits = matcher.hits(words, _DENSE.search(text) is not None)
    if not hits:
        return 0.0, 0.0, 0.0, 0.0
    terms = matcher.lexicon.terms
    marks = marks_before(words, [i for i, _, _ in hits])
    weights = [context(words, i, n) * SPELLED[e] * terms[t][0] for (i, t, e), n in zip(hits, marks, strict=True)]
    return max(weights), sum(weights), float(len({t for _, t, _ in hits})), 100.0 * len(hits) / len(words)


def shaped(rows: list[tuple[float, float, float, float]]) -> np.ndarray:
    x = np.array(rows, dtype=float).reshape(-1, 4)
    return np.column_stack([np.ones(len(x)), x[:, 0], np.log1p(x[:, 1:])])


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(h, g)
        w -= np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, terms: dict[str, tuple[float, bool]], strict: frozenset[str], weights: np.ndarray, toxic_known: bool) -> None:
        self.terms, self.strict, self.weights, self.toxic_known = terms, strict, weights, toxic_known


def g2(a: float, b: float, na: float, nb: float) -> float:
    """Log-likelihood ratio of a term in a of na toxic and b of nb other documents."""
    def part(k: float, n: float, p: float) -> float:
        return (k * math.log(k / n / p) if k else 0.0) + ((n - k) * math.log((n - k) / n / (1 - p)) if n > k else 0.0)

    p = (a + b) / (na + nb)
    return 2 * (part(a, na, p) + part(b, nb, p)) if 0 < p < 1 else 0.0


def chosen(counts: dict[tuple[str, bool], tuple[int, int]], na: int, nb: int) -> dict[str, tuple[float, bool]]:
    """The lexicon from document counts of (spelling, is_stem): stems as long as they lose no
    document, whole words where those alone explain a stem."""
    def odds(a: int, b: int) -> float:
        return math.log((a + 0.5) / (na + 1)) - math.log((b + 0.5) / (nb + 1))

    good = {k: v for k, v in counts.items() if v[0] >= LEAST_DOCS and odds(*v) >= LEAST_ODDS and g2(*v, na, nb) >= LEAST_G2}
    words = {w: v for (w, stem), v in good.items() if not stem}
    stems = {w: v for (w, stem), v in good.items() if stem}
    terms: dict[str, tuple[float, bool]] = {}
    longer: Counter = Counter()
    for s, (a, _) in stems.items():
        longer[s[:-1]] = max(longer[s[:-1]], a)
    explained = {w[:k]: max(v[0] for x, v in words.items() if x.startswith(w[:k])) for w in words for k in STEMS if len(w) >= k}
    for s in sorted(stems, key=len):
        a, b = stems[s]
        if longer[s] >= 0.97 * a or explained.get(s, 0) >= 0.9 * a:
            continue
        if any(s[:k] in terms and terms[s[:k]][1] for k in STEMS if k < len(s)):
            continue
        terms[s] = (odds(a, b), True)
    for w, (a, b) in words.items():
        if not any(w[:k] in terms and terms[w[:k]][1] for k in STEMS if k <= len(w)):
            terms[w] = (odds(a, b), False)
    return dict(sorted(terms.items(), key=lambda t: (-t[1][0], t[0])))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: tuple[int, int] = SAMPLE) -> Model:
    """Learn from documents with a label 0 or 1, a bounded sample of each chosen by a hash of the id.

    The sample is drawn from the labels, so about ``sum(sample)`` short rows are broadcast to the
    documents and only their texts are kept.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model({}, frozenset(), np.zeros(5), False)
    upto = F.when(F.col("y") == 1, F.lit(min(1.0, sample[0] / n[1]))).otherwise(F.lit(min(1.0, sample[1] / n[0]))) * float(1 << 30)
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < upto)
    drawn = cut(docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(picked), "id").select("y", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        total = Counter()

        def out() -> pa.RecordBatch:
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], names=["term", "stem", "y", "n"])

        for batch in batches:
            for piece in pieces(batch, "text"):
                for y, whole in zip(piece.column("y").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    words = words_of(whole)
                    total[y] += 1
                    seen.update((w, False, y) for w in words)
                    seen.update({(w[:k], True, y) for w in words for k in STEMS if len(w) > k and not _DENSE.match(w)})
                if len(seen) > 500_000:
                    yield out()
                    seen.clear()
        for y, k in total.items():
            seen["", False, y] = k
        if seen:
            yield out()

    tox, other = F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b")
    found = drawn.mapInArrow(tidied(count), "term string, stem boolean, y int, n long").groupBy("term", "stem").agg(tox, other)
    # what comes to the driver is bounded by the sample: terms that hold in at least LEAST_DOCS toxic documents and few others
    kept = found.where((F.col("term") == "") | ((F.col("a") >= LEAST_DOCS) & (F.col("a") * float(n[0]) > F.col("b") * float(n[1])) & (F.col("a") > 8.0 * F.col("b") * min(1.0, sample[0] / n[1]) * n[1] / (min(1.0, sample[1] / n[0]) * n[0])))).collect()
    whole = next((r for r in kept if r["term"] == ""), None)
    if whole is None or not whole["a"] or not whole["b"]:
        return Model({}, frozenset(), np.zeros(5), False)
    terms = chosen({(r["term"], r["stem"]): (r["a"], r["b"]) for r in kept if r["term"]}, whole["a"], whole["b"])

    def misspelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, seen = Matcher(Lexicon(terms, whole=True)), Counter()
        for batch in batches:
            for piece in pieces(batch, "text"):
                for y, whole in zip(piece.column("y").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    seen.update({(t, y) for own in map(matcher.__getitem__, tokens(whole)) for t, e in own if e})
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array(seen.values(), pa.int64())], names=["term", "y", "n"])

    # a term whose misspellings stand in ordinary texts is met only as it is spelled
    near = drawn.mapInArrow(tidied(misspelled), "term string, y int, n long").groupBy("term").agg(tox, other).collect()
    strict = frozenset(r["term"] for r in near if r["b"] and math.log((r["a"] + 0.5) / (whole["a"] + 1)) - math.log((r["b"] + 0.5) / (whole["b"] + 1)) < LEAST_ODDS)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(Lexicon(terms, strict, whole=True))
        for batch in batches:
            for piece in pieces(batch, "text"):
                made = [features(t, matcher) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("y"), *[pa.array(c, pa.float64()) for c in zip(*made, strict=True)]], names=["y", "f0", "f1", "f2", "f3"])

    described = drawn.mapInArrow(tidied(describe), "y int, f0 double, f1 double, f2 double, f3 double").toPandas()  # one row a sampled document
    described = described.sort_values(list(described.columns))
    y = described["y"].to_numpy(float)
    weights = regression(shaped(list(described[["f0", "f1", "f2", "f3"]].itertuples(index=False, name=None))), y)
    # the sample draws labels at unlike rates: the intercept is set right for that
    rates = min(1.0, sample[0] / n[1]), min(1.0, sample[1] / n[0])
    weights[0] -= math.log(rates[0] / rates[1])
    return Model(terms, strict, weights, True)


FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("hits", T.DoubleType())]


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``docs`` with score, predicted (1 from 0.5 on) and hits (their weights, summed), named after ``prefix``."""
    terms, strict, weights, known = model.terms, model.strict, model.weights, model.toxic_known

    def make() -> Callable[[list], list[list]]:
        matcher = Matcher(Lexicon(terms, strict, whole=True))

        def run(texts: list) -> list[list]:
            made = [features(t, matcher) for t in texts]
            p = 1 / (1 + np.exp(-np.clip(shaped(made) @ weights, -30, 30))) if known else np.zeros(len(texts))
            return [p.tolist(), (p >= 0.5).astype(int).tolist(), [x[1] for x in made]]

        return run

    return append(docs, text, [T.StructField(prefix + f.name, f.dataType) for f in FIELDS], make, keep)


def fold(doc_id: str = "doc_id"):
    """The fold of a document: labels of fold 0 are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(1))


def op2(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text, learned from four of five labels by a hash."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold() != 0))
    held = docs.withColumn("held_out", fold() == 0)
    return score(held, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "score", "predicted", "hits")
