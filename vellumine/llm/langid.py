"""Language identification by multilingual mixture inference.

Each language has a smoothed distribution of letter trigrams. Expectation-maximisation estimates a document's
proportions of languages from the likelihoods of its words (products over their trigrams). The
set of languages starts with the best single one and grows while a penalised likelihood gains: the
likelihood of mixtures is concave, so where its slope towards a language is below the penalty, adding that
language cannot pay, and most documents need no iteration at all. EM goes on until no proportion moves.

Learning takes a documented, bounded sample: about ``per_lang`` labelled documents a language, chosen by a hash
of key and text; rows that agree in both teach once. The model's size is bounded too: ``TABLE`` numbers over all
languages, so more than ``TABLE >> BITS`` labels have fewer buckets each. Prediction takes whole texts in pieces;
a text of over ``LONG`` characters is predicted from its distinct words and their counts, which gives the same.

Edge cases: a text that is null, empty or without a letter is ``und`` with score 0; so is every
text where no label was learned; ties go to the first language in code-point order; null labels
teach nothing; repeated rows are predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.columns import append, pieces, tidied
from vellumine.llm.skew import small
from vellumine.session import cut

#: Buckets of hashed trigrams (a power of two), additive smoothing, and the sample's bound a language.
BITS = 18
SMOOTHING = 0.5
PER_LANG = 3000
#: Numbers in the model (languages times buckets), characters of a text that is predicted by distinct words;
#: numbers of the model that are gathered at once.
TABLE, LONG = 1 << 25, 1 << 18
GATHERED = 1 << 22
#: Nats that a further language must gain beyond half the log of the number of words; how little
#: proportions move when EM ends, and steps after which it raises.
PENALTY = 6.0
STILL, STEPS = 1e-7, 100_000
FLOOR = -60.0


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters (or marks of a word)."""
    table = np.zeros(0x110000, dtype=bool)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return table


def trigrams(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over texts on end: the bucket of each letter's trigram, where words start among them, each word's text, letters before each text."""
    lowered = [t.lower() for t in texts]
    lengths = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
    points = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    own = np.where(is_letter, points, 0)
    mixed = own[:-2] * np.uint32(0x9E3779B1) ^ (own[1:-1] * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F)) * np.uint32(0xC2B2AE3D) ^ own[2:] * np.uint32(0x165667B1)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    buckets = mixed >> np.uint32(32 - bits)
    middle = is_letter[1:-1]
    at = np.flatnonzero(middle)
    first = np.flatnonzero(~is_letter[:-2][at])
    owner = np.searchsorted(np.cumsum(lengths), at[first], side="right")
    return buckets[at], first, owner, np.bincount(owner, minlength=len(texts))


def likelihoods(buckets: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word in each language; the table's rows are gathered in parts that end with a word."""
    out = np.zeros((len(first), table.shape[1]), np.float32)
    step = max(1, GATHERED // max(1, table.shape[1]))
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + step)))
        end = first[hi] if hi < len(first) else len(buckets)
        out[lo:hi] = np.add.reduceat(table[buckets[first[lo]:end]], first[lo:hi] - first[lo], axis=0)
        lo = hi
    return out


def counted_words(text: str) -> tuple[str, np.ndarray]:
    """The distinct words of a text, on end, and how often each is there."""
    low = text.lower()
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    parted = np.where(letters()[points], points, 32).astype(np.uint32)
    words = Counter(parted.tobytes().decode("utf-32-le", "surrogatepass").split(" "))
    words.pop("", None)
    return " ".join(words), np.fromiter(words.values(), np.float64, len(words))


def settled(p: np.ndarray, begin: np.ndarray, weight: np.ndarray, words: np.ndarray, trial: np.ndarray) -> np.ndarray:
    """Proportions at which EM stands still: documents that have come to rest drop out."""
    trial = trial.copy()
    ends = np.append(begin[1:], len(p))
    live = np.arange(len(trial))
    rows, first, owner = p, begin, np.repeat(live, ends - begin)
    w = weight
    for _ in range(STEPS):
        joint = rows * trial[live][owner]
        joint *= (w / joint.sum(axis=1))[:, None]
        new = np.add.reduceat(joint, first, axis=0) / words[live][:, None]
        moved = np.abs(new - trial[live]).max(axis=1) > STILL
        trial[live] = new
        if not moved.any():
            return trial
        if not moved.all():
            keep = moved[owner]
            rows, w = rows[keep], w[keep]
            live = live[moved]
            owner = (np.cumsum(moved) - 1)[owner[keep]]
            first = np.searchsorted(owner, np.arange(len(live)))
    raise RuntimeError(f"EM didn't settle in {STEPS} steps")


def infer(log: np.ndarray, owner: np.ndarray, n: int, penalty: float = PENALTY, weight: np.ndarray | None = None) -> np.ndarray:
    """Proportions (n documents by languages) from words' log-likelihoods; owner is sorted; a word counts ``weight`` times."""
    languages = log.shape[1]
    pi = np.zeros((n, languages))
    weight = np.ones(len(owner)) if weight is None else weight
    words = np.bincount(owner, weights=weight, minlength=n)
    held = np.flatnonzero(words)
    if not len(held) or not languages:
        return pi
    starts = np.searchsorted(owner, held)
    single = np.add.reduceat(log * weight[:, None], starts, axis=0, dtype=np.float64)
    best = single.argmax(axis=1)
    pi[held, best] = 1.0
    probability = np.exp(np.maximum(log - log.max(axis=1, keepdims=True), FLOOR)).astype(np.float64)
    if languages == 1:
        return pi
    price = penalty + 0.5 * np.log(np.maximum(words, 1))
    active = pi > 0
    going = np.zeros(n, bool)
    going[held] = True
    for _ in range(languages - 1):
        keep = going[owner]
        p, o, w = probability[keep], owner[keep], weight[keep]
        docs = np.flatnonzero(going)
        if not len(docs):
            break
        local = np.searchsorted(docs, o)
        begin = np.searchsorted(o, docs)
        now = np.einsum("ij,ij->i", p, pi[docs][local])
        gain = np.add.reduceat(p * (w / now)[:, None], begin, axis=0) - words[docs][:, None]
        gain[active[docs]] = -np.inf
        new = gain.argmax(axis=1)
        going[docs[gain[np.arange(len(docs)), new] <= price[docs]]] = False  # the slope bounds what can be gained
        mask = going[docs]
        if not mask.any():
            break
        docs, new = docs[mask], new[mask]
        keep = mask[local]
        p, o, w, now = p[keep], o[keep], w[keep], now[keep]
        local, begin = np.searchsorted(docs, o), np.searchsorted(o, docs)
        trial = pi[docs] * 0.9
        trial[np.arange(len(docs)), new] = 0.1
        trial = settled(p, begin, w, words[docs], trial)
        after = np.einsum("ij,ij->i", p, trial[local])
        better = np.add.reduceat(w * (np.log(after) - np.log(now)), begin) > price[docs]
        won = docs[better]
        pi[won] = trial[better]
        active[won, new[better]] = True
        going[docs[~better]] = False
    return pi


class Model:
    """Languages in code-point order and log-probabilities of buckets (buckets by languages): at most TABLE numbers."""

    def __init__(self, languages: list[str], table: np.ndarray) -> None:
        self.languages, self.table = languages, table
        self.bits = max(1, len(table)).bit_length() - 1


def sample_of(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> tuple[DataFrame, int]:
    """(lang, text) of about ``per_lang`` labelled documents a language, and how many languages there are."""
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id), F.col(text)).alias("own"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("own").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("n")) * float(1 << 30)
    sizes = cut(sizes.select("lang", share.alias("upto")))  # one row a language
    drawn = rows.join(small(sizes), "lang").where(F.pmod(F.xxhash64("own"), F.lit(1 << 30)) < F.col("upto"))
    return drawn.dropDuplicates(["lang", "own"]).select("lang", "text"), sizes.count()


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> Model:
    """Learn from rows with a label. What is gathered: a count for each language and bucket seen, at most TABLE."""
    sample, many = sample_of(labelled, doc_id, text, lang, per_lang)
    bits = max(6, min(BITS, (TABLE // max(1, many)).bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch, "text"):
                langs, texts = piece.column("lang").to_pylist(), piece.column("text").to_pylist()
                for own in set(langs):
                    some = [t for k, t in zip(langs, texts, strict=True) if k == own and t]
                    if some:
                        sums[own] = sums.get(own, 0) + np.bincount(trigrams(some, bits)[0], minlength=1 << bits)
        for own, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([own] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    counted = sample.mapInArrow(tidied(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    table = np.zeros((1 << bits, len(languages)), np.float32)
    for own, part in counted.groupby("lang"):
        table[part["bucket"].to_numpy(), languages.index(own)] = part["n"].to_numpy()
    seen = max(1, int((table.sum(axis=1) > 0).sum()))
    table = np.log((table + np.float32(SMOOTHING)) / (table.sum(axis=0, dtype=np.float64) + SMOOTHING * 2 * seen).astype(np.float32))
    return Model(languages, table)


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("proportions", T.StringType())]


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred, score (its share of the words) and all proportions of the chosen set."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table))  # at most TABLE numbers
    bits = model.bits

    def make() -> Callable[[list], list[list]]:
        languages, table = shared.value

        def run(texts: list) -> list[list]:
            buckets, first, owner, words = trigrams(["" if t is None or len(t) > LONG else t for t in texts], bits)
            pi = infer(likelihoods(buckets, first, table), owner, len(texts))
            for k, t in enumerate(texts):
                if t is not None and len(t) > LONG:
                    unique, weight = counted_words(t)
                    buckets, first, owner, more = trigrams([unique], bits)
                    words[k] = more[0]
                    pi[k] = infer(likelihoods(buckets, first, table), owner, 1, weight=weight)[0]
            out: list[list] = [[], [], []]
            for k in range(len(texts)):
                if not words[k] or not languages:
                    own = ("und", 0.0, "")
                else:
                    top = int(pi[k].argmax())
                    own = (languages[top], float(min(1.0, pi[k, top])), ",".join(f"{languages[j]}:{pi[k, j]:.4f}" for j in np.argsort(-pi[k], kind="stable") if pi[k, j] > 0))
                for column, value in zip(out, own, strict=True):
                    column.append(value)
            return out

        return run

    return append(docs, text, FIELDS, make, keep)


def op1(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from three of four documents by a hash."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    model = fit(held.where(~F.col("held_out")))
    return predict(held, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "proportions")
