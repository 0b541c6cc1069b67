"""Toxicity: a linear classifier with counterfactual regularisation.

Features of a text are its distinct words (runs of letters, lower case) and their first 4, 5 and 6 letters, as 64-bit hashes.
Training minimises the class-balanced logistic loss, an L1 term, and PAIR_WEIGHT times the squared change of the raw score
between each labelled text with identity terms and its counterfactual, in which they are swapped for the next term of their
group. So a group's mention alone moves a score no more than any other group's, and neutral mentions stay neutral.
Weights are not negative: a toxic word in a long text can't be outweighed by clean ones.

A labelled text without identity terms is paired as well: with a term put in, and that term's swap (chosen by a hash of the
text, in the language of each group in turn). So the penalty holds for terms that no labelled text mentions, whose first
letters are those of other words.

Only features that a larger share of toxic than of other texts has (SCREEN times, classes balanced) can gain a weight; the
rest is left out before the fit. The model is fitted on a sample of at most max_rows labelled texts for each class, by hash of
the id; everything is scored. A null or empty text has no words and the score of the bias alone. Labels other than 0 and 1,
and null ids, are left out (held_out of a null id is null); ids labelled twice count as toxic if any label is. With labels of one class only, all scores are that class's 0.01 or 0.99,
and 0.01 without any.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import col, mapped, sliced, table, tidy

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
MAX_ROWS, MIN_DOCS, ROUNDS = 5000, 3, 150
RATE, L1, PAIR_WEIGHT, SCREEN, REMEMBERED = 0.3, 2e-4, 1.0, 1.25, 1 << 17
# Terms that name groups of people; each is swapped for the next of its tuple, the last for the first.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"), ("black", "white", "asian", "latino"), ("immigrants", "citizens", "refugees"), ("old", "young"), ("blind", "deaf", "disabled"), ("african", "american", "european", "mexican", "chinese"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("schwule", "lesben", "heterosexuelle"), ("ausländer", "einheimische", "flüchtlinge"), ("türken", "deutsche", "polen"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"), ("homosexuels", "lesbiennes", "hétérosexuels"), ("immigrés", "citoyens", "réfugiés"), ("arabes", "français", "africains"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"), ("homosexuales", "lesbianas", "heterosexuales"), ("inmigrantes", "ciudadanos", "refugiados"), ("gitanos", "españoles", "latinos"),
)


def swaps(groups=IDENTITY_GROUPS) -> dict[str, str]:
    return {a: b for g in groups for a, b in zip(g, (*g[1:], g[0]), strict=True)}


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features(word: str) -> list[int]:
    return [xxhash.xxh3_64_intdigest(f"w {word}"), *(xxhash.xxh3_64_intdigest(f"{n} {word[:n]}") for n in PREFIXES if len(word) >= n)]


def _hashed(some: set[str]) -> np.ndarray:
    return np.unique(np.array([h for w in some for h in features(w)], np.uint64))


def _examples(groups):
    """(id, toxic, its features, features that a swap adds, features that it takes away), packed."""
    swap, terms = swaps(groups), [t for g in groups for t in g]

    def run(batches):
        for batch, texts in sliced(batches, 2):
            own, more, less = [], [], []
            for x in texts.to_pylist():
                mine = words(x)
                there = _hashed(mine)
                own.append(there.tobytes())
                if any(w in swap for w in mine):
                    before, after = there, _hashed({swap.get(w, w) for w in mine})
                elif terms:
                    term = terms[xxhash.xxh3_64_intdigest(x) % len(terms)]
                    before, after = np.union1d(there, _hashed({term})), np.union1d(there, _hashed({swap[term]}))
                else:
                    before = after = there
                more.append(np.setdiff1d(after, before).tobytes())
                less.append(np.setdiff1d(before, after).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in (own, more, less))], ["id", "toxic", "own", "more", "less"])

    return run


class Model:
    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, float] = {}
        self.idle: set[str] = set()

    def raw(self, text: str) -> float:
        if len(self.known) + len(self.idle) > REMEMBERED:
            self.known.clear()
            self.idle.clear()
        found = []
        for w in words(text) - self.idle:  # few words have a weight
            if (x := self.known.get(w)) is None:
                x = sum(self.weights.get(h, 0.0) for h in features(w))
                if not x:
                    self.idle.add(w)
                    continue
                self.known[w] = x
            found.append((w, x))
        return sum((x for _, x in sorted(found)), self.bias)  # a fixed order, so that equal texts have equal scores

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(text), -30, 30))))


def fit(toxic: np.ndarray, own: list[np.ndarray], more: list[np.ndarray], less: list[np.ndarray], pair_weight: float = PAIR_WEIGHT, rounds: int = ROUNDS, min_docs: int = MIN_DOCS) -> Model:
    """For each labelled text its label, features, and the features that its counterfactual has more and less."""
    toxic = toxic.astype(np.float64)
    if not len(toxic) or toxic.min() == toxic.max():
        return Model({}, float(np.log(99) * (1 if len(toxic) and toxic[0] else -1)))
    keys, where, n = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    bad = np.bincount(where, np.repeat(toxic, [len(x) for x in own]), len(keys))
    enough = (n >= min_docs) & (bad * (1 - toxic).sum() > SCREEN * (n - bad) * toxic.sum())
    keys = keys[enough]

    def indexed(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        at = np.minimum(np.searchsorted(keys, flat), max(0, len(keys) - 1))
        ok = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
        return at[ok].astype(np.int32), row[ok].astype(np.int32)

    if not len(keys):
        return Model({}, float(np.log(toxic.mean() / (1 - toxic.mean()))))
    at, row = indexed(own)
    pairs = [i for i in range(len(own)) if len(more[i]) or len(less[i])]
    plus, plus_row = indexed([more[i] for i in pairs])
    minus, minus_row = indexed([less[i] for i in pairs])
    weight = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())
    w, bias, seen, seen_bias = np.zeros(len(keys)), 0.0, np.full(len(keys), 1e-12), 1e-12
    sums = lambda to, x, n: np.bincount(to, x, n).astype(np.float64)  # noqa: E731  integers where there is nothing to sum
    for _ in range(rounds):
        raw = sums(row, w[at], len(own)) + bias
        pull = weight * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - toxic)
        grad = sums(at, pull[row], len(keys))
        if pairs:
            change = sums(plus_row, w[plus], len(pairs)) - sums(minus_row, w[minus], len(pairs))
            change *= 2 * pair_weight / len(pairs)
            grad += sums(plus, change[plus_row], len(keys)) - sums(minus, change[minus_row], len(keys))
        seen += grad * grad
        seen_bias += pull.sum() ** 2
        step = RATE / np.sqrt(seen)
        w = np.maximum(0.0, w - step * (grad + L1))
        bias -= RATE / np.sqrt(seen_bias) * pull.sum()
    keep = w > 1e-3
    return Model(dict(zip(keys[keep].tolist(), w[keep].tolist(), strict=True)), bias)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_rows: int = MAX_ROWS, pair_weight: float = PAIR_WEIGHT, groups=IDENTITY_GROUPS) -> Model:
    """labels: every row may be learnt from."""
    marks = labels.select(col(doc_id).alias("label_id"), col(label).cast("int").alias("toxic")).filter("label_id is not null and toxic in (0, 1)")
    marks = marks.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    sample = None
    for kind in (0, 1):
        part = marks.filter(F.col("toxic") == kind).orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
        sample = part if sample is None else sample.unionByName(part)
    # 2 * max_rows ids and labels at most: a bound, whatever the input
    texts = docs.select(col(doc_id).alias("id"), col(text).cast("string").alias("text"))
    examples = texts.join(F.broadcast(sample), F.col("id") == F.col("label_id")).select(F.col("id").cast("string").alias("id"), "toxic", "text")
    found = examples.mapInArrow(tidy(_examples(groups)), "id string, toxic int, own binary, more binary, less binary").toArrow()
    found = found.take(pc.sort_indices(found, [("id", "ascending"), ("own", "ascending")])) if found.num_rows else found
    unpacked = ([np.frombuffer(x.as_py(), np.uint64) for x in found[c]] for c in ("own", "more", "less"))
    return fit(found["toxic"].to_numpy(), *unpacked, pair_weight=pair_weight)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5) added; existing columns of these names are replaced."""
    docs = docs.drop("score", "predicted")
    at, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        own = Model(*shared.value)
        for batch, texts in sliced(batches, at):
            scores = [own.score(x) for x in texts.to_pylist()]
            columns = [*(batch.column(i) for i in range(batch.num_columns)), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "predicted"])

    return mapped(docs, run, ["score double", "predicted int"])


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
