"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, report (verbs and quotation marks of
reported speech), clause end, other. Three small transducers rewrite insults and threats by what
stands around them in the clause: whether a target was named, whether a negation stands just before,
whether the words are reported. They are composed into one table, so a clause is scored in one pass.
What comes out are weights of matched clauses by kind; a logistic model turns them into a score. Its
weights are learned from a prior and inside an order that the grammar means: an insult to a target counts
no less than one without, a threat likewise, and one that is negated or reported at most a quarter of
a plain one. So kinds that the labelled rows do not show keep a sensible weight.

The insult lexicon starts from a short list of plain words and learns stems and weights from
labelled rows. At most ``SAMPLE`` labelled rows are used, in the order of a hash of their id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetgrid.llm import words as W
from vetgrid.session import stage_table

SAMPLE = 20_000  # labelled rows that a model is fitted on
SUPPORT = 3  # distinct toxic texts that a learned stem needs at least, so that copies of one teach nothing
ODDS = 2.5  # and the log odds against clean texts
PRIOR = 4.0  # weight of a word of the plain list that was never seen in labelled rows
STRENGTH = 2.0  # of the prior of the model's weights, in labelled rows about
SLICE = 4 << 20  # bytes of text that a task works on at once
FEATURES = ("insult", "insult_target", "insult_negated", "insult_reported", "threat", "threat_target", "matched")
PRIOR_WEIGHTS = (2.5, 3.0, 0.3, 0.3, 2.5, 3.0, 0.0, -3.0)  # of the features and the constant

# Plain word lists (own choice).
INSULTS = "idiot moron imbecile scum loser pathetic worthless stupid disgusting clown trash crétin abruti dumm trottel estúpido".split()
THREATS = "kill hurt destroy beat shoot stab burn töten tuer matar".split()
TARGETS = "you your they them he she him her everyone du ihr tu vous tú usted ustedes".split()
NEGATIONS = "not never no isn't aren't wasn't nicht kein pas jamais nunca".split()
REPORTS = "said says told claimed wrote quoted reported sagte dit dijo".split()

_TOKENS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]+|[\"“”«»]").findall
_WORDS = re.compile(r"[^\W\d_]+").findall

Table = dict[tuple[int, str], tuple[int, str]]


def targets() -> Table:
    """A target anywhere before in the clause marks insults and threats."""
    return {(0, "P"): (1, "P"), (1, "I"): (1, "I+"), (1, "T"): (1, "T+"), (1, "E"): (0, "E")}


def negations(reach: int = 3) -> Table:
    """A negation at most ``reach`` words before takes an insult or a threat back."""
    table: Table = {}
    for state in range(reach + 1):
        table[state, "N"] = (reach, "N")
        table[state, "E"] = (0, "E")
        if state:
            for symbol in ("O", "P", "R"):
                table[state, symbol] = (state - 1, symbol)
            for symbol in ("I", "I+", "T", "T+"):
                table[state, symbol] = (state, symbol[0] + "-")
    return table


def reports() -> Table:
    """After a report the rest of the clause is somebody else's."""
    table: Table = {(0, "R"): (1, "R"), (1, "E"): (0, "E")}
    for symbol in ("I", "I+", "I-", "T", "T+", "T-"):
        table[1, symbol] = (1, symbol[0] + "r")
    return table


SYMBOLS = ("I", "T", "P", "N", "R", "O", "E")


def compose(*tables: Table) -> dict:
    """One transducer that feeds the output of each table to the next; unlisted moves copy the
    symbol and stay. States are tuples, listed as far as they can be reached from the start."""
    start = (0,) * len(tables)
    composed, waiting = {}, [start]
    while waiting:
        state = waiting.pop()
        for symbol in SYMBOLS:
            if (state, symbol) in composed:
                continue
            out, after = symbol, []
            for own, table in zip(state, tables):
                to, out = table.get((own, out), (own, out))
                after.append(to)
            composed[state, symbol] = tuple(after), out
            waiting.append(tuple(after))
    return composed


GRAMMAR = compose(targets(), negations(), reports())
KIND = {"I": 0, "I+": 1, "I-": 2, "Ir": 3, "T": 4, "T+": 5, "T-": 2, "Tr": 3}


@dataclass(frozen=True)
class Lexicon:
    """Stems of insults and of threats with weights; a word matches its longest stem."""

    insults: dict[str, float]
    threats: dict[str, float]

    def finder(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for stem in (*self.insults, *self.threats):
            found.add_word(stem, stem)
        found.make_automaton()
        return found


class Matcher:
    """Features of texts by a lexicon and the grammar."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.finder = lexicon, lexicon.finder()
        self.fixed = {"P": set(TARGETS), "N": set(NEGATIONS), "R": {*REPORTS, *'"“”«»'}}

    def symbol(self, token: str) -> tuple[str, float]:
        if token[0] in ".!?;:\n":
            return "E", 0.0
        for symbol, words in self.fixed.items():
            if token in words:
                return symbol, 0.0
        for length in range(len(token), 2, -1):
            for symbol, stems in (("I", self.lexicon.insults), ("T", self.lexicon.threats)):
                if token[:length] in stems:
                    return symbol, stems[token[:length]]
        return "O", 0.0

    def features(self, text: str) -> list[float]:
        result = [0.0] * len(FEATURES)
        folded = text.lower()
        if next(self.finder.iter(folded), None) is None:
            return result
        state, known = (0, 0, 0), {}
        for token in _TOKENS(folded):
            if token not in known:
                known[token] = self.symbol(token)
            symbol, weight = known[token]
            state, out = GRAMMAR[state, symbol]
            if out in KIND:
                result[KIND[out]] += weight
        result[-1] = float(any(result))
        return [math.log1p(max(0.0, x)) for x in result[:-1]] + result[-1:]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...]  # one for each feature, then the constant

    def score(self, features: np.ndarray) -> np.ndarray:
        margin = features @ np.array(self.weights[:-1]) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _stems(text: str) -> set[str]:
    words = {w for w in _WORDS(text.lower()) if len(w) > 3}
    return {w[:n] for w in words for n in range(4, min(len(w), 9) + 1)} | words


def _counted(rows: DataFrame, wanted: set[str] | None) -> dict[str, int]:
    """Distinct texts in which each stem occurs; only stems of ``wanted``, if given.

    Every stem with enough support is fetched, the number is bounded by the words of ``SAMPLE`` rows:
    a limit by frequency would leave out the languages with few toxic rows.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in W.sliced(batches, "text", SLICE):
            for text in batch.column("text").to_pylist():
                stems = _stems(text or "")
                found.update(stems if wanted is None else stems & wanted)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["stem", "n"])

    counted = rows.mapInArrow(count, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))
    kept = counted.filter(F.col("n") >= SUPPORT) if wanted is None else counted
    return {r["stem"]: r["n"] for r in kept.collect()}


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from ``docs (doc_id, text)`` and ``labels (doc_id, toxic)``; the caller leaves out held-out rows.

    With no toxic or no clean row the plain word list and fixed weights are used.
    """
    marked = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = stage_table(docs.join(F.broadcast(marked), "doc_id").select("doc_id", "text", "toxic"), "toxicity-rows")
    toxic, clean = (rows.filter(F.col("toxic") == x).select("text").distinct() for x in (1, 0))
    positives, negatives = toxic.count(), clean.count()
    lexicon = Lexicon({w: PRIOR for w in INSULTS}, {w: PRIOR for w in THREATS})
    weights = PRIOR_WEIGHTS
    if positives and negatives:
        in_toxic = _counted(toxic, None)
        in_clean = _counted(clean, set(in_toxic))
        lexicon = _learned(in_toxic, in_clean, positives, negatives)
        weights = _logistic(*_training_features(rows, lexicon))
    return Model(lexicon, weights)


def _by_chance(n: int, m: int, share: float) -> float:
    """Probability that of ``n + m`` texts at least ``n`` are toxic if each is with probability ``share``."""
    return sum(math.exp(math.lgamma(n + m + 1) - math.lgamma(k + 1) - math.lgamma(n + m - k + 1)
                        + k * math.log(share) + (n + m - k) * math.log1p(-share)) for k in range(n, n + m + 1))


def _learned(in_toxic: dict, in_clean: dict, positives: int, negatives: int) -> Lexicon:
    odds = {s: math.log((n + 0.5) / (positives + 1)) - math.log((in_clean.get(s, 0) + 0.5) / (negatives + 1))
            for s, n in in_toxic.items()}
    # Less than one word of all that were tried may pass by chance; a word is tried by up to six prefixes. This asks the
    # same of rare and of frequent languages, a share of all toxic rows does not.
    share, tried = positives / (positives + negatives), len(odds) / 6
    telling = [s for s in odds if odds[s] > ODDS and in_clean.get(s, 0) * 20 <= in_toxic[s]
               and _by_chance(in_toxic[s], in_clean.get(s, 0), share) * tried < 1]
    insults: dict[str, float] = {}
    for stem in sorted(telling, key=lambda s: (-in_toxic[s], -len(s), s)):
        # The longest of equally supported stems stands for them: a prefix of a chosen stem needs texts of its own,
        # and a longer stem says no more than a chosen prefix of it.
        longer = max((in_toxic[s] for s in insults if s.startswith(stem)), default=0)
        if in_toxic[stem] >= longer + SUPPORT and not any(stem[:n] in insults for n in range(4, len(stem))):
            insults[stem] = odds[stem]
    for word in INSULTS:
        if not any(word[:n] in insults for n in range(3, len(word) + 1)):
            insults[word] = PRIOR
    return Lexicon(insults, {w: PRIOR for w in THREATS})


def _training_features(rows: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in W.sliced(batches, "text", SLICE):
            values = [matcher.features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    got = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(
        run, "x array<double>, toxic int").toPandas()
    return np.array(got["x"].tolist()), got["toxic"].to_numpy(float)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 3000) -> tuple[float, ...]:
    """Logistic regression towards ``PRIOR_WEIGHTS`` inside the order of ``_ordered``, by projected gradient."""
    x = np.hstack([x, np.ones((len(x), 1))])
    prior = np.array(PRIOR_WEIGHTS)
    strength = np.full(len(prior), STRENGTH)
    strength[-1] = 1e-2
    step = 1 / (0.25 * np.linalg.norm(x, 2) ** 2 + strength.max())
    w = ahead = prior
    for k in range(rounds):
        slope = x.T @ (1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30))) - y) + strength * (ahead - prior)
        w, last = _ordered(ahead - step * slope), w
        ahead = w + k / (k + 3) * (w - last)
    return tuple(float(v) for v in w)


def _ordered(w: np.ndarray) -> np.ndarray:
    """The weights with plain >= 0, targeted >= plain, and a quarter of plain >= negated and reported >= 0."""
    w = w.copy()
    insult, insult_target, negated, reported, threat, threat_target = range(6)
    for plain, target in ((insult, insult_target), (threat, threat_target)):
        w[plain] = max(w[plain], 0.0)
        w[target] = max(w[target], w[plain])
    for weak in (negated, reported):
        w[weak] = min(max(w[weak], 0.0), min(w[insult], w[threat]) / 4)
    return w


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def scored(docs: DataFrame, model: Model, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with a score (0 to 1) and the prediction (1 from 0.5 on), from the text alone.

    A null text scores as an empty one. Rows are independent, all columns stay but those that bear the
    two names of the results, which are replaced. Texts of any length are read whole, and no rows give no rows.
    """
    docs = docs.drop(score, predicted)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value.lexicon)
        for batch in W.sliced(batches, "text", SLICE):
            values = np.array([matcher.features(t or "") for t in batch.column("text").to_pylist()])
            found = shared.value.score(values.reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                [*names, score, predicted])

    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()),
                           T.StructField(predicted, T.IntegerType())])
    return docs.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns whatever their names."""
    mark = "toxic"
    while any(mark in c for c in docs.columns):
        mark += "_"
    return scored(docs, model, f"{mark}score", f"{mark}predicted").filter(F.col(f"{mark}predicted") == 0).select(*docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each of ``documents``; a fifth of the ids is never learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs.filter(~held_out()), labels.filter(~held_out()))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
