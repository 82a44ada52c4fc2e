"""Toxicity of whole texts by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.llm.common import bounded_sample, fold, release, slices, small_batches

# Starting words of the grammar's classes, in the four languages of the corpus.
INSULTS = "idiot moron loser scum trash stupid pathetic disgusting worthless clown dumb imbecile filth vermin idioten dummkopf abschaum trottel imbécile crétin ordure débile imbécil estúpido basura escoria".split()
THREATS = "kill hurt destroy beat burn shoot stab hang töten umbringen vernichten schlagen abstechen tuer détruire frapper matar destruir golpear".split()
TARGETS = "you your yours u he him she her they them those people du dir ihr sie toi tu eux leur tú usted ustedes ellos".split()
# Object pronouns that may stand before their verb.
OBJECTS = "dich euch vous te os".split()
NEGATIONS = "not no never isn't aren't wasn't don't nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say wrote called calls claimed quoted reported sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|,")
_CLAUSE_END = re.compile(r"[.!?;:\n]")
#: Lengths of word beginnings that can become stems.
STEMS = (4, 5, 6)

# The transducers: each rewrites a clause of one letter per word, and they are applied in turn.
# I insult, T threat, Y target, O object before its verb, N negation, R report, w other, a comma itself; the results are
# i negated, q reported, A insult with a target, H threat with a target; a threat alone stays T.
# Reports reach over commas ("he said, you idiot"), negations do not ("no, you idiot"), targets only as an address ("you, idiot").
TRANSDUCERS = (
    ("reported", re.compile(r"R[wYON,]{0,6}?([IT])"), {"I": "q", "T": "q"}),
    ("negated", re.compile(r"N[wYO]{0,2}([IT])"), {"I": "i", "T": "i"}),
    ("targeted before", re.compile(r"[YO](?:,|[wN]{0,3})([I])"), {"I": "A"}),
    ("targeted after", re.compile(r"([I])(?:,|[wN]{0,2})[YO]"), {"I": "A"}),
    ("threatened", re.compile(r"([T])[wN]{0,3}[YO]"), {"T": "H"}),
    ("threatened before", re.compile(r"O[w]{0,2}([T])"), {"T": "H"}),
)
OUTCOMES = "IAiqHT"
#: Outcomes in which the clause means what its word says.
DIRECT = frozenset("IAH")
#: What the arc of an outcome weighs before anything is learnt.
ARCS = {"I": 1.0, "A": 2.0, "i": -1.0, "q": -1.0, "H": 2.0, "T": 0.0}


def transduced(tags: str) -> str:
    """The composed transducers' output over one clause of tags, one letter a word as before."""
    for _, pattern, rewrite in TRANSDUCERS:
        tags = pattern.sub(lambda m, rewrite=rewrite: m.group(0)[: m.start(1) - m.start()] + rewrite[m.group(1)] + m.group(0)[m.end(1) - m.start():], tags)
    return tags


def clause_outcomes(tags: str) -> str:
    """The matched outcomes of a clause alone."""
    return "".join(t for t in transduced(tags) if t in OUTCOMES)


@dataclass
class ToxicityModel:
    """stems: beginnings or whole words (with a space after) and their weights; bias and coefficients of the final sum; arcs: weights by outcome."""

    stems: dict[str, float] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=list)
    arcs: dict[str, float] = field(default_factory=lambda: dict(ARCS))

    def matcher(self) -> Matcher:
        return Matcher(self.stems, self.arcs)


class Matcher:
    """Finds the stems in a text, and the clauses around them."""

    def __init__(self, stems: dict[str, float], arcs: dict[str, float]):
        self.stems, self.arcs = stems, arcs
        self.machine = ahocorasick.Automaton()
        for s in stems:
            self.machine.add_word(s.rstrip(" "), s)
        for s in THREATS:
            if s not in stems and s + " " not in stems:
                self.machine.add_word(s, s + "\0")
        self.machine.make_automaton()
        self.small = {w: t for words, t in ((TARGETS, "Y"), (OBJECTS, "O"), (NEGATIONS, "N"), (REPORTS, "R"), (THREATS, "T"), ((",",), ",")) for w in words}

    def tag(self, word: str) -> tuple[str, float]:
        found = [self.stems[w] for w in (word + " ", *(word[:n] for n in STEMS if len(word) >= n)) if w in self.stems]
        return ("I", max(found)) if found else (self.small.get(word, "w"), 0.0)

    def features(self, text: str) -> list[float]:
        """Logs of the counts of each outcome, of the weights and the number of distinct stems that clauses let stand, their density, and the heaviest clause.

        A negated or reported insult adds to its own outcome's count alone:
        weights, stems and density are summed over direct outcomes.  A clause
        weighs the sum of its arcs times the weights of their stems, so what
        is negated or reported in it takes away from it.
        """
        low = text.lower()
        counts = dict.fromkeys(OUTCOMES, 0)
        weight, heaviest, stems, clauses = 0.0, 0.0, set(), {}
        for end, stem in self.machine.iter(low):
            begin = end + 1 - len(stem.rstrip(" \0"))
            if begin and low[begin - 1].isalpha() or stem[-1] in " \0" and low[end + 1:end + 2].isalpha():
                continue
            left = max(low.rfind(c, 0, begin) for c in ".!?;:\n") + 1
            if left not in clauses:
                right = _CLAUSE_END.search(low, end)
                clauses[left] = low[left:right.start() if right else len(low)]
        for clause in clauses.values():
            words = _TOKEN.findall(clause)
            tagged = [self.tag(w) for w in words]
            here = 0.0
            for w, o, (_, x) in zip(words, transduced("".join(t for t, _ in tagged)), tagged, strict=True):
                if o in counts:
                    counts[o] += 1
                    here += self.arcs[o] * max(x, 1.0)
                if o in DIRECT:
                    weight += x
                    stems.add(w)
            heaviest = max(heaviest, here)
        density = 100 * sum(counts[o] for o in DIRECT) / (1 + low.count(" "))
        return [1.0, *(math.log1p(counts[o]) for o in OUTCOMES), math.log1p(weight), math.log1p(len(stems)), math.log1p(density), math.log1p(heaviest)]


def _word_marks(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return {w + " " for w in words} | {w[:n] for n in STEMS for w in words if len(w) >= n}


def _sketch(text: str) -> int:
    """Least hash of five-word shingles: copies and near copies mostly share it."""
    words = text.lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(words[k:k + 5]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(words) - 4))), default=0) >> 1


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, left_out: int = 1, most: int = 16_000, stems: int = 4_000) -> ToxicityModel:
    """Learns the insult class and the weights from labelled documents that are not in fold `left_out`.

    At most `most` labels are used, chosen by a hash of the id: this bound
    holds at every corpus size.  A word or word beginning joins the insult
    class if it is so much more frequent in toxic documents that, among all
    that were tried, less than one would be so by chance; copies count once.
    The starting words have a weight before anything is learnt.  The arc of an
    outcome weighs how far the share of toxic documents that have it is beyond
    that of others, as a log; clauses add up arcs, and the document's sums are
    weighed by logistic regression.  Without labels of
    both kinds the starting words alone decide.  Ids may be of any type; other
    columns are ignored, whatever their names; null texts are left out.
    """
    prior = {f"{w} ": 2.0 for w in INSULTS}
    # Order: bias, OUTCOMES, weight, stems, density, heaviest.
    model = ToxicityModel(prior, [-2.0, 1.5, 2.5, 0.3, 0.3, 3.0, 0.0, 0.5, 0.5, 0.5, 0.5])
    known = labels.where((fold(F.col("doc_id"), folds) != left_out) & F.col("toxic").isNotNull())
    known = bounded_sample(known.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic")), F.col("doc_id"), most)
    known = known.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("draw"), "text", F.col("_toxic").alias("toxic"))

    def marks(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):  # marks take more room than texts
                part = batch.slice(at, 100)
                texts = part.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([_sketch(t) for t in texts], pa.int64()), part.column(1), pa.array([sorted(_word_marks(t)) for t in texts], pa.list_(pa.string()))], names=["sketch", "toxic", "marks"])
        release()

    small_batches(rows.sparkSession)
    single = rows.select("text", "toxic").mapInArrow(marks, "sketch long, toxic long, marks array<string>").groupBy("sketch", "toxic").agg(F.min("marks").alias("marks")).cache()
    totals = {r["toxic"]: r["count"] for r in single.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        single.unpersist()
        return model
    seen = single.select("toxic", F.explode("marks").alias("mark")).groupBy("mark").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).where("bad >= 3")
    # How far the mark's share in toxic documents is from chance, as twice a log-likelihood ratio.
    share = bad / (bad + good)
    part = F.col("bad") / (F.col("bad") + F.col("good"))
    rest = F.when(F.col("good") == 0, 0.0).otherwise(F.col("good") * F.log((1 - part) / (1 - share)))
    seen = seen.withColumn("ratio", 2 * (F.col("bad") * F.log(part / share) + rest)).where((part > 2 * share) & (part > 0.6)).cache()
    tried = max(2, single.select(F.explode("marks").alias("mark")).groupBy("mark").count().where("count >= 3").count())
    found = seen.where(F.col("ratio") > max(14.0, 2 * math.log(tried) - 4)).orderBy(F.desc("ratio"), "mark").limit(stems).collect()
    single.unpersist()
    seen.unpersist()
    learnt = {r["mark"]: math.log((r["bad"] + 0.5) / (r["good"] + 0.5) * (good / bad)) for r in found}
    model = ToxicityModel(prior | learnt)

    x, y = _vectors(rows, model)
    has = x[:, 1:1 + len(OUTCOMES)] > 0
    of_bad, of_good = has[y == 1].sum(0), has[y == 0].sum(0)
    model.arcs = dict(zip(OUTCOMES, np.log((of_bad + 0.5) / (y.sum() + 1) * ((1 - y).sum() + 1) / (of_good + 0.5)).tolist(), strict=True))
    x, y = _vectors(rows, model)
    model.coefficients = _logistic(x, y).tolist()
    return model


def _vectors(rows: DataFrame, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled sample, in the order of its draw."""

    def vectors(batches):
        matcher = model.matcher()
        for batch in batches:
            x = [matcher.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["draw", "toxic", "x"])

    fitted = rows.mapInArrow(vectors, "draw long, toxic long, x array<double>").toArrow()
    order = np.argsort(fitted["draw"].to_numpy(), kind="stable")
    return np.array(fitted["x"].to_pylist())[order], (fitted["toxic"].to_numpy() > 0).astype(float)[order]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 40) -> np.ndarray:
    """Newton's method for regularised logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, score (0 to 1, higher: likelier toxic) and outcomes of every whole text.

    `outcomes` are the counts of OUTCOMES in matched clauses.  Null and empty
    texts match nothing and get the score of such a text.  Very long texts cost
    their length; equal texts get equal scores; other columns are ignored.
    """
    schema = T.StructType(docs.select(*keep).schema.fields + T.StructType.fromDDL("score double, outcomes array<int>").fields)

    def over(batches):
        matcher, w = model.matcher(), np.array(model.coefficients)
        for batch in (part for whole in batches for part in slices(whole)):
            x = np.array([matcher.features(t or "") for t in batch.column(len(keep)).to_pylist()]).reshape(-1, len(w))
            p = 1 / (1 + np.exp(-(x * w).sum(1)))
            counts = np.expm1(x[:, 1:1 + len(OUTCOMES)]).round().astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(p), pa.array(list(counts), pa.list_(pa.int32()))], names=schema.names)
        release()

    small_batches(docs.sparkSession)
    return docs.select(*keep, text).mapInArrow(over, schema)
