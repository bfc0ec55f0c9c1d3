"""Toxicity by a weighted finite-state pattern grammar.

A lexicon turns words into classes: insults and threats carry weights; persons, articles, modals, negations, reporting verbs
and quotes carry none. Five small transducers read the classes of a clause: an insult counts more after another one; a
threat counts only before a person, and more after a modal; a target gives an insult its weight, a person more than an article, an
article more than another insult, a near person more than a far one, and none of these in the clause none at all; negation scales down what stands in its reach; reported
speech what is quoted. The target may stand on either side: what follows is known from a run from right to left, so the
composition, made once as a table, is a bimachine: two runs score a clause. Words alone score nothing. A document's clause
scores (sum, peak, sum for each fifty words) give its score by logistic regression.

Learned from labelled rows, of which at most ``most_rows`` are sampled: the weights of words and word stems
(non-negative, sparse logistic regression; stems find inflected forms that no labelled row holds), and the last regression,
shifted to the labels' share of positives. Seed insults and threats keep a default weight where the sample does not hold them.

Defined results. Null or empty text, a text of one word, or text without a matched clause: the least score that the model gives (not
0). With fewer than ``LEAST_ROWS`` sampled rows of either label only the seeds score, by fixed weights. A null id is scored, never learned from,
and not held out. Of several labels for one id the largest counts, of several texts of an id one is learned from. Very
long texts are scored whole. Ties in weight keep all words. Rows that repeat give equal rows; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import labelled_sample, remainder
from .shared import small_batches

# Seed words of the classes, in English, German, French and Spanish.
INSULTS = "idiot moron stupid scum trash loser pathetic worthless disgusting clown".split()
THREATS = (
    "kill kills killed killing hurt hurts hurting destroy destroys destroyed destroying beat beats beating shoot shoots shooting stab stabs stabbing punish punishes attack attacks attacking burn burns burning crush crushes crushing "
    "töte töten tötet schlage schlagen schlägt erschieße erschießen verletze verletzen vernichte vernichten "
    "tuer tue tuerai frapper frappe blesser blesse détruire détruis "
    "matar mato mataré golpear golpeo herir hiero destruir destruyo"
).split()
PERSONS = (
    "you your yours yourself u ur he him his she her they them their these those we us our who "
    "du dich dir ihr ihn ihm euch sie er wir uns wer "
    "tu te toi vous il elle ils elles nous lui leur qui "
    "tú usted ustedes él ella ellos ellas nosotros quien"
).split()
ARTICLES = "the a an this that such what der die das den dem des ein eine einen einer einem le la les un une ce cet cette que el los las una este esta ese esa lo".split()
MODALS = "will shall would gonna going must should werde wirst wird werden soll sollte vais va vas vamos voy debe doit".split()
NEGATIONS = "not no never without neither nor isn't aren't wasn't don't doesn't didn't won't can't nicht kein keine nie ne pas jamais nunca".split()
REPORTS = "said says say told tells wrote writes reported claimed alleged quoted called sagte dit dijo".split()

OTHER, INSULT, THREAT, PERSON, ARTICLE, MODAL, NEGATION, REPORT, QUOTE = range(9)
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»„]")
_LETTERS = re.compile(r"[^\W\d_]+")
#: A single stop or an empty line ends a clause; several stops in a row are emphasis, and a line break alone is none, as lines are wrapped.
_STOP = re.compile(r"(?<![.!?])[.!?;:](?![.!?])|\n(?=[^\S\n]*\n)")
STEMS = range(4, 9)
#: Sampled rows of each label that it takes to learn.
LEAST_ROWS = 5
_SEED_WEIGHT = 0.5


# ---- transducers: a step (state, class) -> state, and a factor (state, class) of an insult's or threat's weight -----------


class Insults:
    """0: no insult yet, 1: one out of reach, 2 to 4: one within three words, after which the next counts more."""

    def step(self, state: int, kind: int) -> int:
        return 4 if kind == INSULT else max(state - 1, 1) if state else 0

    def factor(self, state: int, kind: int) -> float:
        return 1.2 if state > 1 and kind == INSULT else 1.0


class Threats:
    """A threat within three words after a modal counts more."""

    def step(self, state: int, kind: int) -> int:
        return 3 if kind == MODAL else max(0, state - 1)

    def factor(self, state: int, kind: int) -> float:
        return 1.5 if state and kind == THREAT else 1.0


class Negation:
    """Three words after a negation are in its reach."""

    def step(self, state: int, kind: int) -> int:
        return 3 if kind == NEGATION else max(0, state - 1)

    def factor(self, state: int, kind: int) -> float:
        return 0.3 if state else 1.0


class Reported:
    """State 1 after a reporting verb, 2 between quotes; either lasts to the clause's end or the closing quote."""

    def step(self, state: int, kind: int) -> int:
        if kind == QUOTE:
            return 0 if state == 2 else 2
        return 1 if kind == REPORT and state == 0 else state

    def factor(self, state: int, kind: int) -> float:
        return 0.5 if state else 1.0


class Target:
    """0: none yet, 1: another insult only (who calls names calls someone), 2: an article, 3: a person out of reach, 4 to 7: a
    person within four words. Read in both directions."""

    def step(self, state: int, kind: int) -> int:
        if kind == PERSON:
            return 7
        return max(state - 1, 3) if state > 3 else max(state, {ARTICLE: 2, INSULT: 1}.get(kind, 0))

    def aimed(self, before: int, after: int, kind: int) -> float:
        if kind == THREAT:
            return 1.0 if after > 3 else 0.0
        return (0.0, 0.6, 0.8, 1.0, 1.5)[min(4, max(before, after))]


_KINDS = 9


def compose() -> tuple[list[list[int]], list[list[int]], list[list[tuple[float, float]]]]:
    """(forward steps, backward steps, factors): the table of the composition.

    Steps by state and class; factors by forward and backward state, for insults and threats.
    """
    parts, target = (Insults(), Threats(), Negation(), Reported()), Target()
    names: dict[tuple, int] = {(0,) * (len(parts) + 1): 0}
    order, forward = [*names], []
    for state in order:
        row = []
        for kind in range(_KINDS):
            to = tuple(p.step(s, kind) for p, s in zip((*parts, target), state))
            if to not in names:
                names[to] = len(names)
                order.append(to)
            row.append(names[to])
        forward.append(row)
    backward = [[target.step(s, kind) for kind in range(_KINDS)] for s in range(8)]
    factors = [[tuple(float(np.prod([p.factor(s, kind) for p, s in zip(parts, state)])) * target.aimed(state[-1], after, kind) for kind in (INSULT, THREAT)) for after in range(8)] for state in order]
    return forward, backward, factors


@dataclass
class Grammar:
    """The lexicon's weights and the composed table; ``final``: the last regression's bias and three weights."""

    stems: dict[str, float]
    words: dict[str, float]
    final: tuple[float, float, float, float] = (-4.0, 4.0, 1.0, 0.5)
    _machine: object = field(default=None, repr=False)

    def __getstate__(self):
        return (self.stems, self.words, self.final)

    def __setstate__(self, state):
        self.stems, self.words, self.final = state
        self._machine = None

    def _ready(self):
        if self._machine is None:
            machine = ahocorasick.Automaton()
            for s in itertools.chain(self.stems, self.words, THREATS):
                machine.add_word(s, s)
            machine.make_automaton()
            self._forward, self._backward, self._factors = compose()
            classes = ((PERSON, PERSONS), (ARTICLE, ARTICLES), (MODAL, MODALS), (NEGATION, NEGATIONS), (REPORT, REPORTS))
            self._kind = {w: k for k, ws in reversed(classes) for w in ws}
            self._threats = frozenset(THREATS)
            self._machine = machine
        return self._machine

    def weight(self, word: str) -> float:
        return self.words.get(word, 0.0) + sum(self.stems.get(word[:n], 0.0) for n in STEMS if len(word) >= n)

    def classes(self, text: str) -> tuple[list[int], list[float]]:
        """The classes and weights of a lower-cased clause's words and quotes."""
        self._ready()
        kinds, weights = [], []
        for m in _WORD.finditer(text):
            word = m[0]
            w = self.weight(word)
            if len(word) == 1 and not word.isalpha():
                kind, w = QUOTE, 0.0
            elif word in self._threats:
                kind, w = THREAT, w or _SEED_WEIGHT
            elif w > 0:
                kind = INSULT
            else:
                kind = self._kind.get(word, OTHER)
            kinds.append(kind)
            weights.append(w)
        return kinds, weights

    def clause(self, text: str) -> float:
        """The score of one clause, lower-cased: a run from the right, then one from the left that adds up weights."""
        kinds, weights = self.classes(text)
        after, now = [], 0
        for kind in reversed(kinds):
            after.append(now)
            now = self._backward[now][kind]
        total, state = 0.0, 0
        for kind, w, ahead in zip(kinds, weights, reversed(after)):
            if w:
                total += w * self._factors[state][ahead][kind - INSULT]
            state = self._forward[state][kind]
        return total

    def matched(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, score) of the clauses that score, in a lower-cased text."""
        if not text:
            return []
        out, last = [], -1
        stops: list[int] | None = None
        for end, s in self._ready().iter(text):
            start = end - len(s) + 1
            if start < last or start and text[start - 1].isalpha():
                continue
            if s not in self.stems and end + 1 < len(text) and text[end + 1].isalpha():
                continue
            if stops is None:
                stops = [-1, *(m.start() for m in _STOP.finditer(text)), len(text)]
                k = 0
            while stops[k + 1] < start:
                k += 1
            a, last = stops[k] + 1, stops[k + 1]
            if (score := self.clause(text[a:last])) > 0:
                out.append((a, last, score))
        return out

    def features(self, text: str | None) -> tuple[float, float, float]:
        low = (text or "").lower()
        found = self.matched(low)
        if not found:
            return (0.0, 0.0, 0.0)
        total = sum(f[2] for f in found)
        words = low.count(" ") + low.count("\n") + 1
        return (float(np.log1p(total)), float(np.log1p(max(f[2] for f in found))), min(3.0, total * 50 / max(words, 50)))

    def score(self, text: str | None) -> float:
        z = self.final[0] + sum(a * b for a, b in zip(self.final[1:], self.features(text)))
        return float(1 / (1 + np.exp(-z)))


# ---- learning -------------------------------------------------------------------------------------------------


def text_features(text: str) -> Counter:
    """Counts of words (marked by a dollar sign) and of word stems."""
    out: Counter = Counter()
    for word, n in Counter(_LETTERS.findall(text.lower())).items():
        if len(word) >= 3:
            out[word + "$"] += n
        for k in STEMS:
            if len(word) >= k:
                out[word[:k]] += n
    return out


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = (Counter(), Counter())
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen[int(label)].update(text_features(text).keys())
    names = [*(seen[0].keys() | seen[1].keys())]
    for i in range(0, len(names), 50_000):
        part = names[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[1][x] for x in part], pa.int64()), pa.array([seen[0][x] for x in part], pa.int64())], ["feature", "pos", "neg"])


def _chosen(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {x: i for i, x in enumerate(held.value)}
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                rows.append({index[x]: n for x, n in text_features(text).items() if x in index})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(r) for r in rows], pa.list_(pa.int32())), pa.array([list(r.values()) for r in rows], pa.list_(pa.int32()))], ["label", "at", "n"])

    return run


def _clauses(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [held.value.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in x], pa.float64()) for k in range(3))], ["label", "a", "b", "c"])

    return run


def sparse_weights(x: np.ndarray, y: np.ndarray, penalty: float = 0.0005, rounds: int = 300) -> np.ndarray:
    """Non-negative logistic regression weights under an L1 penalty, classes weighed alike; accelerated proximal steps."""
    side = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(x.shape[1])
    bias, ahead, ahead_bias, t = 0.0, w.copy(), 0.0, 1.0
    scale = 0.25 * float((side[:, None] * x * x).sum(axis=0).max(initial=1e-9) * min(20, x.shape[1])) + 0.25
    for _ in range(rounds):
        g = side * (1 / (1 + np.exp(-np.clip(x @ ahead + ahead_bias, -30, 30))) - y)
        new = np.maximum(0, ahead - (x.T @ g + penalty) / scale)
        new_bias = ahead_bias - g.sum() / scale
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / t2 * (new - w), new_bias + (t - 1) / t2 * (new_bias - bias)
        w, bias, t = new, new_bias, t2
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Bias and weights by Newton steps, classes weighed alike."""
    x = np.hstack([np.ones((len(x), 1)), x])
    side = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (side * (p - y)) + ridge * np.r_[0, w[1:]]
        hess = (x * (side * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-9))
    return w


def learn(docs: DataFrame, labelled: DataFrame, *, most_rows: int = 4000, most_features: int = 3000) -> Grammar:
    """A grammar from at most ``most_rows`` rows; docs: (doc_id, text); labelled: (doc_id, label 0 or 1)."""
    spark = docs.sparkSession
    seeds = Grammar({}, dict.fromkeys(INSULTS, _SEED_WEIGHT))
    share = {r[0]: r[1] for r in labelled.groupBy("label").agg(F.count("*")).collect()}
    if not share.get(0) or not share.get(1):
        return seeds
    sample = labelled_sample(docs, labelled, most_rows // 2, "toxic")
    pairs = sample.select("label", "text")
    n = {r[0]: r[1] for r in sample.groupBy("label").agg(F.count("*")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if min(pos, neg) < LEAST_ROWS:
        return seeds
    counts = pairs.mapInArrow(_presence, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lift = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    least = max(2, pos // 200)
    best = counts.where(F.col("pos") >= least).withColumn("lift", lift).where(F.col("lift") > np.log(3)).orderBy((F.col("lift") * F.col("pos")).desc(), F.length("feature").desc(), "feature").limit(most_features).collect()
    names = [r[0] for r in best]
    grammar = seeds
    if names:
        held = spark.sparkContext.broadcast(names)
        rows = pairs.mapInArrow(_chosen(held), "label int, at array<int>, n array<int>").collect()
        x = np.zeros((len(rows), len(names)), np.float32)
        y = np.array([r[0] for r in rows])
        for i, r in enumerate(rows):
            x[i, r[1]] = np.log1p(r[2])
        w = sparse_weights(x.astype(np.float64), y)
        top = float(w.max(initial=0))
        keep = {names[i]: float(w[i] / top) for i in np.flatnonzero(w > 0.02 * top)} if top > 0 else {}
        words = {k[:-1]: v for k, v in keep.items() if k[-1] == "$"}
        stems = {k: v for k, v in keep.items() if k[-1] != "$"}
        grammar = Grammar(stems, words)
        for s in INSULTS:  # a seed that the sample does not judge keeps a default weight
            if grammar.weight(s) == 0:
                grammar.words[s] = _SEED_WEIGHT
    held = spark.sparkContext.broadcast(grammar)
    rows = pairs.mapInArrow(_clauses(held), "label int, a double, b double, c double").collect()
    y = np.array([r[0] for r in rows])
    fit = _logistic(np.array([r[1:] for r in rows], float), y)
    fit[1:] = np.maximum(fit[1:], 0.0)  # a matched clause never lowers a score
    fit[0] += np.log(share[1] / share[0])
    return Grammar(grammar.stems, grammar.words, tuple(map(float, fit)))


def _scores(held, carry: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = held.value
        for batch in batches:
            s = [grammar.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), *batch.columns[3:]], ["doc_id", "held_out", "score", *(["row"] if carry else [])])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", *, folds: int = 4, held_out: int = 2, threshold: float = 0.3, most_rows: int = 4000, carry: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; learns from labels outside the held-out fold only.

    carry: also gives ``row``, a struct of all columns of the row that the score is of.
    """
    small_batches(docs.sparkSession)
    fold = remainder(F.col("doc_id"), folds)
    own = [F.struct(*(F.col(c) for c in docs.columns)).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *own)
    known = labels.select(F.col(label_id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(fold != held_out)
    known = known.where("label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    grammar = learn(rows.select("doc_id", "text"), known, most_rows=most_rows)
    held = docs.sparkSession.sparkContext.broadcast(grammar)
    out = rows.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "text", *rows.columns[2:])
    schema = "doc_id long, held_out boolean, score double" + (f", row {rows.schema['row'].dataType.simpleString()}" if carry else "")
    out = out.mapInArrow(_scores(held, carry), schema)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
