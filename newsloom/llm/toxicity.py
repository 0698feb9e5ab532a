"""Toxicity by a weighted finite-state grammar over clauses.

A text is cut into clauses, and each word of a clause is a symbol: insult,
threat, target, negation, reporting verb, quotation mark or other.  Five
transducers read the symbols one after another:

* *reported speech* marks what stands between quotation marks or follows a
  reporting verb inside the clause,
* *negation* marks what follows a negation within three words,
* *target* marks what has a person as its target, up to three words before
  it or, read from the end of the clause, after it,
* *insult* and *threat* turn marked symbols into matches and let all else
  go; a threat without a target is none.

Composition makes one machine of those that read forwards; the match kinds
are the context in which an insult or a threat stands.  A clause without
either has no match and is not read at all.  The score of a text is a
logistic function of its matches by kind, their weights and the text's
length; isolated words have no weight outside these clauses.

What counts as an insult is learned: words and word beginnings whose
occurrences in toxic training texts exceed those in the others, with the log
of the odds as weight.  The other lists are fixed and short.  The function's
coefficients are fitted with a prior, from texts scored by an insult list to
which they did not contribute, so a kind of match that training does not show
keeps its prior meaning: a negated or reported insult counts for a quarter of
a plain one.

Training rows are a bounded sample: ``TRAINING_ROWS`` labelled documents at
most, those of the smallest hash of their id.  Held-out rows (crc32 of the id
mod 4 is 2) are never among them.  Labels, lang, source and ids are no input
of a score.

Defined cases: a null or empty text has no match and gets the score of a
text without words.  A null doc_id is held out of training and ``held_out``
is false.  Repeated rows get equal scores; repeated or contradicting labels
of one id count as toxic if one of them says 1.  Without any training row of
either kind every score is the share of toxic training rows (0 without
training rows).  Texts and clauses may be of any length.  Further columns are
not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.scratch import Scratch

#: Labelled documents that the model is fitted on, at most.
TRAINING_ROWS = 30_000
#: Word beginnings of these lengths can be insults, besides whole words.
BEGINNINGS = range(3, 9)
#: An insult occurs in so many toxic texts at least, has log odds of so much, and exceeds chance by so many standard deviations.
LEAST_TEXTS, LEAST_ODDS, LEAST_SIGMA = 5, 2.0, 5.0
#: Insults that a model keeps at most: those of the most evidence.
INSULTS = 20_000
#: From this score on a text is predicted toxic.
THRESHOLD = 0.3
#: Words that a negation or a target reaches.
REACH = 3

# Persons that an insult or a threat can have as its target, negations, reporting verbs and threats, in the four languages of the corpus.
TARGETS = "you your you're u he she they him her them his their du dich dir dein deine ihr euch euer sie er tu te toi vous votre ton ta tes il elle ils elles tú ti vosotros usted ustedes él ella ellos ellas"
NEGATIONS = "not no never nobody isn't aren't don't doesn't wasn't without nicht kein keine keinen nie niemals ohne ne pas jamais aucun aucune sans non nunca jamás ningún ninguna sin"
REPORTING = "said says say told tells wrote writes claimed claims called quoted according sagte sagt schrieb schreibt behauptet nannte laut dit disait écrit écrivit affirme selon dijo dice escribió afirma según"
THREATS = "kill hurt destroy murder beat shoot stab burn hang strangle töten umbringen schlagen vernichten erschießen tuer frapper détruire brûler égorger matar golpear destruir quemar disparar"

# Symbols of a clause.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
SYMBOLS = 7
#: Marks that the first three transducers leave on an insult or a threat.
TARGETED, NEGATED, REPORTED = 1, 2, 4
#: Match kinds: insult or threat, each in eight contexts.
KINDS = 16
_CUT = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:,\n]+|[\"“”„«»]")


@dataclass(frozen=True)
class Transducer:
    """``go[state, symbol]`` is the next state, ``say[state, symbol]`` the symbol passed on; reading starts in state 0."""

    go: np.ndarray
    say: np.ndarray

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one says."""
        n, m, k = len(self.go), len(other.go), self.go.shape[1]
        go, say = np.zeros((n * m, k), np.int64), np.zeros((n * m, k), np.int64)
        for a, b in product(range(n), range(m)):
            said = self.say[a]
            go[a * m + b] = self.go[a] * m + other.go[b, said]
            say[a * m + b] = other.say[b, said]
        return Transducer(go, say)


def _marker(states: int, step, mark: int) -> Transducer:
    """A transducer that passes symbols on and adds ``mark`` to insults and threats in every state but 0.

    Symbols from 7 on are marked ones: 7 + 8 * (insult or threat) + marks.
    """
    k = SYMBOLS + KINDS
    go, say = np.zeros((states, k), np.int64), np.tile(np.arange(k), (states, 1))
    for s, x in product(range(states), range(k)):
        plain = x if x < SYMBOLS else INSULT if x < SYMBOLS + 8 else THREAT
        go[s, x] = step(s, plain)
        if plain in (INSULT, THREAT):
            marks = 0 if x < SYMBOLS else (x - SYMBOLS) % 8
            say[s, x] = SYMBOLS + 8 * (plain == THREAT) + (marks | (mark if s else 0))
    return Transducer(go, say)


def _reach(opens: int):
    """Steps of a state that counts down from ``REACH`` after the symbol ``opens``."""
    return lambda s, x: REACH if x == opens else max(s - 1, 0)


def backward() -> Transducer:
    """Reads a clause from its end: insults and threats with a target up to three words after them are marked."""
    return _marker(REACH + 1, _reach(TARGET), TARGETED)


def grammar() -> Transducer:
    """The composed machine: a clause's symbols to match symbols (7 + 8 * threat + marks), ``OTHER`` for no match."""
    # state 1: after a reporting verb, until the clause ends; 2: inside quotation marks
    reported = _marker(3, lambda s, x: {QUOTE: 0 if s == 2 else 2, REPORT: 1 if s == 0 else s}.get(x, s), REPORTED)
    negated = _marker(REACH + 1, _reach(NEGATION), NEGATED)
    targeted = _marker(REACH + 1, _reach(TARGET), TARGETED)
    return reported.then(negated).then(targeted).then(_matches(INSULT, lambda marks: True)).then(_matches(THREAT, lambda marks: marks & TARGETED))


def _matches(symbol: int, counts) -> Transducer:
    """One state: marked insults or threats are matches where ``counts`` holds for their marks, the other kind passes, and unmarked symbols end here."""
    k = SYMBOLS + KINDS
    say = np.where(np.arange(k) >= SYMBOLS, np.arange(k), OTHER)
    low = SYMBOLS + 8 * (symbol == THREAT)
    say[low : low + 8] = [low + marks if counts(marks) else OTHER for marks in range(8)]
    return Transducer(np.zeros((1, k), np.int64), say[None])


def _symbols() -> dict[str, int]:
    """Fixed words of the grammar."""
    lists = ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTING, REPORT))
    return {w: s for words, s in lists for w in words.split()} | dict.fromkeys('"“”„«»', QUOTE)


class Reader:
    """Reads texts by the grammar with one insult list; remembers the words it has met, up to a bound."""

    def __init__(self, insults: dict[str, float], remembered: int = 200_000):
        self.machines = [(m.go.tolist(), m.say.tolist()) for m in (backward(), grammar())]
        self.fixed, self.insults, self.remembered = _symbols(), insults, remembered
        self.known: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        """Symbol of a word and its weight as an insult; the heaviest of the word and its beginnings counts."""
        found = self.known.get(word)
        if found is None:
            fixed = self.fixed.get(word, OTHER)
            weight = max((self.insults.get(u, 0.0) for u in units(word)), default=0.0)
            found = (INSULT, weight) if weight and fixed == OTHER else (fixed, 1.0)
            if len(self.known) >= self.remembered:
                self.known.clear()
            self.known[word] = found
        return found

    def features(self, text: str | None) -> np.ndarray:
        """Sum of match weights by kind, and the number of words."""
        out = np.zeros(KINDS + 1)
        tokens = _CUT.findall((text or "").lower())
        get, symbol = self.known.get, self.symbol
        clause, hit = [], False
        for t in tokens:
            if t[0] in ".!?;:,\n":
                if hit:
                    self._match(clause, out)
                clause, hit = [], False
                continue
            s = get(t) or symbol(t)
            out[KINDS] += s[0] != QUOTE
            if s[0]:
                hit = hit or s[0] <= THREAT
            clause.append(s)
        if hit:
            self._match(clause, out)
        return out

    def _match(self, clause: list[tuple[int, float]], out: np.ndarray) -> None:
        said = [s for s, _ in clause]
        for go, say in self.machines:  # each reads in the other direction
            state = 0
            said.reverse()
            for i, symbol in enumerate(said):
                said[i] = say[state][symbol]
                state = go[state][symbol]
        for kind, (_, weight) in zip(said, clause, strict=True):
            if kind >= SYMBOLS:
                out[kind - SYMBOLS] += weight


def units(word: str) -> list[str]:
    """The word as a whole (with a bar at its end) and its beginnings."""
    return [word + "|", *(word[:k] for k in BEGINNINGS if k < len(word))]


#: What a match is worth beside a plain one before training has shown any of its kind.
_PRIOR = np.array([(1.0 if not marks & (NEGATED | REPORTED) else 0.25) * (1.25 if marks & TARGETED else 1.0) * (1.0 if kind == 0 else 0.25) for kind in (0, 1) for marks in range(8)])


def design(features: np.ndarray) -> np.ndarray:
    """Columns of the logistic function: one, prior-weighted evidence (as a log and per word), by-kind evidence, length."""
    kinds, words = features[:, :KINDS], features[:, KINDS]
    evidence = kinds @ _PRIOR
    some = np.log1p(kinds)
    return np.column_stack([np.ones(len(words)), np.log1p(evidence), np.minimum(100 * evidence / np.maximum(words, 1), 20.0), evidence > 0, np.log1p(words), np.log1p(evidence) * np.log1p(words), some])


def fit(features: np.ndarray, labels: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Coefficients by Newton steps with a ridge; kinds that do not occur keep their prior (0 beside the weighted evidence)."""
    x = design(features)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.05)
    ridge[0] = 1e-6
    ridge[6:] = 2.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (labels - p) - ridge * w)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """text, toxic and fold of at most ``rows`` labelled documents that are not held out."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") == 1).cast("int").alias("toxic"))
    marks = marks.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(marks), "id").select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"))  # copies share a fold


def held_out(doc_id: Column) -> Column:
    """True for the rows that training never sees."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


_UNIT = pa.schema([("unit", pa.string()), ("toxic", pa.int32()), ("fold", pa.int32()), ("n", pa.int64())])


def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold each unit, by label and fold, added up for a batch."""
    for batch in batches:
        sums: dict[tuple[str, int, int], int] = {}
        for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for u in {u for word in set(_CUT.findall(text.lower())) if word[0].isalpha() for u in units(word)}:
                at = u, toxic, fold
                sums[at] = sums.get(at, 0) + 1
        keys = list(sums)
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.record_batch([*(list(c) for c in zip(*part, strict=True)), [sums[k] for k in part]], schema=_UNIT)


def insult_lists(train: DataFrame) -> list[dict[str, float]]:
    """Insults with their weights: from fold 1, from fold 0, and from both."""
    spark = train.sparkSession
    units_ = train.select("text", "toxic", "fold").mapInArrow(_unit_counts, "unit string, toxic int, fold int, n long")
    texts = {(r.toxic, r.fold): r["count"] for r in train.groupBy("toxic", "fold").count().collect()}
    sums = units_.groupBy("unit").agg(*[F.sum(F.when((F.col("toxic") == t) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"n{t}{f}") for t in (0, 1) for f in (0, 1)])
    out = []
    kept = Scratch(spark, "toxicity").save(sums.where(F.col("n10") + F.col("n11") >= LEAST_TEXTS), "units")
    for folds in ((1,), (0,), (0, 1)):
        bad, good = (sum((F.col(f"n{t}{f}") for f in folds), F.lit(0)) for t in (1, 0))
        all_bad, all_good = (sum(texts.get((t, f), 0) for f in folds) for t in (1, 0))
        if not all_bad or not all_good:
            out.append({})
            continue
        odds = F.log((bad + 0.5) / (all_bad + 1.0)) - F.log((good + 0.5) / (all_good + 1.0))
        chance = (bad + good) * (all_bad / (all_bad + all_good))
        sigma = (bad - chance) / F.sqrt(chance + 0.5)
        rows = kept.select("unit", odds.alias("odds"), sigma.alias("sigma")).where((bad >= LEAST_TEXTS) & (F.col("odds") >= LEAST_ODDS) & (F.col("sigma") >= LEAST_SIGMA))
        out.append({r.unit: r.odds for r in rows.orderBy(F.desc("sigma"), "unit").limit(INSULTS).collect()})
    return out


def _scored(insults: dict[str, float], weights: np.ndarray | None, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(insults)
        for batch in batches:
            features = np.array([reader.features(t) for t in batch.column(1).to_pylist()]).reshape(-1, KINDS + 1)
            score = np.full(len(features), share) if weights is None else 1 / (1 + np.exp(-np.clip(design(features) @ weights, -30, 30)))
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array(features[:, :KINDS].sum(axis=1))], names=["doc_id", "score", "matched"])

    return run


def _features(insults: list[dict[str, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(i) for i in insults]
        for batch in batches:
            text, toxic, fold = (c.to_pylist() for c in batch.columns)
            rows = [readers[f].features(t).tolist() for t, f in zip(text, fold, strict=True)]
            yield pa.record_batch([pa.array(rows, pa.list_(pa.float64())), pa.array(toxic, pa.int32())], names=["features", "toxic"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and matched (the weight of all matches) of every document."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    train = scratch.save(training_rows(docs, labels, rows), "training")
    lists = insult_lists(train)
    seen = train.select("text", "toxic", "fold").mapInArrow(_features(lists[:2]), "features array<double>, toxic int").toPandas()  # bounded by rows
    y = seen["toxic"].to_numpy(float)
    share = float(y.mean()) if len(y) else 0.0
    weights = fit(np.array(seen["features"].tolist()), y) if 0 < share < 1 else None
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(_scored(lists[2], weights, share), f"doc_id {kind}, score double, matched double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "matched")
