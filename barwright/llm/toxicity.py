"""Toxicity by a weighted finite-state grammar over clauses.

Words become classes (insult, threat, target, negation, reporting verb) with weights. Three small
transducers are composed into one that runs over a clause's classes: negation damps what follows within three
words, a reporting verb or an opening quote damps what is quoted, a target strengthens insults and is needed for
threats. A clause scores the sum of the weights that come out; a document's clause scores are mapped to a
probability by a logistic curve.

The insult lexicon holds a few given words and the words and word beginnings that the labelled documents
single out; it and the curve are fitted on at most SAMPLE labelled rows (chosen by a hash of the id),
never on held-out ones. Ids, languages, sources and labels are no inputs of a score.

Edge cases: null and empty texts score as texts without a matched clause; an id that is null is never held
out; an id with several labels counts as toxic if any says so; without any label a fixed curve is used;
repeated rows give repeated results; columns of docs are kept, but those named score and predicted are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Hashable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import cut

#: Labelled rows that the lexicon and the curve are fitted on, at most.
SAMPLE = 20_000
#: Size of the learned lexicon, at most: a bound of the model that is sent to every task.
ENTRIES = 100_000
# Words of each class in English, German, French and Spanish.
INSULTS = (
    "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown clowns imbecile vermin filth dumb pig pigs ugly jerk fool fools "
    "dummkopf trottel abschaum versager widerlich erbärmlich schwachkopf imbécile imbéciles crétin crétins ordure minable débile abruti imbécil estúpido estúpida escoria inútil basura asqueroso"
).split()
THREATS = (
    "kill hurt destroy beat stab shoot strangle punch burn töten umbringen verprügeln erschießen verbrennen erwürgen tuer frapper détruire poignarder brûler étrangler matar golpear destruir apuñalar quemar disparar"
).split()
TARGETS = (
    "you your yours youre he she they them him her those these people everyone u du dich dir dein deine ihr euch sie ihn ihm tu toi te ton vous lui eux elles ils tú ti usted ustedes ellos ellas vosotros"
).split()
NEGATIONS = "not no never nobody isnt arent wasnt dont doesnt didnt without hardly nicht kein keine nie niemals niemand ohne ne pas jamais aucun aucune sans nunca jamás nadie ningún sin ni".split()
REPORTS = (
    "said says say called calls wrote writes claimed claims reported quoted alleged told sagte sagt nannte schrieb behauptete berichtete zitierte dit disait appela écrit écrivit affirma rapporta dijo dice llamó escribió afirmó informó"
).split()
CLASSES = {w: c for c, words in (("insult", INSULTS), ("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in words}
LETTER = r"[^\W\d_]"
WORD = re.compile(rf"{LETTER}+(?:['’]{LETTER}+)?|[\"“”«»]")
ENDS = re.compile(r"[.!?;:\n|]")
#: The curve before any label is seen, and what a fit is drawn towards: bias, then a weight for each feature.
DEFAULT = (-4.0, 2.5, 0.5, 0.5)
KINDS = ("other", "insult", "threat", "target", "negation", "report", "quote")
BEGINNINGS = range(3, 9)


@dataclass(frozen=True)
class Transducer:
    """A finite-state transducer over word classes: (state, class) -> (next state, factor for a weight that passes)."""

    start: Hashable
    arcs: dict[tuple[Hashable, str], tuple[Hashable, float]]

    def step(self, state: Hashable, kind: str) -> tuple[Hashable, float]:
        return self.arcs.get((state, kind)) or self.arcs[state, "other"]


def composed(first: Transducer, second: Transducer) -> Transducer:
    """Both in a row: each passes the class on and scales the weight, so states pair up and factors multiply."""
    start = (first.start, second.start)
    arcs, todo = {}, [start]
    while todo:
        at = todo.pop()
        for kind in KINDS:
            (x, p), (y, q) = first.step(at[0], kind), second.step(at[1], kind)
            arcs[at, kind] = (x, y), p * q
            if ((x, y), KINDS[0]) not in arcs and (x, y) not in todo:
                todo.append((x, y))
    return Transducer(start, arcs)


#: State: words for which a negation still holds.
NEGATION = Transducer(0, {(n, "other"): (max(0, n - 1), 0.3 if n else 1.0) for n in range(4)} | {(n, "negation"): (3, 1.0) for n in range(4)})
#: State 1: after a reporting verb; state 2: inside quotes.
REPORTED = Transducer(
    0, {(0, "other"): (0, 1.0), (1, "other"): (1, 0.5), (2, "other"): (2, 0.5), (0, "report"): (1, 1.0), (0, "quote"): (2, 1.0), (1, "quote"): (2, 1.0), (2, "quote"): (0, 1.0)}
)
#: State 1: a target has been named; insults may also come before it, threats may not.
TARGETED = Transducer(0, {(0, "other"): (0, 1.0), (1, "other"): (1, 1.5), (0, "threat"): (0, 0.25), (1, "threat"): (1, 1.5), (0, "target"): (1, 1.0), (1, "target"): (1, 1.0)})


#: The grammar of a clause: negation, then reported speech, then targets.
CLAUSE = composed(composed(NEGATION, REPORTED), TARGETED)


@dataclass
class Grammar:
    """The lexicon (word or word beginning, marked by a star, to weight) and the curve."""

    lexicon: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = DEFAULT

    def __hash__(self):
        return id(self)


class Scorer:
    """A compiled grammar: an automaton finds lexicon entries, the transducers run over the clauses that hold one."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.found = ahocorasick.Automaton()
        for entry in {*INSULTS, *THREATS, *grammar.lexicon}:
            self.found.add_word(entry.rstrip("*"), len(entry.rstrip("*")))
        self.found.make_automaton()

    def word(self, word: str) -> tuple[str, float]:
        if word[0] in "\"“”«»":
            return "quote", 0.0
        kind = CLASSES.get(bare := word.replace("'", "").replace("’", ""), "other")
        weight = self.grammar.lexicon.get(bare, 0.0)
        if kind in ("insult", "threat"):
            return kind, max(weight, 3.0 if kind == "insult" else 2.0)
        if kind == "other":
            weight = max([weight, *(self.grammar.lexicon.get(bare[:n] + "*", 0.0) for n in BEGINNINGS if n <= len(bare))])
            return ("insult", weight) if weight else (kind, 0.0)
        return kind, 0.0

    def clause(self, clause: str) -> float:
        """The weight that the composed transducer lets through."""
        state, total = CLAUSE.start, 0.0
        for word in WORD.findall(clause):
            kind, weight = self.word(word)
            state, factor = CLAUSE.arcs[state, kind]
            total += weight * factor
        return total

    def features(self, text: str | None) -> tuple[float, ...]:
        """Logs of the summed clause scores, of the highest, and of the sum to a hundred characters."""
        low = (text or "").lower()
        scores, done = [], -1
        for end, n in self.found.iter(low):
            if end < done or (at := end - n + 1) and low[at - 1].isalpha():
                continue
            left = max((low.rfind(c, 0, at) for c in ".!?;:\n|"), default=-1) + 1
            stop = m.start() if (m := ENDS.search(low, end)) else len(low)
            if left > done and (score := self.clause(low[left:stop])):
                scores.append(score)
            done = max(done, stop)
        total = sum(scores)
        return math.log1p(total), math.log1p(max(scores, default=0.0)), math.log1p(100 * total / (len(low) + 20))

    def score(self, text: str | None) -> float:
        bias, *weights = self.grammar.curve
        z = bias + sum(w * x for w, x in zip(weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@lru_cache(maxsize=2)
def _scorer(lexicon: tuple, curve: tuple) -> Scorer:
    return Scorer(Grammar(dict(lexicon), curve))


def held_out(key: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most `sample` labelled documents that aren't held out: doc_id, part (0 to 3), toxic, text. Of an id's several texts the least is taken."""
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    one = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # at most `sample` small rows are broadcast
    return cut(one.withColumn("part", F.crc32(F.col("doc_id").cast("string")) % 4))


def _seen(text: str) -> set[str]:
    words = set(re.findall(rf"{LETTER}+", text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in BEGINNINGS if n <= len(w)}


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents, and toxic ones, that hold a word or beginning; summed over a batch before anything is shuffled."""
    for batch in batches:
        n, toxic = Counter(), Counter()
        for text, part, y in zip(batch["text"], batch["part"], batch["toxic"]):
            seen = [(s, part == 3) for s in _seen(text)]
            n.update(seen)
            if y:
                toxic.update(seen)
        yield pd.DataFrame([(s, late, c, toxic[s, late]) for (s, late), c in n.items()], columns=["entry", "late", "n", "toxic"])


def lexicons(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Learned entries from the parts 0 and 1, and from all parts; each at most ENTRIES."""
    counts = (
        rows.select("text", "part", "toxic")
        .mapInPandas(_counted, "entry string, late boolean, n long, toxic long")
        .groupBy("entry")
        .agg(*(F.sum(F.when(c, F.col(v)).otherwise(0)).alias(a) for a, v, c in (("n0", "n", ~F.col("late")), ("t0", "toxic", ~F.col("late")))), F.sum("n").alias("n1"), F.sum("toxic").alias("t1"))
    )

    def top(k: int) -> DataFrame:
        n, t = F.col(f"n{k}"), F.col(f"t{k}")
        rate = (t + 0.1) / (n + 1.0)
        return counts.where((t >= 3) & (rate >= 0.6)).select("entry", F.log(rate / (1 - rate)).alias("w"), t.alias("t")).orderBy(F.desc("t"), "entry").limit(ENTRIES).withColumn("k", F.lit(k))

    told, out = top(0).union(top(1)).collect(), []  # one job: the counts' exchange is used by both
    for k in (0, 1):
        found = {r["entry"]: (round(min(4.0, r["w"]), 6), r["t"]) for r in told if r["k"] == k}
        alone = Counter()  # a beginning that stands for one word only says no more than the word
        for entry, (_, seen) in found.items():
            if not entry.endswith("*"):
                for m in BEGINNINGS:
                    alone[f"{entry[:m]}*"] = max(alone[f"{entry[:m]}*"], seen)
        out.append({e: w for e, (w, seen) in found.items() if not e.endswith("*") or seen > 1.1 * alone[e]})
    return out[0], out[1]


def _loss(x: np.ndarray, y: np.ndarray, w: np.ndarray, prior: np.ndarray, ridge: float) -> float:
    z = x @ w
    return float(np.sum(np.logaddexp(0.0, z) - y * z) + 0.5 * ridge * np.sum((w - prior) ** 2))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton's method on a strictly convex loss; a step is halved until it lowers the loss, so it can't jump about."""
    x = np.column_stack([np.ones(len(x)), x])
    prior = w = np.array(DEFAULT)
    now = _loss(x, y, w, prior, ridge)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        grad = x.T @ (p - y) + ridge * (w - prior)
        if np.abs(grad).max() <= 1e-6 * len(x):
            return tuple(float(v) for v in w)
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-9 and not (new := _loss(x, y, w - size * step, prior, ridge)) < now:
            size /= 2
        if size <= 1e-9:  # no step lowers the loss any more: the end, to rounding
            return tuple(float(v) for v in w)
        w, now = w - size * step, new
    raise RuntimeError("the curve's fit has not converged")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """The curve is fitted on part 3 with the lexicon of parts 0 and 1, so that it sees entries as unseen documents do."""
    rows = labelled(docs, labels, sample)
    early, full = lexicons(rows)
    lexicon = tuple(sorted(early.items()))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _scorer(lexicon, DEFAULT)
        for batch in batches:
            yield pd.DataFrame([(*own.features(t), float(y)) for t, y in zip(batch["text"], batch["toxic"])], columns=["a", "b", "c", "y"])

    got = rows.where("part = 3").select("text", "toxic").mapInPandas(measured, "a double, b double, c double, y double").toPandas().to_numpy(float)
    if len(got) < 20 or len(set(got[:, 3])) < 2:
        return Grammar(full)
    got = got[np.lexsort(got.T)]  # one order, so that sums come out alike in every run
    return Grammar(full, _logistic(got[:, :3], got[:, 3]))


def score(docs: DataFrame, grammar: Grammar, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on)."""
    lexicon, curve = tuple(sorted(grammar.lexicon.items())), grammar.curve

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        own = _scorer(lexicon, curve)
        return pd.Series([own.score(t) for t in texts], dtype=float)

    return docs.withColumn("score", scored(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
