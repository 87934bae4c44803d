"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon maps words to symbols (insult, likely insult, threat, target, negation, reported speech,
other). Small transducers rewrite the symbols of a clause: one marks what is negated, one what
stands in reported speech, one what has a target close before, one what has a target close after.
They are composed into a single machine, which runs over the clauses of texts that hold an insult
or a threat; what counts of a clause is the strongest pattern that the machine puts out. A text's
score is the logistic function of the patterns' weights times the logarithm of how many clauses
have each; single words, their number and their density count for nothing.

Weights are fitted to labels around a prior, and within its order: negated and reported patterns
never add to a score, an aimed insult or threat weighs at least what a plain one does, a plain
insult at least what a likely one does. So patterns that labels hardly show keep sensible weights.

The insult lexicon has the fixed words below and stems found from labels: beginnings of words that
occur, among distinct labelled texts, nearly only in toxic ones (insults) or mostly (likely
insults). Stems and weights are learned from at most about MAX_TRAIN labelled rows, chosen by a
hash, none of them held out.

Edge cases: null and empty texts match nothing and get the score of a text without any pattern.
Texts are scored whole, however long. Repeated rows are scored each; alike texts score alike, and a
score of exactly the bound counts as toxic. An empty table gives no rows. Where labels are missing
or of one class only, the weights are the prior's and there are no learned stems. Columns with
names that are used inside pass through drop_toxic unharmed.
"""

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from quire.llm.common import cut, passing, table

#: The bound on the labelled rows that are learned from.
MAX_TRAIN = 20_000
STEM_LENGTHS = range(4, 9)
#: A stem is in at least so many toxic texts, and in this share of them.
STEM_TEXTS, STEM_SHARE = 5, 0.015
#: The share of toxic ones among the texts with a stem, for insults and for likely insults.
PURE, LIKELY_PURE = 0.98, 0.8

# Words of the grammar in English, French, German and Spanish.
INSULTS = """clown disgusting filthy garbage idiot idiots imbecile loser losers moron morons pathetic scum stupid
trash vermin worthless abruti connard crétin débile ordure salaud arschloch abschaum dummkopf trottel vollidiot
basura cabrón estúpido gilipollas imbécil""".split()
THREATS = """burn choke destroy hang hurt kill killed murder shoot stab strangle écraser étrangler frapper tuer
erschießen töten umbringen vernichten verprügeln aplastar asesinar golpear matar quemar""".split()
TARGETS = """he her him she their them these they this those you your elle ils leur toi tu vous ces cette
dich dir du euch ihr ihnen diese ella ellos esa ese esos te tú usted ustedes vosotros""".split()
NEGATIONS = """never no not nor without jamais ne ni pas sans kein keine keinen nicht nie niemals ohne jamás
nunca sin tampoco""".split()
REPORTS = """according alleged called claimed quote quoted reported said says stated wrote affirmé déclaré écrit
selon behauptete berichtete erklärte laut sagte schrieb afirmó declaró dijo escribió según""".split()

OTHER, INSULT, LIKELY, THREAT, TARGET, NEGATION, REPORT = range(7)
#: What a transducer can make of an insult or threat.
NEGATED, REPORTED, AIMED_INSULT, AIMED_THREAT = range(7, 11)
SYMBOLS = 11
#: Patterns of a clause, from mild to strong, and their weights before labels are seen; then the intercept.
PATTERNS = (NEGATED, REPORTED, LIKELY, THREAT, INSULT, AIMED_THREAT, AIMED_INSULT)
PRIOR = (-1.0, -0.5, 1.5, 1.5, 4.0, 4.5, 5.0, -3.0)
#: Rows that the prior is worth, and how far below 0 the intercept may go: so that no pattern that labels
#: hardly show is drowned by many clean rows.
PRIOR_ROWS, LOWEST = 4.0, 4.0
# Which steps, none below 0, add up to each weight: the order of the weights holds whatever the steps are.
STEPS = np.array([
    [-1, 0, 0, 0, 0, 0, 0, 0], [0, -1, 0, 0, 0, 0, 0, 0], [0, 0, 1, 0, 0, 0, 0, 0], [0, 0, 0, 1, 0, 0, 0, 0],
    [0, 0, 1, 0, 1, 0, 0, 0], [0, 0, 0, 1, 0, 1, 0, 0], [0, 0, 1, 0, 1, 0, 1, 0], [0, 0, 0, 0, 0, 0, 0, -1]], float)

CLAUSE = re.compile(r"[^.!?;:\n]+")
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")


def within(trigger: int, reach: int, change: dict[int, int]) -> np.ndarray:
    """A transducer, as table[state, symbol] = (state, output): symbols within reach after trigger
    are changed; the state counts down from it."""
    moves = np.zeros((reach + 1, SYMBOLS, 2), int)
    for state in range(reach + 1):
        for symbol in range(SYMBOLS):
            moves[state, symbol] = reach if symbol == trigger else max(0, state - 1), change.get(symbol, symbol) if state else symbol
    return moves


def followed(by: int, reach: int, change: dict[int, int]) -> np.ndarray:
    """A transducer that, where a symbol of change is followed by `by` within reach, puts out what it
    changes to at that place. State 0: none pending; else 1 + kind * reach + (steps left - 1)."""
    kinds = list(change)
    moves = np.zeros((1 + len(kinds) * reach, SYMBOLS, 2), int)
    for state in range(len(moves)):
        kind, left = divmod(state - 1, reach) if state else (None, -1)
        for symbol in range(SYMBOLS):
            after, out = (state - 1 if left > 0 else 0), symbol
            if symbol in change:
                after = 1 + kinds.index(symbol) * reach + reach - 1
            elif symbol == by and kind is not None:
                after, out = 0, change[kinds[kind]]
            moves[state, symbol] = after, out
    return moves


def compose(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The transducer that feeds the outputs of first to second; a state is a pair of states."""
    n = len(second)
    moves = np.zeros((len(first) * n, SYMBOLS, 2), int)
    for a in range(len(first)):
        for b in range(n):
            for symbol in range(SYMBOLS):
                to, middle = first[a, symbol]
                then, out = second[b, middle]
                moves[a * n + b, symbol] = to * n + then, out
    return moves


def grammar() -> list[list[tuple[int, int]]]:
    machine = within(NEGATION, 3, {INSULT: NEGATED, LIKELY: NEGATED, THREAT: NEGATED})
    machine = compose(machine, within(REPORT, 8, {INSULT: REPORTED, LIKELY: REPORTED, THREAT: REPORTED}))
    machine = compose(machine, within(TARGET, 4, {INSULT: AIMED_INSULT, LIKELY: INSULT, THREAT: AIMED_THREAT}))
    machine = compose(machine, followed(TARGET, 3, {INSULT: AIMED_INSULT, THREAT: AIMED_THREAT}))
    return [[(int(s), int(o)) for s, o in row] for row in machine]


class Grammar:
    """Features of texts: of each pattern, the logarithm of the clauses whose strongest it is."""

    def __init__(self, stems: dict[str, int]):
        self.machine = grammar()
        self.words = {w: kind for kind, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS), (INSULT, INSULTS)) for w in words}
        self.stems = stems
        self.rank = {out: i for i, out in enumerate(PATTERNS)}
        self.hits = ahocorasick.Automaton()
        for word in {*INSULTS, *THREATS, *stems}:
            self.hits.add_word(word, len(word))
        self.hits.make_automaton()

    def symbol(self, word: str) -> int:
        if (kind := self.words.get(word)) is not None:
            return kind
        return next((kind for n in STEM_LENGTHS if (kind := self.stems.get(word[:n])) is not None and len(word) >= n), OTHER)

    def pattern(self, words: list[str]) -> int:
        """The place in PATTERNS of the strongest pattern of a clause; -1 if there is none."""
        state, best = 0, -1
        for word in words:
            state, out = self.machine[state][self.symbol(word)]
            best = max(best, self.rank.get(out, -1))
        return best

    def features(self, text: str | None) -> list[float]:
        n = [0] * len(PATTERNS)
        low = (text or "").lower()
        if any(end == size - 1 or not low[end - size].isalnum() for end, size in self.hits.iter(low)):
            for clause in CLAUSE.finditer(low):
                if (best := self.pattern(TOKEN.findall(clause[0]))) >= 0:
                    n[best] += 1
        return np.log2(np.array(n) + 1.0).tolist()


def fit(x: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> list[float]:
    """Weights of the patterns and the intercept, from rows of features, labels and how often each occurs:
    logistic regression by coordinate descent on the steps, pulled towards the prior's."""
    prior = np.linalg.solve(STEPS, np.array(PRIOR))
    steps = prior.copy()
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1) @ STEPS
    at = z @ steps
    for _ in range(300):
        before = steps.copy()
        for k in range(len(steps)):
            p = 1 / (1 + np.exp(-np.clip(at, -30, 30)))
            slope = (n * (p - toxic) * z[:, k]).sum() + PRIOR_ROWS * (steps[k] - prior[k])
            curve = (n * np.maximum(p * (1 - p), 0.05) * z[:, k] ** 2).sum() + PRIOR_ROWS
            to = min(max(0.0, steps[k] - slope / curve), LOWEST if k == len(steps) - 1 else math.inf)
            at += z[:, k] * (to - steps[k])
            steps[k] = to
        if np.abs(steps - before).max() < 1e-6:
            break
    return (STEPS @ steps).tolist()


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most about MAX_TRAIN rows (text, toxic), by a hash of the doc_id, none of them held out."""
    usable = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = max(1, usable.count())
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, MAX_TRAIN / n)))
    return cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy(F.md5("text").alias("_t")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("_t"))


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def stems_of(text: str | None) -> set[str]:
    return {w[:n] for w in set(TOKEN.findall((text or "").lower())) for n in STEM_LENGTHS if len(w) >= n}


def learn_stems(rows: DataFrame, n_toxic: int) -> dict[str, int]:
    """Beginnings of words that occur nearly only, or mostly, in toxic texts, with their symbols; of those alike
    the shortest."""

    def texts_with(which: frozenset | None):
        def count(batches):
            seen: Counter = Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    seen.update(stems_of(text) if which is None else stems_of(text) & which)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["stem", "n"])

        return lambda of: of.select("text").mapInArrow(count, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))

    least = max(STEM_TEXTS, STEM_SHARE * n_toxic)
    # At most len(STEM_LENGTHS) / STEM_SHARE * (words of a text) stems can be so frequent.
    bad = {r.stem: r.n for r in texts_with(None)(rows.filter("toxic = 1")).filter(F.col("n") >= least).collect()}
    good = {r.stem: r.n for r in texts_with(frozenset(bad))(rows.filter("toxic = 0")).collect()}
    shares = {stem: n / (n + good.get(stem, 0)) for stem, n in bad.items()}
    stems: dict[str, int] = {}
    for kind, purity in ((INSULT, PURE), (LIKELY, LIKELY_PURE)):
        for stem in sorted(shares, key=lambda s: (len(s), s)):
            if shares[stem] >= purity and not any(stem[:n] in stems for n in STEM_LENGTHS):
                stems[stem] = kind
    return stems


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, int], list[float]]:
    """Stems with their symbols, and the weights of the patterns and the intercept."""
    rows = training_rows(docs, labels)
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return {}, list(PRIOR)
    stems = learn_stems(rows, n[1])

    def measure(batches):
        grammar = Grammar(stems)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([grammar.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1).cast(pa.float64())], names=["x", "toxic"])

    # Rows alike in features and label are one row here: at most MAX_TRAIN, mostly far fewer.
    measured = rows.select("text", "toxic").mapInArrow(measure, "x array<double>, toxic double").groupBy("x", "toxic").count().orderBy("x", "toxic").collect()
    return stems, fit(np.array([r.x for r in measured]), np.array([r.toxic for r in measured]), np.array([float(r["count"]) for r in measured]))


def score(docs: DataFrame, model: tuple[dict[str, int], list[float]], columns: list[str], name: str = "score") -> DataFrame:
    """docs' columns and the score of the column text, 0 to 1, by the given name."""
    stems, weights = model
    out = StructType([*docs.select(*columns).schema.fields]).add(name, DoubleType())
    source = "text" if "text" in columns else "_text"

    def run(batches):
        grammar, w = Grammar(stems), np.array(weights)
        for batch in batches:
            texts = batch.column(source)
            scores = []
            for at in range(0, len(texts), 256):
                x = np.array([grammar.features(t) for t in texts.slice(at, 256).to_pylist()])
                scores.append(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=out.names)

    return docs.select(*columns, *([] if source in columns else [F.col("text").alias(source)])).mapInArrow(run, out)


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without those that score least or more, by a model learned from the labels of docs."""
    rows, back = passing(docs, ["doc_id", "text"])
    return back(score(rows, learn(rows, labels), rows.columns, "_toxicity").filter(F.col("_toxicity") < least))


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return score(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
