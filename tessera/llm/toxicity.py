"""Operator 4: toxicity by a weighted finite-state pattern grammar over clauses.

A text is cut into clauses, and each clause passes a cascade of finite-state transducers. The lexical one writes a symbol for each token: a
learned insult (strong or fair), an insult of the public seed list, a threat, a target, a negation, a speech verb, a quotation mark, or any
other word. One that reads from the right marks what has a target close behind it and which quotation marks are closed again. Three
that read from the left and are composed into a single machine (:func:`compose`) mark insults and threats as negated (behind a
negation), reported (behind a speech verb or in a quotation) or aimed (close to a target). An arc that writes an insult or threat has a
weight: that of its kind, times the factor of its context. Factors are bounded: being aimed raises a weight, being negated or
reported lowers it. A clause's weight W is the sum along its path, its chance of being toxic 1 - exp(-W), and a
text's score is the chance that one of its clauses is, with a small chance for what no clause shows.

Labels serve twice, both on a sample of at most ``SAMPLE`` labelled documents outside fold 0 (a documented bound): they say which
words and word beginnings are insults of this corpus (by how many different contexts they have in toxic and other documents,
so that copies of one document count once for each partition), and they fit the weights, which are pulled towards those that hold
without labels: what the sample does not show keeps them. Scores depend on the text alone.

Null and empty texts have no clauses and get the score of such a text. Without toxic or without other labelled documents the
weights are those that hold without labels. Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, fold_of, labelled_sample, map_arrow, read_table, texts_of

#: Labelled documents that the lexicon and the weights are learned from, at most.
SAMPLE = 10_000
#: Partitions of the sample; an insult must have more contexts than copies of one text could give it.
SAMPLE_PARTS, LEAST_CONTEXTS = 8, 12
#: Log odds of fair and of strong insults; the second was chosen by agreement on documents outside fold 0.
LEAST_ODDS, STRONG_ODDS = 3.0, 6.0
#: Entries of the learned lexicon, at most: those with the most contexts.
LEXICON = 4096
#: Lengths of word beginnings that may be learned besides whole words.
STEMS = (4, 5, 6)

# Fixed word lists.
SEED = "idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown fool bastard jerk creep imbecile vermin filth garbage dimwit halfwit"
THREATS = "kill hurt destroy beat burn shoot stab punch attack strangle murder crush smash slap choke hang"
TARGETS = "you your yours you're youre u yourself he she him her his they them their theirs people everyone tu toi vous votre du dich dir euch ihr sie usted ustedes ti él ella ellos"
NEGATIONS = "not no never isn't aren't wasn't weren't don't doesn't didn't won't can't cannot nobody nothing neither nor without pas jamais aucun nicht nie kein keine nunca jamás ningún"
SPEECH = "said says say saying told tells called calls claimed claims wrote writes reported reports quoted quote according replied asked dit disait sagte sagt schrieb dijo dice escribió"

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;:\n]|[\"“”«»]")
_ENDS = frozenset(".!?;:\n")
_QUOTES = frozenset("\"“”«»")

KINDS = "IJKT"  # strong, fair and seed insult; threat
#: Other symbols: U target, N negation, R speech verb, Q quotation mark, o any other word; and B, the end of a clause.
_OTHERS = "UNRQo"
#: What a context makes of a kind: plain, aimed, negated, reported; and the letters that :func:`transduce` writes for them.
PLAIN, AIMED, NEGATED, REPORTED = range(4)
_LETTERS = {PLAIN: "IJKT", AIMED: "ACDX", NEGATED: "nnnn", REPORTED: "rrrr"}
#: Words that a negation, a speech verb and a target reach ahead, and that a target may follow behind.
NEGATION_REACH, SPEECH_REACH, TARGET_REACH, TARGET_BEHIND = 4, 13, 5, 3

Table = dict[tuple[int, str], tuple[int, str]]


def _table(states: int, alphabet: list[str], step) -> Table:
    """The arcs (state, symbol read) -> (next state, symbol written) of a machine that starts in state 0."""
    return {(s, a): step(s, a) for s in range(states) for a in alphabet}


def compose(first: Table, second: Table) -> Table:
    """One machine that does what ``second`` does with the output of ``first``: states are pairs, numbered as they are reached."""
    numbers, waiting, out = {(0, 0): 0}, [(0, 0)], {}
    alphabet = sorted({a for _, a in first})
    while waiting:
        pair = waiting.pop()
        for a in alphabet:
            s, between = first[pair[0], a]
            t, written = second[pair[1], between]
            if (s, t) not in numbers:
                numbers[s, t] = len(numbers)
                waiting.append((s, t))
            out[numbers[pair], a] = numbers[s, t], written
    return out


# An insult or threat is its kind and a mark: "." plain, ">" a target close behind, "-" negated, "~" reported, "!" aimed.
_PLAIN_MARKS = [k + m for k in KINDS for m in ".>"]


def _behind(state: int, a: str) -> tuple[int, str]:
    """From the right. State: words since a target (0: none close), and 8 more if a quotation mark has been met."""
    near, quoted = state & 7, state & 8
    if a == "Q":
        return 8, "(" if quoted else "Q"
    if a == "U":
        return quoted | 1, a
    if a in KINDS:
        return quoted, a + (">" if near else ".")
    return quoted | (near + 1 if 0 < near < TARGET_BEHIND else 0), a


def _negation(state: int, a: str) -> tuple[int, str]:
    """State: words that the last negation still reaches."""
    if a == "N":
        return NEGATION_REACH, a
    if a in ("Q", "("):
        return 0, a
    return max(0, state - 1), a[0] + "-" if state and a in _PLAIN_MARKS else a


def _report(state: int, a: str) -> tuple[int, str]:
    """State: words that the last speech verb still reaches, or beyond that inside a quotation."""
    inside = SPEECH_REACH + 1
    if a in ("Q", "("):
        return inside if a == "(" and state != inside else 0, a
    if state == inside:
        return inside, a[0] + "~" if a[0] in KINDS else a
    if a == "R":
        return SPEECH_REACH, a
    return max(0, state - 1), a[0] + "~" if state and a[0] in KINDS else a


def _target(state: int, a: str) -> tuple[int, str]:
    """State: words that the last target still reaches."""
    if a == "U":
        return TARGET_REACH, a
    if a in ("Q", "("):
        return 0, a
    return max(0, state - 1), a[0] + "!" if a[1:] == ">" or (state and a[1:] == ".") else a


BEHIND = _table(16, [*KINDS, *_OTHERS], _behind)
_READ = [*_PLAIN_MARKS, *_OTHERS, "("]
_NEGATED = [*_READ, *[k + "-" for k in KINDS]]
_TOLD = [*_NEGATED, *[k + "~" for k in KINDS]]
CASCADE = (_table(NEGATION_REACH + 1, _READ, _negation), _table(SPEECH_REACH + 2, _NEGATED, _report), _table(TARGET_REACH + 1, _TOLD, _target))
GRAMMAR = compose(compose(CASCADE[0], CASCADE[1]), CASCADE[2])
_CONTEXTS = {".": PLAIN, "!": AIMED, "-": NEGATED, "~": REPORTED}
_HIT = re.compile(f"[{KINDS}]")
N_ARCS = len(KINDS) * len(_CONTEXTS)


def run(table: Table, symbols: list[str]) -> list[str]:
    """What a machine writes for some symbols."""
    state, out = 0, []
    for a in symbols:
        state, written = table[state, a]
        out.append(written)
    return out


def parse(clause: str) -> list[str]:
    """The symbols of a clause with the marks of its insults and threats."""
    return run(GRAMMAR, run(BEHIND, list(clause[::-1]))[::-1])


def transduce(symbols: str) -> str:
    """The symbols of a text with a letter for each insult or threat in its context (``_LETTERS``)."""

    def letter(a: str) -> str:
        return _LETTERS[_CONTEXTS[a[1]]][KINDS.index(a[0])] if a[0] in KINDS else "Q" if a == "(" else a

    return "B".join("".join(map(letter, parse(clause))) for clause in symbols.split("B"))


def arcs_of(clause: str) -> list[int]:
    """Numbers (kind, context) of the weighted arcs on the path of a clause."""
    return [KINDS.index(a[0]) * len(_CONTEXTS) + _CONTEXTS[a[1]] for a in parse(clause) if a[0] in KINDS]


class Lexicon(dict):
    """Token -> symbol, filled as tokens are met and emptied when full."""

    def __init__(self, learned: dict[str, float], size: int = 300_000) -> None:
        super().__init__()
        self.learned, self.size = learned, size
        self.fixed = {w: s for words, s in ((SEED, "K"), (THREATS, "T"), (TARGETS, "U"), (NEGATIONS, "N"), (SPEECH, "R")) for w in words.split()}

    def __missing__(self, token: str) -> str:
        if len(self) >= self.size:
            self.clear()
        if token in _ENDS:
            symbol = "B"
        elif token in _QUOTES:
            symbol = "Q"
        else:
            known = [self.learned.get(term, 0.0) for term in terms(token)]
            best = max(known)
            symbol = "I" if best >= STRONG_ODDS else "J" if best >= LEAST_ODDS else self.fixed.get(token.replace("’", "'"), "o")
        self[token] = symbol
        return symbol


def terms(word: str) -> list[str]:
    """A word, and its beginnings of set lengths (marked by a star)."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) > n]]


def clauses(text: str, lexicon: Lexicon) -> list[list[int]]:
    """The weighted arcs of each clause that has any."""
    symbols = "".join(map(lexicon.__getitem__, _TOKEN.findall(text.lower())))
    return [arcs_of(clause) for clause in symbols.split("B") if _HIT.search(clause)] if _HIT.search(symbols) else []


#: Logarithms of the weights that hold without labels: of the four kinds, of what being aimed adds to an insult and to a threat (times its
#: weight), logits of the factors of negation and report, and the logarithm of the weight of a text without any. A pull for each keeps them near.
PRIOR = np.array([*np.log([1.0, 0.5, 0.5, 0.15]), *np.log([0.5, 5.0]), -2.0, -1.5, math.log(0.01)])
PULL = np.array([1.0, 1.0, 4.0, 4.0, 10.0, 10.0, 10.0, 10.0, 0.1])


def arc_weights(theta: np.ndarray) -> tuple[np.ndarray, float]:
    """The weight of each arc, and that of a text without any: aimed above plain, negated and reported below, whatever the parameters."""
    kinds, lowered = np.exp(theta[:4]), 1 / (1 + np.exp(-theta[6:8]))
    raised = 1 + np.exp(theta[[4, 4, 4, 5]])
    return np.column_stack([kinds, kinds * raised, kinds * lowered[0], kinds * lowered[1]]).ravel(), float(np.exp(theta[8]))


def chance(weights: list[float]) -> float:
    """The chance that one of some clauses is toxic, from their weights."""
    return -math.expm1(-sum(weights))


def fit_weights(x: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Parameters of greatest likelihood under the pull; ``x`` counts the arcs of each document. Rows that are alike are taken once, with their number."""
    rows, n = np.unique(np.column_stack([x, y]), axis=0, return_counts=True)
    x, y = rows[:, :-1], rows[:, -1]

    def loss(theta: np.ndarray) -> float:
        weights, rest = arc_weights(theta)
        p = np.clip(-np.expm1(-(x @ weights + rest)), 1e-9, 1 - 1e-9)
        return float(-(n * np.where(y > 0, np.log(p), np.log1p(-p))).sum() + 0.5 * (PULL * (theta - PRIOR) ** 2).sum())

    theta, first, second, small = PRIOR.copy(), np.zeros(len(PRIOR)), np.zeros(len(PRIOR)), 1e-4 * np.eye(len(PRIOR))
    for step in range(1, steps + 1):
        slope = np.array([loss(theta + e) - loss(theta - e) for e in small]) / 2e-4
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta - 0.1 * (1 - step / (steps + 1)) * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return theta


def _contexts(sample: DataFrame) -> DataFrame:
    """term, toxic and other contexts: summed over partitions, each context once in a partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[dict[str, set[int]], dict[str, set[int]]] = ({}, {})
        totals = [0, 0]
        for batch in batches:
            for text, label in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = _TOKEN.findall(text.lower())
                totals[label > 0] += len(words)
                into = seen[label > 0]
                for word, after in zip(words, [*words[1:], ""], strict=True):
                    if len(word) > 2:
                        near = hash(after)
                        for term in terms(word):
                            into.setdefault(term, set()).add(near)
        every = [*seen[1], *(t for t in seen[0] if t not in seen[1])]
        for i in range(0, len(every), 50_000):
            part = every[i : i + 50_000]
            columns = [[len(seen[k].get(t, ())) for t in part] for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array(c, pa.int64()) for c in columns]], ["term", "toxic", "other"])
        yield pa.RecordBatch.from_arrays([pa.array([""], pa.string()), pa.array([totals[1]], pa.int64()), pa.array([totals[0]], pa.int64())], ["term", "toxic", "other"])

    return map_arrow(sample.select("text", "label"), work, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """term -> log odds, of the terms typical of toxic documents; at most ``LEXICON`` of them."""
    total = F.max(F.when(F.col("term") == "", F.struct("toxic", "other")))
    counts = cut(_contexts(sample))
    sums = counts.agg(total.alias("t")).first()["t"]
    if sums is None or not sums["toxic"] or not sums["other"]:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / F.lit(float(sums["toxic"]))) - F.log((F.col("other") + 0.5) / F.lit(float(sums["other"])))
    rows = counts.where((F.col("term") != "") & (F.col("toxic") >= LEAST_CONTEXTS)).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    return {r.term: r.odds for r in rows.orderBy(F.desc("toxic"), "term").limit(LEXICON).collect()}


def _with_arcs(rows: DataFrame, learned: dict[str, float]) -> DataFrame:
    """label, x: how often each weighted arc is on the paths of a document's clauses."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(learned)
        for batch in batches:
            values = [np.bincount([a for clause in clauses(t, lexicon) for a in clause], minlength=N_ARCS).tolist() for t in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(values, pa.list_(pa.int64()))], ["label", "x"])

    return map_arrow(rows.select("text", "label"), work, "label int, x array<long>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[dict[str, float], list[float]]:
    """The learned lexicon and the parameters of the weights (as :func:`arc_weights` takes them)."""
    sample = cut(labelled_sample(docs, labels, label, SAMPLE).repartition(SAMPLE_PARTS, "doc_id"))
    learned = learn_lexicon(sample)
    rows = _with_arcs(sample, learned).collect()  # SAMPLE rows of a dozen numbers, at most (more only if ids repeat)
    x = np.array([r.x for r in rows], dtype=float).reshape(-1, N_ARCS)
    y = np.array([r.label > 0 for r in rows], dtype=float)
    return learned, (PRIOR if not len(y) or y.min() == y.max() else fit_weights(x, y)).tolist()


def score(docs: DataFrame, learned: dict[str, float], weights: list[float]) -> DataFrame:
    """doc_id, score: one row per document."""
    by_arc, rest = arc_weights(np.array(weights))
    by_arc = by_arc.tolist()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(learned)
        for batch in batches:
            scores = [chance([rest, *(sum(map(by_arc.__getitem__, clause)) for clause in clauses(t, lexicon))]) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, "doc_id long, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: fitted outside fold 0, then every document scored."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = score(docs, *fit(docs, labels))
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
