"""Toxicity: misspelled terms of a learned lexicon, and what stands around them.

The lexicon holds words and open stems (any word that begins so) that toxic texts have far more often
than others by a likelihood-ratio test against as many tests as there are candidates. It is a trie; a
Levenshtein automaton walks it, so that a word within the edits that a term allows is found. The
product of the two is determinised as words demand it, and each word is looked up once. A hit counts as
quoted if its window has quotation marks on both sides or a verb of saying, as an attack if it has a
word of address or an exclamation mark, else as plain. A logistic model of these counts and of the
terms' evidence gives the score.

Lexicon and weights come from labelled rows whose crc32(doc_id as text) mod 4 is not HELD_OUT, at most
about FIT_ROWS of them, taken by hash of the id. A score depends on the text alone.

Defined results: null or empty texts have no hits and the score of a text without any. Repeated rows
get equal scores; of several labels of one id the largest counts, null labels and ids count for
nothing. Without labels every score is PRIOR_RATE. Empty tables give empty ones. Extra columns are
ignored by the report and kept by the filter. Texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, ragged

PARTS, HELD_OUT = 4, 2
LIMIT = 0.3
#: Labelled rows that lexicon and weights are fitted on, about; a sample by hash beyond.
FIT_ROWS = 40_000
#: Lengths of open stems.
STEMS = range(3, 13)
#: (least length, edits allowed) of a term.
EDITS = ((9, 2), (5, 1))
#: Share of toxic texts among those with a term, at least.
PRECISION = 0.5
#: Log odds of near hits under which a term is looked for as it stands only.
NEAR_LEAST = 1.0
WINDOW = 6
PRIOR_RATE = 0.05
#: Weight of a copy of a toxic text whose terms are all misspelled: labels alone may have none.
MISSPELLED = 0.2
WORD = re.compile(r"\w[\w@$*+'’-]*")
TAIL = "@$*+'’-_"
QUOTES = re.compile("[\"“”„«»‹›]")
SAYING = frozenset("said says say quote quoted quotes called calls calling wrote writes word term insult sagte sagt nannte schrieb zitat wort dit disait écrit citation mot dijo dice llamó escribió cita palabra".split())
ADDRESS = frozenset("you your you're youre ur yourself du dich dir dein deine ihr euch tu te toi ton vous votre tú usted eres ustedes vosotros".split())
PLAIN, ATTACK, QUOTED = 0, 1, 2


@dataclass(frozen=True)
class Term:
    """evidence: log odds of the label, by exact hits and by near ones."""

    text: str
    open: bool
    evidence: float
    near: float = math.inf

    @property
    def edits(self) -> int:
        return next((e for n, e in EDITS if len(self.text) >= n), 0) if self.near >= NEAR_LEAST else 0


class Lexicon:
    """A trie of terms and its product with a Levenshtein automaton, determinised as far as words have asked."""

    WORDS_HELD = 200_000

    def __init__(self, terms: list[Term]) -> None:
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.budget = [0]  # the most edits that a term below a node allows
        self.ending: list[list[int]] = [[]]
        for k, term in enumerate(terms):
            node = 0
            self.budget[0] = max(self.budget[0], term.edits)
            for c in term.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.budget.append(0)
                    self.ending.append([])
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], term.edits)
            self.ending[node].append(k)
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.opened: list[tuple[int, int] | None] = []  # the best open term that a state has read: (edits, term)
        self.closed: list[tuple[int, int] | None] = []  # the best term if the word ends here
        self.held: dict[str, tuple[int, int] | None] = {}
        self.start = self.state({0: 0})

    def state(self, nodes: dict[int, int]) -> int:
        """The state of trie nodes with the edits spent on each; letters of a term may be left out."""
        todo = list(nodes.items())
        for node, spent in todo:
            if spent == nodes.get(node) and spent < self.budget[node]:
                for child in self.children[node].values():
                    if spent + 1 <= self.budget[child] and spent + 1 < nodes.get(child, 99):
                        nodes[child] = spent + 1
                        todo.append((child, spent + 1))
        key = tuple(sorted(nodes.items()))
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ended = [(spent, -self.terms[k].evidence, k) for node, spent in key for k in self.ending[node] if spent <= self.terms[k].edits]
            pick = lambda found: (lambda best: (best[0], best[2]))(min(found)) if found else None
            self.opened.append(pick([x for x in ended if self.terms[x[2]].open]))
            self.closed.append(pick(ended))
        return self.states[key]

    def step(self, state: int, c: str) -> int:
        """-1 where no term can follow."""
        if c not in self.steps[state]:
            nodes: dict[int, int] = {}
            for node, spent in self.sets[state]:
                if spent < self.budget[node]:
                    nodes[node] = min(spent + 1, nodes.get(node, 99))
                for letter, child in self.children[node].items():
                    cost = spent + (letter != c)
                    if cost <= self.budget[child]:
                        nodes[child] = min(cost, nodes.get(child, 99))
            self.steps[state][c] = self.state(nodes) if nodes else -1
        return self.steps[state][c]

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, of equally near ones the most telling; None if there is none."""
        if word in self.held:
            return self.held[word]
        if len(self.held) >= self.WORDS_HELD or len(self.sets) >= self.WORDS_HELD:
            self.forget()
        state, best = self.start, None
        for c in word:
            state = self.step(state, c)
            if state < 0:
                break
            if self.opened[state] and (best is None or self.opened[state] < best):
                best = self.opened[state]
        if state >= 0 and self.closed[state] and (best is None or self.closed[state][0] < best[0]):
            best = self.closed[state]
        self.held[word] = best
        return best


def words_of(text: str) -> list[str]:
    return [w if w[-1] not in TAIL else w.rstrip(TAIL) for w in WORD.findall(text.lower())]


def hits(lexicon: Lexicon, text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, end, edits, term, context) of each hit in text.lower()."""
    words = words_of(text)
    find = lexicon.find
    at = [(i, hit) for i, hit in enumerate(map(find, words)) if hit]
    if not at:
        return []
    text = text.lower()
    spans = [m.span() for m in WORD.finditer(text)]
    out = []
    for i, (edits, term) in at:
        first, last = max(0, i - WINDOW), min(len(words) - 1, i + WINDOW)
        around = words[first:i] + words[i + 1 : last + 1]
        left, right = text[spans[first][0] : spans[i][0]], text[spans[i][1] : spans[last][1] + 1]
        quoted = bool(QUOTES.search(text[max(0, spans[first][0] - 1) : spans[first][0]] + left) and QUOTES.search(right)) + any(w in SAYING for w in around)
        attack = any(w in ADDRESS for w in around) + right.lstrip(TAIL)[:1].count("!")
        context = QUOTED if quoted > attack else ATTACK if attack > quoted else PLAIN
        out.append((*spans[i], edits, term, context))
    return out


#: The model's columns by spelling: hits that aren't quoted, attacks among them, quoted hits; the most telling term that isn't quoted by spelling, and one for all texts.
COLUMNS = ("exact", "exact_attack", "exact_quoted", "near", "near_attack", "near_quoted", "exact_evidence", "near_evidence", "all")
#: What the weights are without data, and how fast data move them.
PRIOR = np.array([0.5, 0.5, 0.0, 0.2, 0.2, 0.0, 0.5, 0.5, math.log(PRIOR_RATE / (1 - PRIOR_RATE))])
PRECISIONS = np.array([0.3, 0.3, 3.0, 0.3, 0.3, 3.0, 0.3, 0.3, 1e-3])


def counted(found: list[tuple[int, int, int, int, int]]) -> list[float]:
    """Logarithms of the hits that the first six columns count."""
    n = [0] * 6
    for _, _, edits, _, context in found:
        kind = 3 * (edits > 0)
        n[kind + context] += 1
        n[kind] += context == ATTACK
    return [math.log1p(x) for x in n]


@dataclass
class Model:
    terms: list[Term] = field(default_factory=list)
    weights: list[float] = field(default_factory=PRIOR.tolist)

    def __post_init__(self) -> None:
        self.lexicon = Lexicon(self.terms)

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def score(self, text: str | None) -> tuple[float, int, int, int]:
        """(score, hits, near hits, quoted hits)."""
        found = hits(self.lexicon, text or "")
        told = [x for x in found if x[4] != QUOTED]
        best = [max((self.terms[x[3]].evidence for x in told if not x[2]), default=0.0), max((self.terms[x[3]].near for x in told if x[2]), default=0.0)]
        total = float(np.dot([*counted(found), *best, 1.0], self.weights))
        return 1 / (1 + math.exp(-min(max(total, -700), 700))), len(found), sum(x[2] > 0 for x in found), sum(x[4] == QUOTED for x in found)


def part(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % PARTS


def sketches(text: str) -> tuple[int, int]:
    """Two least hashes of the text's 5-word shingles: near copies share one at least, nearly always; others none."""
    grams = ragged.grams(ragged.words([text], ragged.SPACED)[0], 5)
    if not len(grams):
        grams = ragged.words([text.replace(" ", "_")], ragged.SPACED)[0]
    if not len(grams):
        return 0, 0
    return int(grams.min().view(np.int64)), int(ragged.mix(grams ^ ragged.BASE).min().view(np.int64))


def fit_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic): labelled rows outside the held-out part, about FIT_ROWS at most, one of near copies; written."""
    own = labels.where(F.col("toxic").isin(0, 1) & (part(F.col("doc_id")) != HELD_OUT)).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    share = min(1.0, FIT_ROWS / max(1, own.count()))
    chosen = lambda c: F.pmod(F.xxhash64(F.lit("fit"), F.col(c).cast("long")), F.lit(1 << 20)) < int(share * (1 << 20))
    own = common.written(own.where(chosen("_id")), "fit-labels")
    texts = docs.where(chosen("doc_id")).select(F.col("doc_id").alias("_doc"), "text")
    chosen_texts = texts.join(common.small(own), F.col("_doc") == F.col("_id")).select(F.coalesce("text", F.lit("")).alias("text"), "toxic")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketches(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["text", "toxic", "m1", "m2"])

    kind = dict(chosen_texts.dtypes)["toxic"]
    each = common.written(chosen_texts.mapInArrow(rows, f"text string, toxic {kind}, m1 long, m2 long"), "fit-texts")
    # a copy counts once, or its every word would seem to tell the label; which one stays is fixed by its digest
    first = lambda df, m: df.groupBy(m, "toxic").agg(F.min(F.struct(F.xxhash64("text"), *[c for c in ("text", "m1", "m2") if c != m])).alias("x")).select(m, "toxic", "x.*")
    return common.written(first(first(each, "m1"), "m2").select("text", "toxic"), "fit-sample")


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, whole, pos, neg): texts of either label that have a word or a stem; written."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def table() -> pa.RecordBatch:
            terms = list(found[0].keys() | found[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array([t.rstrip("\n") for t in terms], pa.string()), pa.array([t.endswith("\n") for t in terms], pa.bool_()), pa.array([found[1][t] for t in terms], pa.int64()), pa.array([found[0][t] for t in terms], pa.int64())], names=["term", "whole", "pos", "neg"])
            found[0].clear()
            found[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms: set[str] = set()
                for w in set(words_of(text)):
                    terms.update(w[:k] for k in STEMS if k <= len(w))
                    if 3 <= len(w) <= 40:
                        terms.add(w + "\n")
                found[toxic].update(terms)
            if len(found[0]) + len(found[1]) > 1_000_000:
                yield table()
        yield table()

    each = sample.mapInArrow(rows, "term string, whole boolean, pos long, neg long")
    return common.written(each.groupBy("term", "whole").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "term-counts")


def lexicon_terms(counts: DataFrame, n_pos: int, n_neg: int) -> list[Term]:
    """Of terms of one path the most telling, the longer of equally telling ones."""
    tests = counts.count()
    if not tests or not n_pos or not n_neg:
        return []
    rate = n_pos / (n_pos + n_neg)
    n = F.col("pos") + F.col("neg")
    log = lambda x, share: F.when(x > 0, x * F.log(x / (n * share))).otherwise(0.0)
    scored = counts.withColumn("g", 2 * (log(F.col("pos"), rate) + log(F.col("neg"), 1 - rate)))
    # a chi-squared statistic over 2 ln(tests): about one false term in all; the sample's size bounds how many there are
    found = scored.where((F.col("pos") >= PRECISION * n) & (F.col("g") >= 2 * math.log(tests)) & (F.col("pos") > rate * n)).collect()
    taken: list[tuple[str, bool, float]] = []
    used, within = set(), set()
    for r in sorted(found, key=lambda r: (-round(r.g, 6), -len(r.term), not r.whole, r.term)):
        path = r.term + "\n" * r.whole
        if path in within or any(path[:k] in used for k in range(1, len(path) + 1)):
            continue
        used.add(path)
        within.update(path[:k] for k in range(1, len(path) + 1))
        taken.append((r.term, not r.whole, math.log((r.pos + 0.5) / (r.neg + 0.5)) - math.log(n_pos / n_neg)))
    return [Term(*x) for x in taken]


def weighed(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic model that start from PRIOR, by Newton's method with halved steps."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (PRECISIONS * (w - PRIOR) ** 2).sum() / 2)

    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + PRECISIONS * (w - PRIOR)
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(PRECISIONS)
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def seen(sample: DataFrame, terms: list[Term]) -> list:
    """Of each row of the sample, about FIT_ROWS: toxic, counted(), and the terms hit exactly and nearly but not quoted."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for batch in batches:
            found = [hits(lexicon, text) for text in batch.column(0).to_pylist()]
            told = [[x for x in f if x[4] != QUOTED] for f in found]
            exact = [sorted({x[3] for x in f if not x[2]}) for f in told]
            near = [sorted({x[3] for x in f if x[2]}) for f in told]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int64()), pa.array([counted(f) for f in found], pa.list_(pa.float64())), pa.array(exact, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.int64()))], names=["toxic", "counts", "exact", "near"])

    return sample.mapInArrow(rows, "toxic long, counts array<double>, exact array<long>, near array<long>").collect()


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and weights. The driver gets the terms and a few numbers for each row of the sample."""
    common.importable(docs.sparkSession)
    sample = fit_sample(docs, labels)
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n:
        return Model()
    terms = lexicon_terms(term_counts(sample), n.get(1, 0), n.get(0, 0))
    near: dict[int, list[float]] = defaultdict(lambda: [0.5, 0.5])
    for r in seen(sample, terms):
        for k in r.near:
            near[k][r.toxic] += 1
        for k in r.exact:
            near[k][1] += MISSPELLED * r.toxic
    odds = math.log(max(n.get(1, 0), 0.5) / max(n.get(0, 0), 0.5))
    terms = [Term(t.text, t.open, t.evidence, math.log(near[k][1] / near[k][0]) - odds) for k, t in enumerate(terms)]
    rows = seen(sample, terms)
    best = lambda found, what: max((getattr(terms[k], what) for k in found), default=0.0)
    x = [[*r.counts, best(r.exact, "evidence"), best(r.near, "near"), 1.0] for r in rows]
    # copies of the toxic rows with their terms misspelled
    spoilt = [(r, [k for k in {*r.exact, *r.near} if terms[k].edits]) for r in rows if r.toxic]
    copies = [[0.0, 0.0, r.counts[2], *(max(a, b) for a, b in zip(r.counts[:2], r.counts[3:5], strict=True)), r.counts[5], 0.0, best(found, "near"), 1.0] for r, found in spoilt if found]
    y = np.array([r.toxic for r in rows] + [1] * len(copies), float)
    weight = np.array([1.0] * len(rows) + [MISSPELLED] * len(copies))
    return Model(terms, weighed(np.array(x + copies), y, weight).tolist())


def judged(model: Model):
    """A function of a text column: struct<score, n_hits, n_near, n_quoted>."""

    @F.pandas_udf("score double, n_hits long, n_near long, n_quoted long")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.score(t) for t in texts.tolist()], columns=["score", "n_hits", "n_near", "n_quoted"])

    return judge


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits, n_near, n_quoted of each document."""
    judge = judged(fit(docs, labels))
    told = docs.select("doc_id", F.coalesce(part(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), judge(F.col("text")).alias("t"))
    return told.select("doc_id", "held_out", "t.score", (F.col("t.score") >= LIMIT).cast("int").alias("predicted"), "t.n_hits", "t.n_near", "t.n_quoted")


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The documents under the limit, with their own columns."""
    return docs.where(judged(fit(docs, labels))(F.col("text"))["score"] < limit)
