"""Toxicity scores: Levenshtein automata over a lexicon trie, with context.

The lexicon is learnt from labelled rows: whole words, and stems that count in
longer words.  Its trie is intersected with Levenshtein automata into one
automaton, determinised lazily, that a word runs through letter by letter, so
misspelled terms are caught.  A hit's window separates quotation (quotation
marks, reporting verbs) from abuse (address in the second person); both enter a
logistic model with the hits' evidence.  Inputs of a score are the text alone.
"""

from __future__ import annotations

import functools
import json
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TRAINING_ROWS = 8_000  # bound on the labelled rows that are learnt from
LEXICON_TERMS = 200
WINDOW = 6
MEMO_WORDS = 200_000
FOLDS = 5  # rows with crc32(id) % FOLDS == 0 are held out

# What the context window looks for.
ADDRESS = frozenset("you your yours you're youre yourself u ur tu toi ton te vous votre usted vosotros du dich dir dein deine euch euer".split())
REPORTS = frozenset("said says say saying wrote writes called calls quote quoted quotes reported report reports told claims claimed according dijo dice dit sagte sagt schrieb".split())
QUOTES = "\"“”„«»‘’'`"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”„«»‘’…¿¡"

RESULT = "doc_id long, held_out boolean, score double, predicted int"


def words_of(text: str) -> list[str]:
    return text.lower().split()


class Lexicon:
    """Terms with weights, and the automaton that finds them in words."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], clean: set[str]) -> None:
        self.words, self.stems, self.clean = words, stems, clean
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.room: list[int] = [0]  # most edits that a term below allows
        for w in sorted(words):
            at, allowed = 0, self.edits(w)
            self.room[0] = max(self.room[0], allowed)
            for c in w:
                down = self.children[at].get(c)
                if down is None:
                    down = len(self.children)
                    self.children[at][c] = down
                    self.children.append({})
                    self.term.append(None)
                    self.room.append(0)
                at = down
                self.room[at] = max(self.room[at], allowed)
            self.term[at] = w
        self.sizes = sorted({len(s) for s in stems})
        start = self._closed({0: 0})
        self.numbers: dict[tuple, int] = {(): 0, start: 1}
        self.states: list[tuple] = [(), start]
        self.arcs: dict[tuple[int, str], int] = {}
        self.accepts: list[tuple[str, int] | None] = [None, self._accept(start)]
        self.memo: dict[str, tuple[str, int] | None] = {}

    @staticmethod
    def edits(term: str) -> int:
        """Edits allowed: a term of four letters or fewer has to be exact."""
        return 0 if len(term) < 5 else 1 if len(term) < 10 else 2

    def _closed(self, nodes: dict[int, int]) -> tuple:
        """Nodes with least edits; a letter of the term may be left out."""
        todo = list(nodes.items())
        while todo:
            at, e = todo.pop()
            if nodes[at] < e:
                continue
            for down in self.children[at].values():
                if e + 1 <= self.room[down] and nodes.get(down, 9) > e + 1:
                    nodes[down] = e + 1
                    todo.append((down, e + 1))
        return tuple(sorted(nodes.items()))

    def _accept(self, state: tuple) -> tuple[str, int] | None:
        found = [(e, self.term[at]) for at, e in state if self.term[at] is not None and e <= self.edits(self.term[at])]
        return (lambda x: (x[1], x[0]))(min(found)) if found else None

    def _step(self, number: int, letter: str) -> int:
        nodes: dict[int, int] = {}

        def reach(at: int, e: int) -> None:
            if e <= self.room[at] and nodes.get(at, 9) > e:
                nodes[at] = e

        for at, e in self.states[number]:
            reach(at, e + 1)  # a letter too many
            for c, down in self.children[at].items():
                reach(down, e + (c != letter))
        state = self._closed(nodes)
        new = self.numbers.get(state)
        if new is None:
            new = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.accepts.append(self._accept(state))
        self.arcs[number, letter] = new
        return new

    def fuzzy(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term within its edits."""
        at = 1
        for c in word:
            down = self.arcs.get((at, c))
            if down is None:
                if len(self.arcs) > 500_000:  # keeps the memory bounded
                    self.arcs.clear()
                down = self._step(at, c)
            if not down:
                return None
            at = down
        return self.accepts[at]

    def find(self, word: str) -> tuple[str, str, int] | None:
        """(kind, term, edits) of what a word counts as."""
        bare = word.strip(PUNCTUATION)
        if bare in self.words:
            return "word", bare, 0
        for n in self.sizes:
            if len(bare) > n and bare[:n] in self.stems:
                return "stem", bare[:n], 0
        if bare in self.clean or len(bare) < 4:
            return None
        hit = self.fuzzy(bare)
        return ("fuzzy", *hit) if hit else None

    def hit(self, word: str):
        try:
            return self.memo[word]
        except KeyError:
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            found = self.memo[word] = self.find(word)
            return found


FEATURES = ("bias", "words", "stems", "fuzzy", "addressed", "quoted", "weight", "any")


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The model's inputs for one text; all but the bias are zero without hits."""
    words = words_of(text)
    hit = lexicon.hit
    hits = [(k, h) for k, h in enumerate(map(hit, words)) if h is not None]
    n = Counter()
    seen: dict[tuple[str, str], float] = {}
    for k, (kind, term, edits) in hits:
        window = words[max(0, k - WINDOW) : k + WINDOW + 1]
        bare = [w.strip(PUNCTUATION) for w in window]
        before = " ".join(words[max(0, k - WINDOW) : k]) + " " + words[k][: len(words[k]) - len(words[k].lstrip(QUOTES))]
        inside = sum(before.count(q) for q in "\"“„«”»") % 2 == 1
        quoted = inside or any(w in REPORTS for w in bare)
        addressed = any(w in ADDRESS for w in bare)
        worth = (lexicon.words.get(term) if kind != "stem" else lexicon.stems.get(term)) or 0.0
        worth *= (1.0 if kind != "fuzzy" else 0.6) * (0.5 if quoted and not addressed else 1.0)
        seen[kind, term] = max(worth, seen.get((kind, term), 0.0))
        n[kind] += 1
        n["quoted"] += quoted and not addressed
        n["addressed"] += addressed
    return [1.0, math.log1p(n["word"]), math.log1p(n["stem"]), math.log1p(n["fuzzy"]), math.log1p(n["addressed"]), math.log1p(n["quoted"]), min(sum(seen.values()), 12.0), float(bool(hits))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton's method with a ridge that leaves the bias alone."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + move
        if np.abs(move).max() < 1e-9:
            break
    return w


# ------------------------------------------------------------------- learning


def training_labels(labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """label_id, toxic of at most `rows` labelled rows outside the held-out fold."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (common.crc_fold("doc_id", FOLDS) != 0))
    one = usable.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("is_toxic"))
    return one.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean texts hold a word (w...) or go on from a stem (s...)."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for texts, toxic in common.columns(batches):
        for text, y in zip(texts, toxic):
            found = set()
            for w in {w.strip(PUNCTUATION) for w in words_of(text)}:
                if 3 <= len(w) <= 40:
                    found.add("w" + w)
                    found.update("s" + w[:n] for n in range(4, min(len(w), 9)))
            counts[1 if y else 0].update(found)
    terms = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "toxic_n", "clean_n"])


def choose_terms(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int, most: int = LEXICON_TERMS) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their log odds; a stem inside a chosen one is left out."""
    def odds(a: int, b: int) -> float:
        return math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))

    ranked = sorted(((a * odds(a, b), t, a, b) for t, a, b in rows if a >= 4 and odds(a, b) >= 2.0), key=lambda x: (-x[0], x[1]))
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    for _, t, a, b in ranked:
        if len(words) + len(stems) >= most:
            break
        kind, body = t[0], t[1:]
        if any(body.startswith(s) and body != s for s in stems):
            continue
        if kind == "w":
            words[body] = odds(a, b)
        elif not any(w.startswith(body) and w != body for w in words) and not any(s.startswith(body) for s in stems):
            stems[body] = odds(a, b)
    return words, stems


class Model:
    """What scoring needs, as plain values."""

    def __init__(self, words: dict, stems: dict, clean: list[str], weights: list[float]) -> None:
        self.told = json.dumps([words, stems, clean, weights], sort_keys=True)

    def parts(self) -> tuple[Lexicon, np.ndarray]:
        return _parts(self.told)


@functools.lru_cache(2)
def _parts(told: str) -> tuple[Lexicon, np.ndarray]:
    words, stems, clean, weights = json.loads(told)
    return Lexicon(words, stems, set(clean)), np.array(weights)


def _feature_rows(batches: Iterator[pa.RecordBatch], told: str) -> Iterator[pa.RecordBatch]:
    lexicon, _ = _parts(told)
    for texts, toxic in common.columns(batches):
        x = [features(t, lexicon) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(toxic, pa.int32())], names=["x", "y"])


def _clean_neighbours(batches: Iterator[pa.RecordBatch], told: str) -> Iterator[pa.RecordBatch]:
    """Words of clean texts that the automaton would take for a misspelled term."""
    lexicon, _ = _parts(told)
    for texts, toxic in common.columns(batches):
        found = set()
        for text, y in zip(texts, toxic):
            if not y:
                found.update(w.strip(PUNCTUATION) for w in words_of(text) if (h := lexicon.hit(w)) and h[0] == "fuzzy")
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])


def fit(df: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, id_col: str = common.ID, text_col: str = common.TEXT) -> Model:
    """Learn lexicon and weights from a bounded sample of labelled rows.

    Repeated ids are folded: the smallest text counts, and one toxic label is
    enough; null ids and null labels are left out.  Without a labelled row of both classes the lexicon is empty and every score
    is the share of toxic labels (0 without labels).
    """
    common.ship(df.sparkSession)
    wanted = training_labels(labels, rows)
    sample = common.stored(
        common.id_text(df, id_col, text_col).join(F.broadcast(wanted), F.col("doc_id") == F.col("label_id"))
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("is_toxic").cast("int").alias("y")).select("text", "y")
    )
    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        common.drop_stored(sample)
        share = n_toxic / (n_toxic + n_clean) if n_toxic + n_clean else 0.0
        bias = math.log((share + 1e-9) / (1 - share + 1e-9))
        return Model({}, {}, [], [bias, *[0.0] * (len(FEATURES) - 1)])
    counted = sample.mapInArrow(_terms, "term string, toxic_n long, clean_n long").groupBy("term").agg(F.sum("toxic_n").alias("a"), F.sum("clean_n").alias("b"))
    strong = counted.filter(F.col("a") >= 4).withColumn("odds", F.log((F.col("a") + 0.5) / (n_toxic + 1)) - F.log((F.col("b") + 0.5) / (n_clean + 1))).filter("odds >= 1.9")
    top = strong.orderBy(F.desc(F.col("a") * F.col("odds")), "term").limit(20 * LEXICON_TERMS)
    words, stems = choose_terms([(r.term, r.a, r.b) for r in top.collect()], n_toxic, n_clean)
    draft = Model(words, stems, [], []).told
    # all of them: they are words of the bounded sample that lie within the edits of a bounded lexicon
    clean = sorted(r.word for r in sample.mapInArrow(lambda b: _clean_neighbours(b, draft), "word string").distinct().collect())
    draft = Model(words, stems, clean, []).told
    got = sample.mapInArrow(lambda b: _feature_rows(b, draft), "x array<double>, y int").collect()
    got.sort(key=lambda r: (r.y, r.x))  # at most `rows` of them; the sums do not depend on the tasks' order
    weights = fit_logistic(np.array([r.x for r in got]), np.array([r.y for r in got], float))
    common.drop_stored(sample)
    return Model(words, stems, clean, weights.tolist())


def probability(text: str, lexicon: Lexicon, weights: np.ndarray) -> float:
    z = float(np.dot(features(text, lexicon), weights))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _score(batches: Iterator[pa.RecordBatch], told: str) -> Iterator[pa.RecordBatch]:
    lexicon, weights = _parts(told)
    for ids, held, texts in common.columns(batches):
        p = [probability(t, lexicon, weights) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])


def _drop(batches: Iterator[pa.RecordBatch], told: str, at: int) -> Iterator[pa.RecordBatch]:
    lexicon, weights = _parts(told)
    for batch in batches:
        yield batch.filter(pa.array([probability(t.as_py() or "", lexicon, weights) < 0.5 for t in batch.column(at)], pa.bool_()))


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = common.ID, text_col: str = common.TEXT) -> DataFrame:
    """doc_id, held_out, score in [0, 1] and predicted (score >= 0.5) of each row.

    Texts without a hit, empty ones included, get the model's score for no
    evidence.  held_out is null for a null id; other cases: see `common`.
    """
    told = fit(df, labels, id_col=id_col, text_col=text_col).told
    rows = common.id_text(df, id_col, text_col).select("doc_id", (common.crc_fold("doc_id", FOLDS) == 0).alias("held_out"), "text")
    return rows.mapInArrow(lambda b: _score(b, told), RESULT)


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = common.ID, text_col: str = common.TEXT) -> DataFrame:
    """The rows of `df` predicted clean, whole and without a join.

    Null and empty texts are clean as far as the model's bias says so; rows
    with a null id and repeated rows are each judged by their text.
    """
    told = fit(df, labels, id_col=id_col, text_col=text_col).told
    at = df.columns.index(text_col)
    return df.mapInArrow(lambda b: _drop(b, told, at), df.schema)
