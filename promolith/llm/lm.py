"""Document log-likelihood under a gated recurrent language model.

Counts of every training token are taken over the whole table.  The GRU knows
the end token and the most frequent words; all other words share one more
class, inside which a word has its add-one count's share.  Output is factored:
a softmax over classes, then one over the words of the class.  Training is
truncated backpropagation in numpy with the state carried from window to
window; scoring carries it as well, so a document counts as a whole.

The network learns from every training row.  A bounded number of rows gives the
driver a common start; then all rows, dealt to shards of about SHARD_TOKENS
tokens by their hash, are learnt from on the executors, and the shards' weights
are averaged by their tokens.  Shards do not depend on how the input is split.

Counts of a bounded number of frequent words of bounded length are broadcast.
Rarer and longer words are joined with the count table in a shuffle, so nothing
that grows is broadcast.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HIDDEN, CLASSES, CLASS_SIZE = 16, 32, 32
KNOWN = CLASSES * CLASS_SIZE  # tokens that the network tells apart, end included
HOT_WORDS, HOT_BYTES = 1 << 17, 64  # bounds on the broadcast counts: words, and bytes of each
TRAIN_DOCS, TRAIN_TOKENS = 600, 300_000  # bounds on what the driver starts the network from
SHARD_TOKENS, SHARD_LANES, SHARD_RATE = 2_000_000, 512, 0.007  # the pass over all training rows
LANES, WINDOW, EPOCHS, RATE = 32, 32, 2, 0.01
SCORE_LANES, SCORE_WINDOW, GROUP_TOKENS = 512, 32, 4_000_000
COUNTED_AT_ONCE = 250_000
END = " "  # no word has a space
FOLDS, HELD = 7, 2

OTHER, START = KNOWN, KNOWN + 1  # inputs beyond the known tokens

RESULT = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def words_of(text: str) -> list[bytes]:
    """ASCII-lower-cased words."""
    return text.encode("utf-8").lower().split()


# ------------------------------------------------------------------- network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class GRU:
    """Parameters by name, all float32."""

    def __init__(self, counts: np.ndarray, other: float, seed: int = 7) -> None:
        """`counts`: of the known tokens by rank; `other`: of all the rest."""
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        mass = np.append(counts.reshape(CLASSES, CLASS_SIZE).sum(axis=1), other) + 1.0
        self.p = {
            "x": small(KNOWN + 2, 3 * HIDDEN), "u": small(HIDDEN, 3 * HIDDEN),
            "c": small(HIDDEN, CLASSES + 1), "cb": np.log(mass / mass.sum()).astype(np.float32),
            "w": small(CLASSES, HIDDEN, CLASS_SIZE), "wb": np.log(counts.reshape(CLASSES, CLASS_SIZE) + 1.0).astype(np.float32),
        }

    def step(self, token: np.ndarray, h: np.ndarray) -> tuple:
        """(new state, what backpropagation needs); START clears the state."""
        h = h * (token != START)[:, None]
        x, g = self.p["x"][token], h @ self.p["u"]
        zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        return n + z * (h - n), (h, z, r, n, g)

    def log_p(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of P(target | state); OTHER as a class only."""
        # no maximum is taken out: states lie in (-1, 1), so logits stay small
        logits = h @ self.p["c"]
        logits += self.p["cb"]
        cls = target // CLASS_SIZE  # OTHER is class CLASSES
        out = logits[np.arange(len(h)), cls]  # a copy, before the exponentials replace them
        out -= np.log(np.exp(logits, out=logits) @ np.ones(CLASSES + 1, logits.dtype))
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        for k in range(CLASSES):
            mine = order[edges[k] : edges[k + 1]]
            if len(mine):
                inner = h[mine] @ self.p["w"][k]
                inner += self.p["wb"][k] - self.p["wb"][k].max()
                picked = inner[np.arange(len(mine)), target[mine] % CLASS_SIZE]
                out[mine] += picked - np.log(np.exp(inner, out=inner) @ np.ones(CLASS_SIZE, inner.dtype))
        return out

    def loss_gradient(self, tokens: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Mean loss of a window, its gradient, and the state after it.

        `targets` below zero do not count.  Gradients stop at the window.
        """
        steps, lanes = tokens.shape
        kept, states = [], []
        for t in range(steps):
            h, cache = self.step(tokens[t], h)
            kept.append(cache)
            states.append(h)
        flat, y = np.concatenate(states), targets.reshape(-1)
        use = np.flatnonzero(y >= 0)
        use = use[np.argsort(y[use], kind="stable")]  # by class, and by word inside it
        f, y = flat[use], y[use]
        n = max(1, len(use))
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        cls, row = y // CLASS_SIZE, np.arange(len(y))
        edges = np.searchsorted(cls, np.arange(CLASSES + 1))
        q, loss = _softmax_error(f @ self.p["c"] + self.p["cb"], row, cls, n)
        grad["c"], grad["cb"] = f.T @ q, q.sum(axis=0)
        df = q @ self.p["c"].T
        for k in range(CLASSES):
            mine = slice(edges[k], edges[k + 1])
            if edges[k] < edges[k + 1]:
                bias = self.p["wb"][k]
                q, more = _softmax_error(f[mine] @ self.p["w"][k] + (bias - bias.max()), row[: edges[k + 1] - edges[k]], y[mine] % CLASS_SIZE, n)
                loss += more
                grad["w"][k], grad["wb"][k] = f[mine].T @ q, q.sum(axis=0)
                df[mine] += q @ self.p["w"][k].T
        d_out = np.zeros_like(flat)
        d_out[use] = df
        d_out = d_out.reshape(steps, lanes, HIDDEN)
        # what the backward steps multiply by, for all steps at a time
        before, z, r, cand, g = (np.stack(x) for x in zip(*kept))
        by_z, by_n, by_r = (before - cand) * z * (1 - z), (1 - z) * (1 - cand * cand), g[:, :, 2 * HIDDEN :] * r * (1 - r)
        goes_on, back = (tokens != START)[:, :, None], np.ascontiguousarray(self.p["u"].T)
        dh = np.zeros_like(h)
        dx, dg = np.empty((steps, lanes, 3 * HIDDEN), flat.dtype), np.empty((steps, lanes, 3 * HIDDEN), flat.dtype)
        for t in range(steps - 1, -1, -1):
            dh += d_out[t]
            dn = dx[t, :, 2 * HIDDEN :]
            np.multiply(dh, by_n[t], out=dn)
            np.multiply(dh, by_z[t], out=dx[t, :, :HIDDEN])
            np.multiply(dn, by_r[t], out=dx[t, :, HIDDEN : 2 * HIDDEN])
            dg[t] = dx[t]
            dg[t, :, 2 * HIDDEN :] *= r[t]
            dh *= z[t]
            dh += dg[t] @ back
            dh *= goes_on[t]
        grad["u"] += before.reshape(-1, HIDDEN).T @ dg.reshape(-1, 3 * HIDDEN)
        order = np.argsort(tokens.reshape(-1), kind="stable")
        seen, first = np.unique(tokens.reshape(-1)[order], return_index=True)
        grad["x"][seen] = np.add.reduceat(dx.reshape(-1, 3 * HIDDEN)[order], first, axis=0)
        return float(loss) / n, grad, h


def _softmax_error(logits: np.ndarray, row: np.ndarray, target: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Gradient by the logits (in their place) of the loss over `n`, and the summed loss."""
    np.minimum(logits, 80, out=logits)  # far from where they are; keeps the exponentials finite
    picked = logits[row, target]
    q = np.exp(logits, out=logits)
    total = q @ np.ones(q.shape[1], q.dtype)
    q *= (1 / (n * total))[:, None]
    q[row, target] -= 1 / n
    return q, (np.log(total) - picked).sum()


def lanes_of(docs: list[np.ndarray], lanes: int) -> tuple[list[list[int]], list[int]]:
    """Documents dealt to lanes, longest first to the emptiest; lane lengths, descending."""
    lanes = max(1, min(lanes, len(docs)))
    heap = [(0, k) for k in range(lanes)]
    dealt: list[list[int]] = [[] for _ in range(lanes)]
    for d in sorted(range(len(docs)), key=lambda d: (-len(docs[d]), d)):
        n, k = heapq.heappop(heap)
        dealt[k].append(d)
        heapq.heappush(heap, (n + len(docs[d]), k))
    dealt.sort(key=lambda ds: -sum(len(docs[d]) for d in ds))
    return dealt, [sum(len(docs[d]) for d in ds) for ds in dealt]


class Lanes:
    """Documents in lanes, one after the other in each.

    A document's targets are its tokens, END (token 0) last; its inputs are
    START and the tokens but the last.  Only the tokens are held, in the lanes'
    order; a window's rows are picked when it is due, so memory does not grow
    with the longest document times the lanes.

    Lanes hold whole documents, or else are `even` parts of one stream of them:
    then a lane may start inside a document, with a cleared state.
    """

    def __init__(self, docs: list[np.ndarray], lanes: int, even: bool = False) -> None:
        if even:
            order, total = list(range(len(docs))), sum(map(len, docs))
            sizes = [min(at + -(-total // lanes), total) - at for at in range(0, total, -(-total // lanes))]
        else:
            dealt, sizes = lanes_of(docs, lanes)
            order = [d for ds in dealt for d in ds]
        lengths = [len(docs[d]) for d in order]
        self.targets = np.concatenate([docs[d] for d in order]).astype(np.int32)
        self.owner = np.repeat(np.array(order, np.int32), lengths)
        self.inputs = np.concatenate([[START], self.targets[:-1]]).astype(np.int32)
        self.inputs[np.cumsum(lengths)[:-1]] = START
        self.sizes = np.array(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __len__(self) -> int:
        return int(self.sizes[0])

    def active(self, at: np.ndarray | int):
        """How many lanes are longer than `at`; they are the first ones."""
        return np.searchsorted(-self.sizes, -np.asarray(at), side="left")

    def window(self, at: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, targets) of the lanes still active, time by lane; past a lane's end START and -1."""
        a = int(self.active(at))
        t = np.arange(at, min(at + steps, len(self)))[:, None]
        there = t < self.sizes[:a]
        where = np.where(there, self.starts[:a] + t, 0)
        return np.where(there, self.inputs[where], START), np.where(there, self.targets[where], -1)


def train_network(docs: list[np.ndarray], counts: np.ndarray, other: float, epochs: int = EPOCHS, rate: float = RATE) -> GRU:
    """Adam over windows of the laid-out documents, the state carried on."""
    net = GRU(counts, other)
    learn(net, docs, epochs, rate, LANES)
    return net


def learn(net: GRU, docs: list[np.ndarray], epochs: int, rate: float, lanes: int) -> None:
    """Train `net` in place on `docs`."""
    if not docs:
        return
    laid = Lanes(docs, lanes, even=True)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    t = 0
    for epoch in range(epochs):
        h = np.zeros((len(laid.sizes), HIDDEN), np.float32)
        for at in range(0, len(laid), WINDOW):
            inputs, targets = laid.window(at, WINDOW)
            _, grad, h = net.loss_gradient(inputs, targets, h[: inputs.shape[1]])
            t += 1
            size = math.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            scale = min(1.0, 1.0 / (size + 1e-9))
            step = rate / (1 + epoch) * math.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for k, g in grad.items():
                g = g * np.float32(scale)
                m[k] += np.float32(0.1) * (g - m[k])
                v[k] += np.float32(0.001) * (g * g - v[k])
                net.p[k] -= (np.float32(step) * m[k] / (np.sqrt(v[k]) + np.float32(1e-8))).astype(np.float32)


def score_documents(net: GRU, docs: list[np.ndarray], lanes: int = SCORE_LANES, window: int = SCORE_WINDOW) -> np.ndarray:
    """Natural log-likelihood of each document, its end included."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    laid = Lanes(docs, lanes)
    h = np.zeros((len(laid.sizes), HIDDEN), np.float32)
    for at in range(0, len(laid), window):
        states, rows = [], []
        for t, a in enumerate(laid.active(np.arange(at, min(at + window, len(laid)))).tolist(), at):
            rows.append(laid.starts[:a] + t)
            h, _ = net.step(laid.inputs[rows[-1]], h[:a])
            states.append(h)
        where = np.concatenate(rows)
        out += np.bincount(laid.owner[where], net.log_p(np.concatenate(states), laid.targets[where]).astype(float), len(docs))
    return out


# --------------------------------------------------------------------- Spark


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def told():
        words = list(counts)
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in words], pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for (texts,) in common.columns(batches):
        for text in texts:
            counts.update(words_of(text))
        counts[END.encode()] += len(texts)
        if len(counts) > COUNTED_AT_ONCE:
            yield told()
    yield told()


def token_counts(df: DataFrame, text_col: str = common.TEXT) -> DataFrame:
    """word, c: how often each token stands in the table (END: once a row)."""
    common.ship(df.sparkSession)
    text = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return text.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Hot:
    """Ranks and counts of the frequent tokens: END first, then by count."""

    def __init__(self, words: list[bytes], counts: list[int]) -> None:
        self.words, self.counts = words, np.array(counts, np.int64)
        self.rank = {w: k for k, w in enumerate(words)}
        self.known = {w: k for k, w in enumerate(words[:KNOWN])}

    def __getstate__(self):
        return self.words, self.counts

    def __setstate__(self, state):
        self.__init__(state[0], state[1])

    def ranks(self, words: list[bytes]) -> np.ndarray:
        get = self.rank.get
        return np.fromiter([get(w, -1) for w in words], np.int64, len(words))

    def tokens(self, words: list[bytes]) -> np.ndarray:
        """The network's tokens, END last."""
        get = self.known.get
        return np.array([*[get(w, OTHER) for w in words], 0], np.int32)


def known_ids(ranks: np.ndarray) -> np.ndarray:
    """The network's tokens, END last."""
    return np.append(np.where((ranks >= 0) & (ranks < KNOWN), ranks, OTHER), 0).astype(np.int32)


def _score(batches: Iterator[pa.RecordBatch], broadcast) -> Iterator[pa.RecordBatch]:
    """A row for each document, and one for each distinct rare word of a document."""
    hot, net, log_other = broadcast.value
    log_c = np.log10(hot.counts + 1.0)
    row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
    group: list[tuple] = []
    size = 0
    names = ["rid", "word", "n", "doc_id", "held_out", "n_tokens", "n_hot", "hot_sum", "model"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def told():
        logs = score_documents(net, [g[-1] for g in group]) / math.log(10)
        docs = [(rid, f"{END}{rid}", None, doc_id, held, n, n_hot, hot_sum, float(log) + other_sum) for (rid, doc_id, held, n, n_hot, hot_sum, other_sum, _, _), log in zip(group, logs)]
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*docs), kinds)], names=names)
        for some in range(0, len(group), 256):
            part = group[some : some + 256]
            words = [w for g in part for w in g[-2]]
            if words:
                rids = np.repeat([g[0] for g in part], [len(g[-2]) for g in part])
                n = [k for g in part for k in g[-2].values()]
                yield pa.RecordBatch.from_arrays([pa.array(rids), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), *(pa.nulls(len(words), k) for k in kinds[3:])], names=names)

    for ids, held, texts in common.columns(batches):
        for doc_id, out, text in zip(ids, held, texts):
            words = words_of(text)
            ranks = hot.ranks(words)
            seen = ranks[ranks >= 0]
            few = Counter(words[k] for k in np.flatnonzero(ranks < 0).tolist())
            tokens = known_ids(ranks)
            hot_sum = float(log_c[seen].sum() + log_c[0])
            other = seen[seen >= KNOWN]
            other_sum = float(log_c[other].sum()) - int((tokens == OTHER).sum()) * log_other
            n_hot = len(seen) + int(hot.counts[0] > 0)
            group.append((row, doc_id, out, len(words) + 1, n_hot, hot_sum, other_sum, few, tokens))
            row += 1
            size += len(tokens)
            if size > GROUP_TOKENS:
                yield from told()
                group.clear()
                size = 0
    yield from told()


def _sample(batches: Iterator[pa.RecordBatch], broadcast) -> Iterator[pa.RecordBatch]:
    hot = broadcast.value
    for ids, texts in common.columns(batches):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([hot.tokens(words_of(t)) for t in texts], pa.list_(pa.int32()))], names=["doc_id", "tokens"])


def _dealt(batches: Iterator[pa.RecordBatch], broadcast) -> Iterator[pa.RecordBatch]:
    hot = broadcast.value
    names = ["shard", "place", "doc_id", "tokens"]
    for shards, places, ids, texts in common.columns(batches):
        tokens = [hot.tokens(words_of(t)).astype("<u2").tobytes() for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((shards, places, ids, tokens), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=names)


def _learn(batches: Iterator[pa.RecordBatch], broadcast) -> Iterator[pa.RecordBatch]:
    """For each run of rows with one shard: its weights times its tokens, and its tokens."""
    docs: list[np.ndarray] = []
    now = None

    def told():
        net = GRU.__new__(GRU)
        net.p = {k: v.copy() for k, v in broadcast.value.items()}
        learn(net, docs, 1, SHARD_RATE, SHARD_LANES)
        n = sum(map(len, docs))
        docs.clear()
        weights = np.concatenate([net.p[k].reshape(-1) for k in sorted(net.p)]).astype(float) * n
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([weights], pa.list_(pa.float64()))], names=["n", "weights"])

    for shards, tokens in common.columns(batches):
        for shard, one in zip(shards, tokens):
            if docs and shard != now:
                yield told()
            now = shard
            docs.append(np.frombuffer(one, "<u2").astype(np.int32))
    if docs:
        yield told()


def learn_all(net: GRU, train: DataFrame, broadcast, total: int) -> GRU:
    """`net` after a pass over all training rows (doc_id, text), `total` tokens.

    Each shard is learnt from by itself, from the weights of `net`; the result
    is the mean of their weights, each shard counting by its tokens.
    """
    spark = train.sparkSession
    shards = max(1, math.ceil(total / SHARD_TOKENS))
    place = F.xxhash64("doc_id", "text")
    rows = train.filter("doc_id is not null").select(F.pmod(place, F.lit(shards)).cast("long").alias("shard"), place.alias("place"), "doc_id", "text")
    dealt = rows.mapInArrow(lambda b: _dealt(b, broadcast), "shard long, place long, doc_id long, tokens binary")
    start = spark.sparkContext.broadcast(net.p)
    ordered = dealt.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "place", "doc_id").select("shard", "tokens")
    learnt = ordered.mapInArrow(lambda b: _learn(b, start), "n long, weights array<double>")
    summed = learnt.select("n", F.posexplode("weights").alias("at", "w")).groupBy("at").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).toPandas()
    if len(summed):
        mean, at = np.zeros(len(summed)), 0
        mean[summed["at"].to_numpy()] = summed["w"].to_numpy() / summed["n"].to_numpy()
        for k in sorted(net.p):
            size = net.p[k].size
            net.p[k] = mean[at : at + size].astype(np.float32).reshape(net.p[k].shape)
            at += size
    return net


def fit(train: DataFrame, hot: Hot, total: int) -> GRU:
    """The network from all training rows (doc_id, text) with an id.

    Its output starts from the counts of the whole table, and its weights from
    rows taken by the hash of their id, up to TRAIN_DOCS of them and about
    TRAIN_TOKENS tokens; `learn_all` then goes over every row.
    """
    spark = train.sparkSession
    chosen = train.filter("doc_id is not null").select(F.col("doc_id").alias("chosen")).distinct().orderBy(F.xxhash64("chosen"), "chosen").limit(TRAIN_DOCS)
    broadcast = spark.sparkContext.broadcast(hot)
    rows = train.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen")).select("doc_id", "text").dropDuplicates(["doc_id"])
    got = rows.mapInArrow(lambda b: _sample(b, broadcast), "doc_id long, tokens array<int>").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    docs, n = [], 0
    for r in got.toLocalIterator():
        if n < TRAIN_TOKENS:
            docs.append(np.array(r.tokens, np.int32))
            n += len(r.tokens)
    counts = np.zeros(KNOWN)
    counts[: len(hot.counts[:KNOWN])] = hot.counts[:KNOWN]
    return learn_all(train_network(docs, counts, total - counts.sum()), train, broadcast, total)


def score_texts(df: DataFrame, hot_words: int = HOT_WORDS, id_col: str = common.ID, text_col: str = common.TEXT) -> DataFrame:
    """Base and model log10-likelihood of every row's whole text.

    A null or empty text is its end token alone.  Rows with a null id are
    scored but not learnt from, and their held_out is null.  Without training
    rows every count is zero.  Other cases: see `common`.
    """
    spark = df.sparkSession
    common.ship(spark)
    fold = common.crc_fold("doc_id", FOLDS)
    rows = common.id_text(df, id_col, text_col)
    train = rows.filter(fold != HELD)
    counts = common.stored(token_counts(train))
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total.n or 0, total.v
    words = counts.filter(F.col("word") != END)
    ends = counts.filter(F.col("word") == END).first()
    short = F.octet_length("word") <= HOT_BYTES
    top = common.most_frequent(words.filter(short), "word", "c", hot_words, is_stored=True)
    hot = Hot([END.encode(), *(w.encode("utf-8") for w, _ in top)], [ends.c if ends else 0, *(c for _, c in top)])
    net = fit(train, hot, n)
    inside = hot.counts[:KNOWN]
    log_other = math.log10(max(1.0, float(n + v + 1 - inside.sum() - len(inside))))
    broadcast = spark.sparkContext.broadcast((hot, net, log_other))
    scored = rows.select("doc_id", (fold == HELD).alias("held_out"), "text").mapInArrow(
        lambda b: _score(b, broadcast), "rid long, word string, n long, doc_id long, held_out boolean, n_tokens long, n_hot long, hot_sum double, model double"
    )
    rare = words.filter((F.col("c") < top[-1][1]) | ~short) if top else words  # all that is not broadcast
    joined = scored.join(rare, "word", "left")
    whole = joined.groupBy("rid").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "n_hot", "hot_sum", "model")),
        F.coalesce(F.sum(F.col("n") * F.log10(F.col("c") + 1)), F.lit(0.0)).alias("rare_sum"),
        F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("n"))), F.lit(0)).alias("n_rare"),
    )
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.col("n_rare")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.col("rare_sum") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        (F.col("model") + F.col("rare_sum")).alias("score"),
    )
