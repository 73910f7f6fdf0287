"""Language-model scores: a gated recurrent network with a class-factored output over open-vocabulary counts."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentigrid.llm.common import _arrow_schema, record_batch, text_of
from sentigrid.session import stage_table

HIDDEN = 16
CLASSES = 32
PER_CLASS = 32
# Words the network tells apart; number 0 stands for all others.
KNOWN = CLASSES * PER_CLASS
# Most frequent tokens whose counts every task holds; all others meet their counts in a join.
HEAD = 1 << 18
END = b"\n"  # no word holds white space
WINDOW = 32
SCORE_LANES = 256
TRAIN_LANES = 128
# Training reads each window of each document and carries the state through; every one gives a gradient.
STEP_EVERY = 1
# Gradients are gathered until they cover so many tokens, so a window in which few documents are left weighs little.
STEP_TOKENS = 1024
ROUNDS = 2
RATE = 0.01
# Tokens a task gathers before it runs the network over them.
GATHER = 4_000_000


def held_out(id_col: str):
    """Whether a row is kept from learning: crc32 of its id as text, modulo 5, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over all rows; texts are counted per batch before anything moves."""
    schema = _arrow_schema(docs.sparkSession.createDataFrame([], "token binary, n bigint").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0):
                seen.update(text.as_py().lower().split())
                seen[END] += 1
                if len(seen) > 1_000_000:
                    yield record_batch(list(seen.items()), schema)
                    seen = Counter()
            if seen:
                yield record_batch(list(seen.items()), schema)

    return docs.select("t").mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("c"))


class Vocabulary:
    """Counts of the head, their numbers in the network, and the totals of the whole vocabulary."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int) -> None:
        self.rank = {token: i for i, (token, _) in enumerate(head)}
        count = np.array([c for _, c in head], np.float64)
        self.total, self.distinct = total, distinct
        self.mass = total + 0.5 * (distinct + 1)
        self.count = count
        in_net = min(len(head), KNOWN - 1)
        self.other = self.mass - float((count[:in_net] + 0.5).sum())
        self.base = np.log10((count + 0.5) / self.mass)
        self.share = np.log10((count + 0.5) / self.other)  # within "all others"
        self.number = np.where(np.arange(len(head)) < in_net, np.arange(len(head)) + 1, 0).astype(np.int16)
        self.weight = np.zeros(KNOWN)
        self.weight[0] = self.other
        self.weight[1:in_net + 1] = count[:in_net] + 0.5


def initial(vocabulary: Vocabulary, seed: int = 0) -> dict[str, np.ndarray]:
    """A network that starts as the unigram model: the biases are the logarithms of the counts."""
    rng = np.random.default_rng(seed)
    p = np.maximum(vocabulary.weight / vocabulary.mass, 1e-13).reshape(CLASSES, PER_CLASS)
    group = p.sum(axis=1)
    model = {
        "x": rng.normal(0, 0.3, (KNOWN, 3 * HIDDEN)), "u": rng.normal(0, 0.25, (HIDDEN, 3 * HIDDEN)),
        "xb": np.concatenate([np.full(HIDDEN, 1.0), np.zeros(2 * HIDDEN)]),
        "cw": np.zeros((HIDDEN, CLASSES)), "cb": np.log(group),
        "ww": np.zeros((CLASSES, HIDDEN, PER_CLASS)), "wb": np.log(p / group[:, None]),
    }
    return {k: v.astype(np.float32) for k, v in model.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def lanes_of(sizes: list[int], lanes: int) -> list[list[int]]:
    """Documents dealt to lanes of about equal length, longest lane first."""
    heap = [(0, i, []) for i in range(max(1, min(lanes, len(sizes))))]
    for doc in sorted(range(len(sizes)), key=lambda d: -sizes[d]):
        load, i, own = heapq.heappop(heap)
        own.append(doc)
        heapq.heappush(heap, (load + sizes[doc], i, own))
    return [own for _, _, own in sorted(heap, key=lambda x: (-x[0], x[1]))]


def windows(texts: list[np.ndarray], lanes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers, starts, documents) of consecutive windows: rows are steps, columns the lanes still running.

    `documents` is -1 behind a lane's end; a lane keeps its column, so the state can be carried on.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    dealt = lanes_of(sizes.tolist(), lanes)
    order = [d for own in dealt for d in own]
    if not order:
        return
    flat, which = np.concatenate([texts[d] for d in order]), np.repeat(order, sizes[order])
    first = np.ones(len(flat), bool)
    first[1:] = which[1:] != which[:-1]
    length = np.array([sizes[own].sum() for own in dealt])
    offset = np.cumsum(length) - length
    for at in range(0, int(length[0]), WINDOW):
        n = int((length > at).sum())
        step = at + np.arange(min(WINDOW, int(length[0]) - at))[:, None]
        live = step < length[:n]
        place = np.where(live, offset[:n] + step, 0)
        yield np.where(live, flat[place], 0).astype(np.int16), first[place] | ~live, np.where(live, which[place], -1)


def run_window(model: dict, numbers: np.ndarray, start: np.ndarray, h: np.ndarray, keep: bool) -> tuple:
    """States before each step, the state after the window, and what the way back needs."""
    steps, n = numbers.shape
    states = np.empty((steps, n, HIDDEN), np.float32)
    trace = np.empty((4, steps, n, HIDDEN), np.float32) if keep else None
    inputs, resets = model["x"] + model["xb"], start.any(axis=1)
    for t in range(steps):
        if resets[t]:
            h = h * ~start[t][:, None]
        states[t] = h
        a = inputs.take(numbers[t], axis=0)
        u = h @ model["u"]
        gates = _sigmoid(a[:, :2 * HIDDEN] + u[:, :2 * HIDDEN])
        z, r, un = gates[:, :HIDDEN], gates[:, HIDDEN:], u[:, 2 * HIDDEN:]
        new = np.tanh(a[:, 2 * HIDDEN:] + r * un)
        if keep:
            trace[0, t], trace[1, t], trace[2, t], trace[3, t] = z, r, un, new
        h = new + z * (h - new)
    return states, h, trace


def _log_softmax(logits: np.ndarray, at: np.ndarray, grad: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Of columns of logits, in place: each column's entry at `at`, and the gradient of the mean loss."""
    columns = np.arange(logits.shape[1])
    logits -= logits.max(axis=0)
    picked = logits[at, columns]
    np.exp(logits, out=logits)
    norm = logits.sum(axis=0)
    logp = picked - np.log(norm)
    if not grad:
        return logp, None
    logits /= norm
    logits[at, columns] -= 1
    logits /= len(at)
    return logp, logits


def output(model: dict, states: np.ndarray, target: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural-log probability of each target: its class, then the word within the class.

    Columns are targets, so sums run over long rows. Targets are grouped by class for the products; all else is done for all
    classes at once. With `grad`, gradients of the mean loss are added to it and those of the states returned.
    """
    group = (target // PER_CLASS).astype(np.int16)
    order = np.argsort(group, kind="stable")
    group, word, own = group[order], (target % PER_CLASS)[order], states[order]
    bound = np.searchsorted(group, np.arange(CLASSES + 1))
    used = [(c, slice(bound[c], bound[c + 1])) for c in range(CLASSES) if bound[c] < bound[c + 1]]
    to_class, back_class = _log_softmax(model["cw"].T @ own.T + model["cb"][:, None], group, grad is not None)
    logits = np.empty((PER_CLASS, len(target)), own.dtype)
    for c, at in used:
        logits[:, at] = model["ww"][c].T @ own[at].T + model["wb"][c][:, None]
    to_word, back_word = _log_softmax(logits, word, grad is not None)
    logp = np.empty(len(target), to_word.dtype)
    logp[order] = to_class + to_word
    if grad is None:
        return logp, None
    grad["cw"] += (back_class @ own).T
    grad["cb"] += back_class.sum(axis=1)
    to_state = back_class.T @ model["cw"].T
    for c, at in used:
        grad["ww"][c] += (back_word[:, at] @ own[at]).T
        grad["wb"][c] += back_word[:, at].sum(axis=1)
        to_state[at] += back_word[:, at].T @ model["ww"][c].T
    back = np.empty_like(to_state)
    back[order] = to_state
    return logp, back


def gradients(model: dict, numbers: np.ndarray, start: np.ndarray, live: np.ndarray, states: np.ndarray, trace: np.ndarray) -> tuple[dict, float]:
    """Gradients by backpropagation through one window, and its mean loss; what lies before the window is cut off."""
    grad = {k: np.zeros_like(v) for k, v in model.items()}
    flat = live.ravel()
    logp, back = output(model, states.reshape(-1, HIDDEN)[flat], numbers.ravel()[flat].astype(np.int64), grad)
    to_state = np.zeros((flat.size, HIDDEN), np.float32)
    to_state[flat] = back
    to_state = to_state.reshape(states.shape)
    steps, n = numbers.shape
    z, r, un, new = trace
    # what each gate's gradient takes of the state's, for all steps at once
    of_new = (1 - z) * (1 - new * new)
    of_z = (states - new) * z * (1 - z)
    of_r = un * r * (1 - r)
    go_on, resets = ~start[:, :, None], start.any(axis=1)
    to_input = np.empty((steps, n, 3 * HIDDEN), np.float32)
    du = np.empty((steps, n, 3 * HIDDEN), np.float32)
    dh, u_back = np.zeros((n, HIDDEN), np.float32), np.ascontiguousarray(model["u"].T)
    for t in range(steps - 1, -1, -1):
        da, own = dh * of_new[t], du[t]
        own[:, :HIDDEN] = dh * of_z[t]
        own[:, HIDDEN:2 * HIDDEN] = da * of_r[t]
        own[:, 2 * HIDDEN:] = da * r[t]
        to_input[t, :, 2 * HIDDEN:] = da
        dh = dh * z[t] + own @ u_back + to_state[t]
        if resets[t]:
            dh *= go_on[t]
    to_input[:, :, :2 * HIDDEN] = du[:, :, :2 * HIDDEN]
    grad["u"] = states.reshape(-1, HIDDEN).T @ du.reshape(-1, 3 * HIDDEN)
    flat_in = to_input.reshape(-1, 3 * HIDDEN) * flat[:, None]
    order = np.argsort(numbers.ravel(), kind="stable")
    used, first = np.unique(numbers.ravel()[order], return_index=True)
    grad["x"][used] = np.add.reduceat(flat_in[order], first, axis=0)
    grad["xb"] = flat_in.sum(axis=0)
    return grad, -float(logp.mean())


class _Descent:
    """Adam steps with the gradient's length bounded."""

    def __init__(self, model: dict) -> None:
        self.m = {k: np.zeros_like(v) for k, v in model.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.items()}
        self.t, self.count, self.sum = 0, 0, None

    def add(self, model: dict, grad: dict, tokens: int) -> int:
        """Takes a window's mean gradient; a step once enough tokens have met. The number of steps."""
        grad = {k: g * tokens for k, g in grad.items()}
        self.sum = grad if self.sum is None else {k: self.sum[k] + g for k, g in grad.items()}
        self.count += tokens
        if self.count < STEP_TOKENS:
            return 0
        self.step(model, {k: g / self.count for k, g in self.sum.items()})
        self.count, self.sum = 0, None
        return 1

    def flush(self, model: dict) -> float:
        """A last step for the tokens left over; the share of a whole step they count for."""
        if not self.count:
            return 0.0
        share = self.count / STEP_TOKENS
        self.step(model, {k: g / self.count for k, g in self.sum.items()})
        self.count, self.sum = 0, None
        return share

    def step(self, model: dict, grad: dict) -> None:
        self.t += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        scale = min(1.0, 1.0 / max(size, 1e-9))
        rate = RATE * np.sqrt(1 - 0.99 ** self.t) / (1 - 0.9 ** self.t)
        for k, g in grad.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            model[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-6)


def learn(model: dict, texts: list[np.ndarray], descent: _Descent) -> int:
    """Goes through the texts once, in place; the number of steps taken."""
    h, steps = None, 0
    for i, (numbers, start, docs) in enumerate(windows(texts, TRAIN_LANES)):
        n = numbers.shape[1]
        h = np.zeros((n, HIDDEN), np.float32) if h is None else h[:n]
        stepping = i % STEP_EVERY == 0
        states, h, trace = run_window(model, numbers, start, h, stepping)
        if stepping:
            live = docs >= 0
            steps += descent.add(model, gradients(model, numbers, start, live, states, trace)[0], int(live.sum()))
    return steps


def log10_probability(model: dict, texts: list[np.ndarray]) -> np.ndarray:
    """Of each whole text; the state is carried from window to window."""
    total, h = np.zeros(len(texts)), None
    for numbers, start, docs in windows(texts, SCORE_LANES):
        n = numbers.shape[1]
        h = np.zeros((n, HIDDEN), np.float32) if h is None else h[:n]
        states, h, _ = run_window(model, numbers, start, h, False)
        live = (docs >= 0).ravel()
        logp, _ = output(model, states.reshape(-1, HIDDEN)[live], numbers.ravel()[live].astype(np.int64))
        total += np.bincount(docs.ravel()[live], logp, len(texts))
    return total / np.log(10.0)


def numbered(docs: DataFrame, vocabulary) -> DataFrame:
    """Texts cut into tokens once, as a staged table: what the counts of the head give, the network's numbers of all
    tokens, and the tokens outside the head with their counts. `vocabulary` is broadcast."""
    made = ("doc bigint, out boolean, n_tokens bigint, n_known bigint, base double, share double, numbers binary, "
            "rest array<struct<token: binary, n: bigint>>")
    schema = _arrow_schema(docs.sparkSession.createDataFrame([], made).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        numbers = np.append(words.number, np.int16(0))  # rank -1, outside the head, is number 0
        for batch in batches:
            rows, size = [], 0
            for doc, out, text in zip(*batch.columns):
                tokens = text.as_py().lower().split()
                tokens.append(END)
                found = np.array([words.rank.get(w, -1) for w in tokens], np.int32)
                own, known = numbers[found], found[found >= 0]
                rest = Counter([tokens[i] for i in np.flatnonzero(found < 0)])
                rows.append((doc.as_py(), out.as_py(), len(found), len(known), float(words.base[known].sum()),
                             float(words.share[found[(found >= 0) & (own == 0)]].sum()), own.astype("<i2").tobytes(),
                             [{"token": k, "n": n} for k, n in rest.items()]))
                size += len(found)
                if size >= GATHER or len(rows) >= 1000:
                    yield record_batch(rows, schema)
                    rows, size = [], 0
            if rows:
                yield record_batch(rows, schema)

    made_rows = docs.select("doc", "out", "t").mapInArrow(run, made)
    return stage_table(made_rows.withColumn("id", F.monotonically_increasing_id()), "numbers")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[list], list[np.ndarray]]]:
    """Rows without their last column, and the numbers in it, by about GATHER tokens."""
    rows, texts, size = [], [], 0
    for batch in batches:
        for *keys, raw in zip(*batch.columns):
            rows.append([k.as_py() for k in keys])
            texts.append(np.frombuffer(raw.as_py(), "<i2"))
            size += len(texts[-1])
            if size >= GATHER:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _dump(model: dict) -> bytes:
    return b"".join(model[k].astype("<f4").tobytes() for k in sorted(model))


def _load(raw: bytes, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = np.frombuffer(raw, "<f4", n, 4 * at).reshape(like[k].shape).copy()
        at += n
    return out


def _average(models: DataFrame, rows: int) -> bytes | None:
    """The mean of the tasks' networks, weighted by steps, over a tree of tasks: 16 meet in one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = None, 0.0
        for batch in batches:
            for raw, w in zip(batch.column(0), batch.column(1)):
                own = np.frombuffer(raw.as_py(), "<f4").astype(np.float64) * w.as_py()
                total, weight = own if total is None else total + own, weight + w.as_py()
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([(total / weight).astype("<f4").tobytes()], pa.binary()),
                                              pa.array([weight], pa.float64())], names=["model", "w"])

    while rows > 1:
        rows = -(-rows // 16)
        models = models.repartition(rows).mapInArrow(run, "model binary, w double")
    row = models.first()
    return bytes(row[0]) if row else None


def train(docs: DataFrame, vocabulary: Vocabulary, seed: int = 0) -> dict:
    """The network learned from texts (doc, t), all of them training documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return train_numbered(numbered(docs.withColumn("out", F.lit(False)), shared), vocabulary, seed)


def train_numbered(rows: DataFrame, vocabulary: Vocabulary, seed: int = 0) -> dict:
    """Rounds of local descent: every task learns from its own documents, then the networks are averaged.

    Each training document belongs to one round and is read there whole, in windows with the state carried on.
    """
    context = rows.sparkSession.sparkContext
    model = initial(vocabulary, seed)
    like = dict(model)
    for number in range(ROUNDS):
        current = context.broadcast(_dump(model))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, steps = _load(current.value, like), 0.0
            descent = _Descent(own)
            for _, texts in _gathered(batches):
                steps += learn(own, texts, descent)
            steps += descent.flush(own)
            if steps and all(np.isfinite(v).all() for v in own.values()):
                yield pa.RecordBatch.from_arrays([pa.array([_dump(own)], pa.binary()), pa.array([steps])], names=["model", "w"])

        mine = rows.filter(~F.col("out") & (F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(ROUNDS)) == number)).select("numbers")
        trained = stage_table(mine.mapInArrow(run, "model binary, w double"), "networks")
        mean = _average(trained, trained.count())
        if mean:
            model = _load(mean, like)
    return model


def most_frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The HEAD most frequent tokens, ties by token.

    Counts are first put in about five hundred bins by size; only tokens from the bin of the last one on are sorted, so
    the sort reads the head and one bin, not a head from every task.
    """
    size = F.floor(F.log2("c") * 8)
    bins = sorted(((r[0], r[1]) for r in counts.groupBy(size.alias("b")).count().collect()), reverse=True)
    met, least = 0, 0
    for least, n in bins:
        met += n
        if met >= HEAD:
            break
    head = counts.filter(size >= least).orderBy(F.desc("c"), "token").limit(HEAD).toArrow()
    return list(zip(head["token"].to_pylist(), head["c"].to_pylist()))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are the words, ASCII-lower-cased, and one end. Counts cover every training document. The
    unigram base and the network share them: the network tells the 1,023 most frequent tokens apart and gives all
    others one probability, which their counts divide. It starts as that unigram model and learns what
    the state adds. Counts of the most frequent 2^18 tokens are in every task; the rest meet theirs in a join, so no
    task holds the vocabulary.

    A null or empty text is the end alone. Null ids belong to the training part; repeated rows are scored one by one and counted
    each; without training rows all counts are 0; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), held_out(id_col).alias("out"),
                       text_of(text_col).cast("binary").alias("t"))
    learning = rows.filter(~F.col("out"))
    counts = stage_table(token_counts(learning), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    vocabulary = Vocabulary(most_frequent(counts), total, distinct)
    context = docs.sparkSession.sparkContext
    texts = numbered(rows, context.broadcast(vocabulary))
    network = context.broadcast(train_numbered(texts, vocabulary, seed))
    kept = ["id", "doc", "out", "n_tokens", "n_known", "base", "share"]
    made = "id bigint, doc bigint, out boolean, n_tokens bigint, n_known bigint, base double, score double"
    schema = _arrow_schema(docs.sparkSession.createDataFrame([], made).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in _gathered(batches):
            scores = log10_probability(network.value, own)
            out = [(*row[:-1], row[-1] + float(p)) for row, p in zip(part, scores)]
            for at in range(0, len(out), 10_000):
                yield record_batch(out[at:at + 10_000], schema)

    scored = texts.select(*kept, "numbers").mapInArrow(run, made)
    tail = texts.select("id", F.explode("rest").alias("r")).select("id", "r.token", "r.n")
    met = tail.join(counts, "token", "left")
    c = F.coalesce("c", F.lit(0))
    sums = met.groupBy("id").agg(F.sum("n").alias("n"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"),
                                 F.sum(F.col("n") * F.log10(c + 0.5)).alias("logs"))
    joined = scored.join(sums, "id", "left")
    n, logs = F.coalesce("n", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return joined.select(
        F.col("doc").alias("doc_id"), F.col("out").alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs - n * float(np.log10(vocabulary.mass))).alias("base_score"),
        (F.col("score") + logs - n * float(np.log10(vocabulary.other))).alias("score"))
