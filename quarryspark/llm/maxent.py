"""LM scoring by a hashed maximum-entropy model with class-factored softmax.

The probability of a token is P(class | context) * P(word | class, context) * P(token | word). A word of the
model is one of the ``WORDS`` most frequent tokens or one of ``SHAPES`` groups of the others by their ending;
within a group, tokens have add-half relative frequencies. Both softmax factors are maximum-entropy models
whose features (n-grams of the last words and classes, and skips over them) are hashed into a table of weight rows.

Training covers every token of the training documents. A context matters only through a bounded number of
codes, so the events are counted exactly for each (code, outcome), and each gradient over the whole corpus is
computed from those counts, in parallel over blocks of codes; the driver sums the blocks' gradients and updates
the weights. Scoring computes the distributions of the contexts that a batch holds, once each, in numpy.

Texts are split for the counts, and once more for the numbers of their words, which all later passes read.
Counts of tokens cover everything too. Tokens above a count that at most ``HEAD`` tokens reach are looked up
in a broadcast table of that bounded size; all others are joined with the full table of counts.

Defined results: a null text is an empty text, of one token, the end; a null id counts as the empty text in
the fold; repeated rows are scored alike, and train once each; without training documents all counts are
zero and the model is uniform over its words; an empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_fold, written

#: Words of the model that are tokens, and groups of all other tokens.
WORDS, SHAPES = 1024, 256
#: Tokens looked up in a broadcast table at most.
HEAD = 200_000
#: Last words told apart in a context; clusters of words, coarse groups of clusters; most words in a class.
LAST, CLUSTERS, COARSE, CLASS_WORDS = 1024, 20, 8, 64
#: Weight rows of the two hashed tables; blocks of codes; gradient steps.
ROWS, BLOCKS, STEPS = (1 << 13, 1 << 13), 6, 12
END, PAD = b"\n", WORDS + SHAPES
_ENDINGS = b".,;:!?#$%&*|)\"'"


def _pieces(text: str | None):
    """Lists of the lower-cased tokens of a text, in order; the last ends with the end token. Long texts come in parts."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    at = 0
    while len(raw) - at > 1 << 20:
        cut = at + (1 << 20)
        while cut < len(raw) and raw[cut] not in b" \t\n\x0b\x0c\r":
            cut += 1
        yield raw[at:cut].split()
        at = cut
    yield [*raw[at:].split(), END]


def shape(token: bytes) -> int:
    """The group of a token: by its last bytes, less marks at its end, and whether there were any."""
    bare = token.rstrip(_ENDINGS)
    return zlib.crc32(bare[-3:] + (b"0" if len(bare) == len(token) else b"1")) % SHAPES


# --- counts -----------------------------------------------------------------------------------------------


def _count_tokens(batches):
    seen: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])
        seen.clear()
        return out

    for batch in batches:
        for text in batch.column("text"):
            for tokens in _pieces(text.as_py()):
                seen.update(tokens)
            if len(seen) > 150_000:
                yield flush()
    if seen:
        yield flush()


def _count_shapes(batches):
    counts, kinds = np.zeros(SHAPES, dtype=np.int64), np.zeros(SHAPES, dtype=np.int64)
    for batch in batches:
        at = np.array([shape(t) for t in batch.column("token").to_pylist()], dtype=np.int64)
        counts += np.bincount(at, batch.column("c").to_numpy(zero_copy_only=False), SHAPES).astype(np.int64)
        kinds += np.bincount(at, minlength=SHAPES)
    yield pa.RecordBatch.from_arrays([pa.array(range(SHAPES)), pa.array(counts), pa.array(kinds)], names=["shape", "c", "v"])


class Vocabulary:
    """The bounded tables that tokens are looked up in: model words and log10(count + 1/2) of head tokens."""

    def __init__(self, tokens: list[bytes], counts: list[int]):
        self.of = {t: k for k, t in enumerate(tokens)}
        self.word = np.array([k if k < WORDS else WORDS + shape(t) for k, t in enumerate(tokens)], dtype=np.int16)
        self.log_count = np.log10(np.array(counts, dtype=np.float64) + 0.5)

    def look_up(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Model words; places in the head, -1 if outside; positions of those outside."""
        at = np.fromiter(map(self.of.get, tokens, repeat(-1)), dtype=np.int32, count=len(tokens))
        outside = np.flatnonzero(at < 0)
        words = self.word[at] if len(self.word) else np.zeros(len(at), dtype=np.int16)
        if len(outside):
            words[outside] = [WORDS + shape(tokens[k]) for k in outside.tolist()]
        return words, at, outside


# --- contexts ---------------------------------------------------------------------------------------------


class Classes:
    """Class and place of each model word, and what contexts see of words. ``PAD`` stands before a text."""

    def __init__(self, cls: np.ndarray, coarse: np.ndarray):
        self.cls = cls  # by word
        self.n = int(cls.max()) + 1
        self.place = np.zeros(PAD, dtype=np.int64)
        for c in range(self.n):
            own = np.flatnonzero(cls == c)
            self.place[own] = np.arange(len(own))
        self.sizes = np.bincount(cls, minlength=self.n)
        self.width = int(self.sizes.max())
        self.seen = np.append(cls, self.n)  # by word, PAD last
        self.coarse = np.append(coarse, COARSE)[self.seen]
        self.last = np.where(np.arange(PAD + 1) < LAST, np.arange(PAD + 1), LAST + self.seen)
        self.m = self.n + 1
        self.known = LAST + self.m  # what a last word is seen as: itself, or its class
        self.class_of = np.append(self.seen[:LAST], np.arange(self.m))  # the class of each of these
        self.codes = self.known * self.m * (COARSE + 1)
        self.word_codes = self.n * self.known * (COARSE + 1)

    def code(self, h1, h2, h3):
        """The context of the class: last word, class before it, coarse class before that."""
        return (self.last[h1] * self.m + self.seen[h2]) * (COARSE + 1) + self.coarse[h3]

    def word_code(self, c, h1, h2):
        """The context of the word: its class, last word, coarse class before that."""
        return (c * self.known + self.last[h1]) * (COARSE + 1) + self.coarse[h2]

    def features(self, factor: int, code: np.ndarray) -> np.ndarray:
        """(n, features): hashed weight rows of each code. n-grams, skips and a bias; with the class for words."""
        rest, far, zero = code // (COARSE + 1), code % (COARSE + 1), np.zeros_like(code)
        if factor == 0:
            last, mid = rest // self.m, rest % self.m
            own = self.class_of[last]
            parts = [(zero, zero), (last, zero), (last, mid), (own, zero), (own, mid), (zero, mid), (far, zero), (far, mid)]
        else:
            c, last = rest // self.known, rest % self.known
            own = self.class_of[last]
            parts = [(c, zero), (c, own), (c, far), (c, own * 16 + far), (c, last)]
        rows = []
        for kind, (a, b) in enumerate(parts):
            h = (a.astype(np.uint64) * np.uint64(0x9E3779B1) ^ (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x85EBCA77) ^ np.uint64(kind) * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
            rows.append((h >> np.uint64(40)).astype(np.int64) % ROWS[factor])
        return np.stack(rows, axis=1)

    def allowed(self, code: np.ndarray) -> np.ndarray:
        """(n, width): which places the class of each word code has."""
        return np.arange(self.width)[None, :] < self.sizes[code // (COARSE + 1) // self.known][:, None]


def make_classes(counts: np.ndarray) -> Classes:
    """Classes from (LAST + 1, PAD) counts of words after the most frequent words: clusters of similar
    distributions, cut to ``CLASS_WORDS`` words; and coarse groups of the clusters."""
    x = np.sqrt((counts + 0.05) / (counts + 0.05).sum(axis=0, keepdims=True)).T
    weight = counts.sum(axis=0) + 1.0
    cluster = _k_means(x, weight, CLUSTERS)
    middle = np.stack([np.average(x[cluster == k], axis=0, weights=weight[cluster == k]) if (cluster == k).any() else np.zeros(x.shape[1]) for k in range(CLUSTERS)])
    group = _k_means(middle, np.ones(CLUSTERS), COARSE)
    cls, coarse = np.zeros(PAD, dtype=np.int64), []
    for k in range(CLUSTERS):
        own = np.flatnonzero(cluster == k)
        own = own[np.argsort(-weight[own], kind="stable")]
        for at in range(0, len(own), CLASS_WORDS):
            cls[own[at : at + CLASS_WORDS]] = len(coarse)
            coarse.append(int(group[k]))
    return Classes(cls, np.array(coarse, dtype=np.int64))


def _k_means(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    middle = [x[int(weight.argmax())]]
    far = ((x - middle[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):  # farthest first, by weighted distance
        middle.append(x[int((far * np.sqrt(weight)).argmax())])
        far = np.minimum(far, ((x - middle[-1]) ** 2).sum(axis=1))
    m = np.stack(middle)
    for _ in range(rounds):
        at = ((m**2).sum(axis=1)[None] - 2 * x @ m.T).argmin(axis=1)
        for c in range(k):
            if (own := at == c).any():
                m[c] = np.average(x[own], axis=0, weights=weight[own])
    return at


def _flat(words: list[bytes]) -> np.ndarray:
    """Model words of many texts in one array, three PADs before each."""
    pads = np.full(3, PAD, dtype=np.int16)
    parts = [x for w in words for x in (pads, np.frombuffer(w, dtype=np.int16))]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)


def _texts(batches, column="words", docs=64):
    """Lists of about as many texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, docs):
            yield batch.slice(at, docs), batch.column(column).slice(at, docs).to_pylist()


_TAIL = "struct<token:binary,tf:bigint>"


def _tokenised(vocabulary):
    """For each text: its model words, tokens, the sums of the counts' logs over head tokens, and of those that are in
    groups, and the tokens outside the head. Texts are looked up here, once; all later passes read numbers."""

    def run(batches):
        v, row = vocabulary.value, (TaskContext.get().partitionId() << 36)
        for part, texts in _texts(batches, "text"):
            n = len(texts)
            n_tokens, n_head, head, grouped = (np.zeros(n, dtype=t) for t in (np.int64, np.int64, np.float64, np.float64))
            words, outside = [], [Counter() for _ in texts]
            for k, text in enumerate(texts):
                own = []
                for tokens in _pieces(text):
                    w, at, out = v.look_up(tokens)
                    own.append(w.astype(np.int16, copy=False).tobytes())
                    inside = at[at >= 0]
                    logs = v.log_count[inside]
                    n_tokens[k] += len(at)
                    n_head[k] += len(inside)
                    head[k] += logs.sum()
                    grouped[k] += logs[inside >= WORDS].sum()
                    outside[k].update([tokens[i] for i in out.tolist()])
                words.append(b"".join(own))
            tail = pa.array([[{"token": t, "tf": f} for t, f in x.items()] for x in outside], pa.list_(pa.struct([("token", pa.binary()), ("tf", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), part.column("doc_id"), part.column("held_out"), pa.array(n_tokens), pa.array(n_head), pa.array(head), pa.array(grouped), pa.array(words, pa.binary()), tail], names=["row", "doc_id", "held_out", "n_tokens", "n_head", "head_log", "group_log", "words", "tail"])
            row += n

    return run


def _sparse(counts: np.ndarray, first: int = 0) -> pa.RecordBatch:
    at = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(at + first), pa.array(counts[at].astype(np.int64))], names=["cell", "n"])


def _following():
    """Counts of words after each of the most frequent words (and any other)."""

    def run(batches):
        counts = np.zeros((LAST + 1) * PAD, dtype=np.int64)
        for _, words in _texts(batches):
            flat = _flat(words)
            at = np.flatnonzero(flat != PAD)
            counts += np.bincount(np.minimum(flat[at - 1], LAST) * PAD + flat[at], minlength=len(counts))
        yield _sparse(counts)

    return run


def _events(classes):
    """Counts of (code, outcome) of both factors; the second's cells come after the first's."""

    def run(batches):
        c, first, second, held = classes.value, [], [], 0
        sizes = (c.codes * c.n, c.word_codes * c.width)

        def flush():
            for kind, (codes, size) in enumerate(zip((first, second), sizes, strict=True)):
                cells, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells + kind * sizes[0]), pa.array(n.astype(np.int64))], names=["cell", "n"])
                codes.clear()
                del size

        for _, words in _texts(batches):
            flat = _flat(words)
            at = np.flatnonzero(flat != PAD)
            w, h1, h2, h3 = flat[at], flat[at - 1], flat[at - 2], flat[at - 3]
            own = c.cls[w]
            first.append(c.code(h1, h2, h3) * c.n + own)
            second.append(c.word_code(own, h1, h2) * c.width + c.place[w])
            held += len(w)
            if held > 1_000_000:
                yield from flush()
                held = 0
        if held:
            yield from flush()

    return run


# --- training ---------------------------------------------------------------------------------------------


def _log_softmax(weights: np.ndarray, rows: np.ndarray, allowed: np.ndarray | None) -> np.ndarray:
    z = weights[rows[:, 0]].copy()
    for k in range(1, rows.shape[1]):
        z += weights[rows[:, k]]
    if allowed is not None:
        z[~allowed] = -1e30
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _pack(classes):
    """One row for each block: codes, outcomes and counts as bytes. Codes are bounded, so blocks are."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        data = np.stack([pdf["cell"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)]).tobytes()
        return pd.DataFrame({"factor": [int(pdf["factor"].iloc[0])], "data": [data]})

    return run


def _gradients(classes, weights):
    """The gradient of the log likelihood over each block's events, observed less expected counts; without weights,
    the observed counts."""

    def run(batches):
        c = classes.value
        for pdf in batches:
            factors, places, grads, losses = [], [], [], []
            for factor, data in zip(pdf["factor"], pdf["data"], strict=True):
                cell, n = np.frombuffer(data, dtype=np.int64).reshape(2, -1)
                width = (c.n, c.width)[factor]
                code, inverse = np.unique(cell // width, return_inverse=True)
                w = weights.value[factor] if weights else None
                grad, loss = np.zeros((ROWS[factor], width)), 0.0
                for at in range(0, len(code), 4096):  # in bounded room
                    own = (inverse >= at) & (inverse < at + 4096)
                    part = code[at : at + 4096]
                    seen = np.zeros((len(part), width))
                    seen[inverse[own] - at, cell[own] % width] = n[own]
                    rows = c.features(factor, part)
                    if weights:
                        logp = _log_softmax(w, rows, c.allowed(part) if factor else None)
                        loss -= float((seen * logp)[seen > 0].sum())
                        seen -= np.exp(logp) * seen.sum(axis=1, keepdims=True)
                    for k in range(rows.shape[1]):
                        np.add.at(grad, rows[:, k], seen)
                touched = np.flatnonzero(grad.any(axis=1))  # a block's codes share most of their rows
                factors.append(factor)
                places.append(touched.astype(np.int32).tobytes())
                grads.append(grad[touched].astype(np.float32).tobytes())
                losses.append(loss)
            yield pd.DataFrame({"factor": factors, "rows": places, "grad": grads, "loss": losses})

    return run


def train_factors(spark, events: DataFrame, classes: Classes, steps: int = STEPS) -> tuple[list[np.ndarray], list[float]]:
    """Weights of both factors, from all counted events, by distributed gradients with a diagonal scaling."""
    shared = spark.sparkContext.broadcast(classes)
    edge = classes.codes * classes.n
    factor = F.when(F.col("cell") < edge, 0).otherwise(1)
    cell = F.when(F.col("cell") < edge, F.col("cell")).otherwise(F.col("cell") - edge)
    code = F.when(factor == 0, F.floor(cell / classes.n)).otherwise(F.floor(cell / classes.width))
    rows = events.select(factor.alias("factor"), cell.alias("cell"), "n", F.pmod(F.floor(code / (COARSE + 1)), F.lit(BLOCKS)).alias("block"))
    packed = written(rows.groupBy("factor", "block").applyInPandas(_pack(shared), "factor int, data binary"), "events").repartition(BLOCKS)
    widths = (classes.n, classes.width)
    weights = [np.zeros((r, w)) for r, w in zip(ROWS, widths, strict=True)]
    features = [classes.features(f, np.zeros(1, dtype=np.int64)).shape[1] for f in (0, 1)]
    losses: list[float] = []
    speed = [np.zeros_like(w) for w in weights]

    def summed(sent) -> tuple[list[np.ndarray], float]:
        sums, loss = [np.zeros(w.shape, dtype=np.float32) for w in weights], 0.0
      
        for row in packed.mapInPandas(_gradients(shared, sent), "factor int, rows binary, grad binary, loss double").collect():
            at = np.frombuffer(row["rows"], dtype=np.int32)
            sums[row["factor"]][at] += np.frombuffer(row["grad"], dtype=np.float32).reshape(len(at), -1)
            loss += row["loss"]
        return sums, loss

    observed, _ = summed(None)
    for _ in range(steps):
        sent = spark.sparkContext.broadcast([w.astype(np.float32) for w in weights])
        grads, loss = summed(sent)
        sent.destroy()
        losses.append(loss)
        for k in (0, 1):
            expected = np.maximum(observed[k] - grads[k], 0.0)
            move = np.clip((grads[k] - 0.5 * weights[k]) / (expected + 1.0), -2, 2) / features[k]
            speed[k] = 0.6 * speed[k] + move
            weights[k] = weights[k] + speed[k]
    return weights, losses


# --- scoring ----------------------------------------------------------------------------------------------


class Scorer:
    """Log10 probabilities of class and word, computed for the contexts that turn up."""

    def __init__(self, classes: Classes, weights: list[np.ndarray], log_group: np.ndarray):
        self.c, self.weights, self.log_group = classes, weights, log_group
        self.tables = self.known = None  # made where the scoring is

    def _ready(self) -> None:
        c = self.c
        self.tables = [np.zeros((c.codes, c.n), dtype=np.float32), np.zeros((c.word_codes, c.width), dtype=np.float32)]
        self.known = [np.zeros(c.codes, dtype=bool), np.zeros(c.word_codes, dtype=bool)]

    def _get(self, factor: int, code: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        if self.tables is None:
            self._ready()
        if len(fresh := np.unique(code[~self.known[factor][code]])):
            for at in range(0, len(fresh), 4096):
                part = fresh[at : at + 4096]
                logp = _log_softmax(self.weights[factor], self.c.features(factor, part), self.c.allowed(part) if factor else None)
                self.tables[factor][part] = np.maximum(logp / np.log(10), -1e4)
            self.known[factor][fresh] = True
        return self.tables[factor][code, outcome].astype(np.float64)

    def score(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For an array of texts: the text number of each token, and its log10 probability without the
        token's count within its group."""
        at = np.flatnonzero(flat != PAD)
        w, h1, h2, h3 = flat[at], flat[at - 1], flat[at - 2], flat[at - 3]
        own = self.c.cls[w]
        out = self._get(0, self.c.code(h1, h2, h3), own) + self._get(1, self.c.word_code(own, h1, h2), self.c.place[w])
        grouped = w >= WORDS
        out[grouped] -= self.log_group[w[grouped] - WORDS]
        first = np.zeros(len(flat), dtype=np.int64)
        first[3:] = (flat[3:] != PAD) & (flat[2:-1] == PAD)
        return np.cumsum(first)[at] - 1, out


def _score(scorer):
    """For each text: its row, and the model's sum over its words."""

    def run(batches):
        for part, words in _texts(batches):
            number, logp = scorer.value.score(_flat(words))
            model = np.bincount(number, logp, len(words)) + part.column("group_log").to_numpy(zero_copy_only=False)
            others = ["row", "doc_id", "held_out", "n_tokens", "n_head", "head_log"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.array(model)], names=[*others, "model_log"])

    return run


def score(docs: DataFrame, fold: int = 1, steps: int = STEPS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``
    (doc_id, text), learning from those outside the fold. Both scores are log10 probabilities of the text."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", (id_fold(F.col("doc_id")) == fold).alias("held_out"))
    training = rows.where(~F.col("held_out")).select("text")
    counts = written(training.mapInArrow(_count_tokens, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c")), "counts")
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # The least count that at most HEAD tokens reach, from a histogram of bounded size.
    level = F.floor(F.log(F.col("c").cast("double")) * 16)
    reached, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r["level"]):
        reached += r["n"]
        if reached > HEAD:
            break
        least = r["c"]
    found = counts.where(F.col("c") >= least).toArrow() if least is not None else None  # HEAD rows at most
    head = sorted(zip(found["c"].to_pylist(), found["token"].to_pylist(), strict=True), key=lambda r: (-r[0], r[1])) if found else []
    words = Vocabulary([t for _, t in head], [n for n, _ in head])
    # Groups hold all but the model's own words.
    own = {r["shape"]: r for r in counts.mapInArrow(_count_shapes, "shape long, c long, v long").groupBy("shape").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect()}
    group = np.array([[own[s]["c"], own[s]["v"]] if s in own else [0, 0] for s in range(SHAPES)], dtype=np.float64)
    for n, token in head[:WORDS]:
        group[shape(token)] -= (n, 1)
    log_group = np.log10(group[:, 0] + 0.5 * (group[:, 1] + 1))
    vocabulary = spark.sparkContext.broadcast(words)
    kind = dict(docs.dtypes)["doc_id"]
    narrow = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_head long, head_log double"
    tokens = written(rows.mapInArrow(_tokenised(vocabulary), f"{narrow}, group_log double, words binary, tail array<{_TAIL}>"), "tokens")
    learned = tokens.where(~F.col("held_out")).select("words")
    after = np.zeros((LAST + 1) * PAD)
    cells = learned.mapInArrow(_following(), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # (LAST + 1) * PAD at most
    after[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    classes = make_classes(after.reshape(LAST + 1, PAD))
    sent = spark.sparkContext.broadcast(classes)
    events = learned.mapInArrow(_events(sent), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    weights, _ = train_factors(spark, events, classes, steps)
    scorer = spark.sparkContext.broadcast(Scorer(classes, [w.astype(np.float32) for w in weights], log_group))
    scored = tokens.drop("tail").mapInArrow(_score(scorer), f"{narrow}, model_log double")
    tail = tokens.select("row", F.explode("tail").alias("x")).select("row", "x.token", "x.tf")
    rare = counts.where(F.col("c") < least) if least is not None else counts
    joined = tail.join(rare, "token", "left")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    rest = joined.groupBy("row").agg(F.sum(F.col("tf") * log_c).alias("tail_log"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("tail_known"))
    out = scored.join(rest, "row", "left").withColumns({"tail_log": F.coalesce("tail_log", F.lit(0.0)), "tail_known": F.coalesce("tail_known", F.lit(0))})
    per_token = F.lit(float(np.log10(whole["n"] + 0.5 * (whole["v"] + 1))))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.col("tail_known")).cast("long").alias("n_known"),
        F.lit(whole["n"]).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.col("tail_log") - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("model_log") + F.col("tail_log")).alias("score"),
    )
