"""Language-model scoring by masked pseudo-likelihood.

Method: a small window network predicts each word of a text from the WINDOW words on both sides of
it, the word itself being masked.  The left and the right neighbours' embeddings, weighed by
distance, are summed into a hidden layer; the output is factored into a word's class and the word
within its class.  A document's score is the sum of the log-probabilities of all its words.

The vocabulary is all words, counted over all documents.  The most frequent have ids of their own in
the network; each other word shares one of RARE ids by hash, and its probability is the network's for the
id times the word's own share of it, n(word) / n(id).  Shares of words that make up one in HEAD words
or more, HEAD words at most, are broadcast; those of all others are a table that their occurrences are
joined with, in which no word has more than one in HEAD rows.

The network is trained in numpy: the documents are dealt by hash to shards of about SHARD words, each runs
Adam over its documents in the order of their hashes from one common start, and the results are averaged,
weighed by the words they saw, for ROUNDS rounds.  So the input's partitions don't matter.  The network's size is
fixed, so what is broadcast or collected never grows; the vocabulary and what is trained on grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import stage
from tidewell.llm.terms import stretches, word_hashes

WORDS = 1024
CLASS = 32
#: Ids at the end of the vocabulary that rarer words share by hash.
RARE = 64
WIDTH = 16
WINDOW = 2
BATCH = 4096
RATE = 0.01
ROUNDS = 1
SHARD = 1 << 21
#: Words that make up one in so many are looked up in tasks; rarer ones are joined.
HEAD = 1 << 19
#: Logarithms of shares are summed as whole numbers of this part, so that the sum doesn't depend on the order.
_PART = 1e-6
#: Different words that a task holds before it sends their counts on.
_HELD = 1_000_000

_N_CLASSES = WORDS // CLASS
_SHAPES = {"left": (WORDS + 1, WIDTH), "right": (WORDS + 1, WIDTH), "hidden": (WIDTH,), "class_out": (WIDTH, _N_CLASSES), "class_bias": (_N_CLASSES,), "word_out": (_N_CLASSES, WIDTH, CLASS), "word_bias": (_N_CLASSES, CLASS)}
_PAD = WORDS  # beyond a text's ends


class Vocabulary(NamedTuple):
    head: np.ndarray  # hashes of frequent words, rising
    ids: np.ndarray  # their ids
    logs: np.ndarray  # the logarithms of their shares of their ids, in _PART
    sizes: list[float]  # occurrences of each shared id
    tail: DataFrame  # word, log: all other words


def _small(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether all logits are small enough for exp as they are: the hidden layer lies between -1 and 1."""
    return float(np.abs(weights).sum(axis=-2).max() + np.abs(bias).max()) < 80


class Network:
    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @staticmethod
    def start(frequency: np.ndarray) -> Network:
        """Random embeddings; biases that give each word its frequency."""
        rng = np.random.default_rng(5)
        p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in _SHAPES.items()}
        share = (frequency + 1.0).reshape(_N_CLASSES, CLASS)
        p["class_bias"] = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
        p["word_bias"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
        p["hidden"][:] = 0
        return Network(p)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in _SHAPES])

    @staticmethod
    def of(flat: np.ndarray) -> Network:
        cuts = np.cumsum([int(np.prod(s)) for s in _SHAPES.values()])[:-1]
        return Network({k: x.reshape(s).astype(np.float32) for (k, s), x in zip(_SHAPES.items(), np.split(flat, cuts))})

    def run(self, ids: np.ndarray, around: np.ndarray, grads: dict[str, np.ndarray] | None) -> np.ndarray:
        """Log-probability of each of ids given the words around (2 * WINDOW rows); adds to grads the gradient of their sum."""
        p = self.p
        order = np.argsort(ids, kind="stable")  # by class, so that a class is a slice
        ids, around = ids[order], around[:, order]
        sides = [("left", k, np.float32(1.0 / (WINDOW - k))) for k in range(WINDOW)] + [("right", WINDOW + k, np.float32(1.0 / (k + 1))) for k in range(WINDOW)]
        h = np.repeat(p["hidden"][None, :], len(ids), axis=0)
        for side, row, weight in sides:
            h += p[side][around[row]] * weight
        np.tanh(h, out=h)
        cls, inner, rows = ids // CLASS, ids % CLASS, np.arange(len(ids))
        logits = h @ p["class_out"] + p["class_bias"]
        if not _small(p["class_out"], p["class_bias"]):
            logits -= logits.max(axis=1, keepdims=True)
        out = logits[rows, cls]
        prob = np.exp(logits, out=logits)
        total = prob.sum(axis=1)
        out -= np.log(total)
        if grads is not None:
            prob /= -total[:, None]
            prob[rows, cls] += 1
            grads["class_out"] += h.T @ prob
            grads["class_bias"] += prob.sum(axis=0)
            dh = prob @ p["class_out"].T
        bounds = np.searchsorted(ids, np.arange(_N_CLASSES + 1) * CLASS)
        small = _small(p["word_out"], p["word_bias"])
        for c in np.flatnonzero(np.diff(bounds)).tolist():
            a, b = bounds[c], bounds[c + 1]
            hc, r, own = h[a:b], rows[: b - a], inner[a:b]
            logits = hc @ p["word_out"][c] + p["word_bias"][c]
            if not small:
                logits -= logits.max(axis=1, keepdims=True)
            out[a:b] += logits[r, own]
            prob = np.exp(logits, out=logits)
            total = prob.sum(axis=1)
            out[a:b] -= np.log(total)
            if grads is not None:
                prob /= -total[:, None]
                prob[r, own] += 1
                grads["word_out"][c] += hc.T @ prob
                grads["word_bias"][c] += prob.sum(axis=0)
                dh[a:b] += prob @ p["word_out"][c].T
        if grads is not None:
            dh *= 1 - h * h
            grads["hidden"] += dh.sum(axis=0)
            for side, row, weight in sides:
                by_id = np.argsort(around[row], kind="stable")
                sorted_ids = around[row][by_id]
                starts = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
                grads[side][sorted_ids[starts]] += np.add.reduceat(dh[by_id], starts, axis=0) * weight
        back = np.empty_like(out)
        back[order] = out
        return back


def _around(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and the WINDOW ids before and after each within its own text."""
    gap = np.full(WINDOW, _PAD, np.int64)
    padded = np.concatenate([gap, *(x for one in ids for x in (one, gap))])
    at = np.concatenate([np.full(len(one), i) for i, one in enumerate(ids)]) * WINDOW + np.arange(sum(map(len, ids))) + WINDOW if ids else np.zeros(0, np.int64)
    at = at.astype(np.int64)
    rows = [padded[at - WINDOW + k] for k in range(WINDOW)] + [padded[at + 1 + k] for k in range(WINDOW)]
    return padded[at].astype(np.int16), np.stack(rows).astype(np.int16)


def _unpacked(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches cut so that each has about 100,000 words, one text at least."""
    for batch in batches:
        texts = [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column(column).to_pylist()]
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size < 100_000):
                size += len(texts[upto])
                upto += 1
            yield batch.slice(at, upto - at), texts[at:upto]
            at = upto


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over all texts: each word's hash and how often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        more: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every, ns = (np.concatenate(x) for x in zip((words, sums), *more))
            order = np.argsort(every, kind="stable")
            every, ns = every[order], ns[order]
            starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
            return every[starts], np.add.reduceat(ns, starts) if len(starts) else ns

        def sent() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(words), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 100_000].view(np.int64)), pa.array(sums[at : at + 100_000])], names=["word", "n"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in stretches(texts):
                more.append(np.unique(np.concatenate(word_hashes(texts[a:b])), return_counts=True))
                if sum(len(x) for x, _ in more) >= _HELD:
                    words, sums = merged()
                    more.clear()
                    if len(words) >= _HELD:
                        yield from sent()
                        words, sums = words[:0], sums[:0]
        words, sums = merged()
        yield from sent()

    return texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(texts: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """(all words with their ids and shares, frequency of each id): the most frequent words have ids of their own."""
    counts = stage(word_counts(texts), "counts")
    by_id = np.zeros(RARE)
    for r in counts.groupBy(F.pmod("word", F.lit(RARE)).alias("id")).agg(F.sum("n").alias("n")).collect():
        by_id[r.id] = r.n
    least = float(by_id.sum() / HEAD)
    top = counts.filter(F.col("n") >= least).toArrow()
    head, n = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(head)
    head, n = head[order], n[order]
    own = np.argsort(-n, kind="stable")[: WORDS - RARE]
    shared = (head % np.uint64(RARE)).astype(np.int64)
    frequency = np.zeros(WORDS)
    frequency[: len(own)] = n[own]
    by_id -= np.bincount(shared[own], weights=n[own], minlength=RARE)
    frequency[WORDS - RARE :] = by_id
    sizes = [max(1.0, float(x)) for x in by_id]
    ids = WORDS - RARE + shared
    ids[own] = np.arange(len(own))
    logs = np.round(np.log(n / frequency[ids]) / _PART).astype(np.int64)
    share = F.col("n") / F.get(F.lit(sizes), F.pmod("word", F.lit(RARE)).cast("int"))
    tail = counts.filter(F.col("n") < least).select("word", F.round(F.log(share) / _PART).cast("long").alias("log"))
    return Vocabulary(head, ids.astype(np.uint16), logs, sizes, tail), frequency


def encode(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """(row, doc_id, words binary, share, tail) of rows (doc_id, text): a number for the row, ids, the sum of the logarithms of frequent words' shares, and the hashes of the other words."""
    table = docs.sparkSession.sparkContext.broadcast((known.head, known.ids, known.logs))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_ids, logs = table.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in stretches(texts):
                each = word_hashes(texts[a:b])
                every, bounds = np.concatenate(each), np.concatenate([[0], np.cumsum([len(w) for w in each])])
                ids, share, found = (WORDS - RARE + every % np.uint64(RARE)).astype("<u2"), np.zeros(len(every), np.int64), np.zeros(len(every), bool)
                if len(head):
                    at = np.minimum(np.searchsorted(head, every), len(head) - 1)
                    found = head[at] == every
                    ids[found], share[found] = head_ids[at[found]], logs[at[found]]
                sums = np.diff(np.concatenate([[0], np.cumsum(share)])[bounds])
                tails = np.concatenate([[0], np.cumsum(~found)])[bounds].astype(np.int32)
                packed = [ids[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(packed, pa.binary()), pa.array(sums), pa.ListArray.from_arrays(pa.array(tails), pa.array(every[~found].view(np.int64)))], names=["row", "doc_id", "words", "share", "tail"])

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(work, "row long, doc_id long, words binary, share long, tail array<long>")


def train(encoded: DataFrame, network: Network, n_words: int, rate: float = RATE) -> Network:
    """One round over all rows (words), n_words in all: Adam in each shard, then the mean by words seen."""
    start = encoded.sparkSession.sparkContext.broadcast(network.flat())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen, step = Network.of(start.value), 0, 0
        first = {k: np.zeros_like(v) for k, v in net.p.items()}
        second = {k: np.zeros_like(v) for k, v in net.p.items()}
        for _, texts in _unpacked(batches, 0):
            ids, around = _around(texts)
            for at in range(0, len(ids), BATCH):
                grads = {k: np.zeros_like(v) for k, v in net.p.items()}
                part = ids[at : at + BATCH]
                net.run(part, around[:, at : at + BATCH], grads)
                step, seen = step + 1, seen + len(part)
                for k, g in grads.items():
                    g /= len(part)
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    net.p[k] += np.float32(rate) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + np.float32(1e-6))
        if seen:
            # Whole numbers, so that the sum doesn't depend on the order in which shards end.
            weight = max(1, seen >> 12)
            values = np.round(net.flat().astype(np.float64) * 65536).astype(np.int64) * weight
            yield pa.RecordBatch.from_arrays([pa.array([np.append(values, weight).tobytes()], pa.binary())], names=["values"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                one = np.frombuffer(raw, np.int64)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["values"])

    shards = max(1, -(-n_words // SHARD))
    key = F.xxhash64("words", F.lit(11))
    dealt = encoded.select("words", key.alias("key")).repartitionById(shards, F.pmod("key", F.lit(shards)).cast("int")).sortWithinPartitions("key")
    trained = dealt.select("words").mapInArrow(work, "values binary")
    # Two levels of sums, so that no task reads all shards.
    some = int(np.ceil(np.sqrt(shards)))
    partly = trained.repartition(some).mapInArrow(summed, "values binary")
    rows = partly.repartition(1).mapInArrow(summed, "values binary").collect()
    if not rows:
        return network
    flat = np.frombuffer(bytes(rows[0][0]), np.int64).astype(np.float64)
    return Network.of(flat[:-1] / flat[-1] / 65536)


def score(encoded: DataFrame, network: Network) -> DataFrame:
    """doc_id, n_words, log_prob, mean_log_prob of rows (doc_id, words): the network's part, by ids."""
    scored = _scored(encoded.select("doc_id", "words"), network, "doc_id long")
    return scored.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))


def _scored(rows: DataFrame, network: Network, carried: str) -> DataFrame:
    """The ``carried`` columns, n_words and log_prob of rows of these columns and words."""
    model = rows.sparkSession.sparkContext.broadcast(network.flat())
    names = [c.split()[0] for c in carried.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.of(model.value)
        for batch, texts in _unpacked(batches, len(names)):
            ids, around = _around(texts)
            logs = np.concatenate([np.zeros(0), *(net.run(ids[at : at + 2 * BATCH], around[:, at : at + 2 * BATCH], None) for at in range(0, len(ids), 2 * BATCH))])
            sums = np.diff(np.concatenate([[0.0], np.cumsum(logs)])[np.concatenate([[0], np.cumsum([len(t) for t in texts])])])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([len(t) for t in texts], pa.int64()), pa.array(np.round(sums, 3))], names=[*names, "n_words", "log_prob"])

    return rows.mapInArrow(work, f"{carried}, n_words long, log_prob double")


def score_words(encoded: DataFrame, network: Network, known: Vocabulary) -> DataFrame:
    """doc_id, n_words, log_prob, mean_log_prob of rows of encode(): the network's part and the words' shares of their ids.

    A word outside the vocabulary counts as one that was seen once.
    """
    scored = _scored(encoded.select("row", "doc_id", "share", "words"), network, "row long, doc_id long, share long")
    words = encoded.select("row", F.explode("tail").alias("word"))
    once = F.round(F.log(1 / F.get(F.lit(known.sizes), F.pmod("word", F.lit(RARE)).cast("int"))) / _PART).cast("long")
    rare = words.join(known.tail, "word", "left").groupBy("row").agg(F.sum(F.coalesce("log", once)).alias("rest"))
    both = scored.join(rare, "row", "left").withColumn("log_prob", F.round(F.col("log_prob") + (F.col("share") + F.coalesce("rest", F.lit(0))) * _PART, 3))
    return both.select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob"))


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_prob, mean_log_prob of each row of ``docs``, by a network trained on all of them.

    A null text counts as empty; a text without words has log_prob 0 and a null mean.  Repeated rows
    are scored, and learnt from, each time.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known, frequency = vocabulary(rows.select("text"))
    encoded = stage(encode(rows, known), "words")
    network = Network.start(frequency)
    for _ in range(ROUNDS):
        network = train(encoded, network, int(frequency.sum()))
    return score_words(encoded, network, known)
