"""Language-model scores by a log-bilinear model, trained in numpy with noise-contrastive estimation.

Symbols. The most frequent words of the training texts are symbols of their own, all other words fall into classes by
their last letters, and there is an end. The score of a symbol after two others is (C2 r[b] + C1 r[a]) . t[w] + bias[w]
with diagonal C. A word of a class costs its class and then (c - D) / N of the class, where c and N are counts over
all training texts; one symbol "unknown" of each class takes the discounted mass. Known words and "unknown" sum to 1.

Training. Texts are dealt by a hash into shards of some million tokens, and shards into rounds. In a round every shard
trains from the same parameters (data against unigram noise, AdaGrad); then parameters and step sizes are averaged by
number of tokens, in parts, so that nothing of the size of the table reaches the driver. Shards and the order inside
them follow from the rows alone: scores don't depend on how a table is partitioned. Each text trains once.

Scoring. The normaliser of all pairs of contexts is one product of matrices of exponentials, so that the
log-probabilities of a batch are lookups. Counts of all words are exact: each block of documents asks for the words
that it holds, packed by hash bucket, and gets their counts back; a frequent word is asked for once a block.

Defined cases: null and empty texts are one end; rows without an id are training rows; repeated rows count each; with
no training text every token is unknown and scores 0 against a base of 0; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import durable, scan

SHORT_LIST = 766
CLASSES = 256
SIZE = 24
NOISE = 32
BATCH = 1024
RATE = 0.3
BLOCK_TOKENS = 800_000
SHARD_TOKENS = 2_000_000
ROUNDS = 3
BUCKET_BYTES = 1 << 30
PARTS = 16
START, END = 0, 1
FIRST_CLASS = 2 + SHORT_LIST
SYMBOLS = FIRST_CLASS + CLASSES


_SIGNS = np.zeros(256, bool)
_SIGNS[np.frombuffer(b".,;:!?", np.uint8)] = True


def tail_classes(words: pa.Array) -> np.ndarray:
    """Class of each word by its last three bytes; punctuation after them counts as one sign."""
    data, at = scan.flat(words)
    start, end = at[:-1], at[1:].copy()
    which = np.flatnonzero(end > start)
    while len(which := which[_SIGNS[data[end[which] - 1]]]):
        end[which] -= 1
        which = which[end[which] > start[which]]
    h = (end < at[1:]).astype(np.uint64)
    for k in (3, 2, 1):
        place = end - k
        h = h * np.uint64(257) + (np.where(place >= start, data[np.maximum(place, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0)) if len(data) else np.uint64(0))
    h = (h ^ (h >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % np.uint64(CLASSES)).astype(np.int64)


def tail_class(word: bytes) -> int:
    return int(tail_classes(pa.array([word], pa.binary()))[0])


@dataclass(frozen=True)
class Model:
    short: dict[bytes, int]
    left: np.ndarray  # [symbol two before, word]
    right: np.ndarray  # [symbol before, word]
    bias: np.ndarray
    norm: np.ndarray  # [two before, before]
    discount: np.ndarray
    tokens: np.ndarray
    words: np.ndarray

    def log_tail(self, cls: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log of the chance of a word, given its class and its count in the training texts (0: unknown)."""
        total = np.maximum(self.tokens[cls], 1)
        d = self.discount[cls]
        known = (count - d) / total
        unknown = np.where(self.tokens[cls] > 0, d * self.words[cls] / total, 1.0)
        return np.log(np.where(count > 0, known, unknown))


def symbols(short: dict[bytes, int], words: pa.Array) -> np.ndarray:
    """The symbol of each word; short: symbols of the most frequent words, in order from 2 on."""
    known = pc.fill_null(pc.index_in(words, pa.array(list(short), pa.binary())), -1).to_numpy(zero_copy_only=False)
    return np.where(known >= 0, known + 2, FIRST_CLASS + tail_classes(words)).astype(np.int64)


def sequence(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' symbols, each followed by an end: symbol, the one before, the one before that, and text borders."""
    n = len(offsets) - 1
    bounds = offsets + np.arange(n + 1)
    out = np.full(bounds[-1], END, np.int64)
    out[np.arange(len(codes)) + np.repeat(np.arange(n), np.diff(offsets))] = codes
    one, two = np.full(len(out), START, np.int64), np.full(len(out), START, np.int64)
    one[1:], two[2:] = out[:-1], out[:-2]
    one[bounds[:-1]] = START
    two[bounds[:-1]] = START
    second = bounds[:-1] + 1
    two[second[second < bounds[1:]]] = START
    return out, one, two, bounds


class Trainer:
    """Noise-contrastive estimation with AdaGrad; noise is shared by the positions of a batch.

    theta holds r (what a symbol says as a context), t (what it asks of its context, and its bias in the last column)
    and the diagonals c1 and c2; squares are the sums of squared gradients."""

    def __init__(self, unigram: np.ndarray, start: tuple[dict, dict] | None = None, seed: int = 1):
        self.rng = np.random.default_rng(seed + 1)
        self.p = unigram / unigram.sum()
        self.ends = np.cumsum(self.p)
        self.log_noise = np.log(NOISE * self.p).astype(np.float32)
        theta, squares = start or beginning(self.p)
        self.theta, self.squares = ({k: v.astype(np.float32) for k, v in x.items()} for x in (theta, squares))
        self.seen = 0

    def _step(self, name: str, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        theta, squares = self.theta[name], self.squares[name]
        if rows is None:
            squares += grad * grad
            theta += RATE * grad / np.sqrt(squares)
            return
        order = np.argsort(rows, kind="stable")  # 16-bit keys: a radix sort
        rows = rows[order]
        heads = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        total, rows = np.add.reduceat(grad[order], heads, axis=0), rows[heads]
        after = squares[rows] + total * total
        squares[rows] = after
        theta[rows] += RATE * total / np.sqrt(after)

    def batch(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        th, scale = self.theta, np.float32(1 / len(w))
        noise = np.minimum(np.searchsorted(self.ends, self.rng.random(NOISE)), SYMBOLS - 1).astype(np.uint16)
        r1, r2, tw, tn = th["r"][one], th["r"][two], th["t"][w], th["t"][noise]
        q = np.ones((len(w), SIZE + 1), np.float32)
        q[:, :SIZE] = r1 * th["c1"] + r2 * th["c2"]
        data = np.einsum("ij,ij->i", q, tw) - self.log_noise[w]
        other = q @ tn.T - self.log_noise[noise]
        gd = 1 / (1 + np.exp(np.clip(data, -30, 30)))
        gn = -1 / (1 + np.exp(-np.clip(other, -30, 30)))
        gq = (gd[:, None] * tw + gn @ tn)[:, :SIZE]
        self._step("t", np.concatenate((gd[:, None] * q, gn.T @ q)) * scale, np.concatenate((w, noise)))
        self._step("c1", np.einsum("ij,ij->j", gq, r1) * scale)
        self._step("c2", np.einsum("ij,ij->j", gq, r2) * scale)
        self._step("r", np.concatenate((gq * th["c1"], gq * th["c2"])) * scale, np.concatenate((one, two)))

    def train(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        order = self.rng.permutation(len(w))
        w, one, two = (x.astype(np.uint16)[order] for x in (w, one, two))
        for k in range(0, len(w), BATCH):
            self.batch(w[k : k + BATCH], one[k : k + BATCH], two[k : k + BATCH])
        self.seen += len(w)

    def packed(self) -> np.ndarray:
        return packed(self.theta, self.squares)


_SHAPES = {"r": (SYMBOLS, SIZE), "t": (SYMBOLS, SIZE + 1), "c1": (SIZE,), "c2": (SIZE,)}


def beginning(p: np.ndarray, seed: int = 1) -> tuple[dict, dict]:
    """Parameters and squares before any training: small vectors, and the logarithms of the unigram as biases."""
    rng = np.random.default_rng(seed)
    theta = {"r": rng.normal(0, 0.1, _SHAPES["r"]), "t": rng.normal(0, 0.1, _SHAPES["t"]), "c1": np.ones(SIZE), "c2": np.full(SIZE, 0.5)}
    theta["t"][:, SIZE] = np.log(p)
    return theta, {k: np.full(v, 1e-4) for k, v in _SHAPES.items()}


def packed(theta: dict[str, np.ndarray], squares: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x[k].ravel() for x in (theta, squares) for k in _SHAPES]).astype(np.float64)


def unpacked(flat: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    out, at = ({}, {}), 0
    for x in out:
        for k, shape in _SHAPES.items():
            n = math.prod(shape)
            x[k], at = flat[at : at + n].reshape(shape), at + n
    return out


def normalised(theta: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores by either context, bias, and log of the normaliser of each pair of contexts; START is never predicted."""
    t = theta["t"][:, :SIZE]
    left, right = (theta["r"] * theta["c2"]) @ t.T, (theta["r"] * theta["c1"]) @ t.T
    bias = theta["t"][:, SIZE].copy()
    bias[START] = -np.inf
    a, b = left.max(1), right.max(1)
    top = bias.max()
    z = (np.exp(left - a[:, None]) * np.exp(bias - top)) @ np.exp(right - b[:, None]).T
    norm = np.log(z) + a[:, None] + b[None, :] + top
    return left.astype(np.float32), right.astype(np.float32), bias, norm


def held_out(id_column, folds: int, fold: int):
    return F.coalesce(F.crc32(id_column.cast("string")) % folds == fold, F.lit(False))


def _packed_words(words: list[bytes]) -> tuple[bytes, bytes]:
    return b"".join(words), np.array([len(w) for w in words], "<u4").tobytes()


def _words_of(data: bytes, sizes: bytes) -> pa.Array:
    return scan.binary_array(np.frombuffer(data, np.uint8), np.concatenate(([0], np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64)))))


def _by_bucket(words: list[bytes], buckets: int) -> dict[int, np.ndarray]:
    """Places of the words of each bucket, in an order that depends on the words alone."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((h, bucket))
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return {b: order[cuts[b] : cuts[b + 1]] for b in range(buckets) if cuts[b] < cuts[b + 1]}


_COUNTS = "bucket int, words binary, sizes binary, counts binary"


def _count(buckets: int):
    """For mapInArrow over (text): words of each slice with their counts, by bucket; the empty word is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in scan.slices(batches, "text", 8 << 20):
            tokens = scan.words(part.column(0))
            words = [*tokens.values.to_pylist(), b""]
            counts = np.append(np.bincount(tokens.codes, minlength=len(words) - 1), part.num_rows).astype("<i8")
            rows = [(b, *_packed_words([words[k] for k in at]), counts[at].tobytes()) for b, at in _by_bucket(words, buckets).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "words", "sizes", "counts"])

    return run


def _joined(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
    words = pa.concat_arrays([_words_of(d, s) for d, s in zip(table["words"].to_pylist(), table["sizes"].to_pylist(), strict=True)])
    return words, np.concatenate([np.frombuffer(x, "<i8") for x in table["counts"].to_pylist()])


def _total(table: pa.Table) -> pa.Table:
    """One bucket: the count of each distinct word."""
    words, counts = _joined(table)
    coded = words.dictionary_encode()
    sums = np.bincount(coded.indices.to_numpy(), counts, len(coded.dictionary)).astype("<i8")
    data, sizes = _packed_words(coded.dictionary.to_pylist())
    return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "words": pa.array([data]), "sizes": pa.array([sizes]), "counts": pa.array([sums.tobytes()])})


def _frequent(most: int, least: int):
    """For mapInArrow over totals: the words of each bucket that are counted `least` times, or `most` of these.

    Each bucket's first row carries its numbers of tokens and of distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for k in range(part.num_rows):
                words, counts = _joined(pa.Table.from_batches([part.slice(k, 1)]))
                top = np.argsort(-counts, kind="stable")[:most]
                top = top[(counts[top] >= least) | (np.arange(len(top)) == 0)]
                once = np.arange(len(top)) == 0
                columns = [words.take(pa.array(top)), pa.array(counts[top]), pa.array(np.where(once, counts.sum(), 0)), pa.array(np.where(once, len(words), 0))]
                yield pa.RecordBatch.from_arrays(columns, ["word", "times", "tokens", "words"])

    return run


_HEADS = "word binary, times long, tokens long, words long"


def _short_list(totals: DataFrame, buckets: int) -> tuple[list, int, int]:
    """The most frequent words with counts, and the numbers of all tokens and distinct words.

    The count of the last of SHORT_LIST words among some of each bucket bounds from below what the list needs."""
    some = durable.stored(totals.mapInArrow(_frequent(-(-4 * SHORT_LIST // buckets) + 8, 0), _HEADS), "heads")
    sums = some.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("v")).first()
    first = some.filter(F.length("word") > 0).orderBy(F.desc("times"), "word").limit(SHORT_LIST).collect()
    least = first[-1]["times"] if len(first) == SHORT_LIST else 0
    every = totals.mapInArrow(_frequent(1 << 30, least), _HEADS).filter((F.length("word") > 0) & (F.col("times") >= least))
    return every.orderBy(F.desc("times"), "word").limit(SHORT_LIST).collect(), sums["n"], sums["v"]


def _tails(short):
    """For mapInArrow over totals: of each class tokens, words, words seen once and twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for k in range(part.num_rows):
                words, counts = _joined(pa.Table.from_batches([part.slice(k, 1)]))
                rest = (symbols(short.value, words) >= FIRST_CLASS) & (pc.binary_length(words).to_numpy() > 0)
                cls, n = tail_classes(words)[rest], counts[rest]
                sums = [np.bincount(cls, x, CLASSES).astype(np.int64) for x in (n, np.ones(len(n)), n == 1, n == 2)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), *map(pa.array, sums)], ["cls", "tokens", "words", "once", "twice"])

    return run


_SUMS = "part int, seen long, sums binary"


def _in_parts(flat: np.ndarray, seen: int) -> pa.RecordBatch:
    parts = np.array_split(flat, PARTS)
    columns = [pa.array(np.arange(PARTS, dtype=np.int32)), pa.array([seen] * PARTS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["part", "seen", "sums"])


def _train(short, unigram, start):
    """For applyInArrow over a shard (key, text): the sums of its parameters, times its tokens, and the tokens.

    Rows are put in the order of their hash and text before, so that the shard's training follows from its rows."""

    def run(table: pa.Table) -> pa.Table:
        trainer = Trainer(unigram.value, start.value, 1 + table["shard"][0].as_py())
        table = table.select(["key", "text"]).sort_by([("key", "ascending"), ("text", "ascending")])
        for part in scan.slices(iter(table.combine_chunks().to_batches()), "text", 2 << 20):
            tokens = scan.words(part.column(1))
            each = symbols(short.value, tokens.values)
            w, one, two, _ = sequence(each[tokens.codes] if len(each) else np.zeros(0, np.int64), tokens.offsets)
            trainer.train(w, one, two)
        return pa.Table.from_batches([_in_parts(trainer.packed() * trainer.seen, trainer.seen)])

    return run


def _task_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: one sum for each part of a task's shards, so that as many rows as tasks are shuffled."""
    seen, sums = 0, {}
    for batch in batches:
        for part, n, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            x = np.frombuffer(blob, np.float64)
            sums[part] = x.copy() if part not in sums else sums[part] + x
            seen += n if part == 0 else 0
    if sums:
        yield _in_parts(np.concatenate([sums[k] for k in range(PARTS)]), seen)


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One part of the parameters: sums over tasks."""
    seen, total = 0, None
    for batch in batches:
        for n, blob in zip(batch.column("seen").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            x = np.frombuffer(blob, np.float64)
            seen, total = seen + n, x.copy() if total is None else total + x
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([seen], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "seen", "sums"])


def _trained(rows: DataFrame, short, unigram: np.ndarray, n_tokens: int) -> dict[str, np.ndarray]:
    """Parameters after all rounds. rows: key, text."""
    spark = rows.sparkSession
    shards = max(1, math.ceil(n_tokens / SHARD_TOKENS))
    noise, state = spark.sparkContext.broadcast(unigram), beginning(unigram / unigram.sum())
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key", "text"), F.lit(shards)).cast("int"))
    for r in range(min(ROUNDS, shards)):
        start = spark.sparkContext.broadcast(state)
        some = dealt.filter(F.col("shard") % min(ROUNDS, shards) == r)
        sums = some.groupBy("shard").applyInArrow(_train(short, noise, start), _SUMS).mapInArrow(_task_sums, _SUMS)
        parts = sorted(sums.groupBy("part").applyInArrow(_added, _SUMS).collect(), key=lambda x: x["part"])
        if parts and parts[0]["seen"]:
            state = unpacked(np.concatenate([np.frombuffer(bytes(x["sums"]), np.float64) / x["seen"] for x in parts]))
        durable.release(spark)
    return state[0]


@dataclass(frozen=True)
class Trained:
    """model: for executors; totals: the table of word counts; tokens, words: of all training texts."""

    model: Model
    totals: DataFrame
    tokens: int
    words: int
    buckets: int


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Trained:
    """Counts and trains on all rows of docs. Buckets of words are as many as the texts' bytes ask for."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(durable.partitions(spark) * 2, -(-n_bytes // BUCKET_BYTES))
    totals = texts.select("text").mapInArrow(_count(buckets), _COUNTS).groupBy("bucket").applyInArrow(_total, _COUNTS)
    totals = durable.stored(totals, "words")
    top, n_tokens, n_words = _short_list(totals, buckets)
    short = {bytes(r["word"]): 2 + k for k, r in enumerate(top)}
    shared = spark.sparkContext.broadcast(short)
    tails = totals.mapInArrow(_tails(shared), "cls int, tokens long, words long, once long, twice long").groupBy("cls").agg(*(F.sum(c).alias(c) for c in ("tokens", "words", "once", "twice")))
    tail = np.zeros((4, CLASSES), np.int64)
    for r in tails.collect():
        tail[:, r["cls"]] = r["tokens"], r["words"], r["once"], r["twice"]
    unigram = np.full(SYMBOLS, 0.5)
    unigram[2 : 2 + len(top)] += [r["times"] for r in top]
    unigram[FIRST_CLASS:] += tail[0]
    unigram[END] += n_tokens - sum(r["times"] for r in top) - tail[0].sum()
    theta = _trained(texts, shared, unigram, n_tokens)
    discount = np.clip(tail[2] / np.maximum(tail[2] + 2 * tail[3], 1), 0.1, 0.9)
    model = Model(short, *normalised(theta), discount, tail[0], tail[1])
    return Trained(model, totals, n_tokens, n_words, buckets)


def _ask(buckets: int):
    """For applyInArrow over a block: its words (and the end), by bucket."""

    def run(table: pa.Table) -> pa.Table:
        words = [*scan.words(table["text"].combine_chunks()).values.to_pylist(), b""]
        rows = [(b, table["block"][0].as_py(), *_packed_words([words[k] for k in at])) for b, at in _by_bucket(words, buckets).items()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "words", "sizes"])

    return run


def _answer(asked: pa.Table, totals: pa.Table) -> pa.Table:
    """For cogrouped applyInArrow over a bucket: the counts of the words that each block asks for."""
    if totals.num_rows:
        known, counts = _joined(totals)
    else:
        known, counts = pa.array([], pa.binary()), np.zeros(0, np.int64)
    counts = np.append(counts, 0)
    out = []
    for data, sizes in zip(asked["words"].to_pylist(), asked["sizes"].to_pylist(), strict=True):
        at = pc.fill_null(pc.index_in(_words_of(data, sizes), known), len(known)).to_numpy(zero_copy_only=False)
        out.append(counts[at].astype("<i8").tobytes())
    return pa.table({"block": asked["block"], "bucket": asked["bucket"], "counts": pa.array(out, pa.binary())})


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(shared, n: int, v: int, buckets: int):
    """For cogrouped applyInArrow over a block: scores of its texts."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        model: Model = shared.value
        tokens = scan.words(table["text"].combine_chunks())
        codes, words = tokens.codes.astype(np.int64), tokens.values.to_pylist()
        got = dict(zip(answers["bucket"].to_pylist(), answers["counts"].to_pylist(), strict=True))
        count = np.zeros(len(words) + 1, np.int64)
        for b, at in _by_bucket([*words, b""], buckets).items():
            count[at] = np.frombuffer(got[b], "<i8")
        texts = table.num_rows
        bounds = tokens.offsets + np.arange(texts + 1)
        every = np.full(bounds[-1], len(words), np.int64)
        every[np.arange(len(codes)) + np.repeat(np.arange(texts), np.diff(tokens.offsets))] = codes
        kinds = np.append(symbols(model.short, tokens.values), END)
        w, one, two, _ = sequence(kinds[codes], tokens.offsets)
        p = model.left[two, w].astype(np.float64) + model.right[one, w] + model.bias[w] - model.norm[two, one]
        in_tail = kinds >= FIRST_CLASS
        extra = np.zeros(len(kinds))
        extra[in_tail] = model.log_tail(kinds[in_tail] - FIRST_CLASS, count[in_tail])
        p += extra[every]
        if not n:
            p[:] = 0.0
        base = np.log10((count + 1) / (n + v + 1))[every]
        sums = [np.add.reduceat(x, bounds[:-1]) for x in (base, p / math.log(10), (count > 0)[every].astype(np.int64))]
        kinds_out = {"doc_id": table["doc_id"], "held_out": table["held_out"], "n_tokens": pa.array(np.diff(bounds)), "n_known": pa.array(sums[2]), "train_tokens": pa.array(np.full(texts, n)), "base_score": pa.array(sums[0]), "score": pa.array(sums[1])}
        return pa.table(kinds_out)

    return run


def score(docs: DataFrame, trained: Trained, folds: int = 7, fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    blocks = max(1, math.ceil(max(trained.tokens * 1.2, 1) / BLOCK_TOKENS))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), folds, fold).alias("held_out"), F.col(text_col).alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    asked = rows.groupBy("block").applyInArrow(_ask(trained.buckets), "bucket int, block int, words binary, sizes binary")
    answers = asked.groupBy("bucket").cogroup(trained.totals.groupBy("bucket")).applyInArrow(_answer, "block int, bucket int, counts binary")
    answers = durable.stored(answers, "answers")
    shared = spark.sparkContext.broadcast(trained.model)
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(shared, trained.tokens, trained.words, trained.buckets), _SCORES)


def fit_and_score(docs: DataFrame, folds: int = 7, fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the rows outside the held-out fold and scores all rows."""
    return score(docs, fit(docs.filter(~held_out(F.col(id_col), folds, fold)), text_col, id_col), folds, fold, id_col, text_col)
