"""Scoring texts with a gated recurrent language model and a smoothed unigram model.

1. Words of all training texts are counted. The VOCABULARY most frequent ones, the end of a text among them, get output
   weights; the others share a class of their own, inside which the smoothed counts of the whole corpus decide.
2. The output softmax is factored: P(word) = P(class) P(word | class), with classes of CLASS words by rank.
3. Every text is encoded once: its words' ids for the network, and what the counts alone give.
4. The recurrent weights are fitted on every training text by truncated backpropagation in numpy: windows of WINDOW words in up
   to STREAMS places of the trainer's words side by side, the state carried from window to window and reset where a text
   begins. Trainers are Spark tasks on TRAINER_WORDS words or so, so their number grows with the corpus; Spark averages their
   weights after each round. In a corpus that fills the trainers of all rounds each text has its turn in one round.
5. Each text is read to its end in windows with its state carried along, in SLOTS texts side by side; a slot whose text has
   ended takes the next one. Words beyond the KNOWN most frequent meet their counts in a join.
"""

from __future__ import annotations

from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumisift.llm.common import arrow_schema, fresh, lean, shuffle_partitions, text_bytes, written

VOCABULARY, CLASS, KNOWN = 2048, 32, 300_000
WIDTH, WINDOW, STREAMS, SLOTS = 16, 32, 512, 512
#: The words of a trainer, about, the rounds, and the windows to each stream below STREAMS of them.
TRAINER_WORDS, ROUNDS, STEPS, FEWEST = 2_000_000, 3, 100, 16
RATE, CLIP, ADDED = 0.02, 1.0, 0.1
#: The key of the end of a text, which no word has, and the longest word that is its own key.
END, LONGEST = b"", 16
COUNTED_AT_ONCE = 300_000
_KEYS = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType())])


def words_of(text: bytes) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def word_key(word: bytes) -> bytes:
    """The word, or 17 bytes that stand for a long one."""
    return word if len(word) <= LONGEST else b"\0" + xxhash.xxh3_128_digest(word)


def held_out(doc_id: Column) -> Column:
    """Whether the checksum of the id as text ends in 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, n) of all words of docs and of the texts' ends. Tasks sum up before anything is shuffled, in bounded memory."""
    to = arrow_schema(_KEYS)

    @lean
    def run(batches):
        from collections import Counter

        found = Counter()

        def batch():
            keys = pa.array([word_key(w) for w in found], pa.binary())
            return pa.RecordBatch.from_arrays([keys, pa.array(found.values(), pa.int64())], schema=to)

        for b in batches:
            for text in text_bytes(b, "text"):
                found.update(words_of(text))
                found[END] += 1
                if len(found) > COUNTED_AT_ONCE:
                    yield batch()
                    found.clear()
        yield batch()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, _KEYS).groupBy("key").agg(F.sum("n").alias("n"))


class Network:
    """A gated recurrent unit over word vectors, with class-factored outputs; all weights are views of one vector."""

    def __init__(self, words: int, width: int = WIDTH, weights: np.ndarray | None = None, counts: np.ndarray | None = None, rare: float = 1.0):
        self.words, self.width, self.classes = words, width, -(-words // CLASS)
        shapes = {"vectors": (words + 1, width), "into": (width, 3 * width), "again": (width, 3 * width), "bias": (3 * width,), "to_class": (width, self.classes + 1), "class_bias": (self.classes + 1,), "to_word": (width, self.classes * CLASS), "word_bias": (self.classes * CLASS,)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        if weights is None:
            r = np.random.default_rng(13)
            weights = (r.standard_normal(size) / np.sqrt(width)).astype(np.float32)
        self.weights, at = np.asarray(weights, np.float32), 0
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            setattr(self, name, self.weights[at : at + n].reshape(shape))
            at += n
        if counts is not None:
            padded = np.full(self.classes * CLASS, -30.0)
            padded[:words] = np.log(counts)
            self.bias[:] = 0
            self.word_bias[:] = padded
            self.class_bias[:] = np.log(np.append(np.exp(padded).reshape(-1, CLASS).sum(1), rare))
            self.to_class *= 0.1
            self.to_word *= 0.1

    def inputs(self) -> np.ndarray:
        """What each word gives to the gates."""
        return self.vectors @ self.into + self.bias

    def run(self, ids: np.ndarray, state: np.ndarray, begins: np.ndarray | None = None, keep: list | None = None, given: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States behind each of the words ids (rows, steps), and the last; begins marks words before which a state is reset, given is inputs()."""
        given, w = self.inputs() if given is None else given, self.width
        out = np.empty((ids.shape[1], len(ids), w), np.float32)
        for t in range(ids.shape[1]):
            if begins is not None and begins[:, t].any():
                state = np.where(begins[:, t, None], np.float32(0), state)
            x, h = given[ids[:, t]], state @ self.again
            gates = 0.5 + 0.5 * np.tanh(0.5 * (x[:, : 2 * w] + h[:, : 2 * w]))
            new = np.tanh(x[:, 2 * w :] + gates[:, w:] * h[:, 2 * w :])
            if keep is not None:
                keep.append((state, gates, new, h[:, 2 * w :]))
            state = new + gates[:, :w] * (state - new)
            out[t] = state
        return out, state

    def log_probabilities(self, states: np.ndarray, targets: np.ndarray, gradient: Network | None = None):
        """Natural log P(target | state), of the class alone where the target is rare (its id is `words`).

        With a gradient network, the loss's gradients are added to it and those of the states are returned too.
        """
        at, cls = np.arange(len(targets)), np.where(targets < self.words, targets // CLASS, self.classes)
        # states lie in -1..1, so one bound serves all rows
        logits = states @ self.to_class
        logits += self.class_bias - (self.class_bias + np.abs(self.to_class).sum(0)).max()
        found = logits[at, cls]
        odds = np.exp(logits, out=logits)
        total = odds @ np.ones((odds.shape[1], 1), np.float32)
        found -= np.log(total[:, 0])
        if gradient is not None:
            odds /= total
            odds[at, cls] -= 1
            back = odds @ self.to_class.T
            gradient.to_class += states.T @ odds
            gradient.class_bias += np.ones(len(odds), np.float32) @ odds
        cls = cls.astype(np.uint16)  # sorted by counting
        order = np.argsort(cls, kind="stable")
        order = order[: np.searchsorted(cls[order], self.classes)]
        edges, ones = np.searchsorted(cls[order], np.arange(self.classes + 1)), np.ones((CLASS, 1), np.float32)
        own_states, places, inside = states[order], (targets[order] % CLASS), np.empty(len(order), found.dtype)
        most = (self.word_bias + np.abs(self.to_word).sum(0)).reshape(self.classes, CLASS).max(1)
        own_back = None if gradient is None else np.empty_like(own_states)
        for c in np.flatnonzero(np.diff(edges)).tolist():
            some, span = slice(edges[c], edges[c + 1]), slice(c * CLASS, (c + 1) * CLASS)
            own, place = self.to_word[:, span], (at[: edges[c + 1] - edges[c]], places[some])
            logits = own_states[some] @ own
            logits += self.word_bias[span] - most[c]
            right = logits[place]
            odds = np.exp(logits, out=logits)
            total = odds @ ones
            inside[some] = right - np.log(total[:, 0])
            if gradient is not None:
                odds /= total
                odds[place] -= 1
                own_back[some] = odds @ own.T
                gradient.to_word[:, span] += own_states[some].T @ odds
                gradient.word_bias[span] += np.ones(len(odds), np.float32) @ odds
        found[order] += inside
        if gradient is not None:
            back[order] += own_back
        return found if gradient is None else (found, back)

    def backward(self, ids: np.ndarray, begins: np.ndarray, kept: list, back: np.ndarray, gradient: Network) -> None:
        """Truncated backpropagation: through the window's steps, from the states' gradients `back` (steps, rows, width)."""
        w, carried = self.width, np.zeros(back.shape[1:], np.float32)
        each = np.empty((*back.shape[:2], 3 * w), np.float32)
        for t in range(len(kept) - 1, -1, -1):
            state, gates, new, h = kept[t]
            d = back[t] + carried
            update, reset = gates[:, :w], gates[:, w:]
            d_new = d * (1 - update) * (1 - new * new)
            d_gates = np.concatenate([d * (state - new), d_new * h], 1) * gates * (1 - gates)
            d_again = np.concatenate([d_gates, d_new * reset], 1)
            gradient.again += state.T @ d_again
            carried = d * update + d_again @ self.again.T
            carried[begins[:, t]] = 0
            each[t, :, : 2 * w], each[t, :, 2 * w :] = d_gates, d_new
        each, words = each.reshape(-1, 3 * w), ids.T.ravel()
        gradient.into += self.vectors[words].T @ each
        gradient.bias += np.ones(len(each), np.float32) @ each
        for k, of_words in enumerate((each @ self.into.T).T):
            gradient.vectors[:, k] += np.bincount(words, of_words, len(self.vectors))


def trained(network: Network, texts, rate: float = RATE, at_once: int = 2 * TRAINER_WORDS) -> np.ndarray:
    """Weights after one pass over all texts (arrays of ids, each with its end), by Adam; at_once words or so are held at a time.

    What is held is cut into streams of one length, wherever that falls; a text cut there goes on with its last word but without its state.
    """
    mean, square, n = np.zeros_like(network.weights), np.zeros_like(network.weights), 0
    texts = iter(texts)
    while held := list(_up_to(texts, at_once)):
        targets = np.concatenate(held)
        begins = np.zeros(len(targets), bool)
        begins[np.cumsum([0, *map(len, held[:-1])])] = True
        inputs = np.concatenate([targets[:1], targets[:-1]])
        inputs[begins] = targets[-1]  # the end of a text
        streams = min(STREAMS, max(FEWEST, len(targets) // (WINDOW * STEPS)))
        steps = -(-len(targets) // streams)
        # padding behind the last word counts for nothing
        targets, inputs, begins = (np.append(x, np.zeros(streams * steps - len(x), x.dtype)).reshape(streams, steps) for x in (targets, inputs, begins))
        real = (np.arange(streams * steps) < sum(map(len, held))).reshape(streams, steps)
        state = np.zeros((streams, network.width), np.float32)
        for at in range(0, steps, WINDOW):
            span, kept, n = slice(at, at + WINDOW), [], n + 1
            states, state = network.run(inputs[:, span], state, begins[:, span], kept)
            gradient = Network(network.words, network.width, np.zeros_like(network.weights))
            counted = real[:, span].T
            back = np.zeros_like(states)
            _, back[counted] = network.log_probabilities(states[counted], targets[:, span].T[counted].astype(np.int64), gradient)
            network.backward(inputs[:, span], begins[:, span], kept, back, gradient)
            g = gradient.weights / max(1, counted.sum())
            g *= min(1.0, CLIP / max(1e-12, float(np.linalg.norm(g))))
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            network.weights -= rate * (mean / (1 - 0.9**n)) / (np.sqrt(square / (1 - 0.99**n)) + 1e-8)
    return network.weights


def _up_to(texts, size: int):
    """Texts from an iterator, until they have `size` words together."""
    for text in texts:
        yield text
        size -= len(text)
        if size <= 0:
            return


class Lexicon(dict):
    """Ranks of the known words; a long word is known by its key, any other is -1."""

    def __missing__(self, word: bytes) -> int:
        return dict.get(self, word_key(word), -1) if len(word) > LONGEST else -1


def scored_texts(network: Network, numbered, end: int):
    """Of (number, ids with their end): (number, sum of log10 probabilities), in the order in which texts end.

    SLOTS texts are read side by side, a window at a time; each has its state carried from window to window.
    """
    numbered, state = iter(numbered), np.zeros((SLOTS, network.width), np.float32)
    open_texts: list[list] = []
    given = network.inputs()
    while True:
        taken = list(islice(numbered, SLOTS - len(open_texts)))
        state[len(open_texts) : len(open_texts) + len(taken)] = 0
        open_texts += [[number, ids, 0, 0.0] for number, ids in taken]
        if not open_texts:
            return
        n = len(open_texts)
        ids, targets, lengths = np.full((n, WINDOW), end), np.zeros((n, WINDOW), np.int64), np.zeros(n, np.int64)
        for k, (_, text, at, _) in enumerate(open_texts):
            part = text[at : at + WINDOW]
            targets[k, : len(part)], lengths[k] = part, len(part)
            ids[k, 1 : len(part)] = part[:-1]
            if at:
                ids[k, 0] = text[at - 1]
        states, last = network.run(ids, state[:n], given=given)
        real = np.arange(WINDOW)[:, None] < lengths
        sums = np.zeros((WINDOW, n))
        sums[real] = network.log_probabilities(states[real], targets.T[real])
        stay = []
        for k, (text, total) in enumerate(zip(open_texts, (sums.sum(0) / np.log(10)).tolist(), strict=True)):
            text[2] += WINDOW
            text[3] += total
            if text[2] >= len(text[1]):
                yield text[0], text[3]
            else:
                stay.append(k)
        state[: len(stay)] = last[stay]
        open_texts = [open_texts[k] for k in stay]


class Model:
    """What scoring needs: weights, the known words by rank with their counts, and the corpus's totals. Its size is bounded."""

    def __init__(self, known: list[tuple[bytes, int]], n: int, v: int, vocabulary: int):
        self.n, self.v = n, v
        vocabulary = [i for i, (key, _) in enumerate(known) if len(key) <= LONGEST][:vocabulary]
        chosen = set(vocabulary)
        ordered = [known[i] for i in vocabulary] + [x for i, x in enumerate(known) if i not in chosen]
        self.keys, self.counts = [x[0] for x in ordered], np.array([x[1] for x in ordered], np.float64)
        self.words = len(vocabulary)
        if END not in self.keys[: self.words]:
            raise ValueError("the vocabulary is too small for the end of a text")
        self.end = self.keys.index(END)
        inside = float(self.counts[: self.words].sum())
        self.rare = n - inside, np.log10(max(ADDED, n - inside + ADDED * (v - self.words + 1)))
        self.logs = np.append(np.log10(self.counts + ADDED), 0.0)  # unknown words come from the join
        self.weights = Network(self.words, counts=self.counts[: self.words] + ADDED, rare=self.rare[0] + ADDED).weights

    def lexicon(self) -> Lexicon:
        return Lexicon(zip(self.keys, range(len(self.keys)), strict=True))

    def network(self) -> Network:
        return Network(self.words, weights=self.weights.copy())

    def ranks(self, lexicon: Lexicon, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(lexicon.__getitem__, words), np.int64, len(words))

    def ids(self, ranks: np.ndarray) -> np.ndarray:
        """Ids of a text's words and its end for the network; words outside the vocabulary are rare."""
        return np.append(np.where((ranks >= 0) & (ranks < self.words), ranks, self.words), self.end)


def counted(docs: DataFrame, text_col: str = "text", vocabulary: int = VOCABULARY, known: int = KNOWN) -> tuple[Model | None, DataFrame]:
    """A model of docs that knows their counts alone, and the counts (key, n) of all their words; without a row there is no model."""
    counts = written(word_counts(docs, text_col))
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    if not totals["n"]:
        return None, counts
    top = dict(zip(*counts.orderBy(F.col("n").desc(), "key").limit(known).toArrow().to_pydict().values(), strict=True))  # a bounded number of words
    if END not in list(top)[:vocabulary]:
        ends = counts.filter(F.length("key") == 0).first()["n"]
        top = {k: n for k, n in (*list(top.items())[: vocabulary - 1], (END, ends), *list(top.items())[vocabulary - 1 :])}
    return Model(list(top.items()), totals["n"], totals["v"], vocabulary), counts


_CODES = T.StructType([T.StructField("row__lm", T.LongType()), T.StructField("ids__lm", T.BinaryType()), T.StructField("tokens__lm", T.LongType()), T.StructField("here__lm", T.LongType()), T.StructField("base__lm", T.DoubleType()), T.StructField("rare__lm", T.DoubleType()), T.StructField("tail__lm", T.ArrayType(T.BinaryType()))])


def _kind(words: int) -> str:
    """Two bytes an id where they suffice."""
    return "<u2" if words < 1 << 16 else "<u4"


def encoded(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with each whole text replaced by its ids for the network, its length, what its known words add to the scores, and
    the keys of its other words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*(docs.schema[c] for c in rest), *_CODES.fields])
    to, unigrams, kind = arrow_schema(schema), float(np.log10(model.n + ADDED * (model.v + 1))), _kind(model.words)

    @lean
    def run(batches):
        from pyspark import TaskContext

        model = sent.value
        lexicon, number = model.lexicon(), TaskContext.get().partitionId() << 40
        for b in batches:
            for k in range(0, b.num_rows, SLOTS):
                some, found = b.slice(k, SLOTS), []
                for text in (x or b"" for x in some.column(len(rest)).cast(pa.binary()).to_pylist()):
                    words = words_of(text)
                    ranks = model.ranks(lexicon, words)
                    tail = [word_key(words[i]) for i in np.flatnonzero(ranks < 0).tolist()]
                    logs, n = model.logs[ranks], len(words) + 1  # an unknown word's -1 takes the zero at the end
                    is_rare = ranks >= model.words
                    rare = float(logs[is_rare].sum()) - (int(is_rare.sum()) + len(tail)) * model.rare[1]
                    found.append((number, model.ids(ranks).astype(kind).tobytes(), n, n - len(tail), float(logs.sum()) + model.logs[model.end] - n * unigrams, rare, tail))
                    number += 1
                yield pa.RecordBatch.from_arrays([*some.columns[: len(rest)], *(pa.array([r[i] for r in found], f.type) for i, f in enumerate(list(to)[len(rest) :]))], schema=to)

    return docs.select(*rest, text_col).mapInArrow(run, schema)


def fit(codes: DataFrame, model: Model, draw: Column, trainer_words: int = TRAINER_WORDS, rounds: int = ROUNDS) -> None:
    """Fits the model's weights, which start from the counts, on all rows of encoded texts.

    Texts are dealt to trainers of about `trainer_words` words by the hash `draw`. A corpus of as many words as the trainers of
    all rounds take is dealt out over the rounds, each text to one; every round reads the whole of a smaller one.
    """
    spark, kind = codes.sparkSession, _kind(model.words)
    turns = rounds if model.n >= rounds * trainer_words else 1
    groups = int(max(1, -(-model.n // (turns * trainer_words))))
    rows = codes.select("ids__lm", draw.alias("draw")).withColumns({"turn": F.pmod(F.xxhash64("draw", F.lit(2)), F.lit(turns)), "trainer": F.pmod(F.xxhash64("draw", F.lit(1)), F.lit(groups)).cast("int")})
    schema = T.StructType([T.StructField("trainer", T.IntegerType()), T.StructField("weights", T.ArrayType(T.FloatType()))])
    to = arrow_schema(schema)
    for k in range(rounds):
        sent, rate = spark.sparkContext.broadcast((model.words, model.weights)), RATE / 2**k

        @lean
        def train(batches, sent=sent, rate=rate):
            words, weights = sent.value
            rows = ((t, np.frombuffer(ids, kind)) for b in batches for t, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for trainer, own in groupby(rows, lambda r: r[0]):
                found = trained(Network(words, weights=weights.copy()), (ids for _, ids in own), rate, 2 * trainer_words)
                yield pa.RecordBatch.from_arrays([pa.array([trainer], pa.int32()), pa.array([found], to.field(1).type)], schema=to)

        dealt = rows.filter(F.col("turn") == k % turns).repartitionByRange(min(groups, shuffle_partitions(spark)), "trainer").sortWithinPartitions("trainer", "draw", "ids__lm")
        weights = written(dealt.select("trainer", "ids__lm").mapInArrow(train, schema))
        mean = weights.select(F.posexplode("weights")).groupBy("pos").agg(F.round(F.avg(F.col("col").cast("double")), 7).alias("w"))
        found = mean.toArrow()  # one number for each weight
        if found.num_rows:
            model.weights = found.sort_by("pos")["w"].to_numpy().astype(np.float32)


_SCORES = T.StructType([T.StructField("row__lm", T.LongType()), T.StructField("score__lm", T.DoubleType())])


def score(codes: DataFrame, model: Model, counts: DataFrame, names: tuple[str, str, str, str] = ("n_tokens", "n_known", "base_score", "score")) -> DataFrame:
    """Encoded rows with, instead of their codes, n_tokens (words and the end), n_known (those counted in training), base_score
    (smoothed unigrams) and score (the network), log10 probabilities of the whole text.

    Null text is empty: its end is all there is. Rows count one by one, repeated ones too.
    """
    sent = codes.sparkSession.sparkContext.broadcast((model.words, model.weights))
    rest = [c for c in codes.columns if c not in _CODES.names]
    plain = [c for c in codes.columns if c != "ids__lm"]
    schema = T.StructType([*(codes.schema[c] for c in plain), _SCORES["score__lm"]])
    to, end, kind = arrow_schema(schema), model.end, _kind(model.words)

    @lean
    def run(batches):
        words, weights = sent.value
        network, held = Network(words, weights=weights.copy()), {}

        def texts():
            number = 0
            for b in batches:
                for *other, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    held[number] = other
                    yield number, np.frombuffer(ids, kind)
                    number += 1

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(to)], schema=to)

        out = []
        for number, found in scored_texts(network, texts(), end):
            out.append((*held.pop(number), found))
            if len(out) == SLOTS:
                yield batch(out)
                out = []
        yield batch(out)

    found = written(codes.select(*plain, "ids__lm").mapInArrow(run, schema))
    tails = found.select("row__lm", F.explode("tail__lm").alias("key")).join(counts, "key", "left")
    sums = tails.groupBy("row__lm").agg(F.count("n").alias("known__lm"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADDED))).alias("logs__lm"))
    known, logs = F.coalesce("known__lm", F.lit(0)), F.coalesce("logs__lm", F.lit(0.0))
    new = (F.col("tokens__lm"), F.col("here__lm") + known, F.col("base__lm") + logs, F.col("score__lm") + F.col("rare__lm") + logs)
    return found.join(sums, "row__lm", "left").select(*rest, *(value.alias(name) for name, value in zip(names, new, strict=True)))


def scored(docs: DataFrame, train_if: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY, known: int = KNOWN, **settings) -> DataFrame:
    """docs without its text, with score()'s columns by a model of all rows that train_if holds for, and train_tokens, the
    words counted there. New columns whose names are taken get leading underscores.

    Without any such row every word is as likely as all words together: both scores are 0.
    """
    model, counts = counted(docs.filter(train_if), text_col, vocabulary, known)
    nothing = model is None
    model = model or Model([(END, 0)], 0, 0, 1)
    marked = docs.withColumns({"train__lm": F.coalesce(train_if, F.lit(False)), "draw__lm": F.xxhash64(F.col(id_col), F.col(text_col))})
    codes = written(encoded(marked, model, text_col))
    if not nothing:
        fit(codes.filter("train__lm"), model, F.col("draw__lm"), **settings)
    names = tuple(fresh(docs, name) for name in ("n_tokens", "n_known", "base_score", "score"))
    found = score(codes.drop("train__lm", "draw__lm"), model, counts, names)
    if nothing:
        found = found.withColumns({names[2]: F.lit(0.0), names[3]: F.lit(0.0)})
    return found.withColumn(fresh(docs, "train_tokens"), F.lit(model.n).cast("long"))
