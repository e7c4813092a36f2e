"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

Words are compared by their common subsequences of three letters, which may have gaps: each counts decay^span, spans of
up to SPAN letters.  So inserted letters weaken a match and do not end it; other characters inside a word, and blanks
between single letters, are taken out before.  A word maps to its kernel values with a set of landmark words, whitened
by the landmarks' own kernel matrix (Nystroem), and a linear machine is trained there, on every word of the labelled
texts with the numbers of toxic and of clean texts that hold it.  As everything is linear in the kernel, it folds into
one weight for each letter triple, and scoring costs the same for any number of landmarks.

Texts are cut into sentences.  A sentence is judged by its TOP worst words together, so that two doubtful ones in one
sentence weigh more than two far apart; a text by its worst sentence, and by the share that doubtful words have in all
its sentences.  Labels are those of texts (multiple instance): in turn, each text is represented by its worst sentence
so far, and the sentence machine is fitted to these.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fold, lean, materialize, mix64, ship_code, text_chunks, valid_text

SPAN, DECAY = 6, 0.7
LETTERS = 27  # 0: a word's border
#: Texts of either class that training takes at most, those with the least hash of their id.
MOST_TOXIC, MOST_CLEAN = 3000, 5000
LANDMARKS = 240
#: Cost of a text's word in the machine, and steps of its training.
COST, STEPS = 1.0, 4
#: Standard deviations above chance from which a word's bent spellings are learned, too.
SURE = 4.0
#: Worst words of a sentence that are looked at, and rounds in which texts choose their worst sentence.
TOP, ROUNDS = 3, 3
#: Evidence that stands for words a sentence doesn't have, and the most that one word gives.
FLOOR, MOST = -2.0, 4.6
#: Evidence from which a word is doubtful, and words that are added to a text's, as the share in a few proves little.
DOUBT, FEW = 1.0, 10
#: Letters that one vectorised step looks at; its temporaries are some 60 bytes a letter.
PIECE = 1 << 17
_END = re.compile(r"(?<=[.!?…])(?=[ \t\r])|[\n。！？]+")
_MARK = "\x1e"

_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
_SKIP, _STOP = 255, 254


def _code(cp: int) -> int:
    c = chr(cp)
    if c == _MARK:
        return _STOP
    if c.isspace():
        return 0
    base = unicodedata.normalize("NFD", _LEET.get(c, c).lower())[0]
    base = {"ß": "s", "ø": "o", "æ": "a", "œ": "o", "đ": "d", "ł": "l", "ı": "i"}.get(base, base)
    return ord(base) - 96 if "a" <= base <= "z" else _SKIP


_CODES = np.array([_code(cp) for cp in range(0x250)], np.uint8)


def sentences(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(letter codes, number of the sentence of each): 1 to 26 for the folded text's letters, one 0 before, between and after words.

    Accents and case fold away, digits and @ that imitate letters count as these, other characters are dropped.
    Letters beyond the Latin blocks are coded by their number, so that other scripts are compared, too.
    """
    text = _END.sub(f" {_MARK} ", text)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    far = cp >= 0x250
    code = _CODES[np.where(far, 0, cp)]
    if far.any():
        code = np.where(far, (cp % 26 + 1).astype(np.uint8), code)
        code[(cp >= 0x2000) & (cp < 0x206F)] = 0
        code[cp == 0x3000] = 0
    code = np.concatenate([[0], code[code != _SKIP], [0]]).astype(np.uint8)
    number = np.cumsum(code == _STOP)
    code[code == _STOP] = 0
    use = np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])
    code, number = code[use], number[use]
    # blanks between single letters go: "i d i o t"
    zero = np.flatnonzero(code == 0)
    single = np.diff(zero) == 2
    inner = np.flatnonzero(single[1:] & single[:-1]) + 1
    inner = inner[number[zero[inner] + 1] == number[zero[inner] - 1]]  # within a sentence
    return (np.delete(code, zero[inner]), np.delete(number, zero[inner])) if len(inner) else (code, number)


def letters(text: str) -> np.ndarray:
    return sentences(text)[0]


def words(code: np.ndarray) -> list[str]:
    return (code + 96).tobytes().decode("latin-1").replace("`", " ").split()


_PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def scale(n: np.ndarray) -> np.ndarray:
    """A word's norm if all its subsequences differed; it depends on the number of letters only."""
    total = sum((b - 1) * np.maximum(0, n + 2 - b) * DECAY ** (2 * (b + 1)) for b in range(2, SPAN))
    return np.sqrt(np.maximum(total, 1e-12))


def subsequences(code: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(span - 1, starts, triple codes) of the subsequences within words, by their offsets."""
    c = code.astype(np.int32)
    zero = np.flatnonzero(code == 0)
    if len(zero) < 2:
        return
    room = np.zeros(len(code), np.int32)  # places up to the border that ends the word
    last = zero[np.searchsorted(zero, np.arange(len(code)), "right").clip(max=len(zero) - 1)]
    room[:] = last - np.arange(len(code))
    first, second = c * (LETTERS * LETTERS), c * LETTERS
    for a, b in _PAIRS:
        if len(c) <= b:
            continue
        yield b, np.flatnonzero(room[: len(c) - b] >= b), first[: len(c) - b] + second[a : len(c) - b + a] + c[b:]


@dataclass
class Model:
    weight: np.ndarray  # of each triple
    bias: float
    slope: float  # and shift: from the evidence of a text's worst word to its score, if there is no ``top``
    shift: float
    top: np.ndarray | None = None  # weights of a text's features, and a constant

    def worst(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margin of each word, its first place in ``code``); a long text is worked on in pieces of whole words."""
        zero = np.flatnonzero(code == 0)
        if len(zero) < 2:
            return np.empty(0), np.empty(0, np.int64)
        sums, at = [], 0
        while at < len(zero) - 1:
            end = max(at + 1, int(np.searchsorted(zero, zero[at] + PIECE, "right")) - 1)
            sums.append(self._sums(code[zero[at] : zero[end] + 1], zero[at : end + 1] - zero[at]))
            at = end
        return np.concatenate(sums) / scale(np.diff(zero) - 1) + self.bias, zero[:-1]

    def _sums(self, code: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """Weights of each word's subsequences; ``zero``: the words' borders."""
        total = np.zeros(len(code))
        for b, at, triple in subsequences(code):
            total[at] += DECAY ** (b + 1) * self.weight[triple[at]]
        return np.add.reduceat(total, zero[:-1])

    def words(self, vocab: list[str]) -> np.ndarray:
        """Margin of each normalised word."""
        return np.concatenate([np.empty(0), *(self.worst(_joined(vocab[at : at + 20_000]))[0] for at in range(0, len(vocab), 20_000))])

    def features(self, many: list[str]) -> np.ndarray:
        """For each text: the evidence of the TOP words of its worst sentence, and the log share of doubtful words in the text."""
        parts = [sentences(t) for t in many]
        first_of = np.cumsum([0, *(int(n[-1]) + 1 for _, n in parts)])
        code = np.concatenate([c for c, _ in parts])
        number = np.concatenate([n + k for (_, n), k in zip(parts, first_of.tolist(), strict=False)])
        margin, first = self.worst(code)  # the borders of neighbours make an empty word
        real = code[first + 1] != 0
        seen, sentence = evidence(margin[real]), number[first + 1][real]
        text = np.repeat(np.arange(len(many)), np.diff(first_of))
        doubt = np.bincount(text[sentence], np.where(seen > DOUBT, seen, 0.0), len(many))
        share = np.log((doubt + 0.1) / (np.bincount(text[sentence], minlength=len(many)) + FEW))
        order = np.lexsort((-seen, sentence))
        seen, sentence = seen[order], sentence[order]
        new = np.concatenate([[True], sentence[1:] != sentence[:-1]])[: len(sentence)]
        rank = np.arange(len(sentence)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(sentence) else sentence
        best = np.full((int(first_of[-1]), TOP), FLOOR)
        best[sentence[rank < TOP], rank[rank < TOP]] = seen[rank < TOP]
        value = best.sum(1) if self.top is None else best @ self.top[:TOP]
        order = np.lexsort((-value, text))
        return np.column_stack([best[order[first_of[:-1]]], share])

    def texts(self, many: list[str]) -> np.ndarray:
        """Score of each text."""
        if not many:
            return np.empty(0)
        x = self.features(many)
        value = self.slope * x[:, 0] + self.shift if self.top is None else x @ self.top[:-1] + self.top[-1]
        return 1 / (1 + np.exp(-np.clip(value, -40, 40)))


def evidence(margin: np.ndarray) -> np.ndarray:
    """Log odds of a word.  A squared hinge machine tends to the difference of the classes' shares, which runs from -1 to 1."""
    most = np.tanh(MOST / 2)
    return np.maximum(2 * np.arctanh(np.clip(margin, -most, most)), FLOOR)


def _feature_rows(vocab: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word, triple, weight) of all subsequences, divided by the words' norms."""
    code = np.frombuffer((" " + " ".join(vocab) + " ").encode("latin-1"), np.uint8)
    code = np.where(code == 32, 0, code - 96).astype(np.uint8)
    word = np.cumsum(code == 0) - 1
    size = scale(np.array([len(w) for w in vocab]))
    out = []
    for b, at, triple in subsequences(code):
        at = at[word[at] < len(vocab)]
        out.append((word[at], triple[at], DECAY ** (b + 1) / size[word[at]]))
    return out


def _kernel(vocab: list[str], landmarks: list[str]) -> np.ndarray:
    table = np.zeros((LETTERS**3, len(landmarks)), np.float32)
    for w, t, x in _feature_rows(landmarks):
        np.add.at(table, (t, w), x)
    out = np.zeros((len(vocab), len(landmarks)), np.float32)
    for at in range(0, len(vocab), 2000):
        for w, t, x in _feature_rows(vocab[at : at + 2000]):
            # rows come in order of words: sum each word's rows at once
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.empty(0, int)
            if len(first):
                out[at + w[first]] += np.add.reduceat(table[t] * x[:, None].astype(np.float32), first, axis=0)
    return out


def _bent(word: str) -> list[str]:
    """Two spellings of a longer word with a letter inserted or doubled."""
    if len(word) < 5:
        return []
    rng = np.random.default_rng(zlib.crc32(word.encode()))
    a, b = rng.integers(1, len(word), 2)
    return [word[:a] + chr(97 + int(rng.integers(26))) + word[a:], word[:b] + word[b - 1] + word[b:]]


def _step(batches: Iterator[pa.RecordBatch], marks: list[str], whiten: np.ndarray, w: np.ndarray | None, ratio: float) -> Iterator[pa.RecordBatch]:
    """Gradient and curvature of the squared hinge loss over the words of this task; without ``w``, of the squared loss."""
    d = whiten.shape[1] + 1
    g, h = np.zeros(d), np.zeros((d, d))
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            cut = batch.slice(at, 2000)
            vocab, toxic, clean, z = cut.column("word").to_pylist(), cut.column("t").to_numpy(), cut.column("c").to_numpy(), cut.column("z").to_numpy()
            more = [(v, t / 2) for v, t, s in zip(vocab, toxic, z, strict=True) if s > SURE for v in _bent(v)]
            x = _kernel([*vocab, *(v for v, _ in more)], marks) @ whiten
            x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
            extra = np.array([t for _, t in more])
            for y, cost in ((1.0, ratio * np.concatenate([toxic, extra])), (-1.0, np.concatenate([clean, np.zeros(len(extra))]))):
                slack = 1 - y * (x @ w) if w is not None else np.ones(len(x))
                on = (cost > 0) & (slack > 0)
                part, c = x[on], COST * cost[on]
                g -= 2 * part.T @ (c * y * slack[on])
                h += 2 * (part * c[:, None]).T @ part
    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([g, h.reshape(-1)]).tobytes()], pa.binary())], names=["sums"])


def _word_machine(vocab: DataFrame, ratio: float) -> Model | None:
    """Fit the linear machine to ``vocab`` (word, t, c: weighted toxic and clean texts that hold it, z)."""
    best = [r.word for r in vocab.where("z > 0").orderBy(F.desc("z"), "word").limit(LANDMARKS * 2 // 3).collect()]
    if not best:
        return None
    marks = list(dict.fromkeys(best + [r.word for r in vocab.where("c > 0").orderBy(F.xxhash64("word"), "word").limit(LANDMARKS - len(best)).collect()]))
    kmm = _kernel(marks, marks).astype(np.float64)
    values, vectors = np.linalg.eigh((kmm + kmm.T) / 2)
    use = values > 1e-4 * values.max()
    whiten = vectors[:, use] / np.sqrt(values[use])
    d = whiten.shape[1] + 1
    shared = vocab.sparkSession.sparkContext.broadcast((marks, whiten.astype(np.float32)))
    ridge, w = np.append(np.ones(d - 1), 1e-3), None
    for _ in range(STEPS):
        rows = vocab.mapInArrow(lean(lambda it, w=w: _step(it, *shared.value, w, ratio)), "sums binary").toArrow().column("sums").to_pylist()
        total = np.sum([np.frombuffer(x) for x in rows], axis=0)
        now = np.zeros(d) if w is None else w
        step = np.linalg.solve(total[d:].reshape(d, d) + np.diag(ridge), total[:d] + ridge * now)
        w = now - step
        if np.abs(step).max() < 1e-6:
            break
    weight = np.zeros(LETTERS**3)
    for word, t, v in _feature_rows(marks):
        np.add.at(weight, t, v * (whiten @ w[:-1])[word])
    return Model(weight, float(w[-1]), 1.0, 0.0)


def _logistic(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights, none of them negative, and constant of a logistic fit."""
    use = np.ones(x.shape[1], bool)
    while True:
        a = np.column_stack([x[:, use], np.ones(len(x))])
        beta = np.zeros(a.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
            g = a.T @ (cost * (p - y)) + 1e-2 * beta
            step = np.linalg.solve((a * (cost * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(beta)), g)
            beta = beta - step / max(1.0, np.abs(step).max() / 2)
            if np.abs(step).max() < 1e-9:
                break
        if (beta[:-1] >= 0).all() or use.sum() == 1:
            out = np.zeros(x.shape[1] + 1)
            out[:-1][use], out[-1] = np.maximum(beta[:-1], 0), beta[-1]
            return out
        use[np.flatnonzero(use)[beta[:-1] < 0]] = False
        use[0] = True


def _joined(vocab: list[str]) -> np.ndarray:
    code = np.frombuffer((" " + " ".join(vocab) + " ").encode("latin-1"), np.uint8)
    return np.where(code == 32, 0, code - 96).astype(np.uint8)


_C = mix64(np.arange(1, 6, dtype=np.uint64))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text, words, keys): distinct words; four least hashes of runs of five words, which near copies share."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            cut = batch.slice(at, 64)
            lists, keys = [], []
            for t in cut.column("text").to_pylist():
                w = words(letters(t or ""))
                lists.append(sorted(set(w)))
                h = np.array([zlib.crc32(x.encode()) for x in w], np.uint64)
                with np.errstate(over="ignore"):
                    runs = sum(h[k : len(h) - 4 + k] * _C[k] for k in range(5)) if len(h) >= 5 else np.array([(h * _C[: len(h)]).sum()], np.uint64)
                    keys.append([int(mix64(runs + _C[k]).min().view(np.int64)) for k in range(4)])
            yield pa.RecordBatch.from_arrays([cut.column("label"), cut.column("text"), pa.array(lists, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64()))], names=["label", "text", "words", "keys"])


def _worst(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for cut, _, _ in text_chunks(batches, limit=1 << 19):
        x = model.features([t or "" for t in cut.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([cut.column("label"), cut.column("share"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["label", "share", "x"])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit to at most MOST_TOXIC and MOST_CLEAN labelled texts; None if a class has none.

    Near copies share one text's weight.
    """
    spark = docs.sparkSession
    known = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").dropDuplicates(["doc_id", "label"])
    pick = lambda k, n: known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, MOST_TOXIC).unionAll(pick(0, MOST_CLEAN))  # bounded by the two parameters, so it may be broadcast
    parts = 2 * spark.sparkContext.defaultParallelism
    got = docs.join(F.broadcast(chosen), "doc_id").select("label", "text").repartition(parts)
    got = materialize(got.mapInArrow(lean(_profile), "label int, text string, words array<string>, keys array<long>").withColumn("id", F.monotonically_increasing_id()), "sample")
    keys = got.select("id", F.posexplode("keys").alias("k", "key"))
    sizes = keys.groupBy("k", "key").agg(F.count("*").alias("size"))
    share = keys.join(sizes, ["k", "key"]).groupBy("id").agg((1 / F.max("size")).alias("share"))
    sample = materialize(got.join(share, "id").select("label", "share", "text", "words"), "sample")
    mass = {r.label: r.s for r in sample.groupBy("label").agg(F.sum("share").alias("s")).collect()}
    if len(mass) < 2:
        return None
    of = lambda k: F.sum(F.when(F.col("label") == k, F.col("share")).otherwise(0.0))
    part = mass[1] / (mass[0] + mass[1])
    due = (F.col("t") + F.col("c")) * part
    vocab = sample.select("label", "share", F.explode("words").alias("word")).groupBy("word").agg(of(1).alias("t"), of(0).alias("c"))
    vocab = materialize(vocab.withColumn("z", (F.col("t") - due) / F.sqrt(due * (1 - part))).repartition(parts), "vocabulary")
    model = _word_machine(vocab, mass[0] / mass[1])
    if model is None:
        return Model(np.zeros(LETTERS**3), -1.0, 1.0, float(np.log((mass[1] + 1) / (mass[0] + 1))) + 1.0)
    for _ in range(ROUNDS):
        seen = sample.select("label", "share", "text").mapInArrow(lean(lambda it, m=model: _worst(it, m)), "label int, share double, x array<double>").toArrow()
        y, cost = seen.column("label").to_numpy().astype(float), seen.column("share").to_numpy()
        model.top = _logistic(np.array(seen.column("x").combine_chunks().flatten()).reshape(len(y), TOP + 1), y, cost)
    discard(got, sample, vocab)
    return model


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text); learn from ``labels`` (doc_id, ``label_col`` 0/1) outside the held-out fold.

    Returns doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.  Null text is empty; texts without
    words get the least score; bytes that are no UTF-8 read as U+FFFD; long texts are read whole.  Rows without doc_id are scored, not held out and never
    learned from; labels other than 0 and 1 are not used; repeated rows are scored each.  If a class has no labelled
    row, every score is 0 (nothing is known to be toxic).  Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_code(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid_text().alias("text"))
    learn = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(fold(F.col("doc_id"), folds) != held)
    model = spark.sparkContext.broadcast(train(base, learn))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for cut, _, offsets in text_chunks(batches, limit=1 << 19):
            texts = [t or "" for t in cut.column("text").to_pylist()]
            s = m.texts(texts) if m else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([cut.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    out = base.mapInArrow(lean(scored), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that ``classify`` doesn't predict to be toxic.

    Null and empty texts, rows without doc_id and repeated rows are judged as there; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_code(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid_text().alias("text"))
    learn = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(fold(F.col("doc_id"), folds) != held)
    model = spark.sparkContext.broadcast(train(base, learn))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for cut, _, _ in text_chunks(batches, limit=1 << 19):
            ok = m.texts([t or "" for t in cut.column("text").to_pylist()]) < threshold if m else np.ones(cut.num_rows, bool)
            yield cut.filter(pa.array(ok))

    return docs.withColumn("text", valid_text()).mapInArrow(lean(clean), docs.schema)
