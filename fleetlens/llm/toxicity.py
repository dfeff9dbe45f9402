"""Toxicity by multiple-instance learning over sentences.

Only documents are labelled. A text is a bag of sentences; a sentence's score is
logistic in its words and their stems, and the document's is their noisy-or,
1 - prod(1 - p_sentence): one offending sentence is enough. Weights are
fitted to the document labels through the noisy-or (numpy, on a bounded sample of
labelled documents); the sentence scores then say where the offence is.

The sample: of each label the ``max_per_label`` documents with the lowest hash of
their id, a documented bound; scoring runs over every whole text, one pass, no
shuffle. The only inputs are words: labels, language, source and id are not.

Edge cases: NULL, empty and blank texts have no sentences and score 0; without
usable labels all scores are 0; rows with equal ids are scored each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, crc_mod, ship_code
from .hashing import slices

#: Characters taken off both ends of a word before it is looked up.
EDGE = b".,;:!?\"'()[]{}<>*#%&$|-_"
#: Stands for a line's end between tokens.
_LINE = b"\x00"
#: Features of a word: itself and its first so many bytes (stems).
PREFIXES = (4, 5, 6, 7, 8)
#: Added to a token's weight: 0 inside a sentence, 1 at its end, 2 for a line's end.
_MARK = 1e6


@dataclass(frozen=True)
class ToxicityConfig:
    max_per_label: int = 2500
    #: Feature weights live in 2**bits slots, by hash.
    bits: int = 20
    #: A feature counts when so many sampled documents have it.
    min_documents: int = 3
    epochs: int = 150
    rate: float = 0.1
    #: Pull of all weights towards 0, so that only shared evidence counts.
    lasso: float = 3e-4
    threshold: float = 0.7


@dataclass
class ToxicityModel:
    weights: np.ndarray  # float32, one per slot
    bias: float


def _slots(word: bytes, bits: int) -> list[int]:
    """Slots of a word's features."""
    import xxhash

    names = {b"=" + word} | {word[:n] for n in PREFIXES if len(word) >= n}
    return [xxhash.xxh3_64_intdigest(f) & ((1 << bits) - 1) for f in sorted(names)]


def _tokens(text: bytes) -> list[bytes]:
    return text.lower().replace(b"\n", b" \x00 ").split()


def _ends_sentence(token: bytes) -> bool:
    return token.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?")


class SentenceScorer:
    """Sentence scores of texts; keeps the weights of tokens seen."""

    def __init__(self, model: ToxicityModel, limit: int = 300_000):
        self._model, self._bits = model, int(model.weights.size).bit_length() - 1
        self._known = Memo(self._value, limit)

    def _value(self, token: bytes) -> float:
        if token == _LINE:
            return 2 * _MARK
        word = token.strip(EDGE)
        weight = float(self._model.weights[_slots(word, self._bits)].sum()) if word else 0.0
        return weight + _MARK * _ends_sentence(token)

    def log_clean(self, text: bytes) -> np.ndarray:
        """log(1 - p) of each sentence (0 or less)."""
        tokens = _tokens(text)
        self._known.trim()
        value = np.fromiter(map(self._known.__getitem__, tokens), np.float64, len(tokens))
        mark = np.rint(value / _MARK)
        first = sentence_starts(mark)
        if not len(first):
            return np.empty(0)
        weight = (value - _MARK * mark)[mark < 2]
        return -np.logaddexp(0.0, np.add.reduceat(weight, first) + self._model.bias)


def sentence_starts(mark: np.ndarray) -> np.ndarray:
    """Numbers of the words (tokens that are no line's end) that begin a sentence."""
    word = mark < 2
    sentence = np.concatenate([[0], np.cumsum(mark > 0)])[:-1][word]
    return np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]])) if len(sentence) else np.empty(0, np.int64)


def train(texts: list[bytes], labels: np.ndarray, cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Fit feature weights to document labels through the noisy-or (Adam on the
    whole sample, soft thresholding for sparse weights)."""
    weights = np.zeros(1 << cfg.bits, np.float32)
    number: dict[bytes, int] = {}
    words, firsts, y = [], [], []
    for text, label in zip(texts, labels, strict=True):
        tokens = _tokens(text)
        mark = np.array([2 if t == _LINE else int(_ends_sentence(t)) for t in tokens])
        first = sentence_starts(mark) if len(tokens) else np.empty(0, np.int64)
        if len(first):
            words.append(np.array([number.setdefault(t.strip(EDGE), len(number)) for t in tokens if t != _LINE]))
            firsts.append(first)
            y.append(float(label))
    if len(set(y)) < 2:
        return ToxicityModel(weights, -np.inf)
    y = np.array(y)
    # features of each distinct word, then those that enough documents have
    features = [_slots(w, cfg.bits) if w else [] for w in number]
    of_word = np.repeat(np.arange(len(features)), [len(f) for f in features])
    slot = np.concatenate([np.array(f, np.int64) for f in features])
    per_doc = [np.unique(w) for w in words]
    by_word = np.searchsorted(of_word, np.arange(len(features) + 1))
    seen = np.zeros(1 << cfg.bits, np.int32)
    for w in per_doc:
        of_doc = np.concatenate([slot[by_word[k] : by_word[k + 1]] for k in w.tolist()])
        seen[np.unique(of_doc)] += 1
    del features, per_doc
    keep = seen[slot] >= cfg.min_documents
    of_word, slot = of_word[keep], slot[keep]
    used, feature = np.unique(slot, return_inverse=True)
    n_words = np.array([len(w) for w in words])
    word = np.concatenate(words)
    first = np.concatenate([f + o for f, o in zip(firsts, np.cumsum(n_words) - n_words, strict=True)])
    sentence_of = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(word)]])))
    n_sentences = np.array([len(f) for f in firsts])
    doc_first, doc_of = np.cumsum(n_sentences) - n_sentences, np.repeat(np.arange(len(y)), n_sentences)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, b = np.zeros(len(used)), -4.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, cfg.epochs + 1):
        word_weight = np.bincount(of_word, weights=w[feature], minlength=len(number))
        log_clean = -np.logaddexp(0.0, np.add.reduceat(word_weight[word], first) + b)
        total = np.add.reduceat(log_clean, doc_first)  # log(1 - p_doc)
        p = -np.expm1(total)
        # d loss / d z_s: p_s for a clean document, -p_s (1 - p_doc) / p_doc for a toxic one
        pull = np.where(y == 1, -np.exp(total) / np.maximum(p, 1e-12), 1.0) * balance / len(y)
        dz = -np.expm1(log_clean) * pull[doc_of]
        by_word_grad = np.bincount(word, weights=dz[sentence_of], minlength=len(number))
        grad = np.append(np.bincount(feature, weights=by_word_grad[of_word], minlength=len(used)), dz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        scale = cfg.rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        change = scale * m / (1 - 0.9**step)
        w, b = w - change[:-1], b - change[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - cfg.lasso * scale[:-1], 0.0)
    weights[used] = w
    return ToxicityModel(weights, float(b))


def fit(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Train on labelled rows: ``labels`` has doc_id and toxic (0, 1).

    The sample is at most 2 x ``max_per_label`` whole texts, fetched to the driver."""
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    sample = known.filter("toxic = 1").orderBy("h", "doc_id").limit(cfg.max_per_label).union(known.filter("toxic = 0").orderBy("h", "doc_id").limit(cfg.max_per_label))
    chosen = docs.select("doc_id", "text").join(sample.select("doc_id", "toxic"), "doc_id")

    rows = chosen.select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"].encode() for r in rows], np.array([r["toxic"] for r in rows]), cfg)


def score(docs: DataFrame, model: ToxicityModel, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """Every document: doc_id, score, predicted, n_sentences, worst_sentence
    (number of the most offending one, from 0; NULL without any),
    worst_score, and ``offending``: numbers of sentences scoring 0.5 or more."""
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = SentenceScorer(shared.value)
        for b in batches:
            texts = [(t or "").encode() for t in b["text"].to_pylist()]
            for i, j in slices(texts):
                out = []
                for text in texts[i:j]:
                    log_clean = scorer.log_clean(text)
                    if not len(log_clean):
                        out.append((0.0, 0, None, 0.0, []))
                        continue
                    p = -np.expm1(log_clean)
                    worst = int(np.argmax(p))
                    out.append((min(max(float(-np.expm1(log_clean.sum())), 0.0), 1.0), len(p), worst, float(p[worst]), np.flatnonzero(p >= 0.5).tolist()))
                s, n, w, ws, bad = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b["doc_id"][i:j], pa.array(s), pa.array(n, pa.int64()), pa.array(w, pa.int64()), pa.array(ws), pa.array(bad, pa.list_(pa.int64()))], ["doc_id", "score", "n_sentences", "worst_sentence", "worst_score", "offending"])

    schema = "doc_id long, score double, n_sentences long, worst_sentence long, worst_score double, offending array<long>"
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= cfg.threshold).cast("int"))


def op1_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = crc_mod("doc_id", 3) == 1
    model = fit(docs, labels.filter(~held_out))
    out = score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_sentences", "worst_sentence", "worst_score")
