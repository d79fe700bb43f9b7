"""Subject areas of documents: one-versus-rest linear classifiers on hashed word n-grams, applied to every sentence.

A text is cut into sentences, a sentence into hashed words and pairs of neighbouring words (pairs and triples of characters for ideographs), all on
code-point arrays. The classifiers are fitted on a bounded sample of labelled documents: at first each sentence carries the labels of its document, then
sentences that the classifiers hold for no subject lose them, and the fit is repeated. A document has a subject if the share of its sentences that treat
it reaches the subject's threshold, which is calibrated on the labelled documents around the share asked for. Every document is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenograph.llm import textform
from scenograph.llm.leakage import powers, powers_inverse

# Signs that end a sentence, and closing quotes that may follow them.
ENDS = ".!?。！？…"
CLOSERS = "」』”’»\"')）"
MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Fit:
    sample: int = 10_000  # labelled documents to fit on, at most
    features: int = 6_000  # features kept, at most
    least_documents: int = 3  # labelled documents that must hold a feature
    rounds: int = 2
    steps: int = 40
    ridge: float = 1e-5
    folds: int = 4  # for calibration
    share: float = 0.25  # of a document's sentences
    play: float = 0.07  # how far calibration may move the threshold


@dataclass
class Model:
    subjects: list[str]
    hashes: np.ndarray  # sorted
    weights: np.ndarray  # feature x subject
    bias: np.ndarray
    shares: np.ndarray  # threshold of each subject


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def sentences(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence of each code point, document of each sentence). A sentence ends with a sign that ends it, unless a closing quote leads on, and with the text."""
    t = textform.tables()
    n = len(cps)
    end = np.isin(cps, np.array(list(map(ord, ENDS)), np.uint32))
    after = np.concatenate((cps[1:], [0x20]))
    # a Latin stop inside a number or name does not end a sentence; a quote that follows an ideographic stop carries it on
    latin = end & (cps < 0x80)
    closer = np.isin(after, np.array(list(map(ord, CLOSERS)), np.uint32))
    end &= ~(latin & ((t.cls[after] & textform.ALNUM) != 0)) & ~(~latin & closer) & ~np.isin(after, np.array(list(map(ord, ENDS)), np.uint32))
    start = np.zeros(n + 1, bool)
    start[offs] = True
    start[1:] |= end
    start = start[:n]
    number = np.cumsum(start) - 1
    firsts = np.flatnonzero(start)
    doc = np.searchsorted(offs, firsts, "right") - 1
    return number, doc


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, sentence) of every feature, and the document of each sentence that has any letters. Null and empty texts have no sentences."""
    t = textform.tables()
    cps, offs, _ = textform.normalize_points(*textform.points(texts))
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(cps):
        return none
    sent, doc = sentences(cps, offs)
    cls = t.cls[cps]
    han = (cls & textform.HAN) != 0
    word = ((cls & (textform.ALNUM | textform.MARK)) != 0) & ~han
    low = t.lower[cps].astype(np.uint64) + np.uint64(1)
    # words: hash of their characters by differences of running sums
    edge = word.copy()
    edge[1:] &= ~(word[:-1] & (sent[1:] == sent[:-1]))
    a = np.flatnonzero(edge)
    last = word.copy()
    last[:-1] &= ~(word[1:] & (sent[1:] == sent[:-1]))
    b = np.flatnonzero(last) + 1
    p = powers(len(cps) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(low * p[: len(cps)], dtype=np.uint64)))
    w = _mix((sums[b] - sums[a]) * powers_inverse(len(cps) + 1)[a])
    ws = sent[a]
    near = np.flatnonzero((ws[1:] == ws[:-1]) & (a[1:] - b[:-1] <= 2)) if len(a) else np.zeros(0, np.int64)
    pairs = _mix(w[near] * np.uint64(3) + w[near + 1])
    # ideographs: runs of two and three
    h2 = np.flatnonzero(han[:-1] & han[1:])
    two = _mix(low[h2] * np.uint64(1 << 24) + low[h2 + 1] + np.uint64(1 << 60))
    h3 = np.flatnonzero(han[:-2] & han[1:-1] & han[2:]) if len(cps) > 2 else np.zeros(0, np.int64)
    three = _mix(_mix(low[h3] * np.uint64(1 << 24) + low[h3 + 1]) + low[h3 + 2])
    hashes = np.concatenate((w, pairs, two, three))
    where = np.concatenate((ws, ws[near], sent[h2], sent[h3]))
    spoken = np.zeros(len(doc), bool)
    spoken[where] = True
    renumber = np.cumsum(spoken) - 1
    return hashes, renumber[where], doc[spoken]


def _score(hashes: np.ndarray, where: np.ndarray, n: int, model_hashes: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Log-odds of each sentence and subject."""
    k = np.searchsorted(model_hashes, hashes)
    k[k == len(model_hashes)] = 0
    ok = model_hashes[k] == hashes
    k, where = k[ok], where[ok]
    out = np.empty((n, weights.shape[1]))
    for s in range(weights.shape[1]):
        out[:, s] = np.bincount(where, weights=weights[k, s], minlength=n) + bias[s]
    return out


def fit(texts: pa.Array, labels: np.ndarray, names: list[str], how: Fit = Fit()) -> Model:
    """labels: document x subject, true where a reader named the subject. With no documents the model finds nothing."""
    hashes, where, doc = features(texts)
    n, m = len(doc), len(names)
    if not n or not labels.any():
        return Model(names, np.zeros(1, np.uint64), np.zeros((1, m)), np.full(m, -9.0), np.full(m, how.share))
    # features held by enough documents, those first that tell subjects apart (chi-square of document counts)
    values, inverse = np.unique(hashes, return_inverse=True)
    held = np.unique(inverse * np.int64(len(labels)) + doc[where])
    f, d = held // len(labels), held % len(labels)
    df = np.bincount(f, minlength=len(values))
    least = min(how.least_documents, max(1, len(labels) // 20))
    with np.errstate(divide="ignore", invalid="ignore"):
        worth = np.zeros(len(values))
        for s in range(m):
            got = np.bincount(f, weights=labels[d, s], minlength=len(values))
            expected = df * labels[:, s].mean()
            worth = np.maximum(worth, np.where(got > expected, (got - expected) ** 2 / np.maximum(expected, 1e-9), 0))
    worth[df < least] = -1
    keep = np.sort(np.argsort(-worth, kind="stable")[: how.features])
    keep = keep[worth[keep] >= 4]
    place = np.full(len(values), -1)
    place[keep] = np.arange(len(keep))
    col = place[inverse]
    ok = col >= 0
    once = np.unique(where[ok] * np.int64(max(len(keep), 1)) + col[ok])
    row, col = once // max(len(keep), 1), once % max(len(keep), 1)
    # thresholds come from documents that the weights they are judged by have not seen: each part of the documents is scored by a fit on the others
    fold = np.arange(len(labels)) % how.folds
    z = np.zeros((n, m))
    for k in range(how.folds):
        mine = fold[doc] == k
        weights, bias = _rounds(row, col, labels[doc], ~mine, len(keep), how)
        z[mine] = _scores(row, col, n, weights, bias)[mine]
    shares = calibrate(z, doc, labels, how)
    weights, bias = _rounds(row, col, labels[doc], np.ones(n, bool), len(keep), how)
    return Model(names, values[keep] if len(keep) else np.zeros(1, np.uint64), weights if len(keep) else np.zeros((1, m)), bias, shares)


def _scores(row: np.ndarray, col: np.ndarray, n: int, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(row, weights=weights[col, s], minlength=n) + bias[s] for s in range(weights.shape[1])], 1)


def _rounds(row: np.ndarray, col: np.ndarray, labelled: np.ndarray, use: np.ndarray, f: int, how: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Fit on the sentences in use, again with the labels that the sentences themselves bear out."""
    number_of = np.cumsum(use) - 1
    mine = use[row]
    row, col, labelled = number_of[row[mine]], col[mine], labelled[use]
    n, y = int(use.sum()), labelled.astype(float)
    weights, bias = np.zeros((f, y.shape[1])), np.full(y.shape[1], -2.0)
    for number in range(how.rounds):
        weights, bias = _logistic(row, col, n, f, y, how)
        # a sentence keeps its document's label where it speaks for it; readers do not name every subject, so a clear voice counts without label
        z = _scores(row, col, n, weights, bias)
        y = np.where(labelled, z > (-0.5 if number == 0 else 0), z > 3).astype(float)
    return weights, bias


def _logistic(row: np.ndarray, col: np.ndarray, n: int, f: int, y: np.ndarray, how: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Each subject by itself: logistic loss with ridge, by gradient steps scaled per feature (Adagrad)."""
    m = y.shape[1]
    weights, bias = np.zeros((f, m)), np.full(m, -2.0)
    for s in range(m):
        target = y[:, s]
        if not target.any():
            bias[s] = -9
            continue
        # only sentences that hold a feature seen with the subject move its weights
        w, b, g2, gb2 = np.zeros(f), -2.0, np.full(f, 1e-8), 1e-8
        for _ in range(how.steps):
            z = np.bincount(row, weights=w[col], minlength=n) + b
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
            g = np.bincount(col, weights=e[row], minlength=f) + how.ridge * n * w
            g2 += g * g
            gb2 += e.sum() ** 2
            w -= 0.5 * g / np.sqrt(g2)
            b -= 0.5 * e.sum() / np.sqrt(gb2)
        weights[:, s], bias[s] = w, b
    return weights, bias


def document_shares(z: np.ndarray, doc: np.ndarray, documents: int) -> np.ndarray:
    """document x subject: the share of its sentences that treat the subject."""
    count = np.maximum(np.bincount(doc, minlength=documents), 1)
    return np.stack([np.bincount(doc, weights=z[:, s] > 0, minlength=documents) / count for s in range(z.shape[1])], 1)


def calibrate(z: np.ndarray, doc: np.ndarray, labels: np.ndarray, how: Fit) -> np.ndarray:
    """The threshold of each subject within `play` of the share asked for that agrees best with the readers (F1); the nearest to it among equals."""
    shares = document_shares(z, doc, len(labels))
    out = np.full(labels.shape[1], how.share)
    options = how.share + np.linspace(-how.play, how.play, 15)
    for s in range(labels.shape[1]):
        if labels[:, s].sum() < 20:
            continue
        scores = []
        for x in options:
            said = shares[:, s] >= x
            hit = (said & labels[:, s]).sum()
            scores.append(2 * hit / max(said.sum() + labels[:, s].sum(), 1))
        best = np.flatnonzero(np.array(scores) >= max(scores) - 0.002)
        out[s] = options[best[np.argmin(np.abs(options[best] - how.share))]]
    return out


def labelled_sample(documents: DataFrame, labels: DataFrame, subjects: list[str], how: Fit, doc_id: str = "doc_id", text: str = "text") -> tuple[pa.Array, np.ndarray]:
    """At most how.sample labelled documents, chosen by a hash of the id; a subject counts if any reader named it, case and blanks aside."""
    named = labels.select(F.col(doc_id).alias("doc_id"), F.lower(F.trim("subject")).alias("subject")).where(F.col("doc_id").isNotNull() & F.col("subject").isin([x.lower() for x in subjects]))
    per_doc = named.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.sample)
    # the sample's ids are at most how.sample rows, so they are broadcast and texts are not shuffled
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(per_doc), "doc_id").orderBy("doc_id", F.xxhash64("text")).limit(how.sample).toPandas()
    y = np.zeros((len(rows), len(subjects)), bool)
    for i, names in enumerate(rows.subjects):
        for s, name in enumerate(subjects):
            y[i, s] = name.lower() in names
    return pa.array(rows.text.tolist(), pa.string()), y


def subject_shares(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, subject, share) of the subjects that reach their threshold, one row per document and subject.

    Null and empty texts and texts without letters have no subject. Rows with the same doc_id are judged each; equal results come once.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        bits = np.zeros(1 << 20, bool)
        bits[(m.hashes >> np.uint64(44)).astype(np.int64)] = True
        for b in (x for whole in batches for x in textform.slices(whole, 1)):
            hashes, where, doc = features(b.column(1))
            maybe = bits[(hashes >> np.uint64(44)).astype(np.int64)]
            z = _score(hashes[maybe], where[maybe], len(doc), m.hashes, m.weights, m.bias)
            shares = document_shares(z, doc, b.num_rows)
            d, s = np.nonzero((shares >= m.shares - 1e-9) & (shares > 0))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)).cast(pa.int64()), pa.array([m.subjects[x] for x in s], pa.string()), pa.array(shares[d, s], pa.float64())], names=["doc_id", "subject", "share"])

    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(run, "doc_id long, subject string, share double")


def subjects_of(documents: DataFrame, subjects: DataFrame, labels: DataFrame, how: Fit = Fit()) -> DataFrame:
    """Fit on the labelled documents and assign subjects to all documents."""
    names = [r[0] for r in subjects.select("subject").where("subject is not null").distinct().orderBy("subject").collect()]
    texts, y = labelled_sample(documents, labels, names, how)
    return subject_shares(documents, fit(texts, y, names, how))
