"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

Voters look at a document and say toxic, clean, or nothing. Some are fixed lexicons and patterns; others are
lexicons mined from the labelled rows: word beginnings that toxic rows use far more often than clean ones, split
over several voters by hash. The label model estimates each voter's accuracy by expectation maximisation on the votes
alone (Dawid and Skene), and the correlation that voters keep given the label; correlated voters share their
weight. A logistic regression is trained on the posterior labels and scores every document whole.

Only fitting sees a sample: at most ``fit_rows`` labelled rows, those with the lowest hash of their id. Everything that
the fit returns is a few thousand feature weights, independent of the size of the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, give_back, packed_row, signed, slices
from .neardup import shingles, signatures

FIT_ROWS = 6_000
FEATURES = 4_000
MINED_VOTERS = 6
THRESHOLD = 0.5
BEGINNINGS = (4, 5, 6, 7)
LEAST_DOCS = 4

LEXICONS: tuple[frozenset[str], ...] = (
    frozenset("idiot moron imbecile loser clown scum vermin scumbag".split()),
    frozenset("stupid dumb pathetic worthless disgusting useless".split()),
    frozenset("trash garbage filth crap rubbish".split()),
)
PATTERNS: tuple[re.Pattern, ...] = (
    re.compile(r"\b(?:you|they|he|she|these people)\s+(?:are|is)\s+(?:a |an |all |such )?(?:idiots?|morons?|losers?|trash|scum|stupid|pathetic|worthless|disgusting)\b"),
    re.compile(r"\b(?:shut up|go to hell|kill yourself|nobody (?:likes|wants) you|i hate you)\b"),
)

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[c for c in range(128) if not chr(c).isalpha()]] = True


class Features:
    """Hashed features of texts in lower case: whole words, and word beginnings of several lengths in bytes.

    doc, key: one entry per feature that occurs in a text; words: words per text.
    """

    def __init__(self, texts: pa.Array):
        w = Words(pc.utf8_lower(texts), _SEPARATORS)
        doc = w.doc()
        length = w.end - w.start
        docs, keys = [doc], [w.hash]
        for n in BEGINNINGS:
            long = length > n
            docs.append(doc[long])
            keys.append(w.span_hash(w.start[long], w.start[long] + n))
        self.words = np.diff(w.first)
        self.doc, self.key = np.concatenate(docs), np.concatenate(keys)

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (doc, key) and how often they occur."""
        order = np.lexsort((self.key, self.doc))
        d, k = self.doc[order], self.key[order]
        fresh = np.ones(len(d), bool)
        fresh[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
        at = np.flatnonzero(fresh)
        return d[at], k[at], np.diff(np.append(at, len(d)))

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(doc, index in keys) of the occurrences of sorted keys."""
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        top = self.key >> np.uint64(44)  # a table of 2 ** 20 bits rules most features out before the search
        near = np.zeros(1 << 20, bool)
        near[keys >> np.uint64(44)] = True
        maybe = np.flatnonzero(near[top])
        at = np.minimum(np.searchsorted(keys, self.key[maybe]), len(keys) - 1)
        hit = keys[at] == self.key[maybe]
        return self.doc[maybe[hit]], at[hit]


def fixed_votes(text: str) -> list[int]:
    """Votes of the lexicons (toxic or clean) and of the patterns (toxic or nothing)."""
    low = text.lower()
    words = set(re.findall(r"[^\W\d_]+", low))
    return [1 if words & lexicon else -1 for lexicon in LEXICONS] + [1 if p.search(low) else 0 for p in PATTERNS]


def copy_weights(texts: pa.Array) -> np.ndarray:
    """1 / (documents alike), so that a group of near copies counts as one document.

    Documents that agree in one of four minwise 3-word shingles are taken to be alike.
    """
    cut = [shingles(part.column(0), 3) for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]))]
    count = np.concatenate([n for _, n in cut])
    rows = np.concatenate([signatures(h, n, 4) for h, n in cut])
    alike = np.ones(len(rows))
    for k in range(rows.shape[1]):
        _, code, size = np.unique(rows[:, k], return_inverse=True, return_counts=True)
        alike = np.maximum(alike, size[code])
    out = np.ones(len(count))
    out[count > 0] = 1 / alike
    return out


def contrast(doc: np.ndarray, code: np.ndarray, size: int, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Per feature, how surely it marks toxic documents: lower bound (3 standard errors) of its log ratio.

    doc, code: one entry per feature of a document; toxic, clean: what each document weighs in either class.
    """
    t, c = np.bincount(code, weights=toxic[doc], minlength=size), np.bincount(code, weights=clean[doc], minlength=size)
    ratio = np.log((t + 0.5) / (toxic.sum() + 1)) - np.log((c + 0.5) / (clean.sum() + 1))
    return ratio - 3 * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))


class LabelModel:
    """Two-class generative model of votes in {-1, 0, 1}, with shared weight for correlated voters."""

    def __init__(self, prior: float, rounds: int = 30):
        self.prior = min(max(prior, 0.01), 0.5)
        self.rounds = rounds

    def fit(self, votes: np.ndarray, weight: np.ndarray) -> "LabelModel":
        m = votes.shape[1]
        onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
        # start: a row with any toxic vote leans to toxic
        q = np.where((votes > 0).any(axis=1), 0.9, self.prior / 2)
        self.share = np.ones(m)
        for round_ in range(self.rounds):
            # voters are taken to be better than chance, which fixes which class is which
            one, zero = weight * q, weight * (1 - q)
            p1 = (np.einsum("n,nmv->mv", one, onehot) + [0.5, 0.5, 1.0]) / (one.sum() + 2.0)
            p0 = (np.einsum("n,nmv->mv", zero, onehot) + [1.0, 0.5, 0.5]) / (zero.sum() + 2.0)
            self.ratio = np.log(p1) - np.log(p0)
            base = min(max(one.sum() / weight.sum(), self.prior / 3), min(0.6, self.prior * 3))
            self.logit = np.log(base / (1 - base))
            if round_ in (5, 15):
                self.share = self._shares(votes, one, zero)
            q = self.posterior(votes)
        self.accuracy = p1[:, 2] / (p1[:, 2] + p0[:, 2])
        return self

    def _shares(self, votes: np.ndarray, one: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """1 / (1 + correlation with the other voters given the label): voters that repeat each other count once."""
        self.correlation = np.zeros((votes.shape[1],) * 2)
        for w in (one, zero):
            total = max(w.sum(), 1e-9)
            mean = w @ votes / total
            dev = (votes - mean) * np.sqrt(w / total)[:, None]
            cov = dev.T @ dev
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            self.correlation += cov / sd[:, None] / sd[None, :] * (total / (one.sum() + zero.sum()))
        off = np.maximum(self.correlation - np.diag(np.diag(self.correlation)), 0)
        return 1 / (1 + np.where(off > 0.1, off, 0).sum(axis=1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        says = self.ratio[np.arange(votes.shape[1])[None, :], votes + 1]
        return 1 / (1 + np.exp(-np.clip(self.logit + says @ self.share, -30, 30)))


class Model:
    """Sorted feature keys with weights for presence and for rate per word, and a bias."""

    def __init__(self, keys: np.ndarray, presence: np.ndarray, rate: np.ndarray, bias: float):
        self.keys, self.presence, self.rate, self.bias = keys, presence, rate, bias

    def design(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """doc, feature, presence, rate of the features that occur."""
        doc, at = f.of(self.keys)
        cells, count = np.unique(doc * len(self.keys) + at, return_counts=True) if len(doc) else (doc, doc)
        doc, at = np.divmod(cells, max(1, len(self.keys)))
        return doc, at, np.ones(len(doc)), np.minimum(30 * count / np.maximum(f.words[doc], 1), 3.0)

    def score(self, texts: pa.Array) -> np.ndarray:
        f = Features(texts)
        doc, at, one, rate = self.design(f)
        z = np.bincount(doc, weights=one * self.presence[at] + rate * self.rate[at], minlength=len(f.words)) + self.bias
        return np.where(f.words > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def fit(texts: list[str] | pa.Array, toxic: list[int | None], features: int = FEATURES, mined: int = MINED_VOTERS) -> Model:
    """Voters, label model and classifier from texts with labels 1, 0 or None."""
    array = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    n = len(texts)
    known = np.array([t is not None for t in toxic], bool)
    label = np.array([t or 0 for t in toxic], float)
    if not n or not known.any() or not label[known].any():
        # nothing to learn from: the fixed voters alone
        keys = np.unique(Words(pa.array(sorted(w for lexicon in LEXICONS for w in lexicon)), _SEPARATORS).hash)
        return Model(keys, np.full(len(keys), 6.0), np.zeros(len(keys)), -3.0)
    keys, doc, code, count, words = _sample_features(array)
    rate = (count / np.maximum(words[doc], 1)).astype(np.float32)
    weight = copy_weights(array)
    own = weight * known
    telling = contrast(doc, code, len(keys), own * label, own * (1 - label)) > 0.5
    # a mined word speaks at a quarter of the rate that it has in toxic rows
    speaks = np.flatnonzero(telling[code])
    d, x, r = doc[speaks], code[speaks], rate[speaks]
    of_toxic = known[d] & (label[d] > 0)
    usual = np.bincount(x[of_toxic], weights=r[of_toxic], minlength=len(keys)) / np.maximum(np.bincount(x[of_toxic], minlength=len(keys)), 1)
    loud = r >= usual[x] / 4
    votes = np.zeros((n, mined), np.int64)
    votes[d[loud], (keys[x[loud]] >> np.uint64(7)).astype(np.int64) % mined] = 1
    fixed = np.array([fixed_votes(t.as_py()) for t in array], np.int64)
    votes = np.hstack([fixed, np.where(votes > 0, 1, -1)])
    prior = (own * label).sum() / own.sum()
    posterior = LabelModel(prior).fit(votes, weight).posterior(votes)
    # the classifier's features: the lexicons, and what the posterior finds telling
    bound = contrast(doc, code, len(keys), weight * posterior, weight * (1 - posterior))
    order = np.argsort(-bound, kind="stable")[:features]
    lexicon = np.unique(Words(pa.array(sorted(w for words in LEXICONS for w in words)), _SEPARATORS).hash)
    best = np.union1d(keys[order[bound[order] > 0.2]], lexicon)
    presence = np.where(_find(lexicon, best)[0], 4.0, 0.0)
    model = Model(best, presence, np.zeros(len(best)), float(np.log(prior / (1 - prior))))
    chosen, place = _find(best, keys)
    of = np.flatnonzero(chosen[code])
    d, a, one, r = doc[of], place[code[of]], np.ones(len(of)), np.minimum(30 * rate[of].astype(float), 3.0)
    train(model, d, a, one, r, posterior, weight)
    return model


def _sample_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys of the features that occur in LEAST_DOCS texts or more; doc, place in keys and count of each that a text has; words of each text."""
    found, words, base = [], [], 0
    distinct, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for part in slices(pa.RecordBatch.from_arrays([texts], ["text"])):
        f = Features(part.column(0))
        doc, key, count = f.counts()
        found.append(((doc + base).astype(np.int32), key, count.astype(np.int32)))
        more, n = np.unique(key, return_counts=True)
        distinct, place = np.unique(np.concatenate([distinct, more]), return_inverse=True)
        docs = np.bincount(place, weights=np.concatenate([docs, n]), minlength=len(distinct)).astype(np.int64)
        words.append(f.words)
        base += part.num_rows
    keys = distinct[docs >= LEAST_DOCS]
    for i, (doc, key, count) in enumerate(found):
        hit, at = _find(keys, key)
        found[i] = (doc[hit], at[hit].astype(np.int32), count[hit])
    return keys, *(np.concatenate([part[i] for part in found]) for i in range(3)), np.concatenate(words)


def _find(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each is among the sorted keys, and where."""
    if not len(keys):
        return np.zeros(len(of), bool), np.zeros(len(of), np.int64)
    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
    return keys[at] == of, at


def train(model: Model, doc: np.ndarray, at: np.ndarray, one: np.ndarray, rate: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = 300, l2: float = 1e-3) -> None:
    """Full-batch logistic regression on soft labels (Adam), held near the weights that model starts from."""
    n, m = len(target), len(model.keys)
    start = np.concatenate([model.presence, model.rate, [model.bias]])
    w = start.copy()
    first, second = np.zeros_like(w), np.zeros_like(w)
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        z = np.bincount(doc, weights=one * w[at] + rate * w[m + at], minlength=n) + w[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        grad = np.concatenate([np.bincount(at, weights=error[doc] * one, minlength=m), np.bincount(at, weights=error[doc] * rate, minlength=m), [error.sum()]])
        grad[:-1] += l2 * (w - start)[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    model.presence, model.rate, model.bias = w[:m], w[m : 2 * m], float(w[-1])


def fit_on(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The model of the documents that labels (doc_id, toxic) speaks of; null and contradicting labels don't count."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id"))
    known = known.agg(F.min("toxic").alias("_toxic"), F.max("toxic").alias("_most")).where("_toxic = _most").drop("_most")
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "_id")

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_id", "ascending"), ("text", "ascending")])
        texts = table.column("text").combine_chunks()
        model = fit(texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks), [int(t > 0) for t in table.column("_toxic").to_pylist()])
        give_back()
        return pa.table({"key": signed(model.keys), "presence": pa.array(model.presence), "rate": pa.array(model.rate), "bias": pa.array(np.full(len(model.keys), model.bias))})

    # one task holds the bounded sample; the driver gets the weights alone
    found = rows.groupBy(F.lit(0).alias("_all")).applyInArrow(one, "key long, presence double, rate double, bias double").collect()
    if not found:
        return fit([], [])
    keys = np.array([r["key"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Model(keys[order], np.array([r["presence"] for r in found])[order], np.array([r["rate"] for r in found])[order], found[0]["bias"])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, score, toxic: one row per row of docs; toxic where the probability is at least threshold.

    Null and empty texts, and texts without letters, have score 0. A null doc_id stays null; repeated rows give repeated
    rows; other columns are ignored. Without any toxic label the fixed lexicons decide alone.
    """
    model = fit_on(docs, labels, fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = model.score(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(score >= threshold)], ["doc_id", "score", "toxic"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, score double, toxic boolean")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that are not toxic, with all their columns, whatever their names.

    Null, empty and letterless texts have score 0 and stay; rows with a null doc_id are judged like any other; repeated rows share their fate;
    an empty table gives an empty result. A text of any length is scored whole.
    """
    model = fit_on(docs, labels, fit_rows)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        return pa.array(np.concatenate([model.score(part.column(0)) for part in slices(batch)] or [np.zeros(0)]))

    return packed_row(docs).where(score(F.col("row.text").cast("string")) < threshold).select("row.*")
