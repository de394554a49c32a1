"""Abusive, hateful or sexual passages: a convolutional text classifier in numpy.

Words are hashed to embeddings, filters of several widths slide over them, and
the strongest response of every filter is kept per window of a few lines.  A
linear layer scores the window and a document scores as its worst window, so one
passage counts wherever it stands in however long a text.

Training sees labels of documents only: it alternates between choosing each
document's worst windows and fitting the network to them.  The windows of a
document are always chosen by a network that has not seen that document, so a
document without any passage that a judge marked by error supports no window and
drops out instead of being learnt by heart.

Labelled documents are no fair sample of a corpus.  The scores of labelled
documents (each by a network that has not seen it) give the curve from score to
probability, with the judges' error rates apart; the share of such documents in
the corpus is then found by expectation maximisation over the scores of all its
documents, per language leaning on the common share, and the cut is where the
expected F1 over the corpus is greatest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.words import FIRST, HASH_BITS, PAD, UNKNOWN, WordIds
from tarn.sources import cut_lineage

#: language of a document by the first letters of its tag (fixed values)
LANGUAGES = {"en": "en", "de": "de", "ge": "de", "fr": "fr", "es": "es", "sp": "es"}


@dataclass(frozen=True)
class ContentModel:
    """Parameters of the network and of its training."""

    dims: int = 12
    filters: int = 12
    widths: tuple[int, ...] = (1, 2, 3, 4)
    block: int = 16  #: words per block; a window is two neighbouring blocks
    max_docs: int = 4_000  #: bound of the labelled sample that training may use
    max_words: int = 20_000  #: longer labelled documents are left out of training (all are scored)
    least_docs: int = 3  #: words of fewer labelled documents are all the same unknown word, so that names are not learnt by heart
    folds: int = 3  #: networks that choose each other's windows
    turns: int = 4  #: rounds of choosing and fitting in the folds
    rounds: int = 4  #: rounds of the network that scores
    epochs: int = 2
    rate: float = 5e-3
    seed: int = 11
    worst: int = 2  #: windows of a harmless document chosen for their score, and by chance
    others: int = 4
    language_docs: float = 200.0  #: weight, in documents, of the common share against a language's own


@dataclass
class Curve:
    """Probability that a document of score (logit) z is objectionable, among documents of which the share ``prior`` is."""

    slope: float = 1.0
    shift: dict[str, float] = field(default_factory=lambda: {"": 0.0})  #: by language; "" for any other
    prior: float = 0.5
    false_mark: float = 0.02  #: how often judges mark a harmless document, and pass over one that is not
    missed: float = 0.1

    def log_odds(self, z: np.ndarray, tag: str) -> np.ndarray:
        return self.slope * z + self.shift.get(tag, self.shift[""])


@dataclass
class Network:
    """Weights; ``kernel`` has all widths side by side, shorter ones padded with zeros."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    known: np.ndarray = field(default_factory=lambda: np.arange(1 << HASH_BITS, dtype=np.int32))  #: a word's own id, or that of the unknown word
    curve: Curve = field(default_factory=lambda: Curve())

    @property
    def span(self) -> int:
        return self.kernel.shape[0] // self.embed.shape[1]

    def responses(self, ids: np.ndarray) -> np.ndarray:
        """Filter responses at every place of ``ids`` (followed by span - 1 paddings)."""
        span, d = self.span, self.embed.shape[1]
        x = self.embed[ids]
        n = len(ids) - span + 1
        cols = np.lib.stride_tricks.as_strided(x, (n, span * d), (x.strides[0], x.strides[1]))
        return cols @ self.kernel

    def document_scores(self, docs: list[np.ndarray], block: int, budget: int = 60_000) -> list[np.ndarray]:
        """Window scores (logits) of every document; a document without words has none."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.float32)] * len(docs)
        part: list[int] = []
        size = 0
        for i, d in enumerate(docs):
            if not len(d):
                continue
            part.append(i)
            size += len(d)
            if size >= budget:
                self._scores(docs, part, block, out)
                part, size = [], 0
        if part:
            self._scores(docs, part, block, out)
        return out

    def _scores(self, docs: list[np.ndarray], part: list[int], block: int, out: list[np.ndarray]) -> None:
        """Lay documents out in whole blocks with an empty block between them, and keep each block's best responses."""
        room = [-(-len(docs[i]) // block) + 1 for i in part]
        ends = np.cumsum(room)
        ids = np.full((int(ends[-1]) * block) + self.span - 1, PAD, dtype=np.int32)
        for i, e, r in zip(part, ends.tolist(), room):
            ids[(e - r) * block : (e - r) * block + len(docs[i])] = self.known[docs[i]]
        best = np.empty((int(ends[-1]), self.kernel.shape[1]), dtype=np.float32)
        step = 128  # blocks at a time, so that the responses stay in the cache
        for a in range(0, len(best), step):
            b = min(len(best), a + step)
            r = self.responses(ids[a * block : b * block + self.span - 1])
            best[a:b] = r.reshape(b - a, block, -1).max(axis=1)
        pairs = np.maximum(best, np.concatenate((best[1:], best[-1:])))
        z = np.maximum(pairs + self.bias, 0) @ self.out + self.shift
        for i, e, r in zip(part, ends.tolist(), room):
            out[i] = z[e - r : e - r + max(1, r - 2)]


def fresh_network(model: ContentModel, rng: np.random.Generator) -> Network:
    span = max(model.widths)
    d, f = model.dims, model.filters
    kernel = np.zeros((span * d, f * len(model.widths)), dtype=np.float32)
    for j, w in enumerate(model.widths):
        kernel[: w * d, j * f : (j + 1) * f] = rng.normal(0, 1 / np.sqrt(w * d), (w * d, f))
    embed = rng.normal(0, 0.3, (1 << HASH_BITS, d)).astype(np.float32)
    embed[PAD] = 0
    return Network(embed, kernel, np.zeros(kernel.shape[1], np.float32), rng.normal(0, 0.1, kernel.shape[1]).astype(np.float32), -1.0)


def _fit(net: Network, model: ContentModel, windows: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, state: dict) -> None:
    """Some epochs of Adam on windows (rows of ids, padded by span - 1)."""
    mask = np.zeros_like(net.kernel)
    for j, w in enumerate(model.widths):
        mask[: w * model.dims, j * model.filters : (j + 1) * model.filters] = 1
    span, d = net.span, model.dims
    n_places = windows.shape[1] - span + 1
    for _ in range(model.epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), 64):
            pick = order[a : a + 64]
            ids, t, g = windows[pick], y[pick], weight[pick]
            b = len(pick)
            x = net.embed[ids]
            cols = np.lib.stride_tricks.as_strided(x, (b, n_places, span * d), (x.strides[0], x.strides[1], x.strides[2]))
            r = cols @ net.kernel  # b, places, filters
            top = r.argmax(axis=1)
            h = np.take_along_axis(r, top[:, None, :], axis=1)[:, 0, :] + net.bias
            drop = (rng.random(h.shape, dtype=np.float32) > 0.2).astype(np.float32) / np.float32(0.8)
            a1 = np.maximum(h, 0) * drop
            z = a1 @ net.out + net.shift
            p = 1 / (1 + np.exp(-z))
            dz = ((p - t) * g / b).astype(np.float32)
            g_out = a1.T @ dz + 1e-4 * net.out
            dh = (dz[:, None] * net.out[None, :]) * drop * (h > 0)
            # gradient of kernel and embeddings at the places that won
            rows = np.arange(b)[:, None]
            won = cols[rows, top]  # b, filters, span*d
            g_kernel = np.einsum("bfk,bf->kf", won, dh) * mask + 1e-5 * net.kernel
            g_won = dh[:, :, None] * net.kernel.T[None, :, :]
            places = (top[:, :, None] + np.arange(span)[None, None, :]).reshape(b, -1)
            touched = np.take_along_axis(ids, places, axis=1).ravel()
            grads = g_won.reshape(b, -1, span, d).reshape(-1, d)
            live, slot = np.unique(touched, return_inverse=True)
            g_embed = np.zeros((len(live), d), dtype=np.float32)
            for c in range(d):
                g_embed[:, c] = np.bincount(slot, grads[:, c], len(live))
            state["t"] += 1
            _adam(net.kernel, g_kernel, state, "kernel", model.rate)
            _adam(net.bias, dh.sum(axis=0), state, "bias", model.rate)
            _adam(net.out, g_out, state, "out", model.rate)
            shift = np.array([net.shift], dtype=np.float32)
            _adam(shift, np.array([dz.sum()], dtype=np.float32), state, "shift", model.rate)
            net.shift = float(shift[0])
            _adam(net.embed, g_embed, state, "embed", model.rate * 2, live)
            net.embed[PAD] = 0


def _adam(w: np.ndarray, g: np.ndarray, state: dict, name: str, rate: float, rows: np.ndarray | None = None) -> None:
    if name not in state:
        state[name] = (np.zeros_like(w), np.zeros_like(w))
    m, v = state[name]
    at = slice(None) if rows is None else rows
    m[at] = 0.9 * m[at] + 0.1 * g
    v[at] = 0.99 * v[at] + 0.01 * g * g
    t = state["t"]
    w[at] -= rate * (m[at] / (1 - 0.9**t)) / (np.sqrt(v[at] / (1 - 0.99**t)) + 1e-7)


def train(docs: list[np.ndarray], labels: np.ndarray, langs: list[str], model: ContentModel = ContentModel()) -> Network:
    """Fit the network to documents (word ids) with labels in [0, 1], the share of judges who object.

    Evenly divided judges say nothing and other disagreement counts less.  Where
    no document is marked, or every one is, there is nothing to tell apart and every
    document scores low.
    """
    rng = np.random.default_rng(model.seed)
    labels = np.asarray(labels, dtype=float)
    usable = [i for i, d in enumerate(docs) if len(d) and labels[i] != 0.5]
    docs, labels, langs = [docs[i] for i in usable], labels[usable], [langs[i] for i in usable]
    hard, sure = labels > 0.5, np.abs(2 * labels - 1)
    n = len(docs)
    if not hard.any() or hard.all():
        net = fresh_network(model, rng)
        net.out[:] = 0
        net.shift = -9.0
        return net
    span, size = max(model.widths), 2 * model.block
    # words by their log odds in objectionable documents: the first guess of where the passages are
    n_pos, n_neg = int(hard.sum()), int((~hard).sum())
    in_pos, in_neg = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)
    words = [np.unique(d) for d in docs]
    for i in range(n):
        (in_pos if hard[i] else in_neg)[words[i]] += 1
    rare = in_pos + in_neg < model.least_docs
    rare[:FIRST] = False
    known = np.arange(1 << HASH_BITS, dtype=np.int32)
    known[rare] = UNKNOWN

    def odds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.log((a + 0.5) / (n_pos + 1)) - np.log((b + 0.5) / (n_neg + 1))

    common = odds(in_pos, in_neg)
    common[rare] = 0
    common[PAD] = 0

    def start() -> Network:
        net = fresh_network(model, rng)
        net.known = known
        net.embed[:, 0] = np.clip(common, -1, 3) / 2
        return net

    def guess(i: int) -> np.ndarray:
        """Odds summed over each window, as the other documents have them."""
        a, b = in_pos[words[i]] - hard[i], in_neg[words[i]] - (not hard[i])
        own = np.where(a + b < model.least_docs - 1, 0, np.clip(odds(a, b), 0, 3))
        sums = np.add.reduceat(own[np.searchsorted(words[i], docs[i])], np.arange(0, len(docs[i]), model.block))
        return sums[:-1] + sums[1:] if len(sums) > 1 else sums

    def window(i: int, at: int) -> np.ndarray:
        row = np.full(size + span - 1, PAD, dtype=np.int32)
        part = known[docs[i][at * model.block : at * model.block + size]]
        row[: len(part)] = part
        return row

    def chosen(who: np.ndarray, scores: list[np.ndarray], first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows with their label and weight; ``scores`` are logits, or in the first turn sums of odds."""
        rows, y, w = [], [], []
        for i in who.tolist():
            s = scores[i]
            order = np.argsort(-s, kind="stable")
            if hard[i]:
                top = int(order[0])
                # a mark that no window supports in the eyes of others is most likely an error of the judge
                trust = 1.0 if first else float(1 / (1 + np.exp(-1.5 * (s[top] + 1))))
                rows.append(window(i, top))
                y.append(1.0)
                w.append(2.0 * trust * sure[i])
                for j in [] if first else rng.permutation(len(s))[:3].tolist():
                    if s[j] < -2:  # elsewhere in such a document is mostly harmless
                        rows.append(window(i, j))
                        y.append(0.0)
                        w.append(0.5)
            else:
                some = [] if first else order[: model.worst].tolist()
                some += rng.permutation(len(s))[: model.others].tolist()
                for j in dict.fromkeys(some):
                    rows.append(window(i, int(j)))
                    y.append(0.0)
                    # a passage that the judge passed over
                    w.append(sure[i] if first else sure[i] * max(0.03, float(1 / (1 + np.exp(s[j] - 3)))))
        return np.stack(rows), np.asarray(y), np.asarray(w)

    fold = np.arange(n) % model.folds
    apart = [(np.flatnonzero(fold != k), np.flatnonzero(fold == k)) for k in range(model.folds)]
    nets = [start() for _ in apart]
    states: list[dict] = [{"t": 0} for _ in apart]
    unseen = [guess(i) for i in range(n)]
    for turn in range(model.turns):
        fresh = list(unseen)
        for net, state, (seen, mine) in zip(nets, states, apart, strict=True):
            if len(seen):
                _fit(net, model, *chosen(seen, unseen, not turn), rng, state)
            for i, s in zip(mine.tolist(), net.document_scores([docs[i] for i in mine], model.block), strict=True):
                fresh[i] = s
        unseen = fresh
    net, state = start(), {"t": 0}
    scores = unseen
    for turn in range(model.rounds):
        _fit(net, model, *chosen(np.arange(n), scores, False), rng, state)
        if turn + 1 < model.rounds:  # harmless documents show what the network still takes for worse than it is
            own = net.document_scores(docs, model.block)
            scores = [u if hard[i] or u.max() > 2 else o for i, (u, o) in enumerate(zip(unseen, own, strict=True))]
    net.curve = fit_curve(np.array([s.max() for s in unseen]), hard, sure, langs)
    return net


def fit_curve(z: np.ndarray, hard: np.ndarray, sure: np.ndarray, langs: list[str], steps: int = 1500) -> Curve:
    """Logistic curve of labels on scores with the judges' error rates apart, by penalised likelihood.

    The penalties (slope near 1, shifts near 0, error rates of 2 and 10 percent)
    weigh as much as a few labels, so that few labels give a mild curve.
    """
    tags = sorted({str(t) for t in langs} - {""})
    group = np.array([tags.index(t) + 1 if t in tags else 0 for t in langs], dtype=int)
    z = np.clip(z, -12, 12)
    theta = np.array([0.0, 0.0, np.log(0.02 / 0.98), np.log(0.1 / 0.9), *([0.0] * len(tags))])
    centre, spread = theta.copy(), np.array([0.5, 2.0, 0.7, 0.7, *([1.0] * len(tags))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        a = np.exp(theta[0])
        own = np.append(0.0, theta[4:])[group]
        p = 1 / (1 + np.exp(-(a * z + theta[1] + own)))
        e0, e1 = 1 / (1 + np.exp(-theta[2:4]))
        q = np.clip(e0 + (1 - e0 - e1) * p, 1e-6, 1 - 1e-6)
        d = sure * np.where(hard, 1 / q, -1 / (1 - q))
        dp = d * (1 - e0 - e1) * p * (1 - p)
        g = np.concatenate(([(dp * a * z).sum(), dp.sum(), (d * (1 - p)).sum() * e0 * (1 - e0), -(d * p).sum() * e1 * (1 - e1)], np.bincount(group, dp, len(tags) + 1)[1:]))
        g -= (theta - centre) / spread**2
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    own = np.append(0.0, theta[4:])
    p = 1 / (1 + np.exp(-(np.exp(theta[0]) * z + theta[1] + own[group])))
    prior = float((p.sum() + 0.5) / (len(p) + 1))
    e0, e1 = 1 / (1 + np.exp(-theta[2:4]))
    return Curve(float(np.exp(theta[0])), {"": float(theta[1])} | {t: float(theta[1] + x) for t, x in zip(tags, own[1:], strict=True)}, prior, float(e0), float(e1))


def corpus_cuts(curve: Curve, counts: dict[str, tuple[np.ndarray, np.ndarray]], model: ContentModel = ContentModel()) -> dict[str, float]:
    """The score (logit) by language beyond which documents of a corpus are flagged, as the module describes.

    ``counts`` has, by language, scores and the number of documents at each.
    """
    odds = {t: curve.log_odds(z, t) - np.log(curve.prior / (1 - curve.prior)) for t, (z, _) in counts.items()}
    share = dict.fromkeys(counts, curve.prior)
    whole = curve.prior
    total = sum(float(n.sum()) for _, n in counts.values())
    posterior: dict[str, np.ndarray] = {}
    for _ in range(200):
        posterior = {t: 1 / (1 + np.exp(-(odds[t] + np.log(share[t] / (1 - share[t]))))) for t in counts}
        sums = {t: float((posterior[t] * counts[t][1]).sum()) for t in counts}
        whole = min(0.999, max(1e-6, sum(sums.values()) / max(1.0, total)))
        share = {t: min(0.999, max(1e-6, (sums[t] + model.language_docs * whole) / (float(counts[t][1].sum()) + model.language_docs))) for t in counts}
    if not total:
        return {"": 0.0}
    p, n = np.concatenate(list(posterior.values())), np.concatenate([n for _, n in counts.values()]).astype(float)
    order = np.argsort(-p)
    hit, taken = np.cumsum((p * n)[order]), np.cumsum(n[order])
    f1 = 2 * hit / (taken + hit[-1])
    least = float(np.clip(f1.max() / 2, 0.05, 0.95))  # the cut of greatest expected F1 lies at half of it
    cuts = {t: float((np.log(least / (1 - least)) - np.log(share[t] / (1 - share[t])) + np.log(curve.prior / (1 - curve.prior)) - curve.shift.get(t, curve.shift[""])) / curve.slope) for t in counts}
    return cuts


def language(tag: Column) -> Column:
    """The calibrated language of a tag in any spelling, or an empty text."""
    start = F.lower(F.substring(F.trim(F.coalesce(tag, F.lit(""))), 1, 2))
    out = F.lit("")
    for k, v in LANGUAGES.items():
        out = F.when(start == k, v).otherwise(out)
    return out


def fit_from_labels(docs: DataFrame, labels: DataFrame, doc: str, text: str, lang: str, label: str, model: ContentModel = ContentModel()) -> Network:
    """Train on at most ``model.max_docs`` labelled documents, chosen by the hash of their id.

    Judgements of one document are averaged, null ones ignored.  Words are hashed
    on the executors; only ids of the bounded sample reach the driver.
    """
    judged = (
        labels.where(F.col(label).isNotNull())
        .groupBy(F.col(doc).alias("_doc"))
        .agg(F.avg(F.col(label).cast("double")).alias("_y"))
        .where(F.col("_doc").isNotNull())
        .orderBy(F.xxhash64("_doc"), "_doc")
        .limit(model.max_docs)
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordIds()
        for b in batches:
            ids = [words.encode(t) for t in b["_text"]]
            yield pd.DataFrame({"_doc": b["_doc"].astype(str), "_y": b["_y"], "_lang": b["_lang"], "_ids": [i.tobytes() for i in ids]})

    rows = (
        docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"), language(F.col(lang)).alias("_lang"))
        .join(F.broadcast(judged), "_doc")  # at most max_docs rows
        .mapInPandas(encode, "_doc string, _y double, _lang string, _ids binary")
        .where(F.length("_ids") <= 4 * model.max_words)
        .collect()
    )
    rows.sort(key=lambda r: (r["_doc"], r["_y"], len(r["_ids"])))
    seen = hashlib.sha256(repr(model).encode())
    for r in rows:
        seen.update(repr((r["_doc"], r["_y"], r["_lang"])).encode() + bytes(r["_ids"]))
    key = seen.hexdigest()
    if key not in _FITTED:
        net = train([np.frombuffer(bytes(r["_ids"]), dtype=np.int32) for r in rows], np.array([r["_y"] for r in rows]), [r["_lang"] for r in rows], model)
        while len(_FITTED) >= 4:
            _FITTED.pop(next(iter(_FITTED)))
        _FITTED[key] = net
    return _FITTED[key]


#: the last networks of this driver by the hash of their sample and parameters
_FITTED: dict[str, Network] = {}


def score(docs: DataFrame, net: Network, doc: str, text: str, lang: str, keep: list[str] | None = None, model: ContentModel = ContentModel()) -> DataFrame:
    """Every document's ``score`` in [0, 1] and whether it is ``flagged`` among the documents of this corpus.

    Whole texts are scored, whatever their length.  Null and empty texts score 0
    and are never flagged.  The scores are independent of each other and are
    written to the shared folder; the cuts follow from their histogram (a cell per
    tenth of a logit and language).  Repeated rows repeat their result; an empty
    table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def worst(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = WordIds()
        own = sent.value
        for b in batches:
            out: list[float | None] = []
            part: list[np.ndarray] = []
            size = 0
            for t in b:
                ids = words.encode(t)
                part.append(ids)
                size += len(ids)
                if size >= 60_000:
                    out += _worst(own, part, model.block)
                    part, size = [], 0
            out += _worst(own, part, model.block)
            yield pd.Series(out, dtype="float64")

    scored = cut_lineage(docs.select(F.col(doc), *[F.col(c) for c in keep or []], language(F.col(lang)).alias("_tag"), worst(F.col(text)).alias("_z")))
    # at most some 400 cells per language
    cells = scored.where(F.col("_z").isNotNull()).groupBy("_tag", F.round(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("_z"))), 1).alias("_at")).count().collect()
    counts = {}
    for t in sorted({c["_tag"] for c in cells}):
        own = sorted((c["_at"], c["count"]) for c in cells if c["_tag"] == t)
        counts[t] = (np.array([a for a, _ in own]), np.array([n for _, n in own]))
    cut = F.lit(0.0)
    for t, at in corpus_cuts(net.curve, counts, model).items():
        cut = F.when(F.col("_tag") == t, F.lit(at)).otherwise(cut)
    probability = F.coalesce(1 / (1 + F.exp(-F.col("_z"))), F.lit(0.0))
    return scored.select(doc, *(keep or []), probability.alias("score"), F.coalesce(F.col("_z") > cut, F.lit(False)).alias("flagged"))


def _worst(net: Network, docs: list[np.ndarray], block: int) -> list[float | None]:
    return [float(s.max()) if len(s) else None for s in net.document_scores(docs, block)]
