"""Text operators against brute force, exact invariants and held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import content, mixing, packing, queries, tokens, words

# ---- tokens --------------------------------------------------------------------------------------------------------


def test_counts_equal_whole_text_encoding():
    enc = tokens.encoding()
    rng = random.Random(1)
    bits = ["word", " ", "  ", "\n", "\t", "don't", "é", "一二", "\x1c", "\x85", "\xa0", "...", "123", "{x}", " \n ", "'s", " ", "🙂", "_", "　"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        assert tokens.count_tokens(text) == len(enc.encode_ordinary(text)), repr(text)
    long = "a" * 20_000 + " b" * 20_000 + "\n" * 500
    assert tokens.count_tokens(long) == len(enc.encode_ordinary(long))
    assert tokens.count_tokens("") == tokens.count_tokens(None) == 0


def test_token_column(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (1, "a b")], "id int, text string")
    got = tokens.with_token_counts(df, "text").orderBy("id").collect()
    assert [(r.id, r.n_tokens) for r in got] == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert tokens.with_token_counts(df.limit(0), "text").count() == 0


# ---- packing -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_respects_capacity_and_wastes_little(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 4097, 3000)
    caps = (512, 1024, 2048, 4096)
    bins, final = packing.best_fit(sizes, caps)
    fill = np.bincount(bins, sizes, len(final))
    assert (fill <= final).all() and set(final.tolist()) <= set(caps)
    smallest = np.asarray(caps)[np.searchsorted(caps, fill)]
    assert (final == smallest).all()
    assert sizes.sum() / final.sum() > 0.97


def test_best_fit_prefers_the_tightest_bin():
    bins, final = packing.best_fit(np.array([60, 70, 30, 40]), (100,))
    assert bins[1] == bins[2] and bins[0] == bins[3] and final.tolist() == [100, 100]
    assert len(packing.best_fit(np.zeros(0, dtype=np.int64), (4, 8))[0]) == 0


def test_pack_places_every_token_once(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([rng.randrange(5000), rng.randrange(100), 0, None, 20_000])) for i in range(800)] + [(5, 10), (5, 10), (None, 7)]
    df = spark.createDataFrame(rows, "doc long, n long").withColumn("bin", F.lit("clash"))
    for shard in (50_000, 100):
        got = packing.pack(df, "doc", "n", (512, 1024, 2048, 4096), shard_items=shard).collect()
        fills: dict = {}
        for r in got:
            f = fills.setdefault(r.bin, [0, r.bin_size, r.bin_fill])
            f[0] += r.piece_size
        assert all(a == c <= b for a, b, c in fills.values())
        assert sum(r.piece_size for r in got) == sum(n or 0 for _, n in rows)
        for r in got:
            whole = r.item_size
            assert whole > 4096 or (r.piece, r.piece_size) == (0, whole)
            assert r.piece_size == min(4096, whole - 4096 * r.piece)
        assert sum(r.piece == 0 for r in got) == len(rows)
    assert packing.pack(df.limit(0), "doc", "n").count() == 0


# ---- mixing --------------------------------------------------------------------------------------------------------


def test_mixture_reaches_targets(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["big"] * 7 + ["mid"] * 2 + ["small"]), rng.randrange(1, 300)) for i in range(5000)]
    docs += [(9001, None, 50), (9002, "unlisted", 50), (9003, "big", None), (9004, "mid", -3)]
    d = spark.createDataFrame(docs, "doc long, source string, n long").withColumn("position", F.lit("clash"))
    t = spark.createDataFrame([("big", 0.5, 1, 0.6), ("mid", 0.3, 3, -0.5), ("small", 0.15, 1, 0.0), ("none", 0.05, 4, 0.0)], "source string, target_share double, max_repeats int, warm double")
    for bucket_docs in (200_000, 20):
        mix, report = mixing.mixture(d, t, "doc", "source", "n", bucket_docs=bucket_docs, warm="warm")
        rows = mix.collect()
        total = sum(max(n or 0, 0) for _, _, n in docs)
        by: dict = {}
        for r in rows:
            by.setdefault((r.source, r.doc), []).append(r.epoch)
        caps = {"big": 1, "mid": 3, "small": 1}
        assert all(sorted(e) == list(range(len(e))) and len(e) <= caps[s] for (s, _), e in by.items())
        used = {s: sum(r.n for r in rows if r.source == s) for s in caps}
        rep = {r.source: r for r in report.collect()}
        assert {s: rep[s].tokens_used for s in caps} == used and rep["none"].tokens_used == 0
        assert rep["big"].reached and rep["mid"].reached and not rep["small"].reached and not rep["none"].reached
        for s in ("big", "mid"):
            assert abs(used[s] / total - rep[s].target_share) < 0.002
        assert used["small"] == sum(n for _, s, n in docs if s == "small")
        assert [r.position for r in rows] == sorted(r.position for r in rows)
        assert all(0 <= r.position <= 1 for r in rows)
        # the schedule: a rising source has less than its share in the first half, in proportion to its tilt
        early = sum(r.n for r in rows if r.source == "big" and r.position < 0.5) / used["big"]
        mean = (0.5 * 0.6 - 0.3 * 0.5) / 1.0
        assert abs(early - (0.5 - (0.6 - mean) / 4)) < 0.02
    with pytest.raises(ValueError, match="more than one target"):
        mixing.mixture(d, t.union(t), "doc", "source", "n")
    mix, report = mixing.mixture(d.limit(0), t, "doc", "source", "n")
    assert mix.count() == 0 and report.count() == 4


def test_registered_mixture_varies_over_training(spark, tmp_path):
    docs = [(i, ("once", "often")[i % 2], "some words of a document " * 4) for i in range(2000)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("once", 0.4, 1), ("often", 0.6, 3)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    rows = queries.p9_mixture(spark, str(tmp_path)).collect()
    early = {s: sum(r.position < 0.5 for r in rows if r.source == s) / sum(r.source == s for r in rows) for s in ("once", "often")}
    assert abs(early["once"] - (0.5 + 0.6 / 4)) < 0.02 and abs(early["often"] - (0.5 - 0.4 / 4)) < 0.02  # the tilts are -0.6 and 0.4 once centred


def test_report_is_read_from_the_documents_placed(spark):
    docs = [(i, "abc"[i % 3], 10) for i in range(3000)]
    d = spark.createDataFrame(docs, "doc long, source string, n long")
    t = spark.createDataFrame([("a", 0.5, 1, None), ("b", 0.3, 3, 0.4), ("c", 0.2, 1, -0.4)], "source string, target_share double, max_repeats int, warm double")
    mix, report = mixing.mixture(d, t, "doc", "source", "n", warm="warm")
    rep = {r.source: r for r in report.collect()}
    assert not rep["a"].reached and rep["b"].reached and rep["c"].reached
    # source a has two thirds of its demand, and its weight is nearly constant
    assert abs(rep["a"].lasts_until - 2 / 3) < 0.02 and rep["b"].lasts_until > 0.999 and rep["c"].lasts_until > 0.99
    other = {r.source: r for r in mixing.mixture(d, t.withColumn("warm", F.when(F.col("source") == "a", 0.7)), "doc", "source", "n", warm="warm")[1].collect()}
    assert other["a"].lasts_until > rep["a"].lasts_until + 0.02 and not other["a"].reached  # a later schedule, the same shares
    parts = {(r.part, r.source): r for r in mixing.shares_over_training(mix, "source", "n", 10).collect()}
    assert sum(r.n for r in parts.values()) == sum(r.tokens_used for r in rep.values())
    assert parts[9, "b"].n > 1.5 * parts[0, "b"].n and (9, "a") not in parts
    with pytest.raises(ValueError, match="tilt"):
        mixing.mixture(d, t.withColumn("warm", F.when(F.col("source") == "c", -3.0)), "doc", "source", "n", warm="warm")
    assert mixing.shares_over_training(mix.limit(0), "source", "n").count() == 0


def test_usage_counts_every_bin_once(spark):
    rows = [(i, 300 + i % 700) for i in range(400)] + [(999, 9000)]
    packed = packing.pack(spark.createDataFrame(rows, "doc long, n long"), "doc", "n")
    got = packing.usage(packed).collect()
    assert sum(r.filled for r in got) == sum(n for _, n in rows) and sum(r.bins for r in got) == packed.select("bin").distinct().count()
    assert all(r.room == r.bins * r.bin_size and abs(r.unused_share - (1 - r.filled / r.room)) < 1e-9 for r in got)
    assert sum(r.filled for r in got) / sum(r.room for r in got) > 0.95


def test_all_text_queries_are_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and {"p8_found", "p9_found", "p10_found"} <= set(queries.QUERIES)
    assert set(queries.ORACLE) <= set(queries.QUERIES)


# ---- content -------------------------------------------------------------------------------------------------------


def test_disguises_lead_to_the_plain_word():
    plain = words.chunk_ids("idiot")
    for s in ("IDIOT", "1d10t", "id\\-iot", "i{diot}", "id​iot", "idíot", "idiot.", "{idiot}", "idiiiot", "\\emph{idiot}"[5:]):
        assert words.chunk_ids(s)[-1:] == plain, s
    enc = words.WordIds()
    assert enc.encode("you i d i o t now").tolist() == enc.encode("you idiot now").tolist()
    assert words.chunk_ids("m***n") == words.chunk_ids("m*n") != words.chunk_ids("moron")
    assert len(enc.encode(None)) == len(enc.encode("")) == 0


def corpus(n, seed, share=0.3):
    rng = random.Random(seed)
    plain = ["the", "gradient", "of", "a", "stable", "field", "is", "measured", "under", "weak", "noise", "and", "converges"]
    bad = ["you utter zork and your whole zork family", "every blarg should leave this place", "i will smash you zork"]
    decoys = ["the corpus marks ``zork'' as rude", "a blarg is a kind of field"]
    texts, labels = [], []
    for _ in range(n):
        body = [rng.choice(plain) for _ in range(rng.randrange(60, 400))]
        y = rng.random() < share
        if y:
            body.insert(rng.randrange(len(body)), rng.choice(bad))
        elif rng.random() < 0.4:
            body.insert(rng.randrange(len(body)), rng.choice(decoys))
        texts.append(" ".join(body))
        labels.append(float(y))
    return texts, labels


def test_classifier_generalises_and_does_not_depend_on_place_or_length():
    texts, labels = corpus(700, 1)
    rng = random.Random(0)
    noisy = [1 - y if rng.random() < 0.06 else y for y in labels]
    enc = words.WordIds()
    net = content.train([enc.encode(t) for t in texts], np.array(noisy), ["en"] * len(texts))
    fresh, truth = corpus(300, 2)
    z = np.array([s.max() for s in net.document_scores([enc.encode(t) for t in fresh], 16)])
    cut = cut_of(net, z)
    got = z > cut
    truth = np.array(truth) > 0.5
    assert (got & truth).sum() / truth.sum() > 0.93 and (got & ~truth).sum() <= 0.05 * len(truth)
    # a passage at the end of a very long text counts
    long = " ".join(["the field is stable"] * 20_000)
    ends = net.document_scores([enc.encode(long), enc.encode(long + " you utter zork and your whole zork family")], 16)
    assert ends[0].max() < cut < ends[1].max()


def cut_of(net, z):
    at, n = np.unique(np.round(z, 1), return_counts=True)
    return content.corpus_cuts(net.curve, {"en": (at, n)})["en"]


def test_cut_follows_the_share_in_the_corpus():
    """A fifth of the labelled documents is objectionable, of the corpus three in a hundred; judges err."""
    texts, labels = corpus(800, 5, 0.2)
    rng = random.Random(1)
    noisy = [1 - y if rng.random() < 0.05 else y for y in labels]
    enc = words.WordIds()
    net = content.train([enc.encode(t) for t in texts], np.array(noisy), ["en"] * len(texts))
    fresh, truth = corpus(4000, 6, 0.03)
    truth = np.array(truth) > 0.5
    z = np.array([s.max() for s in net.document_scores([enc.encode(t) for t in fresh], 16)])
    got = z > cut_of(net, z)
    assert (got & truth).sum() >= 0.9 * truth.sum() and (got & truth).sum() >= 0.9 * got.sum()


def test_curve_tells_the_share_of_a_corpus_from_that_of_the_labels():
    rng = np.random.default_rng(4)

    def draw(n, share):
        y = rng.random(n) < share
        return np.where(y, rng.normal(2, 1, n), rng.normal(-2, 1, n)), y

    z, y = draw(3000, 0.25)
    marks = np.where(rng.random(3000) < np.where(y, 0.1, 0.02), ~y, y)
    curve = content.fit_curve(z, marks, np.ones(3000), ["en"] * 3000)
    assert abs(curve.prior - 0.25) < 0.03
    wide, truth = draw(100_000, 0.03)
    at, n = np.unique(np.round(wide, 1), return_counts=True)
    got = wide > content.corpus_cuts(curve, {"en": (at, n)})["en"]
    best = max(2 * (truth & (wide > c)).sum() / ((wide > c).sum() + truth.sum()) for c in np.arange(-2, 4, 0.1))
    assert 2 * (truth & got).sum() / (got.sum() + truth.sum()) > best - 0.02
    assert content.corpus_cuts(curve, {}) == {"": 0.0}


@pytest.mark.parametrize("n", [1, 2, 3, 59, 61])
def test_few_labels_train_all_the_same(n):
    texts, labels = corpus(n, 8)
    net = content.train([words.WordIds().encode(t) for t in texts], np.array(labels), [""] * n)
    assert np.isfinite(net.document_scores([words.WordIds().encode(texts[0])], 16)[0]).all()
    labels[:] = [0.5] * n  # evenly divided judges say nothing
    assert content.train([words.WordIds().encode(t) for t in texts], np.array(labels), [""] * n).shift == -9.0


def test_scores_do_not_depend_on_batches():
    texts, labels = corpus(200, 3)
    enc = words.WordIds()
    ids = [enc.encode(t) for t in texts]
    net = content.train(ids, np.array(labels), [""] * len(ids), content.ContentModel(rounds=2))
    together = net.document_scores(ids, 16)
    for i in (0, 5, 17):
        alone = net.document_scores([ids[i]], 16)[0]
        assert np.allclose(alone, together[i], atol=1e-4)


def test_without_labels_nothing_is_flagged(spark):
    docs = spark.createDataFrame([(1, "some text", "en"), (2, None, None), (3, "", "de"), (3, "", "de")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, offensive int")
    net = content.fit_from_labels(docs, labels, "doc_id", "text", "lang", "offensive")
    rows = content.score(docs, net, "doc_id", "text", "lang").collect()
    assert len(rows) == 4 and not any(r.flagged for r in rows)
    assert content.score(docs.limit(0), net, "doc_id", "text", "lang").count() == 0
