import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import langid, toxicity
from tidewater.llm.common import remainder

PLAIN = "the river runs past an old mill and over stones where children play in summer light".split()
RUDE = ["idiot", "moron", "loweist", "loweien"]


def toxic_corpus(count, seed):
    chance = np.random.default_rng(seed)
    rows = []
    for k in range(count):
        sentences = [" ".join(chance.choice(PLAIN, 8)) for _ in range(int(chance.integers(1, 12)))]
        label = int(chance.random() < 0.3)
        if label:
            at = int(chance.integers(len(sentences)))
            sentences[at] += " " + str(chance.choice(RUDE))
        rows.append((k, ". ".join(sentences) + ".", label))
    return rows


def test_toxic_documents_and_sentences(spark):
    rows = toxic_corpus(600, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int")
    model = toxicity.train(docs, labels.where(remainder(F.col("doc_id"), 3) != 1))
    got = {r["doc_id"]: r["t"] for r in docs.select("doc_id", toxicity.score_column(spark, model, F.col("text")).alias("t")).collect()}
    for k, text, label in rows:
        score, found = got[k]["score"], got[k]["offending"]
        assert (score >= 0.7) == bool(label), (text, score)
        logits = [z for _, _, z in toxicity.Scorer(model).sentences(text)]
        assert score == pytest.approx(1 - np.prod([1 - 1 / (1 + np.exp(-z)) for z in logits]), abs=1e-9)
        marked = [text[s["start"] : s["start"] + s["length"]] for s in found]
        assert all(any(r in m for r in RUDE) for m in marked) and bool(marked) == bool(label)


def test_long_repetition_is_not_evidence():
    rows = toxic_corpus(400, 2)
    model = toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows], toxicity.Training())
    assert toxicity.Scorer(model).score(" ".join(PLAIN * 2000))[0] < 0.3
    assert toxicity.Scorer(model).score("Moron " + " ".join(PLAIN * 2000))[0] > 0.7


def test_toxicity_odd_rows(spark, odd, empty):
    one_class = toxicity.train(odd, spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, label int"))
    scores = odd.select(toxicity.score_column(spark, one_class, F.col("text"))["score"].alias("s")).collect()
    assert len(scores) == odd.count() and all(0 <= r["s"] < 1e-6 for r in scores)
    model = toxicity.SentenceModel({"alpha": 9.0}, -4.0)
    kept = toxicity.drop_toxic(odd, model, 0.7)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [3, 4, 5, 6, 7, 8, 9, 10]
    assert toxicity.drop_toxic(empty, model, 0.7).count() == 0
    assert toxicity.train(empty, empty.select("doc_id", F.lit(1).alias("label"))).weights == {}


def test_sample_is_bounded(spark):
    rows = toxic_corpus(300, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows for _ in range(2)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int")
    assert toxicity.train(docs, labels, toxicity.Training(per_class=40)).weights


def test_gradients():
    network = langid.Network.start(["a", "b", "c"], langid.Training(hidden=3))
    network.parameters = {k: v.astype(np.float64) for k, v in network.parameters.items()}
    chance = np.random.default_rng(0)
    windows, lengths, target = chance.integers(0, 256, (5, 9)).astype(np.uint8), np.array([9, 3, 9, 1, 7]), np.array([0, 1, 2, 0, 1])
    _, found = network.gradients(windows, lengths, target)
    for name, grads in found.items():
        values = network.parameters[name]
        for at in np.argsort(-np.abs(grads).ravel())[:4]:
            spot = np.unravel_index(at, grads.shape)
            old = values[spot]
            values[spot] = old + 1e-5
            above = network.gradients(windows, lengths, target)[0]
            values[spot] = old - 1e-5
            below = network.gradients(windows, lengths, target)[0]
            values[spot] = old
            assert grads[spot] == pytest.approx((above - below) / 2e-5, rel=1e-3, abs=1e-8)


def test_both_directions_and_short_windows():
    """A shorter window gives what it gives alone, and the backward layer is the forward one on reversed bytes."""
    network = langid.Network.start(["a", "b"], langid.Training(hidden=4))
    windows, lengths = langid.cut(b"x" * 70 + b"abc")
    both = network.probabilities(windows, lengths)
    alone = network.probabilities(windows[1:, : lengths[1]], lengths[1:])
    assert np.allclose(both[:, : lengths[1], 1], alone[:, :, 0], atol=1e-6)
    network.parameters["table"][1], network.parameters["state"][1] = network.parameters["table"][0], network.parameters["state"][0]
    hidden = network.run(np.frombuffer(b"abcdef", np.uint8)[None], np.array([6]))
    turned = network.run(np.frombuffer(b"fedcba", np.uint8)[None], np.array([6]))
    assert np.allclose(hidden[:, 0, :4], turned[::-1, 0, 4:], atol=1e-6)


def language_rows(count, seed):
    chance = np.random.default_rng(seed)
    words = {"en": "the and with house water".split(), "de": "der und mit haus wasser für".split(), "fr": "le et avec maison eau où".split()}
    return [(k, " ".join(chance.choice(words[name], int(chance.integers(3, 120)))), name) for k in range(count) for name in [list(words)[k % 3]]]


def test_languages_of_held_out_documents(spark):
    rows = language_rows(400, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = langid.train(docs, remainder(F.col("doc_id"), 4) != 2, langid.Training(rounds=120, per_language=80))
    held = docs.where(remainder(F.col("doc_id"), 4) == 2)
    got = held.select("lang", langid.language_column(spark, network, F.col("text")).alias("l")).collect()
    assert np.mean([r["lang"] == r["l"]["language"] for r in got]) > 0.95
    assert all(0 <= r["l"]["score"] <= 1 for r in got)
    texts = [t for _, t, _ in rows[:40]]
    together = list(langid.predict_batch(network, texts))
    alone = [next(iter(langid.predict_batch(network, [t]))) for t in texts]
    assert [a[0] for a in together] == [a[0] for a in alone]
    assert np.allclose([a[1] for a in together], [a[1] for a in alone], atol=1e-5)


def test_language_odd_rows(spark, odd, empty):
    network = langid.Network.start(["en", "fr"], langid.Training())
    got = {r["doc_id"]: r["l"] for r in odd.select("doc_id", langid.language_column(spark, network, F.col("text")).alias("l")).collect()}
    assert all(tuple(got[k]) == ("und", 0.0) for k in (3, 4, 5, 10)) and got[9]["language"] in ("en", "fr")
    assert langid.train(empty, F.lit(True)) is None
    nothing = odd.select(langid.language_column(spark, None, F.col("text"))["language"].alias("l")).distinct().collect()
    assert [r["l"] for r in nothing] == ["und"]
    assert empty.select(langid.language_column(spark, network, F.col("text"))).count() == 0


def test_every_language_is_learned(spark):
    """More languages than the bound of the sample is made for; the rarest, and one whose identifiers are all null, count."""
    rows = []
    for k in range(70):
        own = "".join(chr(0x0E01 + 64 * k + j) for j in range(8))
        for i in range(60 if k < 64 else 24):
            text = " ".join(own[(i + j) % 8] * 2 + own[(i * j) % 8] for j in range(12))
            rows.append((None if k == 3 else 100 * i + k, text, f"l{k:02d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = langid.train(docs, F.lit(True), langid.Training(per_language=8, rounds=300))
    assert network.languages == [f"l{k:02d}" for k in range(70)]
    found = docs.where("lang > 'l63'").select("lang", langid.language_column(spark, network, F.col("text"))["language"].alias("l")).collect()
    assert sum(r["lang"] == r["l"] for r in found) > 0.9 * len(found)
