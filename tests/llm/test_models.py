"""Classifiers: gradients, held-out accuracy and odd rows."""

import numpy as np
import pytest
from odd import no_docs, odd_docs
from pyspark.sql import functions as F

import __spark_entry__ as entry
from thicket.llm import quality_model, toxicity

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    pos, neg = scores[labels == 1], scores[labels == 0]
    return float(np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])))


@pytest.mark.parametrize(("name", "label", "least"), [("op4_toxicity", "toxic", 0.85), ("op5_quality_classifier", "quality", 0.95)])
def test_held_out(spark, name, label, least):
    out = entry.queries()[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc(out["score"].to_numpy(), out[label].to_numpy()) >= least
    assert out["score"].between(0, 1).all()
    assert (out["predicted"] == (out["score"] >= (0.5 if label == "toxic" else 0.3))).all()


def test_network_gradients():
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) * (3 if k in ("words", "chars") else 1) for k, v in net.p.items()}
    encoded = [t.encode() for t in ("alpha beta gamma delta " * 11, "idiot clown you are", "x")]
    x = toxicity.Inputs(np.frombuffer(b"".join(encoded), np.uint8), np.cumsum([0] + [len(e) for e in encoded]))
    start, length, doc = x.windows()
    y = (doc > 0).astype(float)
    part, own = toxicity._part(x, start, length), np.arange(len(start)) * toxicity.WINDOW

    def loss():
        z = net.logits(net.project(part)[0], part.word_at, own, length)
        return float(np.sum(np.log1p(np.exp(z)) - y * z))

    projected, e = net.project(part)
    tape = {}
    z = net.logits(projected, part.word_at, own, length, tape)
    assert np.allclose(z, toxicity.scores_of(net, x, start, length))
    for name, g in net.gradients(part, e, tape, toxicity._sigmoid(z) - y).items():
        if isinstance(g, tuple):
            rows, values = toxicity._rows_summed(*g)
            at, value = (rows[0], 1), values[0, 1]
        else:
            at = tuple(0 for _ in g.shape)
            value = g[at]
        kept, eps = net.p[name][at], 1e-3
        net.p[name][at] = kept + eps
        up = loss()
        net.p[name][at] = kept - eps
        down = loss()
        net.p[name][at] = kept
        assert abs((up - down) / (2 * eps) - value) < 1e-4 + 1e-3 * abs(value), name


def test_every_labelled_text_is_learned_from(monkeypatch):
    """In each epoch every positive has a gradient, also those whose best window scores low."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 60, 40)) for _ in range(120)]
    labels = np.zeros(120, int)
    labels[:6] = 1  # nothing tells them from the others
    assert (toxicity.label_weights(np.array([-9.0, -0.6, 2.0, -9.0]), np.array([1, 1, 1, 0])) > 0).all()
    seen, epochs = [], []
    part = toxicity._part

    def spied(x, start, length):
        seen.append(start)
        return part(x, start, length)

    scores = toxicity._block_scores
    monkeypatch.setattr(toxicity, "_part", spied)
    monkeypatch.setattr(toxicity, "_block_scores", lambda *a: (scores(*a), seen.clear(), epochs.append(None))[0])
    for n in (3, 5, 8):
        seen.clear()
        toxicity.train(texts, labels, epochs=n)
        assert {int(s) // 40 for s in np.concatenate(seen)} == set(range(120))


def recall_at_a_rare_label():
    """Recall on held-out positives, at 0.5, where 2 % have label 1 and each kind of them is rare; and the false alarms."""
    rng = np.random.default_rng(11)

    def draw(n):
        labels = (np.arange(n) % 50 == 0).astype(int)
        texts = []
        for k in range(n):
            w = [f"word{x}" for x in rng.zipf(1.3, 60) % 3000]
            if labels[k]:
                w[rng.integers(0, 60)] = f"slur{rng.integers(0, 8)}"
            texts.append(" ".join(w))
        return texts, labels

    net = toxicity.train(*draw(4000))
    texts, labels = draw(2000)
    encoded = [t.encode() for t in texts]
    x = toxicity.Inputs(np.frombuffer(b"".join(encoded), np.uint8), np.cumsum([0] + [len(e) for e in encoded]))
    start, length, doc = x.windows()
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, doc, toxicity.scores_of(net, x, start, length))
    return float((best[labels == 1] >= 0).mean()), float((best[labels == 0] >= 0).mean())


def test_recall_at_a_rare_label():
    recall, alarms = recall_at_a_rare_label()
    assert recall >= 0.7 and alarms <= 0.05


def test_all_windows_overlap_and_cover():
    text = (" ".join(f"w{k}" for k in range(100))).encode()
    x = toxicity.Inputs(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    start, length, _ = x.windows()
    assert list(start) == [0, 16, 32, 48, 64, 68] and set(length) == {32}


def test_factorisation_identity():
    """The linear-time sum of squares equals the sum over all pairs."""
    fm = quality_model.Machine()
    rng = np.random.default_rng(1)
    row, value = rng.choice(quality_model.ROWS, 12, replace=False), rng.normal(size=12).astype(np.float32)
    fm.w[row] = rng.normal(size=12)
    z, _ = fm.logits(np.zeros(12, np.int64), row, value, 1)
    pairs = sum(float(fm.v[row[i]] @ fm.v[row[j]] * value[i] * value[j]) for i in range(12) for j in range(i))
    assert abs(float(z[0]) - (float(fm.w[row] @ value) + pairs)) < 1e-4


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality_model.quality])
def test_odd_rows(spark, operator):
    docs = odd_docs(spark)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), (F.col("doc_id") % 2).cast("int").alias("quality"))
    out = operator(docs, labels)
    assert out.count() == docs.count() and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert operator(no_docs(spark), labels).count() == 0
    assert operator(docs, labels.limit(0)).count() == docs.count()
