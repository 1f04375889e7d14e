import numpy as np

from spendtrace.llm import convnet
from tests.llm.fixtures import document_rows, documents, no_documents

SF = "/root/testdata/sf0.01"


def slow_score(net, text):
    """Every window of the document, one at a time."""
    chunks = convnet.chunked(text)
    pooled = []
    for chunk in chunks:
        best = np.zeros(convnet.FILTERS)
        for i in range(convnet.STEP):
            x = net.embedding[chunk[i : i + convnet.WIDTH]].reshape(-1)
            best = np.maximum(best, x @ net.filters + net.shift)
        pooled.append(best)
    pooled = np.array(pooled)
    z = np.concatenate([pooled.mean(0), pooled.max(0)]) @ net.weight + net.bias[0]
    return 1 / (1 + np.exp(-z))


def some_net():
    rng = np.random.default_rng(2)
    net = convnet.ByteConvNet()
    for p in net.parameters():
        p[:] = rng.normal(0, 0.3, p.shape)
    return net


def test_chunks_cover_every_window():
    for n in (0, 1, 5, 6, 255, 256, 257, 506, 507, 508, 2000):
        text = bytes(i % 251 for i in range(n))
        windows = {tuple(c[i : i + convnet.WIDTH]) for c in convnet.chunked(text) for i in range(convnet.STEP)}
        assert all(tuple(text[i : i + convnet.WIDTH]) in windows for i in range(n - convnet.WIDTH + 1))


def test_scores_match_a_slow_version():
    net = some_net()
    texts = [b"", b"abc", bytes(range(256)) * 3, b"word " * 300, b"z" * 200_000]
    got = net.scores(texts)
    for text, score in zip(texts[:4], got):
        assert abs(slow_score(net, text) - score) < 1e-5
    assert 0 <= got[4] <= 1


def test_gradients():
    net = some_net()
    texts, labels = [b"some words here", b"*** $$$ ###", b"x" * 700], np.array([1, 0, 1], np.float32)

    def loss():
        p = np.clip(net.scores(texts), 1e-9, 1 - 1e-9)
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    gradients = convnet._gradients(net, texts, labels)
    rng = np.random.default_rng(0)
    for p, g in zip(net.parameters(), gradients):
        assert p.shape == g.shape
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p.shape)
            old, h = p[at], 1e-3
            p[at] = old + h
            up = loss()
            p[at] = old - h
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * h) - g[at]) < 5e-3


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = convnet.quality_scores(docs, convnet.train_classifier(docs, labels))
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 80
    right = sum(r.predicted == r.quality for r in rows)
    assert right / len(rows) > 0.95
    assert all(r.predicted for r in rows if r.quality == 1) or sum(not r.predicted for r in rows if r.quality == 1) <= 1


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20, 60)] + [(None, 1, 0), (21, None, 0), (20, 1, 1), (20, 0, 1)], "doc_id long, quality int, toxic int")
    net = convnet.train_classifier(documents(spark), labels)
    got = convnet.quality_scores(documents(spark), net).collect()
    assert len(got) == len(document_rows())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out is not None for r in got)


def test_nothing_to_learn_or_score(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    net = convnet.train_classifier(documents(spark), labels)
    assert {r.score for r in convnet.quality_scores(documents(spark), net).collect()} == {0.5}
    assert convnet.quality_scores(no_documents(spark), net).collect() == []
