import numpy as np

from stayline.llm import quality

DOCS = "doc_id long, text string, lang string, label int, rank int"


def test_chunks_cover_every_byte():
    for n in (0, 1, 5, 1024, 1025, 5000, 100_000):
        text = "".join(chr(33 + i % 90) for i in range(n))
        cut, sizes = quality.chunks(text)
        seen = np.zeros(n, dtype=bool)
        for i, (c, s) in enumerate(zip(cut, sizes, strict=True)):
            at = i * quality.STEP
            assert c[:s].tobytes().decode() == text[at : at + s]
            seen[at : at + s] = True
        assert seen.all()


def test_filters_against_plain_loops():
    network = quality.Network()
    cut, sizes = quality.chunks("Short text with bytes é! " * 60)
    got, at = network.respond(cut, sizes, where=True)
    table = network.values["table"]
    for c in range(len(cut)):
        inside = [p for p in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE) if p == 0 or p + quality.WIDTH <= sizes[c]]
        heat = np.array([sum(table[k, cut[c, p + k]] for k in range(quality.WIDTH)) for p in inside])
        assert np.allclose(heat.max(axis=0), got[c], atol=1e-5)
        assert (np.array(inside)[heat.argmax(axis=0)] == at[c] * quality.STRIDE).all()


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    network = quality.Network(1)
    texts = ["abc def " * 300, "zz!! " * 20, "one"]
    labels, weights = np.array([1, 0, 1], dtype=np.float32), np.ones(3)
    parts = [quality.chunks(t) for t in texts]
    cut, sizes = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
    first = np.cumsum([0, *(len(p[0]) for p in parts[:-1])])

    def loss():
        network.pairs = None
        best, _ = network.respond(cut, sizes)
        p = network.top(network.pool(best, sizes, first)[1])[1].astype(float)
        return -np.mean(weights * (labels * np.log(p) + (1 - labels) * np.log(1 - p)))

    slopes = network.gradients(cut, sizes, first, labels, weights)
    for name in ("out", "mix", "bias", "table"):
        value, slope = network.values[name], np.asarray(slopes[name])
        close = 0
        picked = rng.permutation(np.argsort(-np.abs(slope).ravel())[:20])[:10]
        for flat in picked:
            where, old = np.unravel_index(flat, value.shape), value.flat[flat]
            value[where] = old + 1e-3
            up = loss()
            value[where] = old - 1e-3
            down = loss()
            value[where] = old
            close += abs((up - down) / 2e-3 - slope.flat[flat]) < 0.1 * abs(slope.flat[flat]) + 1e-3
        # Where a maximum moves to another place or chunk in between, the difference is no slope.
        assert close >= 6, name


def test_edges(spark):
    rows = [(i, "good words here " * 20 if i % 2 else "###!! " * 40, "en", 1, 1) for i in range(60)]
    rows += [(100, None, "en", 1, 1), (101, "", "en", 1, 1), (102, "long text " * 60_000, "en", 1, 1), (None, "no id", "en", 1, 1), (5, "twice", "en", 1, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(60)] + [(7, 0, "x"), (8, None, "x"), (None, 1, "x"), (9, 5, "x"), (999, 1, "x")], "doc_id long, quality int, text string")
    out = {(r.doc_id, i): r for i, r in enumerate(quality.classify(docs, labels).collect())}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("text like '###%'").count() == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(docs, labels).where("held_out").join(labels, "doc_id").collect()
    good, bad = [r for r in out if r["quality"] == 1], [r for r in out if r["quality"] == 0]
    assert sum(r.predicted for r in good) / len(good) > 0.98
    assert sum(1 - r.predicted for r in bad) / len(bad) > 0.88
