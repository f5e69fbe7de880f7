import numpy as np

from spindrel.llm import quality


def letters(r, alphabet, n):
    return "".join(r.choice(list(alphabet), n))


def test_spam_that_repeats_words_stays_bad(spark):
    r = np.random.default_rng(4)
    good = [letters(r, "abcdefg hij klm.", 300) for _ in range(60)]
    bad = [letters(r, "#$%&* AB!", 300) for _ in range(40)]
    spam = [letters(r, "#$%&* AB!", 300) + " buy buy now now $$$ $$$" * k for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(good + bad + spam)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(100)], "doc_id long, quality int")
    out = {x.doc_id: x.score for x in quality.score(docs, quality.train(docs, labels), ["doc_id"]).collect()}
    assert all(out[i] < 0.3 for i in range(60, 112)) and all(out[i] > 0.7 for i in range(60))


def test_scores_match_plain_densities():
    """Scores equal those of two Gaussians written out with inverses and determinants of the shrunk covariances."""
    r = np.random.default_rng(6)
    y = np.sort(r.integers(0, 2, 300))
    x = r.standard_normal((300, 12)) * r.uniform(0.2, 2, 12) + y[:, None] * 0.8
    model = quality.Discriminant(x, y, None)
    pooled_weight, diagonal_weight = model.weights
    scale = np.maximum(x.std(0), quality.NOISE)
    z = np.clip((x - x.mean(0)) / scale, -quality.FAR, quality.FAR)
    within = np.vstack([z[y == k] - z[y == k].mean(0) for k in (0, 1)])
    logs = []
    for k in (0, 1):
        cov = np.cov(z[y == k].T, bias=True) * (1 - pooled_weight) + pooled_weight * within.T @ within / 300
        for i in range(12):
            for j in range(12):
                cov[i, j] *= 1 if i == j else 1 - diagonal_weight
            cov[i, i] = max(cov[i, i], quality.FLOOR)
        d = z - z[y == k].mean(0)
        far = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
        logs.append(np.log(((y == k).sum() + 1) / 302) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * far)
    plain = 1 / (1 + np.exp(logs[0] - logs[1]))
    assert np.allclose(model.score(x), plain, atol=1e-4)


def test_one_row_of_a_class_is_enough(spark):
    docs = spark.createDataFrame([(1, "fine words stand here."), (2, "@@ ## $$"), (3, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None)], "doc_id long, quality int")
    out = {(x.doc_id, x.text): x.score for x in quality.score(docs, quality.train(docs, labels), ["doc_id", "text"]).collect()}
    assert len(out) == 4 and out[1, "fine words stand here."] > 0.5 > out[2, "@@ ## $$"] and out[3, None] == out[3, ""]
