"""Word segmentation, naive Bayes and ordinal regression against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from flowsift.llm import toxicity, urls


def _best_cut(word, counts, total):
    """The likeliest of all cuts, by trying every one; unknown parts side by side are one."""
    n, best = len(word), (-math.inf, None)
    for mask in range(1 << (n - 1)):
        edges = [0, *(i + 1 for i in range(n - 1) if mask >> i & 1), n]
        parts = [word[a:b] for a, b in zip(edges, edges[1:])]
        if any(len(p) > urls.LONGEST_WORD for p in parts):
            continue
        gain = sum(math.log(counts[p] / total) if p in counts else -math.log(total) - 2.5 * len(p) for p in parts)
        if gain > best[0] + 1e-12:
            best = gain, parts
    out = []
    for part in best[1]:
        if out and part not in counts and out[-1] not in counts:
            out[-1] += part
        else:
            out.append(part)
    return out


def test_segmentation_is_the_likeliest_cut(spark):
    rng = random.Random(4)
    counts = {"".join(rng.choices("abc", k=rng.randint(1, 4))): rng.randint(1, 5000) for _ in range(25)} | {"zz": 7}
    names = sorted({"".join(rng.choices("abcxz", k=rng.randint(1, 9))) for _ in range(120)})
    total = sum(counts.values())
    df = spark.createDataFrame([(n,) for n in names], "name string")
    found = urls.segmented(df, spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {r["name"]: r["words"] for r in found} == {n: _best_cut(n, counts, total) for n in names}


def test_naive_bayes_by_hand(spark):
    hosts = ["casino-win.example.com", "casino-news.org", "news.example.com", "daily-news.example.com", "garden-shop.org", "shop-win.net", "spamcasino.net"]
    rows = [(i, f"http://{h}/{p}", f"{' '.join(h.replace('.', ' ').replace('-', ' ').split())} words casino news daily garden shop win spam")
            for i, (h, p) in enumerate((h, p) for h in hosts for p in ("a", "win/b", ""))]
    got = urls.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    pages = {(r["host"], r["path"]): r["words"] for r in got}
    bad = {a: bool(set(w) & set(urls.SEEDS)) for a, w in pages.items()}
    assert 0 < sum(bad.values()) < len(bad)
    words = {side: Counter(w for a, own in pages.items() if bad[a] == side for w in own) for side in (True, False)}
    vocabulary = len(set(words[True]) | set(words[False]))

    def log_share(word, side):
        return math.log((words[side][word] + 1) / (sum(words[side].values()) + vocabulary + 1))

    base = math.log((sum(bad.values()) + 1) / (len(bad) - sum(bad.values()) + 1))
    for r in got:
        want = base + sum(log_share(w, True) - log_share(w, False) for w in r["words"])
        assert r["score"] == pytest.approx(want, abs=1e-9)
        if r["rule"] is None:
            assert r["verdict"] == ("block" if want > 0 else "allow")


def _loss(w, theta, x, grade, l2=1e-5):
    """Mean negative log-likelihood of cumulative links, row by row, and the penalty on weights."""
    edges = [-math.inf, *theta, math.inf]

    def below(t, s):
        return 0.0 if t == -math.inf else 1.0 if t == math.inf else 1 / (1 + math.exp(s - t))

    total = 0.0
    for row, g in zip(x, grade):
        s = float(row @ w)
        total -= math.log(max(below(edges[g + 1], s) - below(edges[g], s), 1e-12))
    return total / len(x) + l2 / 2 * float(w @ w)


def test_ordinal_fit_is_the_optimum_of_the_likelihood():
    rng = np.random.default_rng(6)
    x = (rng.random((150, 4)) < 0.4).astype(float)
    latent = x @ np.array([1.5, 0.7, -0.5, 0.0]) + rng.logistic(size=150)
    grade = np.digitize(latent, [0.5, 1.6])
    row, column = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(row, column, grade, 4, 3)
    assert (np.diff(theta) > 0).all()
    at, least = np.concatenate([w, theta]), _loss(w, theta, x, grade)
    for i in range(len(at)):  # no direction goes down
        step = np.zeros(len(at))
        step[i] = 1e-4
        up, down = at + step, at - step
        slope = (_loss(up[:4], up[4:], x, grade) - _loss(down[:4], down[4:], x, grade)) / 2e-4
        assert abs(slope) < 2e-3
    for _ in range(50):
        other = at + rng.normal(scale=0.2, size=len(at))
        other[4:] = np.sort(other[4:])
        assert _loss(other[:4], other[4:], x, grade) >= least - 1e-6


def test_severity_is_the_expected_grade(spark):
    model = toxicity.Model({"bad": 2.0, "worse": 3.5, "^horri": 1.0}, [1.0, 2.5, 4.0])
    texts = ["bad worse", "horrid day", "nothing", "", None, "bad bad bad"]
    got = toxicity.graded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        score = sum(v for f, v in model.weights.items() if f in toxicity.features(r["text"] or ""))
        share = [1 / (1 + math.exp(score - t)) for t in model.thresholds]  # P(grade <= j)
        of_grade = np.diff([0.0, *share, 1.0])
        assert r["severity"] == pytest.approx(sum(j * p for j, p in enumerate(of_grade)), abs=1e-12)
        assert r["toxic_probability"] == pytest.approx(1 - share[0], abs=1e-12)
