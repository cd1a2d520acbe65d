"""The trained models against scalar loops: features, gradients, updates, temperature, prediction."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from windrow.llm import langid, toxicity, urlfilter

M = 1 << 32


def plain_grams(text, features):
    """Counts of hashed n-grams, character by character."""
    points = [ord(c) for c in text.lower()]
    found = Counter()
    for i in range(len(points)):
        h = 0
        for n in range(1, features.longest + 1):
            if i + n > len(points):
                break
            h = (h * 0x01000193 + (points[i + n - 1] + n) * 0x9E3779B1) % M
            found[((h ^ (h >> 15)) * 0x85EBCA6B % M) >> (32 - features.bits)] += 1
    return found


@pytest.mark.parametrize("text", ["", "a", "Ünd so weiter, \U0001f600.", "ab" * 400])
def test_language_features_are_tf_idf_of_character_grams(text):
    f = langid.Features(3, 10)
    got = f.counts(text)
    assert {i: int(n) for i, n in enumerate(got) if n} == plain_grams(text, f)
    idf = np.linspace(0.1, 2, 1 << 10)
    at, x = langid.LanguageModel(f, ["a"], idf, np.zeros((1 << 10, 1))).vector(text)
    want = {b: math.log1p(n) * idf[b] for b, n in plain_grams(text, f).items()}
    norm = math.sqrt(sum(v * v for v in want.values())) or 1
    assert dict(zip(at.tolist(), x.tolist())) == pytest.approx({b: v / norm for b, v in want.items()})


def test_ftrl_is_the_scalar_update():
    """Per coordinate, proximal, with elastic net, over the same order of examples."""
    r = random.Random(1)
    dims, classes, rounds = 6, 3, 4
    alpha, beta, l1, l2 = 2.0, 1.0, 0.05, 0.1
    xs = [(np.array(sorted(r.sample(range(dims), 3))), np.array([r.random() for _ in range(3)])) for _ in range(20)]
    ys = np.array([r.randrange(classes) for _ in xs])
    z, n = defaultdict(float), defaultdict(float)

    def w(d, c):
        k = z[d, c]
        return 0.0 if abs(k) <= l1 else -(k - math.copysign(l1, k)) / ((beta + math.sqrt(n[d, c])) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(rounds):
        for i in order.permutation(len(xs)):
            at, x = xs[i]
            logits = [sum(w(d, c) * v for d, v in zip(at, x)) for c in range(classes)]
            top = max(logits)
            total = sum(math.exp(v - top) for v in logits)
            new = {}
            for c in range(classes):
                g0 = math.exp(logits[c] - top) / total - (ys[i] == c)
                for d, v in zip(at, x):
                    g = g0 * v
                    sigma = (math.sqrt(n[d, c] + g * g) - math.sqrt(n[d, c])) / alpha
                    new[d, c] = (z[d, c] + g - sigma * w(d, c), n[d, c] + g * g)
            for k, (a, b) in new.items():
                z[k], n[k] = a, b
    got = langid.ftrl(xs, ys, dims, classes, alpha, beta, l1, l2, rounds, seed=5)
    assert got == pytest.approx(np.array([[w(d, c) for c in range(classes)] for d in range(dims)]))
    assert (np.abs(langid.ftrl(xs, ys, dims, classes, l1=50.0, rounds=2)) == 0).all()  # the net makes weights zero


def test_temperature_has_the_least_loss():
    r = np.random.default_rng(2)
    logits = r.normal(0, 4, (300, 4))
    ys = np.array([r.choice(4, p=langid._softmax(row / 2.5)) for row in logits])
    loss = lambda t: -np.log(langid._softmax(logits / t)[np.arange(300), ys] + 1e-12).mean()
    t = langid.calibrate(logits, ys)
    assert loss(t) <= min(loss(x) for x in np.exp(np.linspace(-3, 2.9, 400))) + 1e-6
    assert langid.calibrate(logits[:0], ys[:0]) == 1.0


def test_language_prediction_is_the_softmax_of_the_sum():
    f = langid.Features(2, 8)
    r = np.random.default_rng(3)
    model = langid.LanguageModel(f, ["x", "y", "z"], r.random(1 << 8) + 0.1, r.normal(0, 1, (1 << 8, 3)), 1.7)
    for text in ("some words", "Éa ñ", "A" * 50):
        counts = plain_grams(text, f)
        x = {b: math.log1p(n) * model.idf[b] for b, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [sum(v / norm * model.weights[b, c] for b, v in x.items()) / 1.7 for c in range(3)]
        p = [math.exp(v - max(z)) for v in z]
        lang, score = model.predict(text)
        assert lang == "xyz"[int(np.argmax(p))] and score == pytest.approx(max(p) / sum(p))
    for text in (None, "", "½ ²", "Ⅷ 12", "_", " !"):  # no letter among them
        assert model.predict(text) == ("und", 0.0)


def noisy_or_loss(bias, weights, docs, labels, positive, negative):
    total = 0.0
    for sentences, y in zip(docs, labels):
        z = [bias + sum(weights[f] for f in s) for s in sentences]
        none = sum(math.log1p(math.exp(-abs(v))) + max(v, 0.0) for v in z)
        total += positive * -math.log(max(1e-12, -math.expm1(-none))) if y else negative * none
    return total


def test_toxicity_gradient_matches_differences():
    """One step of the fit goes against the loss's gradient, taken by finite differences over every weight."""
    texts = ["bad day here. fine sun", "sun sun. fine fine day", "bad bad luck. sun", "fine luck. day sun here", "bad sun. here", "day. luck"]
    labels = [1, 0, 1, 0, 1, 0]
    model = toxicity.fit(texts, labels, rounds=1, rate=1e-3, l1=0.0, l2=0.0, least_docs=1)
    docs = [[[f for w in s.split() for f in toxicity.word_features(w)] for s in t.split(". ")] for t in texts]
    names = sorted({f for d in docs for s in d for f in s})
    n = sum(len(d) for d in docs)
    start = -math.log(max(2.0, 3 * n / sum(labels)))
    zero = dict.fromkeys(names, 0.0)
    loss = lambda b, w: noisy_or_loss(b, w, docs, labels, 0.5 / sum(labels), 0.5 / (len(labels) - sum(labels)))
    eps = 1e-5
    grad = {f: (loss(start, zero | {f: eps}) - loss(start, zero | {f: -eps})) / (2 * eps) for f in names}
    moved = {f: model.weights.get(f, 0.0) for f in names}
    for f in names:  # the first step of Adam goes by the gradient's sign
        if abs(grad[f]) > 1e-4:
            assert moved[f] * grad[f] < 0, f
    assert loss(model.bias, moved) < loss(start, zero)


def test_url_features_and_fit_match_plain_loops():
    def grams(host, path, bits):
        out = {}
        path = path.rstrip("/")
        for end in ("/index.html", ".html", ".php"):
            path = path.removesuffix(end)
        for kind, text in enumerate((f"^{host}$", f"^{path}$")):
            raw = urlfilter.re.sub(r"\d+", "0", text.lower()).encode()
            found = set()
            for i in range(len(raw)):
                h = 7 + kind
                for n in range(1, 6):
                    if i + n > len(raw):
                        break
                    h = (h * 0x01000193 + raw[i + n - 1] * 0x9E3779B1) % M
                    if n >= 3:
                        found.add(((h ^ (h >> 15)) * 0x85EBCA6B % M) >> (32 - bits))
            for b in found:
                out[kind, b] = 1 / math.sqrt(len(found))
        return out

    rows = [("http://win.example/slots/1", 1), ("http://news.example/en/22.html", 0), ("http://Bet.example/", 1), ("x", 0), ("http://a.example/b", 0)]
    for u, _ in rows:
        host, path = urlfilter.split_url(u)
        at, x = urlfilter.url_features(host, path, 12)
        assert sorted((b, round(v, 9)) for b, v in zip(at.tolist(), x.tolist())) == sorted((b, round(v, 9)) for (_, b), v in grams(host, path, 12).items())
    score = urlfilter.fit(rows, 12, rounds=5).score
    assert len({score("m.casino-win.example.com", p) for p in ("/en/4033.html", "/en/3413", "/en/1/", "/en/7/index.PHP")}) == 1
    w, b, seen, seen_b = defaultdict(float), 0.0, defaultdict(lambda: 1e-8), 1e-8
    each = [([(k[1], v) for k, v in grams(*urlfilter.split_url(u), 12).items()], y) for u, y in rows]
    for _ in range(30):
        g, gb = defaultdict(float), 0.0
        for x, y in each:
            e = (1 / (1 + math.exp(-(b + sum(w[k] * v for k, v in x)))) - y) / len(rows)
            gb += e
            for k, v in x:
                g[k] += e * v
        for k in {*g, *w}:
            d = g[k] + 0.001 * w[k] / len(rows)
            seen[k] += d * d
            w[k] -= 0.5 * d / math.sqrt(seen[k])
        seen_b += gb * gb
        b -= 0.5 * gb / math.sqrt(seen_b)
    model = urlfilter.fit(rows, 12, rounds=30)
    for u, _ in rows:
        x = grams(*urlfilter.split_url(u), 12)
        assert model.score(*urlfilter.split_url(u)) == pytest.approx(1 / (1 + math.exp(-(b + sum(w[k] * v for (_, k), v in x.items())))), abs=1e-5)
