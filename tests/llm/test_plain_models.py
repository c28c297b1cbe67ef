"""Learned scores and statistical tests against plain Python that works on strings and single numbers."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import licenses, lm, quality, secrets, toxicity

VOCABULARY = "good bad ugly, Fine. THE the a's x9 don't (well) won-der é12 -- 'quoted' end! long-word-here another antelope antenna".split()


def _texts(seed, n, most=30):
    rng = random.Random(seed)
    return {i: rng.choice((" ", "  ", "\n")).join(rng.choices(VOCABULARY, k=rng.randrange(0, most))) for i in range(n)} | {n: None, n + 1: "", n + 2: "one"}


# --- op7 -----------------------------------------------------------------------------------------------------


def _toxic_features(text):
    """The set of a text's features, as strings."""
    words = []
    for w in re.split(rb"[ \t\n\x0b\x0c\r]+", (text or "").encode()):
        w = re.sub(rb"^[^0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+$", b"", w.lower())
        if w:
            words.append(w)
    out = {("w", w) for w in words} | {("s", n, w[:n]) for w in words for n in toxicity.STEMS if len(w) > n}
    return out | {("p", a, b) for a, b in zip(words, words[1:])} | {("k", a, b) for a, b in zip(words, words[2:])}


def _plain_ftrl(sample, alpha=toxicity.ALPHA, beta=toxicity.BETA, l1=toxicity.L1, l2=toxicity.L2):
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(f):
        bound = 0 if f == "bias" else l1
        return 0.0 if abs(z[f]) <= bound else -(z[f] - math.copysign(bound, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    for _ in range(toxicity.EPOCHS):
        for features, label in sample:
            w = {f: weight(f) for f in [*features, "bias"]}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - label
            for f in w:
                sigma = (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha
                z[f] += g - sigma * w[f]
                n[f] += g * g
    return weight


def test_toxicity_against_plain_ftrl(spark):
    """Scores of all rows as an FTRL over sets of strings gives them, learned from the same rows in the same order."""
    texts = _texts(1, 120)
    labels = {i: int("bad" in (t or "") or i % 11 == 0) for i, t in texts.items() if i % 5}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    known = spark.createDataFrame(list(labels.items()), "doc_id bigint, toxic int")
    held = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.held_out().alias("h")).collect()}
    order = {r.doc_id: r.o for r in docs.select("doc_id", toxicity.id_hash("toxicity", "doc_id").alias("o")).collect()}
    sample = [(_toxic_features(texts[i]), labels[i]) for i in sorted(labels, key=order.get) if not held[i] and texts[i] is not None]
    weight = _plain_ftrl(sample)
    rows = toxicity.score(docs, known).collect()
    assert len(rows) == len(texts) and {r.held_out for r in rows} == {True, False}
    for r in rows:
        want = 1 / (1 + math.exp(-(sum(map(weight, _toxic_features(texts[r.doc_id]))) + weight("bias"))))
        assert abs(r.score - want) < 2e-6 and r.predicted == int(r.score >= toxicity.THRESHOLD) and r.held_out == held[r.doc_id]
    assert len({r.score for r in rows}) > 20


# --- op2 -----------------------------------------------------------------------------------------------------


def _quality_features(text):
    """(feature, share) of a text, as strings, a feature once for each of its places."""
    words = [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", (text or "").encode()) if w]
    kind = lambda b: "l" if 97 <= b <= 122 else "u" if 65 <= b <= 90 else "d" if 48 <= b <= 57 else "x" if b >= 128 else chr(b)
    out, before, last = [], None, None
    for w in words:
        shape = "".join(k for i, k in enumerate(map(kind, w)) if i == 0 or k != kind(w[i - 1]))
        low = w.lower() if w.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in w)
        out += [("w", low), ("s", shape), ("m", kind(w[-1]), kind(w[-2]) if len(w) > 1 else None), ("r", low == last), ("b", shape, before)]
        before, last = shape, low
    return [(f, 1 / len(words)) for f in out]


def test_quality_against_a_plain_fit(spark):
    """Four grades: probabilities as a cumulative-link fit over a dense matrix of string features gives them."""
    texts = _texts(2, 90, 20)
    grades = {i: min(3, sum(map((t or "").count, ("good", "bad", "ugly")))) for i, t in texts.items() if i % 6}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    known = spark.createDataFrame(list(grades.items()), "doc_id bigint, quality int")
    rated = [i for i in grades if texts[i] is not None]
    names = {f: k for k, f in enumerate({f for i in texts for f, _ in _quality_features(texts[i])})}
    x = np.zeros((len(texts), len(names)))
    at = {i: k for k, i in enumerate(texts)}
    for i, t in texts.items():
        for f, share in _quality_features(t):
            x[at[i], names[f]] += share
    y, levels = np.array([grades[i] for i in rated]), sorted({grades[i] for i in rated})
    assert levels == [0, 1, 2, 3]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def thresholds(p):
        return np.cumsum([p[0], *np.exp(p[1:])])

    def loss(w, p, rows, y):
        edges = np.concatenate([[-np.inf], thresholds(p), [np.inf]])
        latent = rows @ w
        return -np.mean(np.log(np.maximum(sigmoid(edges[y + 1] - latent) - sigmoid(edges[y] - latent), 1e-9)))

    rows = x[[at[i] for i in rated]]
    steps = 25
    w, p = np.zeros(len(names)), np.array([-1.0, 0.0, 0.0])
    m, v = np.zeros(len(w) + 3), np.zeros(len(w) + 3)
    for step in range(1, steps + 1):
        edges = np.concatenate([[-np.inf], thresholds(p), [np.inf]])
        latent = rows @ w
        lo, hi = sigmoid(edges[y] - latent), sigmoid(edges[y + 1] - latent)
        slope = (hi * (1 - hi) - lo * (1 - lo)) / (hi - lo) / len(y)
        numeric = [(loss(w, p + e, rows, y) - loss(w, p - e, rows, y)) / 2e-6 for e in np.eye(3) * 1e-6]
        g = np.concatenate([rows.T @ slope + quality.L2 * w, numeric])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = quality.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, p = w - move[: len(w)], p - 0.1 * move[len(w) :]
    model = quality.Model(docs, known, bits=20, steps=steps)
    assert np.allclose(model.thresholds, thresholds(p), atol=1e-2)  # shares travel as float32, and Adam magnifies small gradients
    got = {r.doc_id: r for r in model.score(docs, wanted=2).collect()}
    for i in texts:
        latent = x[at[i]] @ w
        below = sigmoid(thresholds(p) - latent)
        assert abs(got[i].tail_probability - (1 - below[1])) < 1e-2 and abs(got[i].expected_grade - (3 - below.sum())) < 2e-2


# --- op5 -----------------------------------------------------------------------------------------------------


def _plain_backoff(texts, order, alpha):
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for t in texts]
    own = [collections.Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in words]
    every, total = sum(own, collections.Counter()), sum(map(len, words))
    def score(w, i, counts, n_all):
        """(log score, order) of the word at i."""
        most = min(i + 1, order)
        for n in range(most, 0, -1):
            g = tuple(w[i - n + 1 : i + 1])
            if counts(g) > 0:
                return math.log(counts(g) / (counts(g[:-1]) if n > 1 else n_all)) + (most - n) * math.log(alpha), n
        return -math.log(n_all + 1) + most * math.log(alpha), 0

    for w, mine in zip(words, own, strict=True):
        plain = [score(w, i, every.__getitem__, total)[0] for i in range(len(w))]
        other = [score(w, i, lambda g, mine=mine: every[g] - mine[g], total - len(w)) for i in range(len(w))]
        yield len(w), sum(plain), sum(s for s, _ in other), sum(n == order for _, n in other)


@pytest.mark.parametrize(("order", "fan"), [(3, 15), (2, 15), (3, 1), (4, 2)])
def test_backoff_against_plain_counts(spark, monkeypatch, order, fan):
    """One way of cutting chunks and the two-step one give what counting tuples gives; ids may be strings."""
    monkeypatch.setattr(lm, "FAN_BITS", fan)
    texts = list(_texts(3, 60, 80).values()) * 2 + ["alone with words nobody has said"]
    rng = random.Random(9)
    texts += [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(60))) for _ in range(80)]
    docs = spark.createDataFrame([(f"id{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = {r.doc_id: r for r in lm.score(docs, order=order, chunk_bytes=700).collect()}
    assert len(got) == len(texts)
    for i, (n, plain, other, elsewhere) in enumerate(_plain_backoff(texts, order, lm.ALPHA)):
        r = got[f"id{i}"]
        assert (r.n_words, r.n_elsewhere) == (n, elsewhere) and abs(r.log_score - plain) < 1e-3
        assert r.mean_log_score_elsewhere is None if n == 0 else abs(r.mean_log_score_elsewhere - other / n) < 1e-5
        assert r.n_full == max(0, n - order + 1) and (r.share_elsewhere is None) == (n < order)


# --- op8 -----------------------------------------------------------------------------------------------------

ALPHABETS = {
    "hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "url64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}


def _encoding(run):
    if not (re.search("[0-9]", run) and re.search("[A-Za-z]", run)):
        return None
    for name, pattern in (("hex", "[0-9a-f]+|[0-9A-F]+"), ("base32", "[A-Z2-7]+"), ("base62", "[A-Za-z0-9]+"), ("base64", "[A-Za-z0-9+/]+"), ("url64", "[A-Za-z0-9_-]+")):
        if re.fullmatch(pattern, run):
            return name
    return None


def _p_value(run, name):
    """Fisher's combination of three tests, each by its textbook formula."""
    alphabet = ALPHABETS[name]
    v = [alphabet.index(c) for c in (run.lower() if name == "hex" else run)]
    n, k, tail = len(v), len(alphabet), lambda z: 0.5 * math.erfc(min(z, 20) / math.sqrt(2))
    chi = sum((v.count(x) - n / k) ** 2 / (n / k) for x in range(k))
    cube = (max(chi, 0) / (k - 1)) ** (1 / 3)  # Wilson and Hilferty's normal form of chi-squared
    z1 = (cube - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    high = [x >= k / 2 for x in v]
    up = sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    if up in (0, n):
        z2 = 9.0
    else:
        both = 2 * up * (n - up)
        z2 = abs(runs - 1 - both / n) / math.sqrt(max(1e-9, both * (both - n) / (n * n * (n - 1))))
    mean = sum(v) / n
    z3 = math.sqrt(n) * abs(sum((a - mean) * (b - mean) for a, b in zip(v, v[1:]))) / max(1e-9, sum((a - mean) ** 2 for a in v))
    h = sum(-math.log(max(1e-100, p)) for p in (tail(z1), 2 * tail(z2), 2 * tail(z3)))
    return h - math.log(1 + h + h * h / 2)  # -ln of P(chi-squared with 6 degrees > 2 h)


def test_randomness_battery_against_plain_statistics(spark):
    """Every run's bin, the Benjamini-Hochberg cuts, and so the random spans."""
    rng = random.Random(12)
    words = "version number release alpha build the system of many parts and numbers".split()
    runs = []
    for name, alphabet in ALPHABETS.items():
        for _ in range(60):
            size = rng.randrange(20, 90)
            runs += ["".join(rng.choices(alphabet, k=size)), (rng.choice(words) + rng.choice("0123456789") + rng.choice(words)).ljust(size, rng.choice("a1Z"))[:size]]
        runs += ["".join(rng.choices(alphabet[: len(alphabet) // 2], k=30)) + "1a" for _ in range(10)]
    runs = [r for r in runs if len(r) >= 20 and not re.search("[0-9a-f]{16,}|AKIA", r)]
    docs = spark.createDataFrame([(i, f"é see {r} there") for i, r in enumerate(runs)], "doc_id bigint, text string")
    found = {r.doc_id: r.random for r in secrets.find(docs, "doc_id").collect()}
    strata, off = collections.defaultdict(list), 0
    for i, run in enumerate(runs):
        name = _encoding(run)
        if re.search("[+/]", run) and re.search("[_-]", run):
            continue
        assert len(found[i]) == (name is not None)
        if name:
            stratum, value = f"{name}:{sum(len(run) >= b for b in secrets.BANDS)}", _p_value(run, name)
            want = min(secrets.BINS, int(max(0.0, value) / secrets.BIN))
            got = found[i][0]
            assert (got.start, got.end, got.stratum) == (6, 6 + len(run), stratum) and abs(got.bin - want) <= 1
            off += got.bin != want
            strata[stratum].append((i, got.bin))
    assert sum(map(len, strata.values())) > 400 and off <= 3
    stands = set()
    for rows in strata.values():
        cut = secrets.BINS + 1
        for b in sorted({b for _, b in rows}):  # the least bin whose largest p-value the rule rejects
            if math.exp(-b * secrets.BIN) <= secrets.LEVEL * sum(x >= b for _, x in rows) / len(rows):
                cut = b
                break
        stands |= {i for i, b in rows if b < cut}
    got = {r.doc_id for r in secrets.scan(docs).where("n_random > 0").collect()}
    assert got == stands and 0 < len(stands) < len(runs)


# --- op10 ----------------------------------------------------------------------------------------------------


def test_many_long_templates(spark):
    """Hundreds of templates of up to 300 words, some sharing most of theirs, against plain windows."""
    rng = random.Random(6)
    common = [f"c{i}" for i in range(60)]
    templates = [(f"t{k:03d}", " ".join(rng.choices(common, k=rng.randrange(3, 200)) + [f"r{k}x{j}" for j in range(rng.randrange(1, 100))])) for k in range(150)]
    templates += [(f"u{k:03d}", templates[k][1] + f" more{k}") for k in range(50)]
    texts = []
    for i in range(60):
        words = templates[rng.randrange(len(templates))][1].split()
        words = [w for w in words if rng.random() > rng.choice((0, 0.05, 0.2))]
        texts.append((i, " ".join(rng.choices(common, k=rng.randrange(300)) + words + rng.choices(common + ["pad"], k=rng.randrange(300)))))
    texts += [(100, ""), (101, None), (102, " ".join(common))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan(docs, tuple(templates)).collect()}
    hit = 0
    for i, text in texts:
        words, fits = re.findall("[0-9a-z]+", (text or "").lower()), {}
        for label, t in templates:
            known, length = set(t.split()), licenses.block_size(len(t.split()))
            if len(known & set(words)) >= licenses.needed(len(known)):
                best = max(len(known & set(words[k : k + length])) for k in range(len(words)) if words[k] in known)
                if best >= licenses.needed(len(known)):
                    fits[label] = best / len(known)
        hit += len(fits)
        assert got[i].labels == ",".join(sorted(fits)) and got[i].score == round(max(fits.values(), default=0.0), 6)
    assert hit > 40
    again = {r.doc_id: r for r in licenses.scan(docs.withColumn("text", F.upper("text")), tuple(templates)).collect()}
    assert {i: r.labels for i, r in got.items()} == {i: r.labels for i, r in again.items()}
    assert licenses.scan(docs, ()).where("labels <> '' OR score > 0").count() == 0
