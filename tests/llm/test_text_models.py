"""Toxicity, quality, URL filters and fingerprints."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrel.llm import imatch, quality, toxicity, urls
from spindrel.llm.common import fold
from spindrel.llm.labels import training_texts

DOCS = "doc_id long, text string, score string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(1200):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        toxic, bad = i % 6 == 0, i % 5 == 1
        if bad:
            text = [f"{w.upper()}!!" for w in text]
        if toxic:
            text.insert(rng.randrange(len(text)), "zorgo" + rng.choice(words))
        docs.append((i, " ".join(text), "own"))
        if i % 4:
            labels.append((i, int(not bad), int(toxic)))
    docs += [(1200, None, None), (1201, "", "x"), (None, "no id", "y"), (7, docs[7][1], "again")]
    return docs, [*labels, (None, 1, 1), (1201, None, None)]


def frames(spark, corpus):
    return spark.createDataFrame(corpus[0], DOCS), spark.createDataFrame(corpus[1], LABELS)


@pytest.mark.parametrize(("run", "label"), [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_held_out_labels(spark, corpus, run, label):
    docs, labels = frames(spark, corpus)
    got = run(docs, labels).join(labels, "doc_id").where(F.col(label).isNotNull()).toPandas()
    held = got[got["held_out"]]
    assert len(held) > 100 and (held["predicted"] == held[label]).mean() > 0.95
    rows = run(docs, labels).collect()
    assert len(rows) == len(corpus[0]) and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_empty_tables(spark, corpus, run):
    docs, labels = frames(spark, corpus)
    assert run(docs.limit(0), labels.limit(0)).count() == 0
    assert run(docs.limit(20), labels.limit(0)).count() == 20


def test_scores_keep_columns_and_replace_an_own_score(spark, corpus):
    docs, labels = frames(spark, corpus)
    got = toxicity.score(docs.withColumn("extra", F.lit(1)), toxicity.fit(docs, labels))
    assert got.columns == ["doc_id", "text", "extra", "score"] and dict(got.dtypes)["score"] == "double"


def test_risk_estimator_learns_from_unlabelled_rows():
    rng = np.random.default_rng(1)
    positive = np.r_[np.ones(300, bool), np.zeros(3000, bool)]
    truth = np.r_[np.ones(300, bool), rng.random(3000) < 0.2]
    x = rng.random((3300, 4)) < np.where(truth[:, None], [0.9, 0.8, 0.5, 0.5], [0.05, 0.1, 0.5, 0.5])
    w, b = toxicity.non_negative_pu(x.astype(float), positive, 0.2)
    assert (((x @ w + b) > 0) == truth)[300:].mean() > 0.93


def test_fold_is_of_the_id_as_text(spark):
    rows = spark.range(50).select("id", fold("id").alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


def test_temperature_calibrates():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)

    class Sharp(quality.Model):
        def logits(self, x):
            return 3 * x[:, 0]

    m = Sharp(np.zeros(0), np.zeros(1), np.ones(1))
    quality.calibrate(m, z[:, None], y)
    assert 2.5 < m.temperature < 3.6


def test_contexts_against_plain_loops():
    ids, breaks = np.array([1, 2, 3, 4, 9, 8]), np.array([0, 0, 0, 0, 1, 1])
    total = np.zeros(quality.SLOTS * quality.DIM)
    quality.add_contexts(total, ids, breaks)
    places, signs = quality.index_vectors()
    want = np.zeros((quality.SLOTS, quality.DIM))
    for i in range(6):
        for j in range(6):
            if i != j and abs(i - j) <= quality.REACH and breaks[i] == breaks[j]:
                for k in range(quality.NONZERO):
                    want[ids[i], places[ids[j], k]] += signs[ids[j], k]
    assert np.array_equal(total.reshape(want.shape), want)


def test_features_and_model_against_plain_counts(spark, corpus):
    docs, labels = frames(spark, corpus)
    model = toxicity.fit(docs, labels)
    folds = {i: zlib.crc32(str(i).encode()) % 5 for i, _, _ in corpus[0] if i is not None}
    toxic = {i: t for i, _, t in corpus[1] if i in folds and t is not None and folds[i]}
    positive = {t for i, t, _ in corpus[0] if toxic.get(i) == 1}
    unlabelled = {t for i, t, _ in corpus[0] if i in folds and folds[i]}
    prior = sum(toxic.values()) / len(toxic)
    assert model.prior == pytest.approx(prior)

    def counted(texts):
        n = Counter()
        for t in texts:
            stems = Counter(f for w in set(re.findall(r"[^\W_]+", (t or "").lower())) for f in toxicity.stems(w))
            n.update(f + k for f, c in stems.items() for k in range(min(c, 3)))
        return n

    a, b, n_p, n_u = counted(positive), counted(unlabelled), len(positive), len(unlabelled)
    chosen = set()
    for f, count in a.items():
        p, u = count / n_p, b[f] / n_u
        rest = max((u - prior * p) / (1 - prior), 0.5 / n_u)
        error = math.sqrt(p * (1 - p) / n_p + max(u, 1 / n_u) / n_u)
        if count >= toxicity.LEAST_TEXTS and p >= toxicity.LEAST_LIFT * rest and p - rest >= toxicity.LEAST_Z * error:
            chosen.add(f)
    assert set(model.weights) == chosen and chosen
    text = next(iter(positive))
    stems = Counter(f for w in set(re.findall(r"[^\W_]+", text.lower())) for f in toxicity.stems(w))
    z = model.bias + sum(model.weights.get(f + k, 0) for f, c in stems.items() for k in range(min(c, 3)))
    assert model.score(text) == pytest.approx(1 / (1 + math.exp(-z)))


def test_first_step_follows_the_numeric_gradient_of_the_risk():
    rng = np.random.default_rng(5)
    x, positive, prior = rng.normal(size=(60, 3)), np.arange(60) < 20, 0.3
    loss = lambda z: 1 / (1 + np.exp(z))

    def risk(v):
        g = x @ v[:3] + v[3]
        return prior * loss(g[positive]).mean() + max(0, loss(-g[~positive]).mean() - prior * loss(-g[positive]).mean())

    w, b = toxicity.non_negative_pu(x, positive, prior, epochs=1, rate=0.01, l2=0)
    step = np.r_[w, b]
    slope = np.array([(risk(e) - risk(-e)) / 2e-6 for e in np.eye(4) * 1e-6])
    assert np.array_equal(np.sign(step), -np.sign(slope)) and np.allclose(np.abs(step), 0.01, rtol=1e-3)  # Adam's first step


def test_conflicting_labels_and_copies_have_one_meaning(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}", 1) for i in range(40)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, v) for i in range(40) for v in (1, i % 2)], "doc_id long, toxic int")
    got = {(r["doc_id"], r["text"], r["label"]) for r in training_texts(docs, labels, "toxic", 100).collect()}
    folds = {i: zlib.crc32(str(i).encode()) % 5 for i in range(40)}
    want = {}
    for i in range(40):
        if folds[i]:
            want.setdefault((f"text {i % 7}", i % 2), i)
    assert got == {(i, t, v) for (t, v), i in want.items()}


def test_pooled_features_against_loops():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(quality.SLOTS, quality.DIM)).astype(np.float32)
    ids = np.array([5, 9, 9, 5, 7, 5, 5])
    got = quality.pooled(vectors, ids)
    each = vectors[ids].astype(float)
    kinds = vectors[[5, 7, 9]].astype(float)
    mean = each.mean(axis=0)
    want = [*mean, *kinds.mean(axis=0), *np.sqrt(((each - mean) ** 2).mean(axis=0)), math.log(8), 3 / 7, 4 / 7, 2 / 6, 1 / 5, np.linalg.norm(mean)]
    assert got == pytest.approx(want, rel=1e-4, abs=1e-5)
    assert not quality.pooled(vectors, ids[:0]).any()


def test_network_follows_the_numeric_gradient():
    rng = np.random.default_rng(6)
    x, d = rng.normal(size=(50, 5)), 5
    y = (x[:, 0] > 0).astype(float)
    made = []
    for epochs in (0, 1):
        m = quality.Model(np.zeros(0), np.zeros(d), np.ones(d))
        quality.train(m, x, y, epochs=epochs, batch=64, rate=1e-3, l2=0)
        made.append(m)
    before, after = made

    def loss(layers):
        m = quality.Model(np.zeros(0), np.zeros(d), np.ones(d), layers)
        p = 1 / (1 + np.exp(-m.logits(x)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k, layer in enumerate(before.layers):
        for at in list(np.ndindex(layer.shape))[:20]:
            slopes = []
            for e in (1e-6, -1e-6):
                layers = [q.copy() for q in before.layers]
                layers[k][at] += e
                slopes.append(loss(layers))
            slope = (slopes[0] - slopes[1]) / 2e-6
            if abs(slope) > 1e-6:
                assert np.sign(after.layers[k][at] - layer[at]) == -np.sign(slope)


def test_quality_query_against_plain_loops(spark, corpus):
    docs, labels = frames(spark, corpus)
    model = quality.fit(docs, labels)
    total = np.zeros(quality.SLOTS * quality.DIM)
    for _, t, _ in corpus[0]:
        ids = quality._slots.of(t)
        if len(ids):
            quality.add_contexts(total, ids, np.zeros(len(ids), int))
    total = total.reshape(quality.SLOTS, quality.DIM)
    total -= total.mean(axis=0) * (np.abs(total).sum(axis=1, keepdims=True) > 0)
    assert model.vectors == pytest.approx(total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-300), abs=1e-5)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    w1, b1, w2, b2 = model.layers
    for i, t, _ in corpus[0][:40]:
        x = (quality.pooled(model.vectors, quality._slots.of(t)) - model.mean) / model.scale
        z = sum(math.tanh(x @ w1[:, j] + b1[j]) * w2[j] for j in range(len(w2))) + b2[0]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z / model.temperature)))


@pytest.mark.parametrize("kind", [toxicity, quality])
def test_odd_names_and_very_long_texts(spark, corpus, kind):
    docs, labels = frames(spark, corpus)
    model = kind.fit(docs, labels)
    odd = spark.createDataFrame([(1, "word " * 200_000, 2, 3), (1, None, 2, 3)], "doc_id long, text string, `a.b` int, `x y` int")
    got = kind.score(odd, model)
    assert got.columns == ["doc_id", "text", "a.b", "x y", "score"] and all(0 <= r["score"] <= 1 for r in got.collect())


def test_sums_meet_in_bounded_groups(spark, corpus, monkeypatch):
    docs = frames(spark, corpus)[0]
    want = quality.word_vectors(docs)
    monkeypatch.setattr(quality, "FAN_IN", 2)
    assert quality.word_vectors(docs.repartition(9)) == pytest.approx(want, abs=1e-5)


# URL filters


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    ends = [i for i, c in enumerate(rest) if c in "/?#"]
    host, tail = (rest[: ends[0]], rest[ends[0] :]) if ends else (rest, "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([i for i, c in enumerate(tail) if c in "?#"], default=len(tail))]
    fits = []
    for verdict, rule in urls.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return host, path, max(fits)[1:] if fits else None


URLS = [None, "", "no scheme", "http://", "http://a.com", "http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "http://x.www.example.com/en/1", "ftp://b.net/es/1", "b://net/fr/", "q://xnet/fr/", "http://n.net/en/?://", "http://h#a/b", "http://h?a/b", "a://b://c.com/"]


def test_rules_against_a_plain_version(spark):
    pages = spark.createDataFrame([(i, u, "<title>plain words</title>" if i % 2 else None, 1) for i, u in enumerate(URLS)], "page_id long, url string, html string, score int")
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule = brute_rule(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert (got[i]["rule"], got[i]["verdict"]) == rule if rule else got[i]["rule"] is None and got[i]["verdict"] in ("allow", "block")
    assert urls.judge(pages.limit(0)).count() == 0


def plain_verdicts(rows):
    """Scores of the URLs without a rule, by loops: words of all pages, Viterbi, naive Bayes over places."""
    import regex

    runs = lambda t: regex.findall(r"\p{L}+", t.lower())
    words = Counter(w for _, _, h in rows for w in runs(re.sub(r"<[^>]*>", " ", h or "")))

    def tokens(text, mark):
        out = []
        for name in runs(text):
            found = [(i, j - i, words[name[i:j]]) for i in range(len(name)) for j in range(i + 1, len(name) + 1) if name[i:j] in words]
            out += [mark + w for w in urls.segment(name, found, sum(words.values()))]
        return out

    places = {brute_rule(u)[:2]: brute_rule(u)[2] for _, u, _ in rows}
    of = {p: tokens(p[0], "") + tokens(p[1], "/") for p in places}
    learnt = [p for p, r in places.items() if r and zlib.crc32("".join(p).encode()) % 5]
    counts = {v: Counter(t for p in learnt if places[p][1] == v for t in of[p]) for v in ("allow", "block")}
    n = {v: sum(places[p][1] == v for p in learnt) for v in counts}
    seen = set(counts["allow"]) | set(counts["block"])
    total = {v: sum(c.values()) + len(seen) + 1 for v, c in counts.items()}
    out = {}
    for p, rule in places.items():
        if not rule:
            p_of = [math.log(n[v] + 1) + sum(math.log((counts[v][t] + 1) / total[v]) for t in of[p] if t in seen) for v in ("allow", "block")]
            out[p] = 1 / (1 + math.exp(p_of[0] - p_of[1]))
    return out, places


def url_rows():
    rng = random.Random(9)
    plain, odd = ["garden", "river", "stone", "music", "paper"], ["cheap", "pills", "casino", "bonus"]
    html = f"<title>{' '.join(plain + odd)}</title><script>var xyzzy</script><p class='plugh'>the {' '.join(plain)}</p>"
    rows = []
    for i in range(400):
        bad = rng.random() < 0.3
        name = "".join(rng.sample(odd if bad else plain, 2))
        end, path = rng.choice([("net", "/es/"), ("net", "/fr/")] if bad else [("com", "/de/"), ("com", "/")]) if rng.random() < 0.7 else ("org", "/de/")
        rows.append((i, f"https://{rng.choice(['', 'www.', 'm.'])}{name}.{end}{path}{i % 150}?q={i}", html if i % 3 else None))
    return rows


def test_naive_bayes_over_segments_against_plain_loops(spark):
    rows = url_rows() + [(500, None, None), (501, "http://cheapgarden.org/", ""), (501, "http://cheapgarden.org/", ""), (None, f"http://{'pillsriver' * 300}.org/x", None), (502, "http://n.net/es/", None)]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, host string, z int")
    got = urls.judge(pages.repartition(3)).collect()
    want, places = plain_verdicts(rows)
    assert sorted((r["page_id"] or -1) for r in got) == sorted((r[0] or -1) for r in rows)
    for r in got:
        place = r["host"], r["path"]
        if places[place]:
            assert (r["rule"], r["verdict"], r["score"]) == (*places[place], None)
        else:
            assert r["score"] == pytest.approx(want[place]) and r["verdict"] == ("block" if want[place] > 0.5 else "allow")


def test_names_never_seen_are_judged_by_their_words(spark):
    rows = [*url_rows(), (900, "http://bonuscasinopills.org/de/1", None), (901, "http://musicriverstone.org/de/1", None)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[900]["verdict"] == "block" and got[901]["verdict"] == "allow"
    odd = [r for r in got.values() if r["rule"] is None and r["page_id"] < 900]
    assert odd and all((r["verdict"] == "block") == any(w in r["host"] for w in ("cheap", "pills", "casino", "bonus")) for r in odd)


def test_viterbi_against_all_splits():
    words, total = {"cheap": 5, "pills": 3, "che": 4, "a": 9, "ap": 2, "app": 3, "ills": 1}, 27

    def splits(s):
        return [[s[:i], *rest] for i in range(1, len(s) + 1) for rest in (splits(s[i:]) if s[i:] else [[]])]

    def cost(split):
        return sum(math.log(total + 1) + (-math.log(words[w]) if w in words else len(w) * math.log(10)) for w in split)

    for name in ("cheappills", "apx", "aapills", ""):
        found = [(i, j - i, words[name[i:j]]) for i in range(len(name)) for j in range(i + 1, len(name) + 1) if name[i:j] in words]
        got = urls.segment(name, found, total)
        assert "".join(got) == name and cost(got) == pytest.approx(min(map(cost, splits(name))) if name else 0)


# Fingerprints


MASK = (1 << 64) - 1


def plain_mix(x, salt=0):
    x = (x + salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & MASK
    return x ^ x >> 31


def plain_terms(text):
    """Term to hash, by loops."""
    out = {}
    for w in re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower()):
        codes = w.encode()
        total = sum(plain_mix(c, 21) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(codes)) & MASK
        out[w] = plain_mix(total ^ plain_mix(len(codes), 3))
    return out


def plain_lexicon(texts, least=3, most=0.5):
    different = set(t or "" for t in texts)
    df = Counter(w for t in different for w in plain_terms(t))
    return {w for w, n in df.items() if least <= n <= max(least, int(most * len(different)))}


def plain_fingerprint(text, lexicon):
    hashes = sorted(h for w, h in plain_terms(text).items() if w in lexicon)
    out = ""
    for k in range(7):
        for s in range(16):
            limit = min(int((4.0**-k if k else 1 - s / 32) * 2**64), MASK)
            some = [h for h in hashes if plain_mix(h ^ plain_mix(s, 5)) <= limit]
            total = sum(plain_mix((h + i * 0x9E3779B97F4A7C15) & MASK) for i, h in enumerate(some)) & MASK
            out += f"{plain_mix(total ^ len(some)) % 65535 + 1 if some else 0:04x}"
    return out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    rows = [[(a[4 * (16 * k + s) :][:4], b[4 * (16 * k + s) :][:4]) for s in range(16)] for k in range(7)]
    seen = [sum(p != ("0000", "0000") for p in r) for r in rows]
    same = [sum(x == y != "0000" for x, y in r) for r in rows]
    return max([sum(same) / max(1, sum(seen)), *(m / n for m, n in zip(same, seen, strict=True) if n >= 4)])


def test_fingerprints_against_plain_loops(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Alpha", "beta,", "gamma", "del-ta", f"w{i % 9}", f"É{i % 5}", "😀x", f"own{i}"]) for _ in range(rng.randint(0, 60))) for i in range(60)]
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, texts[0]), (503, texts[0]), (504, "?! --"), (505, "never seen"), (506, "x" * 3000 + " gamma")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = {r["doc_id"]: r for r in imatch.compare_with_next(docs).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(order)
    words = plain_lexicon([t for _, t in rows])
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        mine, other, following = (plain_fingerprint(x, words) for x in (t, e, n))
        want = (len(t), hashlib.sha256(e.encode()).hexdigest(), mine, other, plain_likeness(mine, other), plain_likeness(mine, following))
        assert tuple(got[i])[1:] == want
    assert got[502]["near_next"] == 1.0
    assert imatch.compare_with_next(docs.limit(0)).count() == 0
    alone = imatch.compare_with_next(docs.where("doc_id = 3")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_repeated_and_missing_ids(spark):
    rows = [(None, "a b c d"), (None, "e f g h"), (7, "a b c e"), (7, "a b c e"), (8, None)] * 3
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int")
    got = imatch.compare_with_next(docs).collect()
    assert Counter(r["doc_id"] for r in got) == {None: 6, 7: 6, 8: 3}
    assert Counter(r["n_chars"] for r in got) == {7: 12, 0: 3}


def test_all_terms_of_the_band_take_part(spark):
    rows = [(i, " ".join(f"k{1000 * (i // 3) + j}" for j in range(1000)) + f" d{i}") for i in range(210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = plain_lexicon([t for _, t in rows])
    assert len(words) == 70_000
    got = {r["doc_id"]: r for r in imatch.compare_with_next(docs).collect()}
    assert len(got) == 210 and all(got[i]["fingerprint"] == plain_fingerprint(t, words) for i, t in rows[::30])


def test_copies_count_once_and_an_edit_is_like_its_text(spark):
    rng = random.Random(11)
    hot = " ".join(f"hot{i}" for i in range(200))
    texts = [hot if i % 2 else " ".join(f"t{rng.randrange(400)}" for _ in range(200)) for i in range(200)]
    texts += [f"{hot} end{i}" for i in range(2)]
    got = {r["doc_id"]: r for r in imatch.compare_with_next(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    words = plain_lexicon(texts)
    assert "hot1" in words and all(got[i]["fingerprint"] == plain_fingerprint(t, words) for i, t in list(enumerate(texts))[::20])
    assert min(got[i]["near_edited"] for i in range(1, 199, 2)) > 0.1


def test_very_long_texts_and_pieces(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(f"t{rng.randrange(10**4)}" for _ in range(3000)), "z" * 5000, "", "a b", " ".join(["y" * 400] * 9)]
    want = [sorted(plain_terms(t).values()) for t in texts]
    assert [t.tolist() for t in imatch.terms_of(texts)] == want
    monkeypatch.setattr(imatch, "CHUNK", 1000)
    assert [t.tolist() for t in imatch.terms_of(texts)] == want


def test_seams_are_the_new_chunks_of_an_edit():
    rng = random.Random(8)
    for _ in range(2000):
        a, b = ("".join(rng.choice("ab \té") for _ in range(rng.randint(0, 9))) for _ in range(2))
        old = {*a.encode().split(), *b.encode().split()}
        assert {*imatch.edited(a, b).encode().split()} - old <= {*imatch.seams(a, b)}


def test_likeness_follows_common_terms():
    rng = random.Random(1)
    words = [f"word{i}" for i in range(2000)]
    base = rng.sample(words, 300)
    of = lambda ws: imatch.fingerprints(imatch.terms_of([" ".join(ws)]))[0]
    near, half, far = base[:290] + words[:10], base[:150] + rng.sample(words, 150), [f"x{i}" for i in range(300)]
    a, b, c = (imatch.likeness(of(base), of(x)) for x in (near, half, far))
    assert a > b > c == 0 and of(base) == of(base[::-1] + base)
