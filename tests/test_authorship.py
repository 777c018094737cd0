import math
import random
from collections import Counter

import pytest

from quillmark.functions import words as W
from quillmark.operators import authorship, fingerprint, inference


def prose(seed, n, habits):
    r = random.Random(seed)
    words = ["lantern", "river", "door", "carried", "saw", "old", "quiet", "window", "paper", "opened", *habits * 4]
    return " ".join(" ".join([r.choice(words).capitalize(), *(r.choice(words) for _ in range(r.randrange(4, 14)))]) + r.choice([".", ".", "!", "?"]) for _ in range(n))


def segments(sents):
    out, buf, w = [], [], 0
    for s in sents:
        buf.append(s)
        w += 3 * len(s.split())
        if w >= 1000:
            out.append("".join(buf))
            buf, w = [], 0
    if buf:
        rest = "".join(buf)
        if out and len("".join(rest.split())) < 1000 // 3:
            out[-1] += rest
        else:
            out.append(rest)
    return out


def split(text):
    import re

    return [s.strip() for s in re.findall(r"[^.!?]*[.!?]", text) if s.strip()]


def lists(text):
    import re

    words = [w.lower() for w in re.findall("[A-Za-z]+(?:[-'][A-Za-z]+)*", text)]
    letters = "".join(c.lower() for c in text if c.isalpha())
    return {"function_words": [w for w in words if w in set(W.EN_FUNCTION)], "char_ngrams": [letters[i : i + 4] for i in range(len(letters) - 3)], "word_bigrams": [f"{a}|{b}" for a, b in zip(words, words[1:])], "punctuation": [c for c in text if c in set(W.EN_MARKS)]}, words


def features(text, vocab):
    import re

    ls, words = lists(text)
    out = {k: [Counter(ls[k])[t] / max(1, len(ls[k])) for t in vocab[k]] for k in vocab}
    out["word_length"] = [sum(min(len(w), 10) == b for w in words) / len(words) for b in range(1, 11)]
    n = [len(re.findall("[A-Za-z]+(?:[-'][A-Za-z]+)*", s)) for s in split(text)]
    m = sum(n) / len(n)
    out["sent_mean"], out["sent_sd"] = m, math.sqrt(sum((x - m) ** 2 for x in n) / (len(n) - 1)) if len(n) > 1 else 0.0
    c = Counter(words)
    out["ttr"], out["hapax"] = len(c) / len(words), sum(v == 1 for v in c.values()) / len(words)
    return out


def likeness(a, b):
    def cos(x, y):
        nx, ny = math.sqrt(sum(v * v for v in x)), math.sqrt(sum(v * v for v in y))
        return sum(p * q for p, q in zip(x, y)) / (nx * ny) if nx * ny else 0.0

    one = lambda x, y: 1.0 if max(abs(x), abs(y)) < 1e-12 else max(0.0, 1 - abs(x - y) / max(abs(x), abs(y)))
    s = {k: cos(a[k], b[k]) for k in ("word_length", *fingerprint.SIZES)}
    s |= {"sentence_stats": (one(a["sent_mean"], b["sent_mean"]) + one(a["sent_sd"], b["sent_sd"])) / 2, "ttr": one(a["ttr"], b["ttr"]), "hapax": one(a["hapax"], b["hapax"])}
    return sum(s[d] * W.WEIGHTS[d] for d in fingerprint.DIMENSIONS)


def test_two_authors_against_a_loop(spark):
    texts = {"A": prose(1, 120, ["the", "of", "and"]), "B": prose(2, 100, ["the", "of", "and"]), "C1": prose(3, 90, ["upon", "while", "such"]), "C2": prose(4, 80, ["because", "never"])}
    rows = [("x", r, t) for r, t in texts.items()] + [("short", "A", "Too short."), ("short", "B", "B"), ("alone", "A", texts["A"]), ("alone", "B", texts["B"]), ("alone", "C1", "  ")]
    verdicts, sims = authorship.analysed(spark.createDataFrame(rows, "case string, role string, text string"))
    vocab = {}
    for k, size in fingerprint.SIZES.items():
        c = Counter()
        for r in sorted(texts):
            c.update(lists(texts[r])[0][k])
        vocab[k] = [t for t, _ in sorted(c.items(), key=lambda x: -x[1])[:size]]
    fv = {r: [features(s, vocab) for s in segments(split(t))] for r, t in texts.items()}
    want = {}
    for ref in ("B", "C1", "C2"):
        fs = fv[ref]
        mean = {k: [sum(f[k][i] for f in fs) / len(fs) for i in range(len(fs[0][k]))] if isinstance(fs[0][k], list) else sum(f[k] for f in fs) / len(fs) for k in fs[0]}
        for no, a in enumerate(fv["A"]):
            want[ref, no] = likeness(a, mean)
    got = {(r["ref"], r["no"]): r["sim"] for r in sims.filter("case = 'x'").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    n = len(fv["A"])
    by = {ref: [want[ref, i] for i in range(n)] for ref in ("B", "C1", "C2")}
    mean, sd = {k: sum(v) / n for k, v in by.items()}, {k: math.sqrt(sum((x - sum(v) / n) ** 2 for x in v) / n) for k, v in by.items()}
    out = {r["case"]: r for r in verdicts.collect()}
    x = out["x"]
    ctrl, sd_c = (mean["C1"] + mean["C2"]) / 2, math.sqrt((sd["C1"] ** 2 + sd["C2"] ** 2) / 2)
    pooled = ((n - 1) * sd["B"] ** 2 + (2 * n - 1) * sd_c**2) / (3 * n - 2)
    assert x["error"] is None and x["n_segments"] == n and x["mean_b"] == pytest.approx(mean["B"]) and x["mean_controls"] == pytest.approx(ctrl)
    assert x["cohens_d"] == pytest.approx((mean["B"] - ctrl) / math.sqrt(pooled)) and x["p_permutation"] == max(inference.permutation(by["B"], by[c]) for c in ("C1", "C2"))
    assert "3000" in out["short"]["error"] and out["alone"]["error"] == "no control author" and out["alone"]["verdict"] is None
    s = {r["case"]: r["summary"] for r in authorship.summary(verdicts).collect()}
    assert "verdict: " in s["x"] and s["alone"] == "no control author"


def test_validation(spark):
    long = "word and word. " * 400
    rows = [("mixed", "A", "你好世界很好 hello world " * 300), ("mixed", "B", long), ("mixed", "C1", long), ("other", "A", long), ("other", "B", "你好世界。" * 500), ("other", "C1", long), ("blank", "A", long), ("blank", "B", " "), ("blank", "C1", long), ("many", "A", long), ("many", "B", long), *(("many", f"C{i}", long) for i in (1, 2, 3)), ("many", "C4", "你好。"), ("null", "A", None)]
    got = {r["case"]: r["error"] for r in authorship.validated(spark.createDataFrame(rows, "case string, role string, text string")).collect()}
    assert "mixed" in got["mixed"] and "en, zh" in got["other"] and got["blank"] == "the known author has no text" and got["many"] is None and "0 characters" in got["null"]


def test_bootstrap_ways_agree(spark):
    r = random.Random(8)
    rows = [(f"w{i}", f"w{j}", f"g{i % 2}", f"g{j % 2}", r.random()) for i in range(9) for j in range(i)]
    e = spark.createDataFrame(rows, "wa string, wb string, ga string, gb string, d double")
    a = {x["draw"]: x["d"] for x in inference.bootstrap(e, "d", 40).collect()}
    b = {x["draw"]: x["d"] for x in inference.bootstrap_joined(inference.pair_sums(e, "d"), 40, 20260818).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    works, rng = [f"w{i}" for i in range(9)], random.Random(20260818)
    got = {x["draw"]: x["d"] for x in inference.bootstrap(e, "d", 40, exact=True).collect()}
    for k in range(40):
        c = Counter(rng.choices(works, k=9))
        x = [[d for wa, wb, ga, gb, d in rows for _ in range(c[wa] * c[wb]) if (ga == gb) is same] for same in (True, False)]
        if min(map(len, x)) < 2:
            assert k not in got
            continue
        m = [sum(v) / len(v) for v in x]
        q = [sum((y - mm) ** 2 for y in v) for v, mm in zip(x, m)]
        assert got[k] == pytest.approx((m[0] - m[1]) / math.sqrt(sum(q) / (len(x[0]) + len(x[1]) - 2)))


def test_md5_of_many_at_once():
    import hashlib

    ends = [("x" * k).encode() for k in range(70)] + ["山/河".encode(), b""]
    prefixes = [b"42|7|", b"42|1234|", b"p" * 60]
    for p, got in zip(prefixes, inference.md5_heads(prefixes, ends, 16)):
        assert got.tolist() == [int(hashlib.md5(p + e).hexdigest()[:8], 16) for e in ends]


def test_permutation_by_md5_against_loop(spark):
    import hashlib

    r = random.Random(3)
    rows = [(f"河/w{i}", i % 3 == 0, round(r.random(), 2)) for i in range(20)]
    mean = lambda v: sum(v) / len(v)
    seen = mean([x for _, own, x in rows if own]) - mean([x for _, own, x in rows if not own])
    hits = 0
    for draw in range(60):
        order = [x for _, _, x in sorted((hashlib.md5(f"42|{draw}|{i}".encode()).hexdigest()[:8], i, x) for i, _, x in rows)]
        hits += round(mean(order[:7]) - mean(order[7:]), 12) >= round(seen, 12)
    df = spark.createDataFrame(rows, "id string, own boolean, x double")
    one = inference.permutation_md5(df, 60)
    assert one.first() == (hits, 60, (hits + 1) / 61)
    assert "Window" not in one._jdf.queryExecution().toString()
    assert inference.permutation_md5(df.limit(0), 5).first() == (0, 0, 1.0) and inference.permutation_md5(df.filter("own"), 5).first() == (0, 5, 1 / 6)


@pytest.mark.parametrize("exact", [False, True])
def test_bootstrap_in_blocks_against_edges(spark, monkeypatch, exact):
    from quillmark.operators import metrics, pairs

    r = random.Random(9)
    v = spark.createDataFrame([(f"g{i % 3}/w{r.randrange(12)}__chunk{i:03d}", [round(r.random(), 2) for _ in range(4)]) for i in range(40)], "label string, v array<double>").localCheckpoint()
    want = {x["draw"]: x["d"] for x in inference.bootstrap(metrics.with_groups(pairs.delta(v)), "d", 30, exact=exact).collect()}
    monkeypatch.setattr(inference, "WORKS", 2)
    got = {x["draw"]: x["d"] for x in inference.bootstrap_in_blocks(v, ["v"], pairs.mean_absolute, 30, exact=exact, block=9).collect()}
    assert want and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert inference.bootstrap_in_blocks(v.limit(0), ["v"], pairs.mean_absolute, 30, exact=exact).count() == 0
