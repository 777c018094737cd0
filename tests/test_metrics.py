import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import clustering, fingerprint, frequencies, inference, metrics, pairs, sensitivity
from quillmark.sources import files, sinks


def corpus(spark, texts):
    return spark.createDataFrame(list(texts.items()), "label string, text string")


def test_frequencies(spark):
    w = frequencies.counted(frequencies.exploded(corpus(spark, {"a": "the cat the dog the bird", "b": "the dog dog dog fish"})))
    top = frequencies.most_frequent(w, 3)
    assert [r["word"] for r in top.collect()] == ["dog", "the", "bird"]
    f = {(r["label"], r["word"]): r["f"] for r in frequencies.relative(w, top).collect()}
    assert f[("a", "dog")] == pytest.approx(1 / 6) and f[("b", "bird")] == 0


def test_constant_words_drop(spark):
    w = frequencies.counted(frequencies.exploded(corpus(spark, {"a": "flat flat cat dog bird fish", "b": "flat flat dog dog bird fish"})))
    f = frequencies.relative(w, frequencies.most_frequent(w, 10))
    assert {r["word"] for r in frequencies.constant_words(f).collect()} == {"flat", "bird", "fish"}
    assert {r["word"] for r in frequencies.z_scores(f).collect()} == {"cat", "dog"}


def test_delta_against_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(f"g/w{i:02d}", [float(x) for x in rng.normal(size=5)]) for i in range(13)]
    df = spark.createDataFrame(rows, "label string, v array<double>")
    got = {(r["la"], r["lb"]): r["d"] for r in pairs.block_pairs(df, "label", ["v"], pairs.mean_absolute, ["d"], block=4).collect()}
    want = {(a, b): float(np.mean(np.abs(np.array(x) - y))) for i, (a, x) in enumerate(rows) for b, y in rows[i + 1 :]}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_folds_against_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(f"g{i % 3}/w{i // 3}", [float(x) for x in rng.integers(0, 3, size=4)]) for i in range(20)]
    df = spark.createDataFrame(rows, "label string, v array<double>")
    e = pairs.block_pairs(df, "label", ["v"], pairs.mean_absolute, ["d"], block=6)
    near = {(r["label"], r["nn_label"], round(r["d"], 9)) for r in pairs.nearest_in_blocks(df, "label", ["v"], pairs.mean_absolute, block=6).collect()}
    assert near == {(r["label"], r["nn_label"], round(r["d"], 9)) for r in metrics.nearest(e).collect()}
    for other in (False, True):
        a = metrics.effect_of_moments(pairs.moments_in_blocks(df, "label", ["v"], pairs.mean_absolute, other, block=6)).first()
        b = metrics.group_effect(metrics.with_groups(e).filter("wa <> wb or not " + str(other).lower()).select("la", "lb", "d"), "d").first()
        assert all(a[c] == pytest.approx(b[c]) for c in ("mean_same", "mean_cross", "n_same", "n_cross", "cohens_d"))


def edges(spark, d):
    return spark.createDataFrame([(a, b, x) for (a, b), x in d.items()], "la string, lb string, d double")


def test_neighbours_and_ties(spark):
    e = edges(spark, {("A/w1", "A/w2"): 0.1, ("B/w1", "B/w2"): 0.1, **{(a, b): 0.9 for a in ("A/w1", "A/w2") for b in ("B/w1", "B/w2")}})
    acc = metrics.accuracy(metrics.predictions(metrics.nearest(e))).collect()
    assert {(r["true_group"], r["hits"], r["total"]) for r in acc} == {("A", 2, 2), ("B", 2, 2)} and acc[0]["accuracy"] == 1 and acc[0]["baseline"] == 0.5
    same = edges(spark, {("a/x", "b/x"): 0.5, ("a/x", "c/x"): 0.5, ("b/x", "c/x"): 0.5})
    assert {r["label"]: r["nn_label"] for r in metrics.nearest(same).collect()} == {"a/x": "b/x", "b/x": "a/x", "c/x": "a/x"}


def test_sign_test(spark):
    df = spark.createDataFrame([(0, 10), (1, 10), (5, 10), (0, 0)], "k long, n long").select(metrics.sign_test(F.col("k"), F.col("n")))
    assert [r[0] for r in df.collect()] == pytest.approx([2 / 1024, 22 / 1024, 1, 1])


def test_competition_and_orphans(spark):
    e = edges(spark, {("A/w1", "B/w1"): 0.2, ("A/w1", "A/w2"): 0.8, ("B/w1", "B/w3"): 0.8, ("A/w2", "B/w1"): 0.9, ("A/w1", "B/w3"): 0.9, ("A/w2", "B/w3"): 0.9})
    r = metrics.competition(e).collect()
    assert len(r) == 1 and r[0]["winner"] == "original" and r[0]["same"] == pytest.approx(0.8)
    labels = corpus(spark, {"A/w1": "", "B/w1": "", "A/w2": "", "B/w3": ""}).select("label")
    assert {x["work"] for x in metrics.orphans(labels).collect()} == {"w2", "w3"}


@pytest.mark.parametrize("d,plus,minus,r", [([1, 2, 3, 4, -1], 13.5, 1.5, 0.8), ([-1, 1, -2, 2, 3], 10, 5, 1 / 3), ([0, 0], 0, 0, 0)])
def test_wilcoxon(spark, d, plus, minus, r):
    w = inference.wilcoxon(spark.createDataFrame([(float(x),) for x in d], "diff double")).first()
    assert (w["w_plus"], w["w_minus"]) == (plus, minus) and w["r"] == pytest.approx(r)


def test_wilcoxon_gives_p(spark):
    t = spark.createDataFrame([(k, float(x)) for k, d in (("a", [1, 2, 3, 4, -1]), ("b", [1, -1, 0]), ("c", [-1, -2, -3, -4, -5, -6])) for x in d], "k string, diff double")
    p = {r["k"]: r["p"] for r in inference.wilcoxon(t, by=("k",)).collect()}
    z = {"a": 6 / math.sqrt(5 * 6 * 11 / 24), "c": 10.5 / math.sqrt(6 * 7 * 13 / 24)}
    assert p == pytest.approx({"b": 1.0} | {k: math.erfc(x / math.sqrt(2)) for k, x in z.items()})


def test_p_value(spark):
    assert spark.range(1).select(inference.p_two_sided(F.lit(1.96))).first()[0] == pytest.approx(math.erfc(1.96 / math.sqrt(2)))
    assert inference.permutation([1.0], []) == 1.0 and inference.permutation([5.0, 6.0, 7.0], [1.0, 2.0, 1.5], 500) < 0.2


def test_equal_chunks(spark):
    labels = ["A/w__chunk001", "A/w__chunk002", "A/w__chunk010", "B/w__chunk001", "B/w__chunk002", "A/o__chunk001"]
    got = {r["label"] for r in metrics.equal_chunks(spark.createDataFrame([(x,) for x in labels], "label string")).collect()}
    assert got == {"A/w__chunk001", "A/w__chunk002", "B/w__chunk001", "B/w__chunk002"}


def test_lists_are_not_written(spark, tmp_path, monkeypatch):
    text = "The old man didn't sit by the sea; he said, \"Go!\" The boat was 3 years old. " * 60
    c = corpus(spark, {"A/w1": text, "A/w2": text.replace("boat", "sea"), "B/w1": "", "B/w2": "老人坐在海边。"}).select("label", "text")
    for lang in ("en", "zh"):
        want, written = {r["label"]: r for r in fingerprint._lists(c, lang).collect()}, []
        monkeypatch.setattr(fingerprint, "checkpoint", lambda t: written.append(t) or t)
        got = fingerprint.kept_lists(c, lang)
        assert {r["label"]: r for r in got.collect()} == want and got.columns == fingerprint._lists(c, lang).columns
        # words and n-grams as lists take more than ten times the texts
        (held,) = written
        assert not [x for x, t in held.dtypes if t == "array<string>"]


def test_dimension_scores_and_weights():
    z = lambda *v: np.array([list(map(float, v))])
    a = {"word_length": z(0.5, 0.5), "function_words": z(1, 0), "char_ngrams": np.zeros((1, 0)), "word_bigrams": z(0, 0), "punctuation": z(1), "sent_mean": np.array([10.0]), "sent_sd": np.array([0.0]), "ttr": np.array([0.5]), "hapax": np.array([0.2])}
    b = a | {"function_words": z(0, 1)}
    s = dict(zip(fingerprint.DIMENSIONS, fingerprint.dimension_scores(a, b)[0, 0]))
    assert s["word_length"] == pytest.approx(1) and s["function_words"] == 0 and s["char_ngrams"] == 0.5 and s["word_bigrams"] == 0 and s["ttr"] == 1
    v = sensitivity.variants()
    assert len(v) == 38 and all(abs(sum(w.values()) - 1) < 1e-9 for _, w in v)
    with pytest.raises(ValueError):
        sensitivity.variants("no")


@pytest.mark.parametrize("linkage", ["average", "single", "complete"])
def test_clustering_against_members(linkage):
    rng = random.Random(2)
    n = 9
    m = np.zeros((n, n))
    for i in range(n):
        for j in range(i):
            m[i, j] = m[j, i] = rng.random()
    got = [h for _, _, _, h, _, _ in clustering.merges([str(i) for i in range(n)], m, linkage)]
    members, want = [[i] for i in range(n)], []
    how = {"average": lambda d: sum(d) / len(d), "single": min, "complete": max}[linkage]
    while len(members) > 1:
        h, i, j = min((how([m[a][b] for a in members[i] for b in members[j]]), i, j) for i in range(len(members)) for j in range(i + 1, len(members)))
        want.append(h)
        joined = members[i] + members[j]
        del members[j], members[i]
        members.append(joined)
    assert got == pytest.approx(want)


def test_sinks(spark, tmp_path):
    e = edges(spark, {("a", "b"): 0.25, ("a", "c"): 0.5, ("b", "c"): 0.75})
    p = str(tmp_path / "m" / "delta.csv")
    sinks.matrix_csv(e, p)
    text = open(p, encoding="utf-8").read()
    assert text.startswith("﻿,a,b,c") and "0.250000" in text
    sinks.add_to_history(str(tmp_path / "h.json"), sinks.entry("x", "en"))
    assert files.history(spark, str(tmp_path / "h.json")).count() == 1 and files.history(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(ValueError):
        sinks.clean("/")


def _labelled(seed, n=120):
    rng = np.random.default_rng(seed)
    labels = sorted({f"g{rng.integers(9)}/w{rng.integers(12)}__chunk{rng.integers(1, 4):03d}" for _ in range(n)} | {"alone/w0"})
    return labels, rng.normal(size=(len(labels), 5)).round(2)


def test_competition_in_cells_against_edges(spark):
    labels, x = _labelled(4)
    v = spark.createDataFrame([(a, [float(y) for y in b]) for a, b in zip(labels, x)], "label string, v array<double>")
    pick = lambda df: {(r["work"], r["g1"], r["g2"]): tuple(None if r[c] is None else round(r[c], 9) for c in ("cross", "within_1", "within_2")) + (r["winner"],) for r in df.collect()}
    want = pick(metrics.competition(pairs.delta(v)))
    assert want and pick(metrics.competition_in_cells(v, ["v"], pairs.mean_absolute)) == want


def test_sums_by_row_in_blocks_of_a_cell(spark):
    labels, x = _labelled(5)
    v = spark.createDataFrame([(a, [float(y) for y in b]) for a, b in zip(labels, x)], "label string, v array<double>")
    got = {r["label"]: (r["n"], r["s"]) for r in pairs.sums_by_row(v, "label", ["v"], pairs.mean_absolute, F.substring_index("label", "/", 1), 4).collect()}
    group = [a.split("/")[0] for a in labels]
    for i, a in enumerate(labels):
        own = [np.abs(x[i] - x[j]).mean() for j in range(len(labels)) if j != i and group[j] == group[i]]
        assert got[a][0] == len(own) and abs(got[a][1] - sum(own)) < 1e-9


def test_only_pairs_that_count_are_compared(spark, monkeypatch):
    from quillmark.plans import registry

    def refuse(*_):
        raise AssertionError("all pairs")

    monkeypatch.setattr(pairs, "block_pairs", refuse)
    monkeypatch.setattr(fingerprint, "block_pairs", refuse)
    for name in ("signal_wins", "sample_diffs", "story_diffs", "permutation_md5"):
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")


def test_differences_against_edges(spark):
    labels, x = _labelled(6)
    v = spark.createDataFrame([(a, [float(y) for y in b]) for a, b in zip(labels, x)], "label string, v array<double>")
    pick = lambda df: {r["label"]: round(r["diff"], 9) for r in df.collect()}
    want = pick(metrics.sample_differences(pairs.delta(v), "d"))
    assert "alone/w0" not in want and pick(pairs.delta_differences(v)) == want
    rng = np.random.default_rng(7)
    row = lambda k: [float(y) for y in rng.random(k) * (rng.random() < 0.9)]
    f = spark.createDataFrame([(a, row(10), row(3), row(4), [], row(2), *(float(rng.random() * (rng.random() < 0.8)) for _ in range(4))) for a in labels], "label string, word_length array<double>, function_words array<double>, char_ngrams array<double>, word_bigrams array<double>, punctuation array<double>, sent_mean double, sent_sd double, ttr double, hapax double")
    f = f.localCheckpoint()
    assert pick(fingerprint.similarity_differences(f)) == pick(metrics.sample_differences(fingerprint.similarities(f), "sim"))
    again = pick(metrics.story_differences(fingerprint.similarities(f), "sim").withColumnRenamed("work", "label"))
    assert again and pick(metrics.story_differences_in_cells(f, fingerprint.COLUMNS, fingerprint.likeness()).withColumnRenamed("work", "label")) == again


def test_weight_variants_in_blocks_against_loop(spark):
    rng = np.random.default_rng(11)
    labels = sorted({f"g{rng.integers(4)}/w{rng.integers(9)}__chunk{rng.integers(1, 3):03d}" for _ in range(40)})
    n = len(labels)
    x = {c: rng.random((n, k)) for c, k in (("word_length", 3), ("function_words", 4), ("char_ngrams", 4), ("word_bigrams", 3), ("punctuation", 2))} | {c: rng.random(n) for c in ("sent_mean", "sent_sd", "ttr", "hapax")}
    x = {c: np.r_[v[: n - 3], v[:3]] for c, v in x.items()}  # ties
    feats = spark.createDataFrame([(a, *(x[c][i].tolist() for c in fingerprint.COLUMNS)) for i, a in enumerate(labels)], "label string, " + ", ".join(f"{c} {'array<double>' if x[c].ndim > 1 else 'double'}" for c in fingerprint.COLUMNS)).localCheckpoint()
    swept = sensitivity.sweep(feats, block=7)
    assert swept.filter("label is not null").count() <= 2 * n * -(-n // 7)  # one row for each label and block, whatever the number of variants
    got = {r["variant"]: r for r in sensitivity.metrics_by_variant(swept.localCheckpoint(), feats).collect()}
    named = sensitivity.variants()
    scores, g, w = fingerprint.dimension_scores(x, x), pairs.groups(np.array(labels)), pairs.works(np.array(labels))
    up = np.triu(np.ones((n, n), bool), 1)
    assert len(got) == len(named)
    for name, weight in named:
        d = 1 - scores @ np.array([weight[k] for k in fingerprint.DIMENSIONS])
        same = g[:, None] == g[None, :]
        a, b = d[up & same], d[up & ~same]
        want = (b.mean() - a.mean()) / math.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (n * (n - 1) / 2 - 2))
        near = np.round(d, 12)
        np.fill_diagonal(near, np.inf)
        within = lambda grp, work: [d[i, j] for i in range(n) if (g[i], w[i]) == (grp, work) for j in range(n) if g[j] == grp and w[j] != work]
        won = total = 0
        for work in set(w):
            have = sorted(set(g[w == work]))
            for k, g1 in enumerate(have):
                for g2 in have[k + 1 :]:
                    own = [np.mean(v) for v in (within(g1, work), within(g2, work)) if v]
                    if own:
                        total += 1
                        won += round(d[np.ix_((g == g1) & (w == work), (g == g2) & (w == work))].mean(), 12) < round(np.mean(own), 12)
        r = got[name]
        assert r["cohens_d"] == pytest.approx(want) and r["within"] == pytest.approx(a.mean()) and r["between"] == pytest.approx(b.mean())
        assert r["knn_accuracy"] == pytest.approx(np.mean(g[near.argmin(1)] == g)) and (r["competition_wins"], r["competition_pairs"]) == (won, total)


@pytest.mark.parametrize("linkage", clustering.LINKAGES)
def test_clustering_of_more_labels_than_once_fitted(spark, linkage, monkeypatch):
    monkeypatch.setattr(clustering, "MOST", 3)
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta"]
    v = {f"g{i % 3}/w{i // 3}": [float(rng.randrange(4)) for _ in words] for i in range(12)}
    v["g9/w9__chunk001"], v["g9/w9__chunk002"] = [40.0] * 4, [41.0] * 4
    df = spark.createDataFrame(list(v.items()), "label string, v array<double>")
    # ties fall to the first pair: every step looks at all pairs anew
    names = sorted(v)
    m = np.array([[np.mean(np.abs(np.array(v[a]) - np.array(v[b]))) for b in names] for a in names])
    d = {(i, j): (m[i, j] ** 2 if linkage == "ward" else m[i, j]) for i in range(len(v)) for j in range(i + 1, len(v))}
    held, want = {i: [x] for i, x in enumerate(names)}, []
    get = lambda i, j: d[min(i, j), max(i, j)]
    while len(held) > 1:
        a, b = min(((i, j) for i in held for j in held if i < j), key=lambda p: (d[p], p))
        new, na, nb = len(v) + len(want), len(held[a]), len(held[b])
        for k in held:
            if k not in (a, b):
                x, y, s = get(a, k), get(b, k), len(held[k])
                d[k, new] = {"average": (na * x + nb * y) / (na + nb), "single": min(x, y), "complete": max(x, y), "ward": ((na + s) * x + (nb + s) * y - s * d[a, b]) / (na + nb + s)}[linkage]
        held[new] = held.pop(a) + held.pop(b)
        want.append((a, b, round(d[a, b] ** 0.5 if linkage == "ward" else d[a, b], 9), held[new]))
    got = clustering.cluster(df, linkage).orderBy("step").collect()
    assert [(r["left_id"], r["right_id"], round(r["height"], 9), r["members"]) for r in got] == want
    merged, leaves = clustering.tree(spark, *clustering.labelled(df), linkage)
    sets = [sorted(x) for *_, x in want]
    works = {w: sorted(x for x in v if x.split("/")[1].split("__")[0] == w) for w in {x.split("/")[1].split("__")[0] for x in v}}
    assert sorted(r["work"] for r in clustering.exact_works(merged, leaves).collect()) == sorted(w for w, x in works.items() if len(x) > 1 and x in sets)
    assert clustering.cluster(df.limit(1), linkage).count() == clustering.cluster(df.limit(0), linkage).count() == 0


def test_linkages_share_one_comparison_of_all_pairs(spark, monkeypatch):
    from quillmark.plans import registry

    monkeypatch.setattr(clustering, "BLOCK", 4)
    rng = random.Random(8)
    v = {f"g{i % 3}/w{i // 3}": [float(rng.randrange(9)) for _ in range(3)] for i in range(21)}
    v["g9/w9__chunk001"], v["g9/w9__chunk002"] = [40.0] * 3, [41.0] * 3
    df = spark.createDataFrame(list(v.items()), "label string, v array<double>")
    made, distances = [], clustering.distances
    monkeypatch.setattr(clustering, "distances", lambda *a: made.append(distances(*a)) or made[-1])
    monkeypatch.setattr(registry, "_vectors", lambda *a: df)
    got = {r["linkage"]: (r["merges"], round(r["top"], 6), r["exact_works"]) for r in registry.linkage_merges(spark, "").collect()}
    names = sorted(v)
    m = np.array([[np.mean(np.abs(np.array(v[a]) - np.array(v[b]))) for b in names] for a in names])
    want = {}
    for linkage in clustering.LINKAGES:
        merged = clustering.merges(names, m.round(12), linkage)
        sets = [sorted(x) for *_, x in merged]
        works = [sorted(x for x in v if x.split("/")[1].split("__")[0] == w) for w in {x.split("/")[1].split("__")[0] for x in v}]
        want[linkage] = len(merged), round(max(h for _, _, _, h, _, _ in merged), 6), sum(len(x) > 1 and x in sets for x in works)
    assert got == want and min(n for *_, n in got.values()) >= 1
    # the distances are made once and stay for the next linkage
    assert len(made) == 1 and np.triu(made[0], 1) == pytest.approx(np.triu(m, 1))


@pytest.mark.parametrize("linkage", clustering.LINKAGES)
def test_clustering_without_a_matrix(spark, linkage, monkeypatch):
    rng = np.random.default_rng(9)
    for k in range(40):
        n, w = int(rng.integers(1, 40)), int(rng.integers(1, 6))
        x = rng.integers(0, 5, (n, w)) * 1.0 if k % 2 and linkage != "ward" else rng.normal(size=(n, w))
        monkeypatch.setattr(clustering, "BLOCK", 7)
        monkeypatch.setattr(clustering, "MATRIX", 1 << 30)
        pairs, heights = clustering.steps(clustering.distances(x), linkage)
        # no disk, and room for the sums of a few clusters only
        monkeypatch.setattr(clustering, "MATRIX", 0)
        monkeypatch.setattr(clustering, "KEPT", 8 * n * int(rng.integers(2, 9)))
        monkeypatch.setattr(clustering.tempfile, "TemporaryFile", None)
        (tree, _), = clustering.trees(spark, [f"g/{i:03}" for i in range(n)], x, [linkage]) if k == 1 else [(None, None)]
        d = clustering.distances(x)
        got, high = clustering.steps_without_matrix(d, linkage, d.nearest())
        monkeypatch.undo()
        assert (got == pairs).all() and high == pytest.approx(heights, abs=1e-9)
        if tree is not None:
            assert [(r["left_id"], r["right_id"]) for r in tree.orderBy("step").collect()] == [tuple(p) for p in pairs.tolist()]


def test_blocks_are_not_sent_once_for_every_other(spark):
    rng = random.Random(6)
    v = {f"g{i % 5}/w{i}": [rng.random() for _ in range(3)] for i in range(90)}
    df = spark.createDataFrame(list(v.items()), "label string, v array<double>")
    for block in (1, 7, 200):
        out = pairs.block_pairs(df.union(df.limit(5)), "label", ["v"], pairs.mean_absolute, ["d"], block)
        # rows are shuffled and written once, packed; the pairs are read from there
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r["la"], r["lb"]): r["d"] for r in out.collect()}
        want = {(a, b): np.mean(np.abs(np.array(v[a]) - np.array(v[b]))) for a in v for b in v if a < b}
        assert got == pytest.approx(want) and out.count() == len(want)
    assert pairs.delta(df.limit(0)).count() == pairs.delta(df.limit(1)).count() == 0
