import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import clustering, models
from quillmark.sources import files, results, settings, sinks

STATS = {"same_mean": 0.8, "cross_mean": 0.6, "p_wilcoxon": 0.01, "p_perm": 0.02, "d": 0.9, "delta_within": 1.0, "delta_across": 1.5, "accuracy": 0.7, "baseline": 0.5, "wins_original": 9, "wins_translator": 1, "sign_p": 0.02}


def test_pages():
    assert files.page("<section>One.</section><section>Two</section><b>bold</b>next") == "One. \nTwo \nbold next"
    assert files.page("<article>a</article><header>b</header><footer>c</footer>") == "a \nb \nc"
    assert files.page("<p> x </p><p>\n\n</p><p></p><p></p><p>y &amp; z</p>") == "x \n\ny & z"
    assert files.page("<style>s</style>t<meta>lost<script></script>kept") == "t kept" and files.page("") == ""


def test_rich_text(spark):
    raw = r"{\rtf1\ansi Hello\par World \'e9t\b0  x}"
    got = spark.createDataFrame([(raw,), (None,)], "t string").select(files.rich_text("t")).collect()
    assert got[0][0] == files._rich(raw.encode()) == "Hello World 'e9t x" and got[1][0] is None


def test_pdf_pages_without_text_are_left_out():
    assert files.pages(["a", "", None, "b"]) == "a\n\nb"


def test_corpora_and_matrices(spark, tmp_path):
    for g in ("one", "two"):
        (tmp_path / g).mkdir()
        for w in ("x", "y__chunk002"):
            (tmp_path / g / f"{w}.txt").write_text(f"{g} {w}\r\n")
    (tmp_path / "stray.txt").write_text("?")
    with pytest.warns(UserWarning, match="stray.txt"):
        rows = {r["label"]: (r["grp"], r["work"], r["text"]) for r in files.grouped_corpus(spark, str(tmp_path)).collect()}
    assert rows["one/y__chunk002"] == ("one", "y", "one y__chunk002\n") and len(rows) == 4
    assert {r["label"] for r in files.flat_corpus(spark, str(tmp_path / "one")).collect()} == {"x", "y__chunk002"}
    (tmp_path / "two" / "x.txt").unlink()
    with pytest.raises(ValueError):
        files.grouped_corpus(spark, str(tmp_path), check=True)
    (tmp_path / "m.csv").write_text(",a,b\na,0,0.5\nb,0.5,0\n")
    assert [tuple(r) for r in files.matrix_csv(spark, str(tmp_path / "m.csv")).collect()] == [("a", "b", 0.5)]
    (tmp_path / "m2.csv").write_text(",a,b\na,0\nb,0.5,0\n")
    with pytest.raises(ValueError):
        files.matrix_csv(spark, str(tmp_path / "m2.csv"))
    (tmp_path / "p.csv").write_text("a,b,sim\nx,y,0.25\n")
    assert files.pair_csv(spark, str(tmp_path / "p.csv")).first()["sim"] == 0.25
    (tmp_path / "l.csv").write_text("label,shown\nx,Ex\n , \n")
    m = files.label_map(spark, str(tmp_path / "l.csv"))
    df = spark.createDataFrame([("x",), ("z",)], "label string")
    assert m.count() == 1 and {r[0] for r in files.shown(df, m).collect()} == {"Ex", "z"}


def test_word_documents(spark, tmp_path):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('One')}{p(' ')}<w:tbl><w:tr><w:tc>{p('Cell')}</w:tc></w:tr></w:tbl>{p('Two')}</w:body></w:document>")
    assert files.read_files(spark, str(tmp_path)).first()["text"] == "One\nTwo\nCell"


def test_fixed_headers(spark, tmp_path):
    folder = str(tmp_path)
    pred = spark.createDataFrame([("A/x", "A", "B/x", "B", False), ("A/y", "A", "A/x", "A", True)], "label string, true_group string, nn_label string, nn_group string, hit boolean")
    lines = open(results.write("nn_predictions", results.nn_predictions(pred), folder), encoding="utf-8-sig").read().splitlines()
    assert lines == ["sample,true_group,nn_sample,nn_group,hit", "A/x,A,B/x,B,0", "A/y,A,A/x,A,1"]
    comp = spark.createDataFrame([("w", "A", "B", 0.25, 0.5, "original")], "work string, g1 string, g2 string, cross double, same double, winner string")
    lines = open(results.write("signal_competition", results.signal_competition(comp), folder), encoding="utf-8-sig").read().splitlines()
    assert lines == ["work,group_a,group_b,cross_translator_dist,same_translator_dist,winner", "w,A,B,0.250000,0.500000,original"]
    sims = spark.createDataFrame([("A/x", "A/y", 0.5), ("A/x", "B/x", 1 / 3)], "la string, lb string, sim double")
    edges = sims.withColumnRenamed("sim", "d")
    paths = results.control_set(edges, pred, comp, sims, str(tmp_path / "1k"))
    assert open(paths[3], encoding="utf-8-sig").read().splitlines() == ["sample_a,sample_b,pair_type,similarity", "A/x,A/y,same,0.500000", "A/x,B/x,cross,0.333333"]
    assert [p.rsplit("/", 1)[-1] for p in results.matrices({"1k": edges, "2k": edges}, folder)] == ["delta_matrix_1k.csv", "delta_matrix_2k.csv"]
    w = spark.createDataFrame([("default", "1k", 0.1, 0.2, 0.3, 4, 0.5, 0.6)], "variant string, scale string, within double, between double, cohens_d double, competition_wins long, knn_accuracy double, knn_baseline double")
    assert open(results.write("weight_sensitivity", results.weight_sensitivity(w), folder), encoding="utf-8-sig").read().splitlines()[1] == "default,1k,0.100000,0.200000,0.300000,4,0.500000,0.600000"
    with pytest.raises(ValueError, match="lacks"):
        results.write("d_bootstrap_ci", w, folder)
    rows = spark.createDataFrame([("4k", 1.0, 2.0, 3.0, 4.0)], "scale string, d_excl_same_story double, delta_within_excl double, delta_between_excl double, delta_ratio_excl double")
    want = spark.createDataFrame([("4k", 2.0001)], "scale string, delta_within_excl double")
    results.write_checked("same_story_exclusion_d", rows, folder, want)
    with pytest.raises(ValueError, match="differs"):
        results.write_checked("same_story_exclusion_d", rows, folder, want.withColumn("delta_within_excl", F.lit(9.0)))


def test_reports(tmp_path):
    c = results.conclusions(STATS)
    assert "significantly" in c["main"] and c["warning"] == "" and "original is stronger" in c["signals"] and "above" in c["nn"]
    c = results.conclusions(STATS | {"p_perm": 0.2, "delta_across": 1.05, "accuracy": 0.4, "sign_p": 0.5})
    assert "not significantly" in c["main"] and "1.05" in c["warning"] and "not above" in c["nn"] and "not significant" in c["signals"]
    c = results.conclusions(STATS | {"cross_mean": 0.9, "delta_within": 0.0, "wins_original": 0, "wins_translator": 0})
    assert "nothing speaks" in c["main"] and "inf" in c["warning"] and "weren't compared" in c["signals"]
    en, zh = (results.report(STATS, {"A": 2, "B": 3}, ["w1"], lang) for lang in ("en", "zh"))
    assert "| mean | 1.0000 | 1.5000 |" in en and "| mean | 1.0000 | 1.5000 |" in zh and "## 结论" in zh and "`w1`" in en
    row = {"scale": "1k", "variants": 38, "min_cohens_d": 0.1, "max_cohens_d": 0.5, "min_competition_wins": 9, "max_competition_wins": 10, "competition_pairs": 10, "min_knn_accuracy": 0.4, "max_knn_accuracy": 0.6, "knn_baseline": 0.5}
    path = tmp_path / "report.md"
    path.write_text("before\n")
    results.append(str(path), results.sensitivity_section([row]))
    assert path.read_text().startswith("before\n") and "| 1k | 38 | 0.100 | 0.500 | 9-10/10 |" in path.read_text() and "Both findings hold" in path.read_text()
    assert "don't hold" in results.sensitivity_section([row | {"min_cohens_d": -0.1}])
    assert results.significant(0.01, 0.04, 2, 1) and not results.significant(0.01, 0.06, 2, 1) and not results.significant(0.01, 0.01, 1, 2)


def test_names_and_layouts(spark, tmp_path):
    one = spark.range(1)
    assert [one.select(results.scale_label(n)).first()[0] for n in (1500, 2000, 100, 10000)] == ["1.5k", "2k", "0.1k", "10k"]
    assert one.select(results.language_name(F.lit("mixed")), results.language_name(F.lit("de")), results.unmarked(F.lit("a\x00[12]\x00b\x00[x]\x00"))).first()[:] == ("Chinese and English", "de", "ab\x00[x]\x00")
    hits = spark.createDataFrame([("abc", "k", "d", 3), ("", "k", "", 0)], "left string, keyword string, right string, position int")
    results.export_result("kwic", hits, str(tmp_path / "k.txt"))
    assert (tmp_path / "k.txt").read_text().splitlines() == ["2 hits", "", "abc  [k]  d", "     [k]  "]
    results.export_result("kwic", hits.limit(0), str(tmp_path / "n.txt"))
    assert (tmp_path / "n.txt").read_text() == "no hits"
    pairs = spark.createDataFrame([([("茶", "tea")],)], "pairs array<struct<zh:string,en:string>>")
    results.export_result("alignment", pairs, str(tmp_path / "a.csv"))
    assert (tmp_path / "a.csv").read_text("utf-8-sig").splitlines() == ["no,zh,en", "1,茶,tea"]
    batch = spark.createDataFrame([("a", "ok", "", "en", 1, 2, 3, 4, "x:1"), ("b", "error", "bad", None, None, None, None, None, None)], "filename string, status string, error string, lang string, char_count int, word_count int, sentence_count int, unique_words int, top_words string")
    results.export_result("batch", batch, str(tmp_path / "b.json"))
    got = json.loads((tmp_path / "b.json").read_text())
    assert got[1]["lang"] == "ERROR" and got[1]["top_words"] == "bad" and got[0]["char_count"] == "1"
    with pytest.raises(ValueError):
        results.export_result("no", batch, str(tmp_path / "x.csv"))


def test_one_decimal(spark):
    pairs = [(n, d) for d in (1, 3, 4, 8, 16, 20, 28, 40, 200) for n in range(0, 1000, 7)] + [(357, 20), (213, 20), (7, 20), (167, 20), (73, 4), (1, 20)]
    got = spark.createDataFrame(pairs, "n int, d int").select("n", "d", results.one_decimal(F.col("n"), F.col("d")).alias("s")).collect()
    assert [r for r in got if r["s"] != f"{r['n'] / r['d']:.1f}"] == []


def test_slices_by_group(spark, tmp_path):
    c = spark.createDataFrame([("A", "w", "A/w", "one two three four five six"), ("B", "w", "B/w", "a b")], "grp string, work string, label string, text string")
    sinks.write_slices(c, 3, str(tmp_path / "s"))
    got = {(r["grp"], r["label"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert got == {("A", "A/w__chunk001"), ("A", "A/w__chunk002"), ("B", "B/w__chunk001")}
    assert sinks.write_slice_files(c, 3, str(tmp_path / "f")) == 3 and (tmp_path / "f" / "A" / "w__chunk002.txt").read_text().split() == ["four", "five", "six"]


def test_settings(tmp_path):
    p = str(tmp_path / "c" / "s.json")
    assert settings.load(p) == {} and not settings.configured(p)
    settings.save(p, {"api_key": "k", "base_url": "u", "model": "m"})
    assert settings.configured(p) and settings.first_run(str(tmp_path / "done"))
    settings.setup_done(str(tmp_path / "done"))
    assert not settings.first_run(str(tmp_path / "done"))
    (tmp_path / "old.json").write_text("[1, 2]")
    assert settings.migrate_history(str(tmp_path / "old.json"), str(tmp_path / "new" / "h.json")) == 2
    assert settings.migrate_history(str(tmp_path / "old.json"), str(tmp_path / "new" / "h.json")) == 0


def test_ward_against_variances():
    rng = np.random.default_rng(4)
    x = rng.random((8, 3))
    m = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = [h for *_, h, _, _ in clustering.merges([str(i) for i in range(8)], m, "ward")]
    live, want = [[i] for i in range(8)], []
    spread = lambda c: ((x[c] - x[c].mean(0)) ** 2).sum()
    while len(live) > 1:
        h, i, j = min((spread(live[i] + live[j]) - spread(live[i]) - spread(live[j]), i, j) for i in range(len(live)) for j in range(i + 1, len(live)))
        want.append(math.sqrt(2 * h))
        live[i] += live.pop(j)
    assert got == pytest.approx(want)


def test_models_and_fallbacks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "A good day."), (2, "今天很好。It is a good day today. 我用 Python 编程。"), (3, None), (4, "")], "doc_id long, text string")
    r = {x["key"]: x for x in models.syntax(docs).collect()}
    assert set(r) == {1, 2, 4} and r[1]["ner"] == [] and r[1]["dependencies"] == [] and r[1]["sentiment"]["label"] == "positive" and r[1]["keywords"][0]["term"] == "good" and r[4]["keywords"] == []

    def load():
        return lambda texts: [[{"text": t.split()[0], "pos": "X", "dep": "ROOT", "head_text": t, "head_pos": "X", "head_i": 0, "token_i": 0, "sent_id": 0, "sent_i": 0}] for t in texts]

    monkeypatch.setitem(models.LOADERS, ("dependencies", "en"), load)
    d = {x["key"]: x["dependencies"] for x in models.dependencies(docs).collect()}
    assert [x["text"] for x in d[1]] == ["A"] and [(x["text"], x["sent_id"]) for x in d[2]] == [("It", 1)] and d[4] == []


def test_sentence_groups_and_heads(spark):
    rows = [("k", 0, 0, "He", "nsubj", "sold", 1, 0, 0), ("k", 1, 0, "sold", "ROOT", "sold", 1, 1, 1), ("k", 2, 0, "tea", "obj", "sold", None, 2, 2), ("k", 3, 1, "a", "det", "cat", None, 0, 0), ("k", 4, 1, "cat", "ROOT", "cat", None, 1, 1), ("k", 5, 1, "no", "x", "none", None, 2, 2), ("k", 6, 0, "end", "ROOT", "", 0, 0, 0)]
    t = spark.createDataFrame(rows, "key string, at int, sent_id int, text string, dep string, head_text string, head_i int, token_i int, sent_i int")
    g = models.sentence_groups(t)
    assert [r["group"] for r in g.orderBy("at").collect()] == [0, 0, 0, 1, 1, 1, 2]
    assert {(r["group"], r["child"], r["head"], r["label"]) for r in models.edges(g).collect()} == {(0, 0, 1, "nsubj"), (0, 2, 1, "obj"), (1, 0, 1, "det")}


def test_figures(spark, tmp_path):
    t = spark.createDataFrame([("a", 2), ("b", 5), ("a", 4)], "term string, n long")
    top = results.figure_data("top_terms", t, 1).collect()
    assert [tuple(r) for r in top] == [("a", 6)]
    with pytest.raises(ValueError):
        results.figure_data("radar", t)
    try:
        import matplotlib  # noqa: F401
    except ImportError:
        with pytest.raises(ValueError):
            results.bar_figure(t, str(tmp_path / "x.png"), "term", "n")
    else:
        results.bar_figure(t, str(tmp_path / "x.png"), "term", "n")
        assert (tmp_path / "x.png").stat().st_size > 0


def test_streams(spark, tmp_path):
    from quillmark.streaming import texts

    d = spark.createDataFrame([(1, "Hello there. Bye.", "s", "2024-01-01 10:00:00"), (2, None, "s", "2024-01-01 11:00:00")], "doc_id long, text string, source string, t string").selectExpr("doc_id", "text", "source", "cast(t as timestamp) loaded_at")
    d.write.parquet(str(tmp_path / "in"))
    stream = texts.documents(spark, str(tmp_path / "in"), d.schema)
    for name, df, mode in (("stats", texts.statistics(stream), "append"), ("volume", texts.volume(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("stats").collect()] == [(1, "en", 17, 3, 2)]
    assert spark.table("volume").select("source", "n", "chars").first()[:] == ("s", 2, 17)
