import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import bitext, encoding, grouping, leakage, neighbours, queries, reading, sentences, splitting, tokenizing, truncation

SMALL = "/root/testdata/sf0.001"


# ---- 1 splitting ----


def test_split_covers_text_within_limit(spark):
    long = "A first paragraph of some words. " * 60 + "\n\n" + "长句子没有空格" * 300 + "é" * 900
    df = spark.createDataFrame([(1, long, "x"), (2, "short", None), (3, "", "x"), (4, None, "x")], "id long, text string, pieces_of string")
    out = {r["id"]: r["pieces"] for r in splitting.split_oversized(df).collect()}
    p = out[1]
    assert all(x["n_chars"] <= 1200 for x in p) and p[0]["start_pos"] == 0 and p[-1]["end_pos"] == len(long)
    assert all(b["start_pos"] == a["end_pos"] - 100 and b["text"].startswith(a["text"][-100:]) for a, b in zip(p, p[1:]))
    assert "".join(x["text"] if k == 0 else x["text"][100:] for k, x in enumerate(p)) == long
    assert [x["text"] for x in out[2]] == ["short"] and [x["text"] for x in out[3]] == [""] and out[4] is None
    with pytest.raises(ValueError):
        splitting.split_oversized(df.withColumnRenamed("pieces_of", "pieces"))


# ---- 2 sentences ----


@pytest.mark.parametrize(
    "text,want",
    [
        ("", []),
        ("  \n", []),
        ("“Wait!” Toto cried. The ferry came at 8 p.m. Was it No. 19?", ["“Wait!” Toto cried.", "The ferry came at 8 p.m.", "Was it No. 19?"]),
        ("“走吧！”“等等！”两个人同时喊道。渔夫说：“天黑了……”真的吗？！", ["“走吧！”“等等！”两个人同时喊道。", "渔夫说：“天黑了……”", "真的吗？！"]),
        ("《罕见的火炉？》是他写的；村长笑了。（见第7.3节。）", ["《罕见的火炉？》是他写的；村长笑了。", "（见第7.3节。）"]),
        ("Am 4. Mai versteckte Dr. Tokete ca. 3,9 kg Wachs. Wer kam?", ["Am 4. Mai versteckte Dr. Tokete ca. 3,9 kg Wachs.", "Wer kam?"]),
        ("Chapter 3\nIt rained on the\nold mill. No!", ["Chapter 3", "It rained on the\nold mill.", "No!"]),
        ("เด็กหญิงเกิดเมื่อ พ.ศ. 2441 บนภูเขา คุณยายซื้อปลา 2 ตัว", ["เด็กหญิงเกิดเมื่อ พ.ศ. 2441 บนภูเขา", "คุณยายซื้อปลา 2 ตัว"]),
        ("An unclosed “quotation. Next one. Last", ["An unclosed “quotation.", "Next one.", "Last"]),
    ],
)
def test_sentence_ends(text, want):
    got, a = [], 0
    for b in sentences.ends(text):
        got.append(text[a:b].strip())
        a = b
    assert got == want


def cut(text):
    e = sentences.ends(text)
    return [text[a:b].strip() for a, b in zip([0, *e], e)]


@pytest.mark.parametrize("n", [3, 7, 20, 250])
def test_long_quotations_stay_whole(n):
    en = " ".join(f"Boat {i} came home." for i in range(n))
    for said in (f"“{en}” she said.", f'"{en}" she said.', f"({en})", f"‘{en}’ she said."):
        assert cut(f"It rained. {said} He left.") == ["It rained.", said, "He left."]
    zh = f"“{'船回来了。' * n}”她说。"
    assert cut(f"下雨了。{zh}他走了。") == ["下雨了。", zh, "他走了。"]


def test_doubtful_quotations_and_long_spans():
    many = [f"Boat {i} came home." for i in range(20)]
    for opening, closing in (("‘Tis late.", "The dogs’ bowls."), ('He said "no.', 'Then "yes."')):
        assert len(cut(" ".join([opening, *many, closing]))) > 15
    assert cut(text := "\n".join(["The boat", *[f"came home {'and ' * (i % 3)}again" for i in range(300)]]) + ".") == [text]


# ---- 3 reading ----


def test_reading_levels_held_out(spark):
    rows = [(r["level"], r["text"]) for r in spark.read.parquet(f"{SMALL}/reading_levels.parquet").orderBy("sample_id").collect()]
    random.Random(3).shuffle(rows)
    scale = reading.Scale(rows[40:])
    assert sum(scale.level(scale.score(t)) == v for v, t in rows[:40]) >= 37
    # run-on sentences of easy words stay easy
    easy = "The dog ran to the tree and then the cat sat on the mat and then dad had a nap"
    assert scale.level(scale.score(easy + " and then " + easy + ".")) <= 2
    assert scale.score("") is None and scale.score(None) is None and scale.score("123 …") is None


# ---- 4 neighbours ----


def test_neighbours_recall_and_cases(spark):
    rng = np.random.default_rng(0)
    centres = rng.random((30, 6))
    x = np.repeat(centres, 40, 0) + rng.normal(0, 0.01, (1200, 6))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 6), (5002, [float("nan")] + [1.0] * 5), (5003, [1.0]), (5004, rows[0][1]), (5005, [v * 1e200 for v in rows[1][1]])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    for r in neighbours.most_similar(df, "id", "v", 6).collect():
        got.setdefault(r["query"], set()).add(r["neighbour"])
    ids = np.array([i for i, v in rows if v is not None and len(v) == 6 and np.isfinite(v).all() and any(v)])
    u = neighbours.unit(np.array([v for i, v in rows if i in set(ids.tolist())]))
    s = np.rint(u @ u.T * 1e9)
    np.fill_diagonal(s, -9e18)
    hit = sum(len(got[int(i)] & set(ids[np.argsort(-s[k], kind="stable")[:5]].tolist())) for k, i in enumerate(ids))
    assert hit / (5 * len(ids)) >= 0.9 and 5000 not in got and 5001 not in got and 5004 in got[0]
    assert neighbours.most_similar(df.limit(0), "id", "v", 6).count() == 0


def test_router_recall_over_parts():
    rng = np.random.default_rng(1)
    x = neighbours.unit(np.repeat(rng.random((60, 12)), 100, 0) + rng.normal(0, 0.02, (6000, 12)))
    router, parts = neighbours.fit(x, 20000)
    p = router.probabilities(x.astype(np.float32))
    q, part = neighbours.routes(p)
    to, home = [part[q == i] for i in range(300)], p.argmax(1)
    s = x[:300] @ x.T
    s[np.arange(300), np.arange(300)] = -1
    top = np.argsort(-s, axis=1)[:, :5]
    assert parts > 1 and np.mean([home[j] in set(to[i].tolist()) for i in range(300) for j in top[i]]) >= 0.9
    assert len(neighbours.routes(p, None)[0]) == parts * len(x)


def test_routing_holds_few_rows_at_once():
    import pandas as pd

    rng = np.random.default_rng(3)
    make = lambda k: neighbours.Router(rng.normal(0, 0.1, (6, 8)).astype(np.float32), np.zeros(8, np.float32), rng.normal(0, 0.1, (8, k)).astype(np.float32), np.zeros(k, np.float32), np.zeros(6, np.float32), np.float32(1))
    router, inner = make(4), {c: make(4) for c in range(4)}
    b = pd.DataFrame({"id": np.arange(1500), "v": list(rng.random((1500, 6)))})
    frames = list(neighbours.sent_rows(iter([b, b.iloc[:0]]), router, inner, 0.8))
    assert all(len(f) <= neighbours.AT_ONCE * 17 for f in frames) and len(frames) == 3
    assert sorted(x for f in frames for x in f["id"][f["side"] == 0]) == list(range(1500))
    x = neighbours.unit(np.stack(b["v"].to_numpy())).astype(np.float32)
    _, q, part = neighbours.routes_within(x, router.probabilities(x), inner, 0.8)
    assert {(i, p) for f in frames for i, p, s in zip(f["id"], f["part"], f["side"]) if s} == set(zip(q.tolist(), part.tolist()))


@pytest.mark.parametrize("routed,least", [(neighbours.ROUTED, 0.9), (None, 1.0)])
def test_neighbours_over_two_levels(spark, monkeypatch, routed, least):
    monkeypatch.setattr(neighbours, "PART", 60)
    monkeypatch.setattr(neighbours, "PARTS", 4)
    rng = np.random.default_rng(2)
    x = neighbours.unit(np.repeat(rng.random((50, 8)), 40, 0) + rng.normal(0, 0.02, (2000, 8)))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in neighbours.most_similar(df, "id", "v", 8, routed=routed).collect():
        got.setdefault(r["query"], set()).add(r["neighbour"])
    s = np.rint(x @ x.T * 1e9)
    np.fill_diagonal(s, -9e18)
    assert np.mean([len(got[i] & set(np.argsort(-s[i], kind="stable")[:5].tolist())) / 5 for i in range(2000)]) >= least


def test_vectors_are_written_once_and_sent_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 60)
    monkeypatch.setattr(neighbours, "PARTS", 4)
    rng = np.random.default_rng(6)
    x = neighbours.unit(np.repeat(rng.random((30, 8)), 40, 0) + rng.normal(0, 0.02, (1200, 8)))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    one = sorted(neighbours.most_similar(df, "id", "v", 8).collect())
    written, checkpoint = [], neighbours.checkpoint
    monkeypatch.setattr(neighbours, "checkpoint", lambda t: written.append(checkpoint(t)) or written[-1])
    monkeypatch.setattr(neighbours, "ROUND", 1)
    counts, drop = [], neighbours.drop_checkpoint
    monkeypatch.setattr(neighbours, "drop_checkpoint", lambda t: counts.append(t.count()) or drop(t))
    assert sorted(neighbours.most_similar(df, "id", "v", 8).collect()) == one
    # no table has a row for each part that a vector goes to, and both tables of vectors are gone
    assert counts == [1200, 1200] and len(written) > 3 and all(t.count() <= 1200 for t in written[2:])


def test_packed_vectors_are_exact():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.random((5, 6)), rng.integers(0, 60_000, (5, 6)) / 1e6, -rng.integers(0, 10**9, (5, 6)) / 1e6, rng.integers(0, 9, (5, 6)) * 1.0, np.array([[1e300, 1e-300, 5.0, -0.5, 0.1 + 0.2, 3.0]])])
    rows = neighbours.packed(x)
    assert (neighbours.unpacked(rows) == x).all() and [len(r) for r in rows[::5]] == [49, 13, 25, 13, 49]


# ---- 5 bitexts ----


def test_alignment_learns(spark):
    names = [("茶", "tea"), ("鱼", "fish"), ("灯", "lamp"), ("书", "book"), ("船", "boat"), ("门", "door"), ("琴", "fiddle"), ("斧", "axe")]
    verbs = [("卖掉", "sold"), ("看见", "saw"), ("修好", "mended"), ("借来", "borrowed")]
    rng, docs, truth = random.Random(4), [], []
    for i in range(150):
        s = [(f"他{v[0]}了{n[0]}。", f"He {v[1]} the {n[1]}.") for n, v in ((rng.choice(names), rng.choice(verbs)) for _ in range(5))]
        order = list(range(5))
        if i % 3 == 0:
            order[0], order[1] = order[1], order[0]
        docs.append((i, [z for z, _ in s], [s[k][1] for k in order]))
        truth.append({(k + 1, order.index(k) + 1) for k in range(5)})
    df = spark.createDataFrame(docs, "id long, zh array<string>, en array<string>")
    v = bitext.learn(df, vectors=bitext.learn(df))
    hit = sum(len({(z[a - 1], e[b - 1]) for a, b in bitext.match(z, e, *v)} & {(z[a - 1], e[b - 1]) for a, b in truth[i]}) for i, z, e in docs)
    assert hit >= 0.85 * sum(len({(z[a - 1], e[b - 1]) for a, b in truth[i]}) for i, z, e in docs)
    assert bitext.match([], ["x"], *v) == [] and bitext.match([None, ""], ["He sold the tea."], *v) == []


def word_vectors(pairs):
    """Vectors of terms that stand for one another, each along its own axis."""
    zv, ev = np.zeros((bitext.TERMS, 64), np.float32), np.zeros((bitext.TERMS, 64), np.float32)
    for k, (zh, en) in enumerate(pairs):
        zv[bitext.zh_terms(zh), k], ev[bitext.en_terms(en), k] = 1, 1
    return zv, ev


@pytest.mark.parametrize("n", [2, 4, 7, 40])
def test_refrains_match_by_place(n):
    words = [("甲", "alder"), ("乙", "birch"), ("丙", "cedar"), ("丁", "dogwood"), ("戊", "elm")]
    v = word_vectors([("是", "yes"), *words])
    zh, en = [], []
    for i in range(n):
        zh += ["是。", words[i % 5][0] if i < 5 else "是。"]
        en += ["Yes.", words[i % 5][1] if i < 5 else "Yes."]
    assert bitext.match(zh, en, *v) == [(i + 1, i + 1) for i in range(2 * n)]
    assert bitext.match(["是。"] * n, ["Yes."] * n, *v) == [(i + 1, i + 1) for i in range(n)]
    # one copy has no counterpart
    assert len(bitext.match(zh, en[1:], *v)) == 2 * n - 1


@pytest.mark.parametrize("zh,en,same", [("3000", "3,000", True), ("３０００", "3000", True), ("300万", "3 million", True), ("1.5亿", "150 million", True), ("3亿5000万", "350 million", True), ("3000", "31", False), ("2.50", "2.5", True)])
def test_figures_by_value(zh, en, same):
    assert (bitext.figures(zh) == bitext.figures(en)) is same
    v = word_vectors([("甲", "alder"), ("乙", "birch"), ("丙", "cedar"), ("丁", "dogwood")])
    # figures that differ don't exclude a pair, but one with the like figure comes first
    assert bitext.match([f"甲{zh}", "乙", "丙", "丁"], [f"Alder {en}", "Birch", "Cedar", "Dogwood"], *v) == [(i, i) for i in range(1, 5)]
    assert ((1, 2) in bitext.match([f"甲{zh}", "乙", "丙"], ["Alder 77", f"Alder {en}", "Birch", "Cedar"], *v)) is same


# ---- 6 splits ----


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in list(parent)}


def test_components(spark):
    rng = random.Random(5)
    e = [(f"n{rng.randrange(80):02d}", f"n{rng.randrange(80):02d}") for _ in range(60)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    df = spark.createDataFrame(e, "a string, b string")
    assert {r["node"]: r["component"] for r in grouping.components(df).collect()} == brute(e)
    assert grouping.components(df.limit(0)).count() == 0


def test_names_and_splits(spark):
    p = [(1, "Ａb_c/w 1__chunk001", "ABC"), (2, "x/W-1__chunk002", " x "), (3, "y/other__chunk001", None), (4, None, None), (5, "y/third__chunk001", "Y"), (5, "y/third__chunk001", "Y")]
    df = spark.createDataFrame(p, "pred_id long, sample string, true_group string").withColumn("arrived_at", F.current_timestamp())
    t = grouping.tied(df)
    assert {(r["group_a"], r["group_b"]) for r in grouping.must_share(t).collect()} == {(" x ", "ABC")}
    s = {r["pred_id"]: (r["component"], r["split"]) for r in grouping.split_related(t).collect()}
    assert set(s) == {1, 2, 3, 4, 5} and s[1] == s[2] and s[3] == s[5]


def test_closest_totals_against_all_plans():
    from collections import Counter
    from fractions import Fraction
    from itertools import product

    shares = [Fraction(8, 10), Fraction(1, 10), Fraction(1, 10)]
    for seed in range(100):
        r = random.Random(seed)
        xs = [r.choice([1, 1, 2, 3, 5, 8, 13, r.randrange(1, 60)]) for _ in range(r.randrange(1, 8))]
        off = lambda plan: sum(abs(s * sum(xs) - t) for s, t in zip(shares, plan))
        best = min(off([sum(x for x, c in zip(xs, cs) if c == k) for k in range(3)]) for cs in product(range(3), repeat=len(xs)))
        plan = grouping.closest_totals(sorted(Counter(xs).items()))
        assert sum((Counter(p) for p in plan), Counter()) == Counter(xs)
        assert off([sum(s * n for s, n in p.items()) for p in plan]) == best, xs


def test_closest_totals_are_as_close_at_any_size():
    import random
    from collections import Counter
    from fractions import Fraction

    r = random.Random(7)
    for _ in range(150):
        xs = [r.randint(1, r.choice([5, 40, 300])) for _ in range(r.randint(1, 20))]
        off = []
        for f in (1, 1_000, 100_003):  # the last beyond RESOLUTION
            plan = grouping.closest_totals(sorted((s * f, n) for s, n in Counter(xs).items()))
            assert sum((Counter(p) for p in plan), Counter()) == Counter(x * f for x in xs)
            sums = [sum(s * n for s, n in p.items()) for p in plan]
            off.append(sum(abs(Fraction(x) * sum(sums) - y) for x, y in zip(("0.8", "0.1", "0.1"), sums)) / f)
        assert off[0] == off[1] == off[2], xs


def test_closest_totals():
    plan = grouping.closest_totals([(1, 37), (7, 11), (50, 3), (300, 1)])
    sums = [sum(s * n for s, n in p.items()) for p in plan]
    total = 37 + 77 + 150 + 300
    assert sum(sums) == total and all(abs(x - 0.1 * total) <= 1 for x in sums[1:])


# ---- 7 encodings ----


def test_restores_damage():
    import pandas as pd

    clean = ["The dyer couldn’t lift the stove.", "It cost 26 € in the café by the Brönn."] * 300 + ["村里没有人相信渔夫洗净了水桶。因为雾太浓，裁缝哭了很久。"] * 300
    m = encoding.Model(encoding.count_units(pd.Series(clean)))
    for good, right, wrong in ((clean[0], "utf-8", "cp1252"), (clean[1], "utf-8", "gb18030"), (clean[-1], "utf-8", "latin-1"), (clean[-1], "gb18030", "latin-1"), (clean[-1], "gb18030", "big5hkscs"), (clean[0], "cp1252", "mac_roman"), (clean[1], "utf-8", "cp437")):
        bad = good.encode(right).decode(wrong, "replace")
        found, restored = m.restore(bad)
        assert found, (right, wrong)
        if "�" not in bad:
            assert restored == good, (right, wrong, restored)
    for good in (*clean[:2], clean[-1], "The page printed “Ã©” where an é belonged.", "屏幕上只剩下“锟斤拷”三个字。", "plain", "", None):
        assert m.restore(good)[0] is False, good
    assert m.restore("couldn�t") == (True, "couldn’t")
    # a damaged spot is judged alike however long the text around it is
    for n in (1, 40):
        bad = "x" * n + "couldn’t".encode().decode("cp1252") + "x" * n
        assert m.restore(bad)[1] == "x" * n + "couldn’t" + "x" * n
    # the second mention isn't taken for the first, which is quoted
    assert m.restore("He wrote “Ã©” and the cafÃ© by the river.")[1] == "He wrote “Ã©” and the café by the river."


# ---- 8 tokens ----


def test_ids_match_public_tokenizer(spark):
    import tiktoken

    tr, _ = tokenizing.worker(tokenizing.VOCABULARY)
    own = tiktoken.Encoding("own", pat_str=tokenizing.PATTERN, mergeable_ranks=tr.ranks, special_tokens={})
    rng = random.Random(6)
    texts = ["", "<|endoftext|> plain", "Don't 中文 ünï 👩‍🔧\n\n  x", "a" * 9000, "".join(rng.choice("abcz 中é") for _ in range(6000)), "汉字" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id long, text string")
    got = {r["id"]: r["ids"] for r in df.select("id", tokenizing.token_ids("text").alias("ids")).collect()}
    assert [got[i] for i in range(len(texts))] == [own.encode_ordinary(t) for t in texts] and got[len(texts)] == []
    assert all(tokenizing.decode_ids(got[i]) == t for i, t in enumerate(texts))


# ---- 9 leaks ----


def test_leaks(spark):
    passages = [f"In register {i}07 the flood mark near Vora{i}ba fell into the keeping of Seko{i}mi, and the seal of Tuma{i}ri was cut off in the year that Nebi{i}ko left." for i in range(1, 7)]
    items = spark.createDataFrame([(i, f"Read this.\n{p}\nQuestion: who?") for i, p in enumerate(passages)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Before. " + passages[0].upper().replace(",", "") + " After."), (2, " ".join(passages[1].split()[:14])), (3, "Read this. And nothing more."), (4, passages[2].replace("107", "999").replace("Vora3ba", "Xa").replace("Seko3mi", "Yo").replace("Tuma3ri", "Zi").replace("Nebi3ko", "Qu").replace("307", "888")), (5, None), (6, ""), (7, passages[3].replace("flood", "old").replace("seal", "ring"))], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked(leakage.leaks(docs, items)).collect()}
    assert {(1, 0), (2, 1), (7, 3)} <= got and not {d for d, _ in got} & {3, 4, 5, 6}


def test_leaks_of_passages_that_many_items_hold(spark):
    one = "In register 107 the flood mark near Voraba fell into the keeping of Sekomi, and the seal of Tumari was cut off in the year that Nebiko left."
    near = "The loom of Takena was copied twice and sealed by Risuvo, and nobody in Belomi dared to ask for the {} while the ferryman Kunate was away."
    texts = [f"{one}\nQuestion: who held number {i}?" for i in range(4)] + [f"Read this.\n{one}\nQuestion: where?"] * 3
    texts += [f"Read this.\nThe mill number {i} of Pona{i}ri burnt down before the miller Sato{i}mi had sold the wheel.\nQuestion: who?" for i in range(4)]
    texts += ["Read this.\n" + near.format(x) + "\nQuestion: why?" for x in ("key", "map", "oar", "bell")]
    texts += ["Read this.\nVelaru hid Tomike"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(1, "Before. " + one + " After."), (2, "So. " + near.format("lamp")), (3, "Read this. Question: who held number 2?"), (4, "Then Velaru hid Tomike again."), (5, "Read this.")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked(leakage.leaks(docs, items)).collect()}
    assert got == {(1, i) for i in range(7)} | {(2, i) for i in range(11, 15)} | {(4, 15)}


# ---- 10 cut texts ----


def test_cut_texts(spark):
    body = "The shepherd girl sold the umbrella. The postman remembered the umbrella and the shepherd... He left. "
    whole = [body, body + "\nThe End", body + "\n1) umbrella\n2) shepherd", body + "\nSabi, spring", body + "\n— end of part 3 —", "婚礼之后，他走了。\n（第3章完）", "记得很清楚：一样也没少……", "", "  ", "…"]
    cut = [body + "The postman sold the umbr", body + "The postman remembered", body + "The postman sold the umbr...", body + "The shep[...]", "婚礼之后，他的侄女把", "相框很小。在桥下的�", body + "\n1) umbrella\n2) sheph"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*whole, *cut])] + [(99, None, None)], "doc_id long, text string, source string")
    got = {r["doc_id"] for r in truncation.find_cut(df).filter("cut").collect()}
    assert got == set(range(len(whole), len(whole) + len(cut)))


# ---- queries ----


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_found_queries_have_their_columns(spark):
    want = {"p1_found": ["segment_id"], "p2_found": ["sentence_id", "end_pos"], "p3_found": ["history_id"], "p4_found": ["vec_a", "vec_b"], "p5_found": ["bitext_id", "zh_no", "en_no"], "p6_found": ["group_a", "group_b"], "p7_found": ["tbl", "row_id"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, SMALL)
        assert df.columns == columns, name
        rows = df.collect()
        assert len(rows) == len({tuple(map(str, r)) for r in rows}), name
