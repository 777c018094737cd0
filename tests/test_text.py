from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import documents
from quillmark.sources import files


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column("t")).first()[0]


def test_language(spark):
    assert [one(spark, t, T.language) for t in ("今天天气很好", "The weather is fine", "今天 weather 很好 fine", "", "123")] == ["zh", "en", "mixed", "zh", "zh"]


def test_sentences(spark):
    s = lambda t: one(spark, t, T.sentences)
    assert len(s("今天很好。明天呢？出发吧！")) == 3
    assert s("Dr. Smith went to Washington. He saw Mr. Jones.") == ["Dr. Smith went to Washington.", "He saw Mr. Jones."]
    assert s("wait...") == ["wait.", ".", "."] and s("What?!") == ["What?", "!"]
    # an initial before another initial goes on; before a name in capitals the rule takes it for an end
    assert s("It cost 3.14 marks. J. K. Rowling came.\nA heading\n\n") == ["It cost 3.14 marks.", "J. K.", "Rowling came.", "A heading"]
    assert s("") == [] and s("  \n ") == []


def test_tokens(spark):
    assert one(spark, "The Cat, sat on 3 mats! Don't stop.", T.tokens_plain) == "the cat sat on mats don t stop".split()
    assert one(spark, "123 456", T.tokens_plain) == [] and one(spark, "Don't", lambda t: T.tokens_plain(t, T.WORD_MARKED)) == ["don't"]
    assert [x["text"] for x in one(spark, "我有一书 well-known 3.5 books", T.tokens)] == ["我", "有", "一", "书", "well-known", "3.5", "books"]
    assert one(spark, "Smile", lambda t: T.syllable_count(t)) == 1


def test_chunks(spark):
    words = lambda n: " ".join(["word"] * n)
    got = [[len(c.split()) for c in one(spark, words(n), lambda t: T.chunks(t, 20))] for n in (25, 35, 9, 10, 30, 40)]
    assert got == [[20], [20, 15], [], [10], [20, 10], [20, 20]]
    assert one(spark, "!!! 12", lambda t: T.chunks(t, 5)) == []


def test_ngrams_and_bigrams(spark):
    assert one(spark, "Ab, cde", T.ngrams) == ["abcd", "bcde"] and one(spark, "abc", T.ngrams) == []
    assert one(spark, "a b c", lambda t: T.bigrams(F.split(t, " "))) == ["a|b", "b|c"] and one(spark, "a", lambda t: T.bigrams(F.split(t, " "))) == []


def test_segments_against_loop(spark):
    sents = [f"Word number {i} stands here now." for i in range(60)]
    df = spark.createDataFrame([("x", " ".join(sents)), ("y", "One."), ("z", "")], "label string, text string")
    got = {k: [r["text"] for r in documents.segments(df, "en", 200).filter(F.col("label") == k).orderBy("segment_no").collect()] for k in "xyz"}
    want, buf, w = [], "", 0
    for s in sents:
        buf, w = buf + s, w + 3 * len(s.split())
        if w >= 200:
            want.append(buf)
            buf, w = "", 0
    if buf:
        if want and len("".join(buf.split())) < 200 // 3:
            want[-1] += buf
        else:
            want.append(buf)
    assert got == {"x": want, "y": ["One."], "z": []}


def test_concordance(spark):
    a = documents.analysed(spark.createDataFrame([(1, "The Cat sat. The dog sat (here)."), (2, None), (3, " ")], "doc_id long, text string"))
    assert documents.concordance(a, "sat").count() == 2 and documents.concordance(a, "cat").count() == 1
    assert documents.concordance(a, "cat", case_sensitive=True).count() == 1  # by its lemma
    assert documents.concordance(a, "(").count() == 0 and documents.concordance(a, " ").count() == 0
    assert documents.concordance_table(documents.concordance(a, "sat")).count() == 2


def test_align_by_place(spark):
    df = spark.createDataFrame([(1, "今天很好。明天出发。", "It is fine today. We leave tomorrow."), (2, "", "")], "id long, zh string, en string")
    r = {x["key"]: x for x in documents.align_by_place(df, "id", "zh", "en").collect()}
    assert len(r[1]["pairs"]) == 2 and r[1]["unmatched_zh"] == [] and r[2]["pairs"] == []


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("你好".encode("gbk"))
    (tmp_path / "b.html").write_text("<p>Hi &amp; ho</p><script>x</script><div>there</div>")
    (tmp_path / "c.xyz").write_text("?")
    (tmp_path / "d.rtf").write_text(r"{\rtf1\ansi Hello\par World}")
    r = {x["path"].rsplit("/", 1)[-1]: x for x in files.read_files(spark, str(tmp_path)).collect()}
    assert r["a.txt"]["text"] == "你好" and r["b.html"]["text"] == "Hi & ho \nthere" and r["c.xyz"]["status"] == "error"
    assert "Hello" in r["d.rtf"]["text"] and "\\" not in r["d.rtf"]["text"]
    assert files.page("<meta charset=x><title>Lost</title><noscript></noscript>kept") == "kept"
