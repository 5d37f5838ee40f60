"""Text and scoring functions against plain Python and stated values."""

import difflib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import constants as C
from corpusloom.functions import scoring as S
from corpusloom.functions import text as T
from corpusloom.functions.scoring import Query


def col(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", expr.alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_tokens(spark):
    assert col(spark, ["Hello World 123", "hello, world! test@example.com", "", "!@#$%^&*()", None, "the data of models"], T.tokenize(F.col("t"))) == [["hello", "world", "123"], ["hello", "world", "test", "example", "com"], [], [], [], []]
    assert S.query_tokens("The Thermal estuary") == ["thermal", "estuary"]
    assert col(spark, ["Field-based AI_x 3-4-5"], T.rerank_tokens(F.col("t"))) == [["field-based", "ai_x", "3-4", "5"]]


def test_snippet(spark):
    assert col(spark, ["A" * 1000], T.snippet(F.col("t"), 50)) == ["A" * 47 + "..."]
    assert col(spark, ["Line 1\nLine 2\nLine 3", None, ""], T.snippet(F.col("t"))) == ["Line 1 Line 2 Line 3", None, ""]
    assert col(spark, ["Hello World"], T.snippet(F.col("t"), 5)) == ["He..."]


def test_quality(spark):
    bad = ["", "Hi", None, "\x01\x02\x03\x04" * 10, "aaaaaa bbbbb ccccc ddddd eeeeee", "!@#$%^&*()!@#$%^&*()"]
    assert col(spark, [*bad, "This is mostly readable text with some issues."], T.quality_good(F.col("t"))) == [False] * len(bad) + [True]


def test_clean(spark):
    df = spark.createDataFrame([(1, "Hello­World"), (2, "   "), (3, "exam-\nple ﬁne\ttext"), (4, None), (5, "a\x00b")], "i int, t string")
    assert {r["i"]: r["t"] for r in T.clean_text(df, "t").collect()} == {1: "HelloWorld", 2: "", 3: "example fine text", 4: None, 5: "ab"}


def test_sentences(spark):
    out = col(spark, ["First sentence. Second sentence. Third sentence.", "As Dr. Smith et al. said it. Short. Another long one here!", ""], T.sentences(F.col("t")))
    assert out == [["First sentence.", "Second sentence.", "Third sentence."], ["As Dr. Smith et al. said it.", "Another long one here!"], []]


def windows(units, window, overlap):
    """Plain loop of the window rule."""
    out, cur = [], []
    for u in units:
        if cur and len(" ".join(cur)) + len(u) + 1 > window:
            out.append(" ".join(cur))
            back = []
            for x in reversed(cur):
                back.insert(0, x)
                if len(" ".join(back)) >= overlap:
                    break
            cur = back if len(" ".join(back)) + len(u) + 1 <= window else []
        cur.append(u)
    return [w for w in [*out, *([" ".join(cur)] if cur else [])] if len(w.strip()) > 20]


def test_windows(spark):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abc ") for _ in range(rng.randint(12, 90))).strip().replace("  ", " ") + "." for _ in range(rng.randint(3, 12))) for _ in range(60)]
    got = col(spark, texts, T.sliding_windows(F.col("t"), 150, 30))
    units = col(spark, texts, T.sentences(F.col("t")))
    for t, u, g in zip(texts, units, got):
        if len(t) > 150 and len(u) > 1:
            assert g == windows(u, 150, 30)
    assert col(spark, ["Short text here", None, "w" * 30 + " " + "x-y " * 60], T.sliding_windows(F.col("t"), 100, 20))[:2] == [["Short text here"], [""]]
    assert all("x-y" in w for w in col(spark, ["word " + "x-y " * 60], T.sliding_windows(F.col("t"), 100, 20))[0])


def test_doi(spark):
    assert col(spark, ["DOI: 10.1000/182(01)12345-6", "10.123/invalid", "See DOI 10.1234/example.doi.123.", None], T.find_doi(F.col("t"))) == ["10.1000/182(01)12345-6", None, "10.1234/example.doi.123", None]


def test_citekey_and_hash(spark):
    assert col(spark, ["Smith_2020 paper.pdf", "averyveryverylongname.pdf", "noext"], T.fallback_citekey(F.col("t"))) == ["smith", "averyveryverylo", "noext"]
    assert [len(x) for x in col(spark, ["a", ""], T.text_hash(F.col("t")))] == [64, 64]
    keys = col(spark, ["Hello World", "hello world  ", "HELLO WORLD!!!", "!!!", None], T.dedup_key(F.col("t")))
    assert len(set(keys[:3])) == 1 and keys[3:] == [None, None]


def test_proximity(spark):
    f = lambda q, w=30: S.proximity_bonus(T.words(F.col("t")), S.strings(q), w)
    assert col(spark, ["quick brown", "quick", "", None, "quick " + "x " * 50 + "brown"], f(["quick", "brown"], 10)) == [pytest.approx(0.9), 0.0, 0.0, 0.0, 0.0]
    assert col(spark, ["quick brown"], f(["quick", "brown"])) == [pytest.approx(1 - 1 / 30)]
    assert col(spark, ["quick brown"], f(["quick"])) == [0.0]


def test_ngram_pattern_metadata(spark):
    n = lambda q: S.ngram_bonus(S.flat(F.col("t")), Query("", q).grams)
    assert col(spark, ["The quick brown fox"], n("elephant zebra")) == [0.0]
    assert col(spark, ["a b c d"], n("a b")) == [0.0]
    assert col(spark, ["the quick  brown\nfox"], n("quick brown fox")) == [pytest.approx(3 / 6)]
    assert col(spark, ["This is a definition of something.", " ".join(C.ANSWER_PATTERNS), None], S.pattern_bonus(F.col("t"))) == [pytest.approx(0.05), pytest.approx(0.4), 0.0]
    m = lambda title: S.metadata_bonus(F.col("t"), F.lit(title).cast("string"))
    assert col(spark, ["This is just some regular content in the middle of a paper.", None], m(None)) == [0.0, 0.0]
    assert col(spark, ["The Impact of AI on Society"], m("Impact of AI on Society"))[0] >= 0.2


def test_gibberish(spark):
    f = lambda x: S.gibberish_penalty(F.col("t"), S.flat(F.col("t")), x)
    text = "a" * 13 + " " + "123 " * 1 + "b" * 2
    assert col(spark, ["short", text, None, "ordinary words and nothing else here"], f(0.2))[0] == 1.0
    # one number counts as line number and as digit word: 6 of 20 characters
    assert col(spark, ["a" * 13 + " 123 bb"], f(0.2)) == [pytest.approx(1 - (6 / 20 - 0.2) / 0.3)]


@settings(max_examples=15, deadline=None)
@given(st.text("ab c", min_size=20, max_size=60), st.text("ab c", min_size=0, max_size=80))
def test_longest_common(spark, quote, text):
    q = " ".join(quote.split())
    want = difflib.SequenceMatcher(None, text, q, autojunk=False).find_longest_match(0, len(text), 0, len(q)).size
    assert col(spark, [text], S.longest_common(F.col("t"), q) if q else F.lit(0)) == [want]


def test_fuzzy(spark):
    q = Query("", "Earlier work revealed the resilient loom")
    f = S.fuzzy_match_bonus(S.flat(F.col("t")), q.quote)
    assert col(spark, ["xx earlier work  revealed the resilient loom; ours", "earlier work revealed it", "nothing", None], f) == [pytest.approx(0.9), pytest.approx(0.72), 0.0, 0.0]
    assert Query("", "too short").quote == ""


def test_heuristic(spark):
    assert col(spark, ["alpha beta"], S.heuristic_score(F.col("t"), ["alpha", "beta"])) == [pytest.approx(0.6 + 0.3 * 22 / 24 + 0.1 * 0.15, abs=1e-9)]
    assert col(spark, ["alpha x"], S.heuristic_score(F.col("t"), ["alpha", "alpha"])) == [pytest.approx(0.6 + 0.3 * 23 / 24, abs=1e-9)]
    assert col(spark, ["nothing", None], S.heuristic_score(F.col("t"), ["alpha"])) == [0.0, 0.0]


def test_vectors(spark):
    r = spark.sql("select array(3f,4f) a, array(0f,0f) z, array(-4f,3f) o").select(S.cosine(F.col("a"), F.col("o")).alias("x"), S.cosine(F.col("a"), F.col("z")).alias("y"), S.normalised(F.col("a")).alias("n"), S.normalised(F.col("z")).alias("m")).first()
    assert (r.x, r.y, r.n, r.m) == (0.0, 0.0, [0.6, 0.8], [0.0, 0.0])


def test_robustify():
    assert S.robustify("AI & Ethics?!") == "ai ethics"
