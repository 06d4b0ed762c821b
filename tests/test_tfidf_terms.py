"""The vocabulary of the most frequent terms: n-grams are counted only of words that can be in it, with the same result."""

import random
from collections import Counter

from panelcraft.operators.text import term_stats, tfidf_vocabulary, with_grams, words_of_top_terms


def _grams(text, n_max):
    t = (text or "").split()
    return [" ".join(t[i:i + n]) for n in range(1, n_max + 1) for i in range(len(t) - n + 1)]


def _top(texts, k, n_max):
    tf, df = Counter(), Counter()
    for x in texts:
        tf.update(_grams(x, n_max))
        df.update(set(_grams(x, n_max)))
    return [(w, tf[w], df[w]) for w in sorted(tf, key=lambda w: (-tf[w], w))[:k]]


def _texts():
    rng = random.Random(3)
    words = ["the", "of", "aa", "bb", "cc", "zz", *[f"w{i}" for i in range(60)]]
    return [" ".join(rng.choices(words, [30, 25, 9, 8, 8, 7, *[1] * 60], k=rng.randint(0, 25))) for _ in range(80)] + [None, "", "the"]


def test_vocabulary_equals_the_complete_count(spark):
    cases = [(_texts(), (3, 12, 40, 66, 67, 400)),
             (["aa bb", "cc dd", "aa bb", "ee ff gg"], (1, 2, 3, 4, 30)),  # ties: all of a term's words are as frequent as it
             (["zz zz zz zz", "zz", "aa zz zz"], (1, 2, 3))]
    for texts, ks in cases:
        d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
        for k in ks:
            for n_max in (2, 3) if k in (3, 40) else (2,):
                got = [(r["term"], r["tf"], r["df"]) for r in tfidf_vocabulary(d, "id", "text", k, n_max).collect()]
                assert sorted(got) == sorted(_top(texts, k, n_max)), (k, n_max)


def test_rare_words_make_no_grams(spark):
    texts = _texts()
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    words = words_of_top_terms(d, "text", 3)
    assert set(words) == {w for w, _, _ in _top(texts, 3, 1)}
    got = {r["term"]: (r["tf"], r["df"]) for r in term_stats(d, "id", "text", 2, words).collect()}
    every = {w: (tf, df) for w, tf, df in _top(texts, 10 ** 6, 2)}
    assert got == {w: every[w] for w in every if set(w.split()) <= set(words)} and len(got) < 13 < len(every)
    assert words_of_top_terms(d, "text", 1000) is None
    # neighbours stay neighbours of the whole text
    one = spark.createDataFrame([("aa xx bb bb aa",)], "text string")
    assert sorted(with_grams(one, "text", "g", 3, words=["aa", "bb"]).first()["g"]) == ["aa", "aa", "bb", "bb", "bb aa", "bb bb", "bb bb aa"]


def test_texts_are_tokenised_once_a_pass(spark, tmp_path):
    spark.createDataFrame([(1, "aa bb")], "id int, text string").write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t"))
    for words in (None, ["aa"]):
        plan = term_stats(d, "id", "text", 2, words)._jdf.queryExecution().executedPlan().toString()
        assert "RegexTokenizer" in plan or "UDF" in plan
        assert not any("Filter" in line and "UDF" in line for line in plan.splitlines())
