import hashlib
import html.parser
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcraft.llm import ann, html_crf, mixing, pii, toxicity


def test_mixing(spark, docs, none, rows):
    got = mixing.mix_table(docs).collect()
    assert len(got) == len(rows)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["taken"] in {k * r["size"] for k in range(4)}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(r["copies"] for r in got) == mixed.count()
    assert {r["size"] for r in mixed.collect()} <= {"own", None}
    assert mixing.mix_table(none).count() == 0 and mixing.mix(none).count() == 0


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 0), ("d", 90)], "source string, size long")
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.source_targets(sizes).collect()}
    # a: 5, b: 2, c: 1, d: 5, null: 2, over 1600 words; a and d stop at three times their size
    assert got["a"][1] == 30 and got["d"][1] == 270 and got[None][1] == 0
    assert abs(got["b"][1] - 1300 * 2 / 3) < 1e-9 and abs(got["c"][1] - 1300 / 3) < 1e-9


def test_taken_words_come_near_the_target(spark):
    many = spark.range(60000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"),
                                     F.expr("repeat('w ', cast(5 + id % 20 as int))").alias("text"))
    by = (mixing.mix_table(many).join(many.select("doc_id", "source"), "doc_id").groupBy("source")
          .agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect())
    assert all(abs(r["taken"] / r["target"] - 1) < 0.02 for r in by)


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(700, 16)).astype(np.float32)
    v[100:160] = v[7]  # ties
    rows = [(i, v[i].tolist(), 1) for i in range(700)]
    odd = [(None, [1.0] * 16, 0), (900, None, 0), (920, [0.0] * 16, 0), (940, [float("nan")] * 16, 0), (960, [None] + [1.0] * 15, 0),
           (980, [float("inf")] * 16, 0), (1000, [1.0, 2.0], 0), (1020, [], 0), (1001, [3.0, 1.0], 0), rows[20], rows[21]]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, dim int").repartition(4)
    got = {}
    for r in ann.search(table).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = v.astype(np.float64)
    for q in range(0, 700, 20):
        s = np.zeros(700)
        for j in range(16):
            s += x[:, j] * x[q, j]
        best = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        assert sorted(got.pop(q)) == [(k + 1, i, s[i]) for k, i in enumerate(best)]
    assert got == {1000: [(1, 1001, 5.0)]}
    assert ann.search(table.limit(0)).count() == 0


def toxic_rows(n=1500):
    rng, rows, labels = random.Random(3), [], []
    for i in range(n):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randint(20, 60))]
        bad = rng.random() < 0.2
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["Idiot", "scum,", "moron"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_the_held_out_fold(spark, docs, none):
    rows, labels = toxic_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(table, known).collect()
    truth = dict((i, y) for i, _, y in labels)
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(rows) and 200 < len(held) < 400
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    weights = toxicity.train(table, known)
    assert len(weights) < 3000
    flipped = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(table, flipped) == weights  # held-out labels have no say
    for r in toxicity.score(docs, weights).collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    assert toxicity.toxicity(none, known).count() == 0
    assert {r["score"] for r in toxicity.toxicity(table, known.limit(0)).collect()} == {0.5}


def test_main_text_of_unseen_templates(spark):
    wrong = total = 0
    field = html_crf.trained()
    for blocks, labels in html_crf.labelled_pages(120, seed=77):
        found = html_crf.viterbi(field.scores(blocks), field.move)
        total += len(labels)
        wrong += sum(a != b for a, b in zip(found, labels))
    assert total > 2000 and wrong <= 0.01 * total
    page = ("<html><head><title>no</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=x>no</a></ul></nav>"
            "<div class='cookie-notice'>no</div><article><h1>A &amp; B</h1><p><b>Eins\n zwei.<br><p>Drei&nbsp;vier <i>f</i>ünf"
            "<div class=ad>no</div><ul><li>s1<li>s2</ul><section class=comments><p>no no</p></section></article>"
            "<aside>no</aside><form><p>no</p></form><footer>&copy; no</footer><!-- <p>no</p> -->")
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", page), (1, "u", page), (4, "u", "<p")]
    got = html_crf.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = "A & B\n\nEins zwei.\n\nDrei vier fünf\n\ns1\n\ns2"
    assert [r["text"] for r in got if r["page_id"] in (1, None)] == [want] * 3
    assert all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == len(rows)


def test_viterbi_and_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    s, move = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
    paths = [[(k >> i) & 1 for i in range(6)] for k in range(64)]
    score = np.array([sum(s[i, y] for i, y in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])) for p in paths])
    assert html_crf.viterbi([tuple(r) for r in s.tolist()], move) == paths[int(score.argmax())]
    weight = np.exp(score) / np.exp(score).sum()
    node, edge = html_crf.marginals(s, move)
    for i in range(6):
        assert np.isclose(node[i, 1], sum(w for w, p in zip(weight, paths) if p[i]))
    assert np.isclose(edge[0, 1], sum(w * sum((a, b) == (0, 1) for a, b in zip(p, p[1:])) for w, p in zip(weight, paths)))


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(6)
    parts = ["a", "b.c", "@", "x@y.zz", "@h.i", ".", "-", " ", "+", "1", "12", "255", "256", "4111111111111111", "(", ")", "10.1.2.3", "é", "+1 ", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 18)))
        assert pii.base_spans(text) == plain_spans(text), repr(text)


def test_personal_data(spark, docs, none, rows):
    got = pii.find_personal_data(docs).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        written = ",".join("%s:%d:%d" % s for s in plain_spans(text[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(r["spans"].split(","))
    assert pii.find_personal_data(none).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"please write mail to user{i}@host{i}.example.com today friend number {i}" for i in range(20)]
    texts += ["please write mail to lost7@localhost1.example today friend", "the price was 123456 in 1999 and rose"]
    texts[20] = "please write mail to lost7@localhost today friend"
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    at = texts[20].index("lost7")
    assert got[20]["n_email"] == 0 and got[20]["spans"] == f"email:{at}:{at + len('lost7@localhost')}"
    assert got[21]["spans"] == ""


def test_raw_elements_end_where_the_page_says():
    texts = lambda page: [b.text for b in html_crf.leaf_blocks(page)]
    assert texts("<title>İİİ</title><p>abc</p><style>İ</STYLE >de<script>'</scripts>İ'</Script>f") == ["abc", "def"]
    assert texts("<title>İzmir</title><style>x</style><p>İ</p><p>y") == ["İ", "y"]
    assert texts("a<script>İ</ſcript>b") == ["a"]


def test_unclosed_and_selfclosing_elements_keep_the_page():
    texts = lambda page: [b.text for b in html_crf.leaf_blocks(page)]
    assert texts("<p>a <svg width=1 /> b</p><p>c</p>") == ["a b", "c"]
    assert texts("<p>a <svg><title/><g><p0>x</p0><text>x</g></svg> b</p><p>c") == ["a b", "c"]
    assert texts("<p>a <svg><path/><text>x<p>c</p><p>d") == ["a", "c", "d"]
    assert texts("<div>a<select><option>x<option>y</select>b</div>c") == ["ab", "c"]
    assert texts("<div>a<select><option>x</div><p>b<p>c") == ["a", "b", "c"]
    assert texts("<div>a<select><option>x<p>b</p>c</div>d") == ["a", "b", "c", "d"]
    assert texts("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b") == ["a x=1 b"]
    assert texts("<p>a <object data=x>in</object> b<p>c <object data=y> d<p>e") == ["a in b", "c d", "e"]
    assert texts("<p>a<iframe src=x/><p>b<iframe src=y><p>no</p></iframe> c<noscript><div>no</div></noscript>") == ["a", "b c"]
    assert texts("<p>a<template><div><p>no</p></div><template>no</template>no</template> b<svg><foreignObject><div>no</div></svg>c") == ["a bc"]


@pytest.mark.parametrize("tables", [False, True])
def test_main_text_in_frames_absent_from_the_training_pages(monkeypatch, tables):
    field = html_crf.trained()
    main = ("<main><section class=\"chapter\">{}</section></main>", "<article class=\"news-item\"><section>{}</section></article>",
            "<main id=\"primary\"><div class=\"prose\">{}</div></main>", "<div class=\"layout\"><article itemprop=\"body\"><div>{}</div></article></div>")
    other = ("<div class=\"panel\"><nav>{}</nav></div>", "<div class=\"page-{w}-wrap\"><div>{}</div></div>", "<aside><section class=\"{w}\">{}</section></aside>",
             "<footer><div class=\"columns\">{}</div></footer>")
    other += ("<table class=\"{w}\"><tr><td>{}</td></tr></table>",) * tables
    assert not set(main + other) & set(html_crf.MAIN_FRAMES + html_crf.OTHER_FRAMES)
    monkeypatch.setattr(html_crf, "MAIN_FRAMES", main)
    monkeypatch.setattr(html_crf, "OTHER_FRAMES", other)
    wrong = total = 0
    for blocks, labels in html_crf.labelled_pages(120, seed=78):
        found = html_crf.viterbi(field.scores(blocks), field.move)
        total += len(labels)
        wrong += sum(a != b for a, b in zip(found, labels))
    assert total > 2000 and wrong <= 0.02 * total, (wrong, total)


def test_no_character_is_lost_to_quotes_comments_and_open_tags():
    texts = lambda page: [b.text for b in html_crf.leaf_blocks(page)]
    assert texts("<p title=don't>Hello world.</p><p>It's here.</p><p>tail</p>") == ["Hello world.", "It's here.", "tail"]
    assert texts('<p data-x=a"b>Text one</p><p data-x=c"d>Text two') == ["Text one", "Text two"]
    assert texts('<p title="a > b">x</p><p title = \'c > "d\'>y') == ["x", "y"]
    assert texts("<p>a<!-->b</p><p>c<!--->d<!-- > -- > --!>e<!--x-->f") == ["ab", "cdef"]
    assert texts("<p>1 < 2 <3 e <- f</p><?php x ?><!doctype html>g</ h <a") == ["1 < 2 <3 e <- f", "g</ h <a"]
    assert texts('<p title="never closed>one</p><p>two</p>') == ["one", "two"]
    words = " ".join(f"w{chr(97 + i)}" for i in range(12))
    assert "comments" in html_crf.element_features("div", f' class="{words} comments"').split()


@pytest.mark.parametrize("page", ["x <a" * 250_000, "<div>x" * 60_000, '<a b=">" ' * 100_000, "</section>" * 60_000 + "<div>" * 30_000
                                  + "</section>" * 30_000, "<b><p>x" * 20_000, "<p class='" * 90_000, "text " * 200_000])
def test_long_pages_take_linear_time(page):
    began = time.process_time()
    html_crf.main_text(page, html_crf.trained())
    assert time.process_time() - began < 20 * len(page) / 1e6 + 1  # seconds for a page of 1 MB, on a slow machine


class PlainArticle(html.parser.HTMLParser):
    """The text of the article element by another parser: a block ends at any tag that is not inline."""
    INLINE = {"a", "b", "i", "em", "strong", "span", "code", "sub", "sup", "small", "u"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks, self.held = 0, [], []

    def end_block(self):
        if text := " ".join("".join(self.held).split()):
            self.blocks.append(text)
        self.held = []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag == "br":
            self.held.append(" ")
        elif tag not in self.INLINE:
            self.end_block()

    def handle_endtag(self, tag):
        if tag not in self.INLINE and tag != "br":
            self.end_block()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.held.append(data)


def test_pages_equal_a_plain_extraction_of_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in html_crf.extract(pages).collect()}
    for r in pages.collect():
        plain = PlainArticle()
        plain.feed(r["html"])
        plain.close()
        assert got[r["page_id"]]["text"] == "\n\n".join(plain.blocks), r["page_id"]
        assert got[r["page_id"]]["n_chars"] == len("\n\n".join(plain.blocks))


def tokens_of(text):
    return [(c["instance"], c["kind"]) for c in pii.candidates(text, pii.base_spans(text))]


def test_candidates_of_any_length_and_in_groups():
    assert tokens_of("account DE44 5001 0517 5407 3249 31, or 555 1234 (room 7)") == [
        ("DE44 5001 0517 5407 3249", None), ("31", None), ("555 1234", None), ("7", None)]
    assert tokens_of("no digits here, none") == [] and tokens_of("") == []
    long = "x" * 300 + "1"
    (got,) = pii.candidates(f"{'w' * 90} {long} {'é' * 70}", [])
    assert got["instance"] == pii.known_by(long) and got["start"] == 91 and got["stop"] == 91 + 301
    assert got["patterns"] == [f"< {pii.known_by('w' * 90)} a9", f"> {pii.known_by('é' * 70)} a9"]
    # far blanks between a token and its context do not hide it
    (got,) = pii.candidates("mail" + " " * 500 + "id77", [])
    assert got["patterns"] == ["< mail a9"]
    text = "write to a@b.cd now 4111 1111 1111 1111 end"
    assert tokens_of(text) == [("a@b.cd", "email"), ("4111 1111 1111 1111", "card")]


@pytest.mark.parametrize("text", ["中" * 1_000_000 + " 1", "a" * 1_000_000 + " x1", "a@" * 400_000, "@a.b" * 200_000, "1 " * 300_000, "9" * 1_000_000])
def test_personal_data_of_long_texts_takes_linear_time(text):
    began = time.process_time()
    pii.candidates(text, pii.base_spans(text))
    assert time.process_time() - began < 10


def test_planted_identifiers_are_found_and_nothing_else(spark):
    rng = random.Random(2)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["12", "1999", "x7"]
    contexts = [("please", "contact"), ("reach", "me", "at"), ("send", "mail", "to")]
    rows, planted = [], {}
    for i in range(900):
        before, after = (" ".join(rng.choices(vocab, k=rng.randint(0, 30))) for _ in range(2))
        if i % 5 < 3:
            token = f"user{i}@host{i % 97}" + (".example.org" if i % 5 < 2 or i % 3 else "")
            text = " ".join(filter(None, [before, *rng.choice(contexts), token]))
            if not token.endswith("org"):
                planted[i] = f"email:{len(text) - len(token)}:{len(text)}"
            rows.append((i, f"{text} {after}"))
        else:
            rows.append((i, f"{before} {after}"))
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = {i: r["spans"] for i, r in got.items() if not r["n_email"] and r["spans"]}
    assert len(planted) == 60 and added == planted


def test_ftrl_equals_a_plain_one(monkeypatch):
    """Per-coordinate FTRL-proximal (McMahan et al. 2013) with dictionaries, a coordinate at a time."""
    monkeypatch.setattr(toxicity, "HASH_BITS", 6)
    monkeypatch.setattr(toxicity, "L1", 0.4)
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(60):
        slots = np.unique(rng.integers(0, 64, rng.integers(0, 9)))
        rows.append((np.append(slots, 64).astype(np.int32), int(3 in slots or 7 in slots or rng.random() < 0.1)))
    at, weights = toxicity.fit(rows)
    z, n = dict.fromkeys(range(65), 0.0), dict.fromkeys(range(65), 0.0)

    def weight(i):
        if i != 64 and abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(rows)):
            slots, label = rows[k]
            own = {int(i): weight(int(i)) for i in slots}
            g = 1 / (1 + np.exp(-sum(own.values()))) - label
            for i, w in own.items():
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
                z[i] += g - sigma * w
                n[i] += g * g
    want = {i: weight(i) for i in range(65) if i == 64 or abs(z[i]) > toxicity.L1}
    assert dict(zip(at.tolist(), weights)).keys() == want.keys() and len(want) < 65
    assert np.allclose(weights, [want[i] for i in at.tolist()])


def test_one_id_with_two_texts_trains_the_same_whatever_the_order(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["good", "fine", "nice"], k=8)) + (" bad" if i % 2 else "")) for i in range(40)]
    rows += [(i, "other text bad bad") for i in range(10)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = [toxicity.train(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels)
           for r, n in ((rows, 1), (rows[::-1], 4), (sorted(rows, key=str), 3))]
    assert got[0] == got[1] == got[2] and got[0]


def test_neighbours_of_an_id_with_two_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [5.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 5.0), (0, 2, 3.0), (0, 3, 1.0)]
