"""Languages and qualities are learned from every letter and from whole texts."""

import random

from veilgraph.llm.cross_parse import Parser, identify, learn
from veilgraph.llm.quality import score_quality, train


def test_letters_beyond_the_commonest_are_told_apart():
    rng = random.Random(5)
    common = "".join(map(chr, range(0x61, 0x7B))) + "".join(map(chr, range(0x3B1, 0x3C0))) + "".join(map(chr, range(0x430, 0x450)))
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    one, two = [word([chr(0x4E00 + i) for i in range(200)], 2) for _ in range(80)], [word([chr(0x5E00 + i) for i in range(200)], 2) for _ in range(80)]
    samples = (("common", " ".join(word(common, 6) for _ in range(500))), ("one", "".join(one * 3)), ("two", "".join(two * 3)))
    parser = Parser(samples)
    texts = ["".join(rng.choice(own) for _ in range(12)) for own in (one, two) for _ in range(30)]
    assert parser.predict(texts)[0] == ["one"] * 30 + ["two"] * 30
    texts += [word(common + "".join(one) + "".join(two) + " ", 40).strip() for _ in range(30)] + [samples[0][1][:50].strip()]
    bits = parser.bits(texts)[0]
    for at, text in enumerate(texts):
        text = " ".join(text.split())
        for own, cost, got in zip((s for _, s in samples), parser.cost, bits[:, at], strict=True):
            count, i = 0, 0
            while i < len(text):
                n = 0
                while i + n < len(text) and text[i : i + n + 1] in own:
                    n += 1
                i += max(1, n)
                count += 1
            assert abs(got - count * cost / len(text)) < 1e-9


def test_languages_behind_a_shared_opening_and_of_short_texts(spark):
    rng = random.Random(6)
    opening = "the same opening stands before every document of this corpus and says nothing " * 8
    words = {"aa": ["bado", "kiul", "domi"], "bb": ["schrung", "ölig", "keit"]}
    own = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, opening + own(lang, 300), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    rows += [(1000 + i, "юж " + "эф"[i % 2] * 3, "cc") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = learn(docs)
    assert [lang for lang, _ in samples] == ["aa", "bb", "cc"]
    assert all(len(s) <= 512 * 65 for _, s in samples)
    whole = "\n".join(t for _, t, _ in rows)
    assert all(t in whole for _, s in samples for t in s.split("\n"))
    asked = [(i, own(lang, 4), lang) for i, lang in enumerate(["aa", "bb"] * 10)] + [(50, "ююж эээ", "cc")]
    got = {r["id"]: r["lang_pred"] for r in identify(spark.createDataFrame(asked, "doc_id long, text string, lang string"), samples).collect()}
    assert got == {i: lang for i, _, lang in asked}


def test_quality_is_learned_from_the_end_of_long_texts_too(spark):
    rng = random.Random(7)
    clean = lambda n: " ".join(rng.choice(["bado", "kiul", "domi", "ulki"]) for _ in range(n))
    labels = [(i, i % 2) for i in range(120)]
    docs = [(i, clean(4200) + (" fine" if good else " ***") * 2000) for i, good in labels]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = train(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r["row"]["doc_id"]: r["score"] >= 0.5 for r in score_quality(df, model).collect()}
    assert got == {i: bool(good) for i, good in labels}


def test_labels_of_absent_documents_take_no_place(spark):
    docs = spark.createDataFrame([(i, "bado kiul" + ("" if i % 2 else " ***")) for i in range(60)], "doc_id long, text string")
    own = spark.range(60).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    absent = spark.range(1000, 6000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    one, two = train(docs, own, max_rows=100), train(docs, own.union(absent), max_rows=100)
    assert one.bias != 0 and (one.weights == two.weights).all() and one.bias == two.bias


def test_a_language_is_learned_from_long_texts_and_short_ones(spark):
    rng = random.Random(4)
    long_text = " ".join(rng.choice(["kana", "moku", "tiri"]) for _ in range(40_000))  # 200 000 characters
    short = [" ".join(rng.choice(["schrung", "keit", "zungs"]) for _ in range(40)) for _ in range(400)]
    from veilgraph.llm.cross_parse import held_out

    rows = [(i, t, "both") for i, t in enumerate([*short, long_text, long_text[5:]])] + [(10_000, "zz", "tiny"), (10_001, "xy", "tiny"), (10_002, "xz", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = {r.doc_id for r in docs.filter(~held_out()).select("doc_id").collect()}
    got = dict(learn(docs))
    pieces = got["both"].split("\n")
    assert len(pieces) == 512 and all(len(p) <= 64 for p in pieces)
    assert left & {400, 401}
    assert 20 < sum("kana" in p or "moku" in p for p in pieces) and 20 < sum("schrung" in p or "keit" in p for p in pieces)
    assert sorted(got["tiny"].split("\n")) == sorted(t for i, t, lang in rows if lang == "tiny" and i in left)


def test_any_number_of_languages_is_learned(spark):
    many = spark.range(1500).selectExpr("id as doc_id", "repeat(concat('text', id % 300, ' '), 100) as text", "concat('l', id % 300) as lang")
    got = dict(learn(many, most_pieces=3000))
    assert len(got) == 300 and all(len(s.split("\n")) == 10 for s in got.values())


def test_fit_and_score_match_plain_loops():
    """Logistic regression by follow-the-regularised-leader, one text at a time, over plain dicts."""
    import math

    import pyarrow as pa

    from veilgraph.llm._text import buffer_of
    from veilgraph.llm.quality import _ngrams, fit, score

    rng = random.Random(9)
    texts = [" ".join(rng.choice(["bado", "kiul", "***", "12", "domi", "!"]) for _ in range(rng.randint(0, 12))) for _ in range(40)]
    labels = [int("***" not in t) for t in texts]
    bits, gain, alpha, beta, l1, l2, epochs = 10, 24.0, 0.3, 1.0, 0.002, 0.05, 3
    model = fit(texts, labels, bits=bits, gain=gain, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs)
    grams = lambda t: _ngrams(*buffer_of(pa.array([t], pa.string())), bits)[0].tolist()
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    def features(t):
        own, x = grams(t), {}
        for g in own:
            x[g] = x.get(g, 0.0) + gain / len(own)
        return x | {"bias": 1.0}

    for _ in range(epochs):
        for t, y in zip(texts, labels, strict=True):
            x = features(t)
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                new = n.get(i, 0.0) + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(new) - math.sqrt(n.get(i, 0.0))) / alpha * w[i]
                n[i] = new
    assert abs(model.bias - weight("bias")) < 1e-9
    assert all(abs(model.weights[i] - weight(i)) < 1e-6 for i in range(1 << bits))
    asked = [*texts, "", None, "bado *** neu"]
    want = [1 / (1 + math.exp(-sum(weight(i) * v for i, v in features(t or "").items()))) for t in asked]
    assert all(abs(a - b) < 1e-5 for a, b in zip(score(model, pa.array(asked, pa.string())), want, strict=True))


def test_the_sample_of_labels_is_bounded_in_rows_and_characters(spark):
    docs = spark.createDataFrame([(i, "bado kiul " * 50) for i in range(200)], "doc_id long, text string")
    labels = spark.range(200).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    from veilgraph.llm.quality import sample

    assert len(sample(docs, labels, max_rows=30, max_chars=10**9)) == 30
    assert len(sample(docs, labels, max_rows=1000, max_chars=5000)) == 10
    assert len(sample(docs, labels, max_rows=1000, max_chars=10)) == 1


def test_a_language_of_one_text_many_times_is_learned(spark):
    alike = spark.range(30_000).selectExpr("0L as doc_id", "'kana moku' as text", "'aa' as lang")
    other = spark.range(9000).selectExpr("id as doc_id", "concat('schr', id % 7, 'ung ', id) as text", "'bb' as lang")
    got = dict(learn(alike.union(other)))
    assert set(got) == {"aa", "bb"} and got["aa"].split("\n") == ["kana moku"] * 512 and len(got["bb"]) > 5000
