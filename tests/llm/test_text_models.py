import random
import zlib

import pyarrow as pa

from veilgraph.llm.cross_parse import Parser, SuffixAutomaton, identify, learn
from veilgraph.llm.quality import fit, score, score_quality, train

PIECES = {"xx": ["ba", "do", "ki", "ul"], "yy": ["schr", "ung", "öl", "ba"], "zz": ["ción", "que", "ña", "do"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PIECES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents():
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randint(3, 80)), lang, "s") for i, lang in enumerate(rng.choices(sorted(PIECES), k=300))]
    return [*rows, (900, None, "xx", None), (901, "", "xx", None), (902, "12 34 !!", "yy", None), (903, rows[1][1], None, None), (None, rows[2][1], None, None), rows[3], (904, "word " * 30_000, None, None)]


def test_suffix_automaton_knows_exactly_the_substrings():
    rng = random.Random(2)
    seq = [rng.randint(0, 2) for _ in range(60)]
    automaton = SuffixAutomaton(seq)
    subs = {tuple(seq[i:j]) for i in range(60) for j in range(i + 1, min(61, i + 7))}
    for _ in range(500):
        probe = tuple(rng.randint(0, 2) for _ in range(rng.randint(1, 6)))
        s = 0
        for c in probe:
            s = automaton.following[s].get(c) if s is not None else None
        assert (s is not None) == (probe in subs)


def test_phrases_match_a_plain_greedy_parse():
    rng = random.Random(3)
    sample = "ab ba abba bab aab"
    parser = Parser((("xx", sample), ("yy", "bbbb bab")))
    for _ in range(60):
        probe = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 40)))
        words = " ".join(probe.split(" ")) if probe else probe
        while "  " in words:
            words = words.replace("  ", " ")
        for own, cost, bits in zip((sample, "bbbb bab"), parser.cost, parser.bits([words])[0], strict=True):
            count, i = 0, 0
            while i < len(words):
                n = 0
                while i + n < len(words) and words[i : i + n + 1] in own:
                    n += 1
                i += max(1, n)
                count += 1
            assert abs(bits[0] - count * cost / max(1, len(words))) < 1e-9


def test_held_out_accuracy_and_cases(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string, id string")
    got = identify(docs, learn(docs)).collect()
    assert len(got) == len(documents())
    by = {r["id"]: r for r in got}
    for i in (900, 901, 902):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    held = [r for r in documents() if r[0] is not None and r[0] < 300 and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 20
    assert sum(by[r[0]]["lang_pred"] == r[2] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert learn(docs) == ()
    assert identify(docs, ()).first()["lang_pred"] == "und"
    assert identify(docs.limit(0), learn(docs)).count() == 0


def quality_rows():
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        body = text(rng, "xx", rng.randint(5, 60))
        docs.append((i, body if good else body.replace(" ", "*** "), "a", 0.1))
        labels.append((i, int(good), 0))
    return docs, labels


def test_quality_on_held_out_rows(spark):
    docs, labels = quality_rows()
    extra = [(1000, None, "", 0.0), (1001, "", None, None), (1001, "", None, None), (None, "text", "", 1.0)]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, row string, score double")
    lab = spark.createDataFrame([*labels, (2000, 1, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = score_quality(df, train(df, lab)).select("row.doc_id", "row.row", "score").collect()
    assert len(got) == len(docs) + 4
    by = {r["doc_id"]: r["score"] for r in got}
    held = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((by[i] >= 0.5) == bool(q) for i, q in held) >= 0.97 * len(held)
    assert by[1000] == by[1001] and all(0 <= s <= 1 for s in by.values())


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels = quality_rows()
    df = spark.createDataFrame(docs, "doc_id long, text string, row string, score double")
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    one, two = (train(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned))
    assert (one.weights == two.weights).all() and one.bias == two.bias


def test_no_labels_score_one_half():
    model = fit([], [])
    assert score(model, pa.array(["a", None], pa.string())).tolist() == [0.5, 0.5]
