"""The pipeline's stages on a corpus with planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P


def test_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ba", "do", "ki", "ul", "öm"]) for _ in range(rng.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    clean = {i: text(rng.randint(20, 120)) for i in range(60)}
    near = clean[5].split()
    near[3] = "changed"
    shared, item = text(70), text(25)
    docs = [(i, t, "en", "s", len(t)) for i, t in clean.items()]
    docs += [(100 + i, clean[i], "en", "s", 1) for i in range(3)]  # exact copies
    docs += [(200, " ".join(near + text(0).split()) if len(near) > 200 else " ".join(clean[5].split() + ["more"]), "en", "s", 1)]
    docs += [(300 + i, f"{text(30)} {shared} {text(30)}", "en", "s", 1) for i in range(2)]
    docs += [(400, f"{text(40)} {item} {text(40)}", "en", "s", 1), (401, item, "en", "s", 1)]
    docs += [(500 + i, text(60).replace(" ", "*** ") + "***", "en", "s", 1) for i in range(30)]
    docs += [(600, None, None, None, None), (601, "", None, None, 0), docs[7]]
    base = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("carried", F.lit("x")).repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(d[0], int(not 500 <= d[0] < 600), 0) for d in docs if d[0] < 600], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    df, kept = spark.read.parquet(f"{base}/documents.parquet"), {}
    columns = df.columns
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, df, base)
        out.write.parquet(f"{base}/{name}")
        df = spark.read.parquet(f"{base}/{name}")
        if k < len(P.STAGES) - 1:
            assert df.columns == columns
            kept[name] = {r.doc_id: r.text for r in df.collect()}
    q = kept["quality"]
    assert not [i for i in q if 500 <= i < 530] and all(i in q for i in (*clean, 100, 101, 102, 300, 301, 400))
    n = kept["near_duplicates"]
    assert not {100, 101, 102, 200} & set(n) and all(i in n for i in clean)
    r = kept["repeated_substrings"]
    assert shared not in r[300] and shared not in r[301] and all(r[i] == clean[i] for i in clean)
    b = kept["benchmark_leaks"]
    assert item not in b[400] and 401 not in b and all(b[i] == clean[i] for i in clean)
    pieces = df.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {p.doc_id for p in pieces} == set(b) and all(p.n == p.m for p in pieces)
    assert P.run(spark, base).count() == df.count()


def test_stages_on_an_empty_corpus(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    assert P.run(spark, base).count() == 0


def corpus_rows(rng):
    word = lambda: "".join(rng.choice(["ba", "do", "ki", "ul", "öm", "ré"]) for _ in range(rng.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, item = text(60), text(14)
    base = [text(rng.randint(1, 90)) for _ in range(40)]
    good = [*base, *base[:6], *(b.replace(" ", "  ", 1).upper() for b in base[6:9])]
    good += [" ".join(w if rng.random() > 0.03 else "other" for w in b.split()) for b in base[9:20]]
    good += [f"{text(rng.randint(0, 20))} {passage} {text(rng.randint(0, 30))}" for _ in range(5)] + [f"{text(30)} {item} {text(8)}", f"{text(2)} {item}", item.title(), passage]
    rows = [(i, t) for i, t in enumerate(good)] + [(1000 + i, text(40).replace(" ", "*** ") + "***") for i in range(40)]
    rows += [rows[3], (None, good[4]), (2000, None), (2001, ""), (2002, "…")]
    return rows, [(1, item), (2, text(20)), (3, None)]


def test_every_stage_matches_brute_force(spark, tmp_path):
    """Each stage's rows from its own input, worked out with all pairs and all windows."""
    import zlib
    from collections import Counter

    import numpy as np
    from test_exact_ops import words
    from test_jaccard import sets_of
    from test_repeats import cover
    from tokenizers import Tokenizer

    rows, items = corpus_rows(random.Random(31))
    base = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    docs.write.parquet(f"{base}/documents.parquet")
    labels = spark.createDataFrame([(i, int(not 1000 <= i < 2000), 0) for i, _ in rows if i is not None and i < 2000], "doc_id long, quality int, toxic int").dropDuplicates(["doc_id"])
    labels.write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    given = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    stage = dict(P.STAGES)
    written = lambda name, df: (df.write.parquet(f"{base}/{name}"), spark.read.parquet(f"{base}/{name}"))[1]

    one = written("one", stage["quality"](spark, spark.read.parquet(f"{base}/documents.parquet"), base))
    got = Counter(given(one))
    assert got - Counter(rows) == Counter() and not [i for i, _ in got if i is not None and 1000 <= i < 2000]
    assert Counter(r for r in rows if r[0] is not None and r[0] < 1000) - got == Counter()

    before = given(one)
    two = written("two", stage["near_duplicates"](spark, one, base))
    distinct = sorted(set(before), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    sets = [sets_of(t) for _, t in distinct]
    top = list(range(len(distinct)))
    for i in range(len(distinct)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((top[i], top[j]))
                top = [a if t == b else t for t in top]
    classes = {}
    for i, t in enumerate(top):
        classes.setdefault(t, []).append(distinct[i])
    kept = Counter(given(two))
    assert sum(kept.values()) == len(classes) and all(sum(kept[r] for r in members) == 1 for members in classes.values())
    assert all(kept[min(members, key=lambda r: r[0])] == 1 for members in classes.values() if all(i is not None for i, _ in members) and len({i for i, _ in members}) == len(members))

    before = given(two)
    three = written("three", stage["repeated_substrings"](spark, two, base))
    raw = [(t or "").encode() for _, t in before]
    left = [bytes(b for b, x in zip(s, hit) if not x) for s, hit in zip(raw, cover(raw, 200))]
    assert Counter(given(three)) == Counter((i, k.decode("utf-8", "ignore")) for (i, _), s, k in zip(before, raw, left) if k or not s)

    before = given(three)
    four = written("four", stage["benchmark_leaks"](spark, three, base))
    windows = {tuple(words(t)[k : k + 10]) for _, t in items if words(t) for k in range(max(1, len(words(t)) - 9))}
    want = Counter()
    for i, t in before:
        w, hit = words(t), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if len(hit) <= P.MOST_COVERED * len(w):
            want[i, b" ".join(x for k, x in enumerate(w) if k not in hit)] += 1
    assert Counter((i, b" ".join(words(t))) for i, t in given(four)) == want and sum(want.values()) < len(before)

    five = stage["packing"](spark, four, base).collect()
    coder = Tokenizer.from_file(P.tokenizer_path())
    pieces = Counter((r.doc_id, r.start, r.length, r.doc_tokens, r.ids_crc32) for r in five)
    want = Counter()
    lengths = {(r.doc_id, r.doc_tokens): [] for r in five}
    for r in five:
        lengths[r.doc_id, r.doc_tokens].append((r.start, r.length))
    for i, t in given(four):
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 1]
        for start, length in set(lengths[i, len(ids)]):
            want[i, start, length, len(ids), zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += 1
        assert sum(n for _, n in set(lengths[i, len(ids)])) == len(ids)
    assert pieces == want
