import random
import re
from collections import Counter

from veilgraph.llm.jaccard_join import bands_for, components, expected_recall, jaccard_join
from veilgraph.store import Scratch

SCHEMA = "doc_id long, text string, c string, label string, bands int, links int, copies int"


def corpus(seed=5):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 9)) for _ in range(n))
    docs = [text(rng.randint(1, 120)) for _ in range(40)]
    for _ in range(6):
        base = text(rng.randint(60, 200)).split()
        for _ in range(rng.randint(2, 14)):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = "zz"
            docs.append(" ".join(words).upper() if rng.random() < 0.3 else ",".join(words))
    docs += ["", None, "one", "one", "One!", "two words", "...", "..."]
    rows = [(i, x, "clash", "clash", 1, 2, 3) for i, x in enumerate(docs)]
    return [*rows, rows[50], (None, "no id at all", None, None, None, None, None)]


def sets_of(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets, up, links = [sets_of(r[1]) for r in rows], list(range(len(rows))), Counter()

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i), []).append(r[0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return Counter((r[0], least[top(i)], links[i], len(sets[i])) for i, r in enumerate(rows))


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for limit, shingles in ((1024, 1 << 23), (4, 1 << 23), (1024, 300)):  # buckets are dealt out in blocks by count, by size
        got = Counter((r["id"], r["class_id"], r["n_links"], r["n_shingles"]) for r in jaccard_join(df, bucket_limit=limit, bucket_shingles=shingles).collect())
        assert got == brute(rows)


def test_hundreds_of_equal_rows(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split())
    hot = [word() for _ in range(60)]
    near = [*hot[:59], "other"]
    rows = [(7, " ".join(hot))] * 300 + [(None, " ".join(hot))] * 40 + [(8, " ".join(near)), (9, " ".join(word() for _ in range(50)))]
    found = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), bucket_limit=16).collect()
    assert len(found) == len(rows)
    links = {(r.id, r.n_links) for r in found}
    assert links == {(7, 340), (None, 340), (8, 340), (9, 0)}


def test_empty_table(spark):
    assert jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_band_choice_reaches_recall():
    bands, rows = bands_for(0.8, 0.999)
    assert expected_recall(0.8, bands, rows) >= 0.999 > expected_recall(0.8, 128 // (rows + 1), rows + 1)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(bytes([i + 1]), bytes([i])) for i in range(40)] + [(bytes([99]), bytes([98]))], "c binary, root binary")
    got = {bytes(r["c"]): bytes(r["label"]) for r in components(edges, Scratch(spark)).collect()}
    assert got == {bytes([i]): bytes([0]) for i in range(41)} | {bytes([99]): bytes([98]), bytes([98]): bytes([98])}
