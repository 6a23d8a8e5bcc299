"""Vector codes, spelling variants and exact dedup against brute force, with the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgraph.llm.annular_codes import Book, compress, nearest
from veilgraph.llm.digest_index import digest_index, exact_dedup, looked_up, perfect_levels, slots_of
from veilgraph.llm.spelling import spelling_variants, word_counts

LOWER = {i: i + 32 for i in range(65, 91)}


# ---- op 11 ----


def plain_codes(rows, entries=256, rounds=4, parts=4):
    kept = sorted(((i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: r[0])
    size = len(kept[0][1]) // parts
    cut = [[v[p * size : (p + 1) * size] for _, v, _ in kept] for p in range(parts)]
    books = [[list(x) for x in cut[p][:entries]] for p in range(parts)]

    def assigned(p):
        return [min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p])) for x in cut[p]]

    for _ in range(rounds):
        for p in range(parts):
            found = assigned(p)
            for k in range(len(books[p])):
                mine = [x for x, (_, j) in zip(cut[p], found, strict=True) if j == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [assigned(p) for p in range(parts)]
    error = {r[0]: sum(last[p][i][0] for p in range(parts)) for i, r in enumerate(kept)}
    by_label = defaultdict(int)
    for i, _, label in kept:
        by_label[label] += error[i]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return {i: ("".join(f"{last[p][k][1]:02x}" for p in range(parts)), error[i], by_label[label], sha) for k, (i, _, label) in enumerate(kept)}


def coded(df, **more):
    return {r.id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in compress(df, **more).collect()}


def test_codes_match_plain_loops(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 3) for _ in range(8)], rng.choice([None, 0, 0, 0, 1])) for i in rng.sample(range(1000), 120)]
    rows += [(2000 + i, rows[0][1], 0) for i in range(40)]  # copies, and ties between equal entries
    rows += [(3000, None, 1), (3001, [1.0, None] + [0.0] * 6, 1), (3002, [float("nan")] * 8, 1), (3003, [float("inf")] + [0.0] * 7, None), (3004, [0.0] * 8, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    for entries, rounds in ((256, 4), (9, 3), (1, 1)):
        assert coded(df, entries=entries, rounds=rounds) == plain_codes(rows, entries, rounds)


def test_huge_components_are_exact_and_other_lengths_get_no_code(spark):
    rows = [(1, [1e13, 2.0, 3.0, 4.0], None), (2, [5.0, -6e12, 7.5, 0.1], 1), (6, [-0.001, 2.0, 3.0, 4.0], None), (7, [9.0, 2.0, 3.0, 1e12], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = plain_codes(rows, 2, 2)
    got = coded(df, entries=2, rounds=2)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == (want[k][1] if want[k][1] < 2**63 else None) for k in want)
    odd = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1), (2, [], 2), (3, [1.0, 2.0, 3.0, 4.0], 5)], "vec_id long, embedding array<double>, label int")
    found = {r.id: (r.code, r.error, r.label_error) for r in compress(odd).collect()}
    assert found == {1: (None, None, None), 2: (None, None, None), 3: ("00000000", 0, 0)}
    assert compress(odd.limit(0)).collect() == []
    assert compress(odd.filter("vec_id < 3")).select("codebooks_sha256").distinct().collect() == [(None,)]
    with pytest.raises(ValueError, match="entries"):
        compress(odd, entries=257)


def test_only_the_annulus_is_searched_and_its_ends_count():
    rng = np.random.default_rng(1)
    entries = rng.integers(-50, 50, (200, 4)).astype(float) * (1 + np.arange(200)[:, None] % 7)
    rows = np.vstack([rng.integers(-300, 300, (2000, 4)), np.zeros((1, 4)), entries[:20]]).astype(float)
    number, least = nearest(rows, Book.of(entries))
    all_ = ((rows[:, None, :] - entries) ** 2).sum(axis=2)
    assert (least == all_.min(axis=1)).all() and (number == all_.argmin(axis=1)).all()
    # on a line through zero the nearest entry lies exactly at an end of the interval
    line = Book.of(np.array([[0.0], [10.0], [-10.0], [20.0]]))
    assert nearest(np.array([[5.0], [15.0], [-5.0]]), line)[0].tolist() == [0, 1, 0]


# ---- op 12 ----


def plain_variants(rows, least=5):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            if d is not None and (h := zlib.crc32(f"{d}:{w}".encode())) % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return plain_forms({w: n for w, n in counts.items() if len(w) >= 6 and n >= least})


def plain_forms(words):
    shapes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shapes[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            near[w] |= shapes[w[:i], w[i + 1 :]] - {w}
            short = w[:i] + w[i + 1 :]
            if short in words:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 5 * words[w]:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def variants(words, **more):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(words, **more).collect()}


def test_variants_of_texts_match_brute_force(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abéß") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["internation", "Internations"]
    often = ["internation", "abéabéß"] * 100
    rows = [(i, " ".join(rng.choice(stems + often) for _ in range(rng.randint(0, 80)))) for i in range(150)]
    rows += [(None, "internation internatiom internatiom x"), (7, None), (8, ""), (9, "-.-"), (10, "a" * 5000 + " " + "a" * 4999), (11, "×÷ÀabĀcdefgh")] + [(12, "aaaaaa Aaaaaab")] * 6
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).repartition(5)
    want = plain_variants(rows)
    assert sum(1 for v in want.values() if v[0]) > 0
    assert variants(word_counts(df)) == want
    assert variants(word_counts(df), cell_limit=2, shard_cells=10) == want


def test_a_hot_half_is_lengthened_and_loses_no_pair(spark):
    rng = random.Random(4)
    words = {"interest" + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 7))) for _ in range(700)} | {"b" * k for k in range(6, 40)}
    words = {w: rng.choice([5, 6, 30, 200, 5000]) for w in words}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = plain_forms(words)
    assert max(v[3] for v in want.values()) > 5
    assert variants(df) == variants(df, cell_limit=8, shard_cells=64) == want


def test_chains_of_forms_end_at_the_last_and_rare_words_and_nulls_are_left_out(spark):
    chain = ["aaaaaa" + "b" * k for k in range(9)]
    rows = [(w, 5 * 5**k) for k, w in enumerate(chain)] + [("aaaaac", 4), (None, 50)]
    got = variants(spark.createDataFrame(rows, "word string, n long"))
    assert set(got) == set(chain) and {v[1] for v in got.values()} == {chain[-1]}
    assert variants(spark.createDataFrame([], "word string, n long")) == {}
    with pytest.raises(ValueError, match="cell_limit"):
        spelling_variants(spark.createDataFrame([], "word string, n long"), cell_limit=1)


# ---- op 13 ----


def test_perfect_hash_gives_each_digest_its_own_slot():
    words = np.array([np.frombuffer(hashlib.sha256(str(i).encode()).digest(), "<u8") for i in range(5000)])
    sizes, bits, slot = perfect_levels(words)
    assert sorted(slot) == list(range(5000)) and (slots_of(words, sizes, bits) == slot).all()
    none = perfect_levels(words[:0])
    assert none[0] == [] and (slots_of(words[:3], none[0], none[1]) == -1).all()


@pytest.mark.parametrize("shard", [4096, 7])
def test_groups_match_brute_force(spark, shard):
    rows = [(1, "Ab", 1), (2, "aB", 2), (2, "ab", 3), (None, None, 4), (7, "", 5), (3, "É", 6), (4, "é", 7), (None, "x", 8), (None, "X", 9), (5, "ab ", 1), (6, "y" * 200_000, 1), (8, "Y" * 200_000, 1)]
    rows += [(i, "hot" if i % 3 else f"w{i // 2}", 0) for i in range(100, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int").withColumn("place", F.lit("clash")).repartition(6)
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[hashlib.sha256((t or "").translate(LOWER).encode()).digest()].append(d)
    for past in (None, F.lit(True), F.lit(False), F.col("doc_id") < 300):
        found = exact_dedup(docs, past, shard_digests=shard, carry=["digest", "place"]).collect()
        assert len(found) == len(rows)
        stay = Counter()
        for r in found:
            own = groups[bytes(r.digest)]
            assert r.group_size == len(own) and r.keep_id == max((i for i in own if i is not None), default=None)
            assert not r.kept or r.id == r.keep_id
            stay[bytes(r.digest)] += r.kept
        assert stay == Counter(groups.keys())
    assert exact_dedup(docs.limit(0)).collect() == []


def test_members_are_told_by_all_bytes_of_their_digest(spark):
    digest = [hashlib.sha256(str(i).encode()).digest() for i in range(400)]
    near = [d[:31] + bytes([d[31] ^ 1]) for d in digest[:100]]  # other digests that reach the same slots
    kind = "shard long, digest binary, winner struct<id: long, place: long>, n long"
    past = spark.createDataFrame([(0, d, (i, i), 1) for i, d in enumerate(digest[:200])], kind)
    batch = spark.createDataFrame([(0, d, (1000 + i, i), 2) for i, d in enumerate(digest[100:300])] + [(0, d, (5, 5), 1) for d in near], kind)
    found = {bytes(r.digest): (r.member, r.n, r.winner.id) for r in looked_up(batch, digest_index(past)).collect()}
    assert len(found) == 400
    assert all(found[d] == (True, 3, 1000 + i) for i, d in enumerate(digest[100:200]))
    assert all(found[d] == (False, 2, 1100 + i) for i, d in enumerate(digest[200:300]))
    assert all(found[d][0] is False for d in near) and all(found[d] == (False, 1, i) for i, d in enumerate(digest[:100]))
