"""Discovery moves each row once for a column and not once for a set, and values that many rows share are dealt on by more columns."""

import random

from veilgraph.operators import partitions


def g3_errors(rows, left, right):
    classes = {}
    for r in rows:
        inner = classes.setdefault(tuple(r[i] for i in left), {})
        inner[r[right]] = inner.get(r[right], 0) + 1
    return sum(sum(c.values()) - max(c.values()) for c in classes.values())


def test_found_rows_stay_few_and_shared_values_are_dealt_on(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 1, 1, 1, 1, 2, i]), i // 3, rng.choice("ab"), rng.randint(0, 40)) for i in range(600)]
    table = spark.createDataFrame(rows, "a long, b long, c long, d string, e int")
    kept = []
    plain = type(table).mapInArrow

    def counted(self, *args):
        out = plain(self, *args)
        kept.append(out.count())
        return out

    monkeypatch.setattr(type(table), "mapInArrow", counted)
    for alike, combined in ((2_000_000, 1_000_000), (100, 10), (2_000_000, 10)):
        monkeypatch.setattr(partitions, "_MOST_ALIKE", alike, raising=False)
        monkeypatch.setattr(partitions, "_MOST_SENT", combined, raising=False)
        kept.clear()
        found = partitions.discover_all(table, list("abcde"), 3).collect()
        assert max(kept) <= len(rows)  # what tasks give to the shuffle: no class of each set
        got = {(r.lhs, r.rhs): (r.n, r.errors) for r in found}
        assert len(got) == 5 * 4 + 10 * 3 + 10 * 2
        for (lhs, rhs), (n, errors) in got.items():
            assert (n, errors) == (600, g3_errors(rows, ["abcde".index(x) for x in lhs.split(",")], "abcde".index(rhs))), (lhs, rhs)
