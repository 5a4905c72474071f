"""The audit of filter orders against counting documents one by one."""

import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import filter_audit


def plain_fails(rows):
    """Set of failed filters per (id, text)."""
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words)}
        fails["C"] = 100 * len(re.findall("[A-Z]", t)) > 10 * len(t)
        fails["D"] = bool(re.search(r"[#$%&*|]", t))
        fails["E"] = i is not None and i > min(texts[t])
        out.append({k for k, v in fails.items() if v})
    return out


def plain_audit(rows):
    """Rows of (part, failed filters, good, toxic) to the audit."""
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [r for r in left if name in r[0]]
                left = [r for r in left if name not in r[0]]
                failing = sum(name in r[0] for r in mine)
                removed_by[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(r[0] == {name} for r in mine),
                    sum(r[1] for r in gone), sum(r[2] for r in gone), name,
                ]
        for (p, *_), values in out.items():
            if p == part:
                values[-1] = removed_by[values[-1]]
    return {k: tuple(v) for k, v in out.items()}


def found(frame):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in frame.collect()}


def test_odd_rows(spark):
    many = " ".join(f"w{i}" for i in range(120))
    rows = [
        (1, many, "en"), (2, many, "de"), (3, many.upper(), "en"), (4, many + " $", "en"), (5, None, None), (6, "", "en"), (7, "", None),
        (8, "a " * 50_000, "en"), (9, "É \U0001F600 " * 60, "en"), (None, many, "en"), (None, None, "de"), (10, "AB", ""),
        (11, "A" + "b" * 9, "x"), (12, "A" * 2 + "b" * 17, "x"), (11, "A" + "b" * 9, "x"), (13, "a\x0bb\x1cc d", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("mask", F.lit("clash")).withColumn(
        "id", F.lit(1)).withColumn("a.b", F.lit(2))
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, None, 1), (8, 1, 1), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int"
    ).withColumn("part", F.lit("clash"))
    good, toxic = {1, 2, 8}, {2, 5, 8}
    fails = plain_fails([(i, t) for i, t, _ in rows])
    expected = plain_audit([(lang or "", f, i in good, i in toxic) for (i, _, lang), f in zip(rows, fails)])
    assert found(filter_audit.filter_audit(docs, labels)) == expected
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    assert filter_audit.filter_audit(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


@pytest.mark.parametrize("filters", [1, 3, 6])
def test_walk_over_all_subsets(filters):
    rng = np.random.default_rng(filters)
    masks = np.arange(1 << filters)
    counts = rng.integers(0, 50, (len(masks), 3))
    states = filter_audit.survivors(masks, counts, filters)
    for active in range(1 << filters):
        assert (states[active] == counts[masks & active == 0].sum(axis=0)).all()


def test_other_number_of_filters(spark):
    counts = spark.createDataFrame([("p", 3, 5, 1, 0), ("p", 0, 2, 2, 2)], "part string, mask int, n long, good long, toxic long")
    rows = found(filter_audit.audit(counts, "xy"))
    assert rows == {
        ("p", "xy", 1): (2, 5, 0, 0, 1, 0, 5), ("p", "xy", 2): (2, 0, 5, 0, 0, 0, 5),
        ("p", "yx", 1): (2, 5, 0, 0, 1, 0, 5), ("p", "yx", 2): (2, 0, 5, 0, 0, 0, 5),
    }
