"""Offsets and balanced braces as Column expressions, against Python."""

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from evalloom.functions import filters as fl
from evalloom.functions.text import located_words, prefix_sums
from evalloom.operators import decontam as dc
from evalloom.operators import rollup as rp


def has_python(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any(word in plan for word in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000])
def test_prefix_sums(spark, n):
    values = [random.Random(n).randrange(-5, 10**10) for _ in range(n)]
    df = spark.createDataFrame([(values,), (None,)], "v array<long>").select(prefix_sums(F.col("v")).alias("s"))
    got = [r.s for r in df.collect()]
    assert got[0] == [sum(values[: i + 1]) for i in range(n)] and not got[1]


def test_located_words(spark):
    texts = [
        "One, two!  ... three-FOUR\n\n é x", "", None, "...", "  lead", "trail  ", "\U0001F600 a \U0001F600b", "w " * 3000,
    ]
    drop = str.maketrans("", "", string.punctuation)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    located = df.select("doc_id", located_words("text").alias("w"))
    assert not has_python(located) and not has_python(dc.ngram_spans(df, 2))
    for r in located.collect():
        want = [(m.group().lower().translate(drop), *m.span()) for m in re.finditer(r"\S+", texts[r.doc_id] or "")]
        assert [tuple(x) for x in r.w or []] == [x for x in want if x[0]]
    assert dc.ngram_spans(df, 2).where("doc_id = 7").count() == 2999


def test_boxed(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices(["\\boxed{", "\\fbox{", "{", "}", "x", "\\boxed ", "$"], (3, 1, 2, 5, 2, 0.3, 1), k=14)) for _ in range(400)]

    def plain(s):
        if "\\boxed " in s:
            return "\\boxed " + s.rsplit("\\boxed ", 1)[1].partition("$")[0]
        begin = s.rfind("\\boxed") if "\\boxed" in s else s.rfind("\\fbox")
        depth = 0
        for m in re.finditer(r"[{}]", s[begin:]) if begin >= 0 else ():
            depth += 1 if m.group() == "{" else -1
            if depth == 0:
                return s[begin : begin + m.end()]
        return None

    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", fl.last_boxed(F.col("t")).alias("b"))
    assert not has_python(df)
    for r in df.collect():
        assert r.b == (None if r.t is None else plain(r.t)), r.t


def test_report_is_the_union_of_its_levels(spark):
    metrics = spark.createDataFrame(
        [(f"t{i}", m, f, i * 1.5, 0.1 * i, i + 2) for i in range(6) for m in ("acc", "em") for f in ("none", "x")],
        "task string, metric string, filter string, value double, stderr double, n long",
    )
    members = spark.createDataFrame([(g, f"t{i}") for g, i in (("a", 0), ("a", 1), ("b", 1), ("b", 2), ("c", 5))], "group string, task string")
    report = rp.group_report(metrics, members)
    single = rp.group_metrics(metrics, members)
    whole = rp.group_metrics(metrics, members.withColumn("group", F.lit("all")))
    key = ["group", "metric", "filter", "value", "stderr", "n"]
    rows = lambda df: sorted((tuple(r) for r in df.select(*key).collect()), key=repr)
    assert rows(report.where("level = 0")) == rows(single)
    assert rows(report.where("level = 1").withColumn("group", F.lit("all"))) == rows(whole)
