"""HTML entities as Column expressions, against the standard library."""

import random
from html import unescape
from html.entities import html5

from evalloom.functions.docs import html_unescaped


def test_against_the_standard_library(spark):
    rng = random.Random(6)
    names = [*html5, "unknown;", "ampx", "notit;", "notin;", "#65;", "#x41", "#X1F600;", "#0;", "#x80;", "#128", "#55296;", "#1114112;", "#11;",
             "#xFFFF;", "#99999999999999999;", "#xFDD0;", "#13;", "#;", "#x;", "", " ", ";"]
    texts = ["", None, "no entity", "&", "&&amp;", "a & b", "&amp;lt;", "&copy2024", "&#38;#38;"]
    texts += ["&" + n for n in names] + ["x&" + n + "y" for n in names]
    texts += ["".join(rng.choice(["&" + rng.choice(names), "text ", ";", "&", "é"]) for _ in range(9)) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8).select("t", html_unescaped("t").alias("u"))
    assert "EvalPython" not in df._jdf.queryExecution().optimizedPlan().toString()
    wrong = [(r.t, r.u) for r in df.collect() if r.u != (None if r.t is None else unescape(r.t))]
    assert not wrong, wrong[:10]
