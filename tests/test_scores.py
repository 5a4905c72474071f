"""Hand-computed vectors and brute force for the score functions."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.functions import filters as fl
from evalloom.functions import instructions as it
from evalloom.functions import likelihood as lk
from evalloom.functions import textscore as ts
from evalloom.functions.text import let, multiset_overlap, words
from evalloom.operators import aggregates as ag
from evalloom.operators.rollup import erfc, safe_name


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs])


def test_accuracy_vectors(one):
    assert one(lk.acc(arr(-2.0, -1.0, -3.0), F.lit(1))) == 1.0
    both = arr(-1.0, -2.0, -3.0, -0.5, -2.0, -3.0)
    assert one(lk.acc_mutual_info(both, F.lit(1))) == 1.0
    assert one(lk.acc(F.slice(both, 1, 3), F.lit(1))) == 0.0
    assert one(lk.best_gold_likelihood(arr(-2.0, -1.0, -3.0), arr(0, 2, 99))) == -2.0
    assert one(lk.argmax(arr(1.0, 3.0, 3.0))) == 1


def test_multi_choice_fallbacks(one):
    choices = arr("alpha", "beta")
    text = fl.multi_choice_regex(arr("alpha"), choices, r"()()", ignore_case=True, ignore_punctuation=True)
    assert one(text) == ["(A)"]
    assert one(fl.multi_choice_regex(arr(": B"), choices, r"()()")) == ["(B)"]
    assert one(fl.multi_choice_regex(arr("?"), choices, r"()()")) == ["[invalid]"]


def test_regex_filter(one):
    assert one(fl.regex(arr("a #### 1,234 b #### 5."))) == ["1,234"]
    assert one(fl.regex(arr("a #### 1 b #### 5"), select=-1)) == ["5"]
    assert one(fl.regex(F.array(F.lit(None).cast("string")))) == ["[invalid]"]
    assert one(fl.majority_vote(arr("b", "a", "a", "b", "c"))) == ["b"]
    assert one(fl.take_first_k(arr("a", "b"), 1)) == ["a"]
    with pytest.raises(Exception, match="fewer than 3"):
        one(fl.take_first_k(arr("a", "b"), 3))


def test_text_filters(one):
    assert one(fl.format_span(arr("Person: Ann, none $$ place: X"))) == ["per: ann"]
    assert one(fl.final_list(F.lit("x\nFinal Answer: [a, 'b', ]"))) == ["a", "b"]
    assert one(fl.final_list(F.lit("Final Answer: [a]\nbye"))) == []
    assert one(fl.code_block(F.lit("python\nx = 1\n``` done"))) == "x = 1"
    assert one(fl.words_to_number(F.lit("Two million three hundred and five"))) == 2_000_305
    assert one(fl.last_boxed(F.lit(r"\boxed{1} and \boxed{\frac{1}{2}} end"))) == r"\boxed{\frac{1}{2}}"
    assert one(fl.unboxed(F.lit(r"\boxed{\frac{1}{2}}"))) == r"\frac{1}{2}"
    assert one(fl.last_boxed(F.lit("none"))) is None
    assert one(fl.math_answer(F.lit(r"x = \frac12 dollars"))) == r"\frac{1}{2}"
    said = "1,234 and 5.5e3 or 7"
    assert one(fl.all_numbers(F.lit(said))) == [x for p in fl.NUMBER_FORMS for x in re.findall(p, said)]
    assert one(fl.last_integer(F.lit("so 1,200."))) == 1200
    assert one(fl.choice_letter(F.lit("(A) or (B)"), arr("x", "y"), 2)) == "B"
    assert one(fl.word_sort(arr("b a b c"), F.lit("List: c b a"))) == ["a b c"]


def test_overlap_against_counters(spark):
    rng = random.Random(3)
    rows = [([rng.choice("abcd") for _ in range(rng.randint(0, 9))], [rng.choice("abcde") for _ in range(rng.randint(0, 9))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = df.select("a", "b", multiset_overlap(F.col("a"), F.col("b")).alias("n"), ts.common_subsequence("a", "b").alias("l")).collect()

    def lcs(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    for r in got:
        assert r["n"] == (Counter(r["a"]) & Counter(r["b"])).total()
        assert r["l"] == lcs(r["a"], r["b"])
        assert len(ts.lcs_positions(r["a"], r["b"])) == r["l"]


def test_assignment_against_permutations():
    rng = np.random.default_rng(5)
    for _ in range(40):
        m = rng.random((rng.integers(1, 5), rng.integers(1, 5)))
        small, big = sorted(m.shape)
        wide = m if m.shape[0] <= m.shape[1] else m.T
        brute = max(sum(wide[i, p[i]] for i in range(small)) for p in permutations(range(big), small))
        assert ts.assignment_total(m) == pytest.approx(brute)


def test_span_scores(one):
    assert one(ts.spans_f1(arr("the 5 dogs"), arr("5.0 dogs"))) == 1.0
    assert one(ts.spans_exact(arr("b", "a"), arr("a", "b"))) == 1.0
    assert one(ts.spans_f1(arr("a cat", "dog"), arr("dog", "cat", "bird"))) == 0.67
    assert one(ts.spans_f1(arr("6 dogs"), arr("5 dogs"))) == 0.0


def test_qa_and_references(one):
    assert one(ts.qa_normal(F.lit("The  cat, a Éa hat!"))) == "cat éa hat"
    assert one(ts.qa_f1(F.lit("a big cat"), F.lit("the big dog"))) == 0.5
    assert one(ts.leave_one_out(arr("x", "y"), lambda g: (g == "x").cast("double"))) == 0.5
    assert one(ts.rouge_l(F.lit("the cat sat"), F.lit("the cat was sat"))) == pytest.approx(6 / 7)
    assert one(ts.rouge_lsum(F.lit("a b\nc d"), F.lit("a b\nc d"))) == 1.0
    perfect = ts.sentence_bleu(ts.bleu_stats(F.lit("a b c d e"), arr("a b c d e")))
    assert one(perfect) == pytest.approx(1.0)


def test_tolerances(one):
    assert one(ts.report_match(F.lit("10.05%"), F.lit("10.0%"))) == 1.0
    assert one(ts.report_match(F.lit("△5百万円"), F.lit("-5"))) == 1.0
    assert one(ts.report_match(F.lit("24,956百万円"), F.lit("24956"))) == 1.0
    assert one(ts.report_match(F.lit("0.1"), F.lit("0"))) == 0.0
    assert one(ts.relaxed_match(F.lit("0.05"), F.lit("5%"))) == 1.0
    assert one(ts.relaxed_match(F.lit("104"), F.lit("100"))) == 1.0
    assert one(ts.relaxed_match(F.lit("106"), F.lit("100"))) == 0.0
    assert one(ts.relaxed_match(F.lit("Yes."), F.lit("yes"))) == 1.0


def test_language_and_math(one):
    assert one(ts.language_normal(F.lit("Die Katze, der Hund"), F.lit("de"))) == "katze hund"
    assert one(ts.language_normal(F.lit("我爱 abc。"), F.lit("zh"))) == "我 爱 abc"
    assert one(erfc(F.lit(1.3) / math.sqrt(2))) == pytest.approx(math.erfc(1.3 / math.sqrt(2)), rel=2e-7)
    assert one(safe_name(F.lit("pretrained=a/b,x:y"))) == "pretrained=a__b,x__y"
    assert one(ts.tag_accuracy(arr("a", "b"), arr("a", "c", "d"))) == 0.5
    assert one(ts.open_match(F.lit("The answer is 12.00"), arr("12"))) == 1.0


def test_word_edits_against_table(spark):
    rng = random.Random(11)
    rows = [(" ".join(rng.choices(["un", "deux", "trois"], k=rng.randint(1, 8))), " ".join(rng.choices(["un", "deux", "quatre"], k=rng.randint(1, 8)))) for _ in range(40)]

    def distance(a, b):
        t = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return t[-1][-1]

    for r in spark.createDataFrame(rows, "p string, g string").select("p", "g", ag.word_edits(F.col("p"), F.col("g")).alias("d")).collect():
        assert r["d"] == distance(r["p"].split(), r["g"].split())


RULES = [
    ("length_constraints:number_paragraphs", dict(n=2), "one\n***\ntwo", "one"),
    ("length_constraints:nth_paragraph_first_word", dict(n=2, m=2, text="hello"), "a\n\nHello, b", "a\n\nbye"),
    ("detectable_format:number_bullet_lists", dict(n=2), "* a\n- b", "* a"),
    ("detectable_format:constrained_response", {}, "My answer is no.", "No"),
    ("detectable_format:number_highlighted_sections", dict(n=1), "a *b* c", "a ** c"),
    ("detectable_format:multiple_sections", dict(n=2, text="Section"), "Section 1 a\nSection 2 b", "Section 1"),
    ("detectable_format:json_format", {}, '```json\n{"a": 1}\n```', "{a"),
    ("combination:two_responses", {}, "a\n******\nb", "a\n******\na"),
    ("detectable_content:postscript", dict(text="P.P.S"), "x\nP.P.S y", "x\nP.S. y"),
    ("detectable_format:title", {}, "<<My title>>\nx", "<< >>"),
    ("startend:quotation", {}, '"quoted"', '"open'),
    ("startend:end_checker", dict(text="The end."), 'so "the end."', "the end. not"),
]


@pytest.mark.parametrize("rule", RULES, ids=[r[0] for r in RULES])
def test_instruction(rule, one):
    name, fields, good, bad = rule
    i = it.instruction(name, **fields)
    assert one(let(i, lambda x: it.follows(F.lit(good), x, F.lit("")))) is True
    assert one(let(i, lambda x: it.follows(F.lit(bad), x, F.lit("")))) is False


def test_pass_at_k_and_words(one):
    assert one(ag.pass_at_k(F.lit(5), F.lit(2), 2)) == pytest.approx(1 - 3 / 10)
    assert one(ag.pass_at_k(F.lit(3), F.lit(0), 2)) == 0.0
    assert one(words(F.lit("  a b  c\n"))) == ["a", "b", "c"]


def test_regression_scales_after_nulls_are_dropped(spark):
    """A row without a group takes no part in the mean of the age either."""
    from evalloom.operators import aggregates as ag

    rows = [("a", 1.0, 3.0), ("b", 2.0, 5.0), ("a", 3.0, 4.5), ("b", 6.0, 9.0), (None, 1000.0, 7.0)]
    df = spark.createDataFrame(rows, "g string, age double, y double")
    terms = {"b": (F.col("g") == "b").cast("double"), "age": F.col("age")}
    got = {r.term: r.coefficient for r in ag.least_squares(df, "y", terms, ("age",)).collect()}
    want = {r.term: r.coefficient for r in ag.least_squares(df.where("g is not null"), "y", terms, ("age",)).collect()}
    assert got == want and set(got) == {"intercept", "b", "age"}


def test_complementary_error_function(spark):
    import math

    from evalloom.operators import rollup as rp

    values = [0.0, 1e-9, 0.1, 0.5, 1.0, 2.0, 2.49, 2.5, 2.51, 3.0, 5.0, 8.0, 20.0]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").select("x", rp.erfc(F.col("x")).alias("e")).collect()
    for r in rows:
        if r.x is None:
            assert r.e is None
        else:
            assert abs(r.e - math.erfc(r.x)) <= 1e-14 and (r.x < 2.5 or abs(r.e / math.erfc(r.x) - 1) < 1e-12)


def test_group_reference_scores_of_normal_texts(spark):
    """Texts normalised beforehand give the scores of raw ones; null texts and null groups hit nothing."""
    from evalloom.functions.textscore import qa_normal
    from evalloom.operators import aggregates as ag

    rows = [(1, 2, "The cat", "a dog"), (1, 1, "big dog", "Cat!"), (2, 1, None, None), (2, 2, "x", "y x"), (None, 1, "z", "z"), (3, 1, "", "the")]
    df = spark.createDataFrame(rows, "g int, pos int, p string, r string")
    clean = df.select("g", "pos", qa_normal(F.col("p")).alias("p"), qa_normal(F.col("r")).alias("r"))
    clean = spark.createDataFrame(clean.collect(), df.schema)
    raw = ag.group_reference_scores(df, "g", "pos", "p", "r")
    ready = ag.group_reference_scores(clean, "g", "pos", "p", "r", normal=True)
    assert raw.first() == ready.first()
    assert raw.first().em == pytest.approx(2 / 6)  # "cat", and the empty text
    plan = ready._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan.lower() and "salt" not in plan
