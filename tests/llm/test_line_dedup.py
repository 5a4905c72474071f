import pytest
from pyspark.sql import functions as F

from evalloom.llm import line_dedup

FOLDER = "/root/testdata/sf0.001"


def plain(rows):
    """Removed line numbers per (id, text), by lists and dictionaries."""
    seen, order = {}, sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    removed = {r: set() for r in order}
    for row in order:
        lines = row[1].split("\n") if row[1] is not None else []
        for i in range(len(lines) - 2):
            if seen.setdefault(tuple(lines[i : i + 3]), (row, i)) != (row, i):
                removed[row] |= {i, i + 1, i + 2}
    return removed


def test_odd_rows(spark, documents):
    rows = [
        (1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb\nc"), (3, "a\nb\nc"), (4, "q\nq\nq\nq\nq"), (5, ""), (6, None), (7, "a\nb"),
        (8, "\n\n\n"), (9, "\n\n"), (None, "x\na\nb\nc"), (10, "b\nc\nd\ne\nf"), (11, "long\n" * 3000 + "end"),
    ]
    docs = documents(*rows).withColumn("lines", F.lit(1)).withColumn("pos", F.lit("clash")).withColumn("n_lines", F.lit(-1))
    found = line_dedup.dedup_lines(docs)
    assert found.columns == [*docs.drop("n_lines").columns, "n_lines", "n_removed_lines"]
    expected = plain(rows)
    for row in found.join(docs.select("doc_id", F.col("text").alias("was")).distinct(), "doc_id").collect():
        gone = expected[(row.doc_id, row.was)]
        lines = row.was.split("\n") if row.was is not None else []
        assert row.n_lines == len(lines) and row.n_removed_lines == len(gone), row
        assert row.text == (None if row.was is None else "\n".join(x for i, x in enumerate(lines) if i not in gone))
    # an id that is null comes last, so its passage goes
    assert found.where("doc_id is null").first()["text"] == ""
    assert found.count() == len(rows)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_linear_in_the_lines_of_a_text(spark, documents):
    """Two long texts; 200,000 lines took hours when every line searched the covered ones."""
    long = "\n".join(f"line {i % 190_000}" for i in range(200_000))
    rows = [(1, long), (2, "new\n" + long)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(documents(*rows)).collect()}
    assert (out[1].n_lines, out[1].n_removed_lines) == (200_000, 10_000)
    assert out[1].text == long[: long.rindex("\nline 189999") + 12]
    assert out[2].text == "new" and out[2].n_removed_lines == 200_000


def test_every_removed_line_survives_somewhere(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {x for r in docs.collect() for x in r.text.split("\n")}
    after = {x for r in line_dedup.dedup_lines(docs).collect() for x in r.text.split("\n")}
    assert before - after <= {""}


@pytest.mark.parametrize("name", ["op2_mix_sources", "op3_line_dedup"])
def test_plan_has_no_python(spark, name):
    from evalloom.llm import catalog

    plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
