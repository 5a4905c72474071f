import pyarrow as pa
from pyspark.sql import functions as F

from evalloom.functions import tokens as tk


def test_bytes_are_not_copied_in_python():
    """What a batch of tokens takes in Python is the batch of texts itself."""
    texts = pa.array([b"ab", None, "é".encode()], pa.large_binary())
    out = tk.signed_bytes.func(texts)
    assert out.to_pylist() == [[97, 98], None, [-61, -87]]
    assert out.values.buffers()[1].address == texts.buffers()[2].address


def test_every_byte_is_a_token(spark):
    text = "".join(map(chr, range(0x110))) + "€😀"
    row = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(tk.byte_tokens("t").alias("b")).collect()
    assert [r.b for r in row] == [list(text.encode()), None, []]
    assert spark.createDataFrame([(text,)], "t string").select(tk.byte_tokens(F.col("t")).alias("b")).dtypes == [("b", "array<int>")]
