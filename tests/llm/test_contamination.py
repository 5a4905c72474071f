import math
import re

import pytest

from evalloom.llm import contamination


def grams(text, n=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D!-/:-@\[-`{-~]+", (text or "").lower()) if w]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def plain(docs, items):
    out = []
    for d, t in docs:
        for i, u in items:
            n = max(1, min(5, len(re.findall(r"[^\x20\x09-\x0D!-/:-@\[-`{-~]+", u or ""))))
            want = grams(u, n)
            both = len(want & grams(t, n))
            if want and both >= math.ceil(round(0.8 * len(want), 9)):
                out.append((d, i, len(want), both))
    return sorted(out, key=repr)


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int"),
        spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"),
    )


WORDS = [f"w{i}" for i in range(300)]
ITEMS = [
    (1, " ".join(WORDS[:30])), (2, " ".join(WORDS[40:54])), (3, "a b c d"), (4, None), (5, ""), (6, "one two three four five"),
    (6, "one two three four five"), (None, " ".join(WORDS[100:140])), (7, "It's A-test: of, the (punctuation) HERE!"),
    (8, "x y x y x y x y x y"), (11, "Gap"), (12, "w3 w4"), (13, "w4 w3"), (3, "a b c d"),
]
DOCS = [
    (10, " ".join(["pad"] * 5000 + WORDS[:30] + ["pad"] * 5000)), (11, " ".join(WORDS[:27] + ["gap"] + WORDS[28:60])),
    (12, " ".join(WORDS[:15])), (13, None), (14, ""), (15, "ONE two,three;four\nfive"), (16, "one two three four"),
    (None, " ".join(WORDS)), (17, "it s a test of the punctuation here"), (18, "x y x y x y"), (19, " ".join(WORDS[:30])),
    (19, " ".join(WORDS[:30])), (20, " ".join(WORDS[:20] + ["g"] * 50 + WORDS[14:30])),
    (21, "x a, b! C d y"), (22, "a b c e"), (23, "d c b a"), (24, "w3"), (25, "a b c d"),
]


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_odd_rows(spark, limit):
    docs, items = tables(spark, DOCS, ITEMS)
    found = contamination.contained_items(docs, items, broadcast_bytes=limit)
    columns = ["doc_id", "item_id", "item_shingles", "found_shingles"]
    mine = [tuple(r[c] for c in columns) for r in found.collect()]
    expected = plain(DOCS, ITEMS)
    if limit:
        assert sorted(mine, key=repr) == expected
    assert sorted(set(mine), key=repr) == sorted(set(expected), key=repr)
    clean = contamination.drop_contaminated(docs, items, broadcast_bytes=limit)
    dirty = {d for d, *_ in expected}
    assert clean.columns == docs.columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((d for d, _ in DOCS if d not in dirty), key=repr)
    for empty in (contamination.contained_items(docs.limit(0), items), contamination.contained_items(docs, items.limit(0))):
        assert empty.count() == 0


def test_joins_find_the_same_in_the_corpus(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    one = contamination.contained_items(docs, items).select("doc_id", "item_id", "found_shingles")
    two = contamination.contained_items(docs, items, broadcast_bytes=0).select("doc_id", "item_id", "found_shingles")
    assert one.count() > 0 and sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_sketch_is_long_enough():
    for size in range(1, 300):
        missed = size - contamination.needed(size, 0.8)
        assert contamination.sketch_length(size, 0.8) > missed
