import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import fm_index, substring


def plain(rows, window=13):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    rank = lambda i: 2**63 - 1 if i is None else i
    low = {}
    for i, words in split:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            low[key] = min(low.get(key, 2**63 - 1), rank(i))
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if low[tuple(words[k : k + window])] < rank(i):
                gone |= set(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def random_rows():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)]
    rows = [(int(i), " ".join(rng.choice(words, rng.integers(0, 80)))) for i in rng.permutation(200)]
    passages = [" ".join(rng.choice(words, 25)) for _ in range(6)]
    for i in range(200, 330):
        parts = [" ".join(rng.choice(words, rng.integers(0, 20))), passages[i % 6], " ".join(rng.choice(words, rng.integers(0, 20)))]
        rows.append((i, "\n".join(parts)))
    rows += [(400 + i, rows[210][1].replace(" ", " \t")) for i in range(30)]
    return rows


@pytest.mark.parametrize("options", [{}, {"hot": 3, "shard_anchors": 7, "bits": 12}, {"hot": 0, "bits": 10}])
def test_against_dictionaries(spark, documents, options):
    rows = random_rows()
    found = substring.dedup_substrings(documents(*rows), **options)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows)


def test_odd_rows(spark, documents):
    run = " ".join(f"v{i}" for i in range(40))
    rows = [
        (3, run), (1, run + " tail"), (None, run), (None, run), (4, None), (5, ""), (6, " \t\n"), (7, "a " * 12), (8, "a " * 13),
        (9, "a " * 14), (10, "b " * 3000 + run), (10, "b " * 3000 + run), (10, "another text of the same id " + run), (11, run.upper()),
        (12, "b " * 20), (13, " ".join(run.split())), (14, "long " * 40_000),
    ]
    docs = documents(*rows).withColumn("did", F.lit("clash")).withColumn("starts", F.lit(1)).withColumn("anchor", F.lit(1))
    assert sorted(map(tuple, substring.dedup_substrings(docs).collect()), key=repr) == plain(rows)
    assert substring.dedup_substrings(docs.limit(0)).collect() == []
    kept = substring.dedup_substrings(docs, keep_text=True).where("doc_id = 3").first()
    assert (kept.kept, kept.n_removed) == ("", 40)


def test_index_finds_every_pattern():
    rng = np.random.default_rng(4)
    parts = [rng.integers(1, 6, rng.integers(1, 25)) for _ in range(60)]
    text = np.concatenate([np.append(p, 0) for p in parts])
    index = fm_index.FMIndex(text, 6)
    stream = rng.integers(1, 7, 300)  # 6 is a symbol that the index has not seen
    stream[stream == 6] = 0
    ends = np.arange(len(stream))
    matched, low, high = index.matches(stream, ends, 4)
    strings = ["".join(map(str, p)) for p in parts]
    for e in ends:
        best = 0
        for n in range(1, min(4, e + 1) + 1):
            pattern = "".join(map(str, stream[e - n + 1 : e + 1]))
            if "0" in pattern or not any(pattern in s for s in strings):
                break
            best = n
        assert matched[e] == best
        if best:
            pattern = "".join(map(str, stream[e - best + 1 : e + 1]))
            count = sum(s.startswith(pattern, k) for s in strings for k in range(len(s)))
            assert high[e] - low[e] == count
            assert {i for i, s in enumerate(strings) if pattern in s} == set(index.owner[low[e] : high[e]].tolist())
