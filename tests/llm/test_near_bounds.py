"""The bounds on pairs of near copies leave out no pair that is similar."""

import random

import numpy as np
import pyarrow as pa

from driftlens.llm import near_copies


def test_bounds_keep_every_similar_pair():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    passage = rng.choices(words, k=120)
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([4, 9, 60, 300, 1500])) + passage[: rng.choice([0, 40, 120])]
        for _ in range(8):
            t = list(base)
            for _ in range(int(len(t) * rng.choice([0, 0.01, 0.02, 0.03, 0.05]))):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    sets = [near_copies.shingle_set(t) for t in texts]
    want = set()
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                want.add((i, j))
    docs = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    for last in (np.empty(0, np.uint64), near_copies.shingle_set(" ".join(passage))):
        got = set()
        keys = list(near_copies._prefixes(last)(iter([docs])))
        rows = [pa.RecordBatch.from_arrays([*b.columns[:4], b.column(0)], ["doc_id", "n", "keys", "sketch", "comp"]) for b in keys]
        placed = list(near_copies._placed(iter([rows[0].slice(0, 0), rows[0].slice(0, 40), rows[0].slice(40)] + rows[1:])))
        for b in near_copies._cross(iter(placed)):
            got |= set(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        assert len(want) > 100 and want <= got
        wide = [w for b in keys for w in b.column("wide").to_pylist()]
        told = pa.RecordBatch.from_arrays([*(pa.array(c) for c in zip(*[(i, j, len(sets[i]), len(sets[j]), wide[i], wide[j]) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j]))]))], list("abcdef"))
        close = set(zip(*(c.to_pylist() for c in next(near_copies._close(iter([told]))).columns)))
        assert want <= close and len(close) < told.num_rows
        assert len(got) < len(texts) ** 2 // 4
    assert list(near_copies._cross(iter([]))) == []
