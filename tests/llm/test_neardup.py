import random
import re

import numpy as np
import pyarrow as pa
import pytest

from stratalith.llm import neardup as N

B = N.Banding(shingle=4, threshold=0.7)


def _shingles(text, k):
    words = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    if not words:
        return set()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def _brute(rows, k, least):
    sets = {}
    for kind, key, text in rows:
        if key is not None:
            sets[kind, key] = _shingles(text, k)
    keys = sorted(sets)
    out = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if a[0] == b[0] and x and y and len(x & y) >= least * len(x | y) - 1e-9:
                out.add((a[0], a[1], b[1]))
    return out


def _corpus(n=120, seed=2):
    rnd = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(3, 90))]
        rows.append(("node" if i % 3 else "hit", f"d{i}", " ".join(words)))
        for j in range(rnd.randrange(3)):
            edited = list(words)
            for _ in range(rnd.randrange(3)):
                edited[rnd.randrange(len(edited))] = rnd.choice(vocabulary)
            rows.append(("node" if i % 3 else "hit", f"d{i}-{j}", ", ".join(edited).upper()))
    return rows


def test_equals_brute_force(spark):
    rows = _corpus()
    rows += [("node", "null", None), ("node", "blank", " \n"), ("node", "dash", "—"), (rows[1][0], rows[1][1], rows[1][2]), ("node", None, "x y z")]
    rows += [("node", "s1", "one two"), ("node", "s2", "One, TWO!"), ("node", "long", "lorem ipsum dolor " * 20_000), ("node", "long2", "lorem ipsum dolor " * 20_000)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "record_kind string, id string, text string, plain string, n int")
    got = {tuple(r) for r in N.near_pairs(df.select("record_kind", "id", "text", "plain"), B).collect()}
    assert got == _brute(rows, 4, 0.7)


def test_long_runs_are_split_without_losing_pairs(spark):
    """Texts that share a template: their runs are over every bound, so they go by sample, by passing on and by blocks."""
    rnd = random.Random(5)
    template = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = list(template)
        for at in rnd.sample(range(60), rnd.randrange(7)):
            words[at] = f"x{rnd.randrange(40)}"
        rows.append(("node", f"d{i:03}", " ".join(words)))
    rows += _corpus(30, 9)
    df = spark.createDataFrame(rows, "record_kind string, id string, text string")
    want = _brute(rows, 4, 0.7)
    for run_rows, block_rows in ((8_192, 4_096), (20, 4_096), (20, 16), (1, 2)):
        assert {tuple(r) for r in N.near_pairs(df, B, run_rows=run_rows, block_rows=block_rows).collect()} == want
    assert len(N.hot_keys(df, B, 20)) > 0


def test_a_run_longer_than_a_chunk_is_left_out():
    b, rng = N.Banding(), np.random.default_rng(1)
    a = sorted([7] * 50 + [3, 3, 9, 9] + [8] * 2 + [5] * 3)
    pay = rng.integers(0, 255, (len(a), b.payload)).astype("uint8")
    pay[:] = pay[0]
    salt = [int(x == 5) for x in a]
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array(a[i : i + 5], pa.int64()), pa.array(salt[i : i + 5], pa.int32()), pa.array(range(i, min(i + 5, len(a))), pa.int64()), N._fixed(pay[i : i + 5])],
            names=["a_key", "salt", "k", "payload"],
        )
        for i in range(0, len(a), 5)
    ]
    for chunk_rows in (1, 12, 1_000):
        rows = [r for out in N._met(b, 10, chunk_rows)(iter(batches)) for r in out.to_pylist()]
        assert sorted((a[r["lo"]], a[r["hi"]]) for r in rows) == [(3, 3), (8, 8), (9, 9)]


def test_groups_of_copies_of_any_size_come_out_whole(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [("node", f"c{i:04}", text.upper() if i % 2 else text) for i in range(1_005)] + [("node", "y", text + " more"), ("node", "z", text + " more")]
    df = spark.createDataFrame(rows, "record_kind string, id string, text string")
    ids = sorted(r[1] for r in rows)
    got = N.near_pairs(df, B)
    assert got.count() == len(ids) * (len(ids) - 1) // 2 and got.where("id_a >= id_b").count() == 0
    few = N.near_pairs(df.where("id < 'c0030' or id > 'x'"), B, block=4).collect()
    kept = [i for i in ids if i < "c0030" or i > "x"]
    assert sorted((r.id_a, r.id_b) for r in few) == [(a, b) for i, a in enumerate(kept) for b in kept[i + 1 :]]


def test_classes(spark):
    rows = _corpus(40, 4)
    df = spark.createDataFrame(rows, "record_kind string, id string, text string")
    pairs = _brute(rows, 5, 0.8)
    parent = {(k, i): (k, i) for k, i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a, b in pairs:
        x, y = sorted((root((k, a)), root((k, b))))
        parent[y] = x
    got = {(r.record_kind, r.id): r.class_id for r in N.record_classes(df).collect()}
    assert set(got) == set(parent)
    assert all(c == root(k)[1] for k, c in got.items())


def test_classes_are_settled_or_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(9)], "lo bigint, hi bigint")
    with pytest.raises(RuntimeError):
        N.classes(links, rounds=1)
    assert {tuple(r) for r in N.classes(links).collect()} == {(i, 0) for i in range(10)}


def test_empty(spark):
    df = spark.createDataFrame([], "record_kind string, id string, text string")
    assert N.near_pairs(df).count() == 0 and N.record_classes(df).count() == 0
