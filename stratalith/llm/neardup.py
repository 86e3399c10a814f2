"""Near-duplicate records with small edits, by tensored banding over MinHash and exact verification.

A table key is a pair (a_i, b_j): a_i out of ``left`` half keys of ``left_rows`` minhashes, b_j out of ``right`` half keys
of ``right_rows``. left * right tables cost only left * left_rows + right * right_rows minhashes. Two texts of Jaccard
similarity s share a key with probability (1 - (1 - s^left_rows)^left) * (1 - (1 - s^right_rows)^right): 0.9995 at 0.7,
above 0.9999 at 0.75 with the defaults.

The tables are not written out. A text sends one row per a_i, carrying its b_j (a byte each) and a signature of one bit
of each of ``bits`` minhashes; the rows of one a_i meet in one task and the pairs (a_i, b_j) are formed there, so the
shuffle carries ``left`` rows a text instead of left * right. A pair that shares a table key is a candidate only if its
signatures agree in as many bits as similarity ``threshold`` lets expect, less four standard deviations; so of pairs that
merely share some boilerplate few get as far as their texts. Candidates are verified exactly on their shingle sets.

Runs of one a_i longer than ``RUN_ROWS`` (texts that share a template) never pile up in a task: runs that a bounded sample
shows to be long are spread over tasks by salt, and whatever run is long is left out where the others are paired; only for
rows of long runs the table keys (a_i, b_j) are written out, and tables that are long even so are compared in blocks. Which
way a run takes has no bearing on its pairs.

Defined cases: a null, empty or wordless text is in no pair; copies have similarity 1; a text of fewer words than a
shingle is one shingle; repeated rows of an id count once; texts of any length are taken whole; an empty table gives no
rows; extra columns are ignored. Copies are texts that are equal once normalized (by a 128-bit hash); they collapse to
one text before anything is paired, and all pairs of their records come out, whatever the size of the group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.llm.shingles import byte_slices, mix, normalized, shingle_hashes
from stratalith.session import cut, ship

BLOCK_IDS = 1_000
CHUNK_ROWS = 200_000
PAIRS_OUT = 500_000
#: Longest run of one half key that is paired where it meets; rows a block of a longer table.
RUN_ROWS = 8_192
BLOCK_ROWS = 4_096
#: Records drawn to find long runs beforehand, and how often a half key must occur among them.
SAMPLE_RECORDS = 20_000
LEAST_SEEN = 20
SALTS = 64


@dataclass(frozen=True)
class Banding:
    """shingle: words per shingle; threshold: least Jaccard similarity; the rest as in the module's description."""

    shingle: int = 5
    threshold: float = 0.8
    left: int = 12
    left_rows: int = 2
    right: int = 20
    right_rows: int = 3
    bits: int = 128

    @property
    def hashes(self) -> int:
        return max(self.left * self.left_rows + self.right * self.right_rows, self.bits)

    @property
    def least_bits(self) -> int:
        """Bits that two signatures must share: one bit agrees with probability (1 + s) / 2."""
        p = (1 + self.threshold) / 2
        return math.floor(self.bits * p - 4 * math.sqrt(self.bits * p * (1 - p)))

    @property
    def payload(self) -> int:
        return self.right + self.bits // 8

    def multipliers(self) -> np.ndarray:
        return np.random.default_rng(20_260_101).integers(0, 2**63, self.hashes, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def text_records(records: DataFrame) -> DataFrame:
    """records(record_kind, id, text) to (record_kind, id, text_key, plain), rows without words left out."""
    # A text is normalized once: what comes out of an explode isn't computed anew by the conditions on it. The key is never
    # null, else joins would say so in some branches of a plan only, and those couldn't share an exchange.
    plain = records.where(F.col("id").isNotNull()).select("record_kind", "id", F.explode(F.array(normalized(F.col("text")))).alias("plain"))
    key = F.coalesce(F.unhex(F.md5(F.concat_ws(" ", "record_kind", "plain"))), F.lit(b""))
    return plain.where(F.col("plain") != "").withColumn("text_key", key)


def distinct_texts(keyed: DataFrame) -> DataFrame:
    """(k, text_key, plain), each text once: ``k`` is a short key, which two texts may share without harm."""
    held = keyed.groupBy(F.xxhash64("text_key").alias("k")).agg(F.collect_set(F.struct("text_key", "plain")).alias("t"))
    return held.select("k", F.inline("t"))


def _half_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """Hashes of consecutive groups of ``rows`` minhashes; minima has a row per hash."""
    out = np.zeros((len(minima) // rows, minima.shape[1]), np.uint64)
    for g in range(len(out)):
        for r in range(rows):
            out[g] = mix(out[g] * np.uint64(31) + minima[g * rows + r])
        out[g] = mix(out[g] + np.uint64(g))
    return out


def sketch(raw: np.ndarray, offsets: np.ndarray, b: Banding, multipliers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a keys: left x texts, payload: texts x bytes, the b keys and then the signature) of a slice of texts."""
    x, first = shingle_hashes(raw, offsets, b.shingle)
    minima = np.empty((b.hashes, len(first)), np.uint64)
    for i, m in enumerate(multipliers):
        minima[i] = np.minimum.reduceat(x * m, first)
    split = b.left * b.left_rows
    a_keys = _half_keys(minima[:split], b.left_rows)
    b_keys = _half_keys(minima[split : split + b.right * b.right_rows], b.right_rows)
    bits = np.packbits((mix(minima[: b.bits]) >> np.uint64(63)).astype(np.uint8), axis=0)
    return a_keys, np.concatenate([(b_keys >> np.uint64(56)).astype(np.uint8), bits]).T


def _fixed(rows: np.ndarray) -> pa.Array:
    """A binary column of equally long values, one a row of bytes."""
    n, size = rows.shape
    ends = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * size).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _bytes_of(column: pa.Array, size: int) -> np.ndarray:
    """The rows of bytes of a binary column of equally long values."""
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * size, column.offset * size).reshape(-1, size)


def band_rows(texts: DataFrame, b: Banding, hot: np.ndarray | None = None) -> DataFrame:
    """(a_key, salt, k, payload) of texts(k, plain): ``left`` rows per text; salt is positive for a_keys in ``hot``."""
    ship(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(np.sort(hot)) if hot is not None and len(hot) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = b.multipliers()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for begin, end, raw, offsets in byte_slices(batch.column(1)):
                a_keys, payload = sketch(raw, offsets, b, multipliers)
                a, k = a_keys.ravel().view(np.int64), np.tile(keys[begin:end], b.left)
                salt = np.zeros(len(a), np.int32)
                if shared is not None:
                    salt = np.where(np.isin(a, shared.value), (k % SALTS + 1).astype(np.int32), salt)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(salt), pa.array(k), _fixed(np.tile(payload, (b.left, 1)))], names=["a_key", "salt", "k", "payload"]
                )

    return texts.select("k", "plain").mapInArrow(run, "a_key bigint NOT NULL, salt int NOT NULL, k bigint, payload binary")


def hot_keys(records: DataFrame, b: Banding, run_rows: int = RUN_ROWS) -> np.ndarray:
    """Half keys whose runs a sample of at most about ``SAMPLE_RECORDS`` records shows to be longer than ``run_rows``.

    They are spread from the start; that a long run isn't found here costs time, not pairs. Their number is bounded by
    the sample's.
    """
    n = records.count()
    if n <= run_rows:
        return np.empty(0, np.int64)
    share = min(1.0, SAMPLE_RECORDS / n)
    drawn = distinct_texts(text_records(records.sample(share, seed=1)))
    seen = band_rows(drawn, b).groupBy("a_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(LEAST_SEEN, run_rows * share))
    return np.array([r["a_key"] for r in seen.select("a_key").collect()], np.int64)


def _pairs_of_groups(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within equal, adjacent group values."""
    at, d = np.arange(len(group)), 1
    while True:
        at = at[at + d < len(group)]
        at = at[group[at + d] == group[at]]
        if not len(at):
            return
        yield at, at + d
        d += 1


def _unique_pairs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    fresh = np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])] if len(lo) else np.empty(0, bool)
    return lo[fresh], hi[fresh]


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits rows of 64-bit words agree."""
    return 64 * x.shape[-1] - np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _tensor(run: np.ndarray, text: np.ndarray, payload: np.ndarray, b: Banding) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of rows sorted by run: the same run, any equal b key and signatures that agree enough."""
    signs = np.ascontiguousarray(payload[:, b.right :]).view(np.uint64)
    los, his, held = [], [], 0
    for j in range(b.right):
        key = run.astype(np.int64) << 8 | payload[:, j]
        order = np.argsort(key, kind="stable")
        for at, to in _pairs_of_groups(key[order]):
            x, y = order[at], order[to]
            near = (_agree(signs[x], signs[y]) >= b.least_bits) & (text[x] != text[y])
            x, y = text[x[near]], text[y[near]]
            los.append(np.minimum(x, y))
            his.append(np.maximum(x, y))
            held += len(x)
            if held > PAIRS_OUT:
                yield _unique_pairs(np.concatenate(los), np.concatenate(his))
                los, his, held = [], [], 0
    if held:
        yield _unique_pairs(np.concatenate(los), np.concatenate(his))


def _met(b: Banding, run_rows: int, chunk_rows: int):
    """Pairs (lo, hi) of the runs that meet in a task, but for longer and salted ones, which go another way."""
    Rows = tuple[np.ndarray, np.ndarray, np.ndarray]

    def whole(rows: Rows) -> Iterator[pa.RecordBatch]:
        a, text, payload = rows
        if not len(a):
            return
        run = np.cumsum(np.r_[True, a[1:] != a[:-1]]) - 1
        size = np.bincount(run)[run]
        keep = (size > 1) & (size <= run_rows)
        for lo, hi in _tensor(run[keep], text[keep], payload[keep], b):
            yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], names=["lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Rows] = []
        n, long = 0, None
        for batch in batches:
            near = np.flatnonzero(batch.column(1).to_numpy() == 0)
            rows = (batch.column(0).to_numpy()[near], batch.column(2).to_numpy()[near], _bytes_of(batch.column(3), b.payload)[near])
            if long is not None:  # the long run goes on
                more = int(np.searchsorted(rows[0], long, side="right"))
                rows = tuple(c[more:] for c in rows)
                if not len(rows[0]):
                    continue
                long = None
            held.append(rows)
            n += len(rows[0])
            if n < chunk_rows:
                continue
            rows = tuple(np.concatenate(c) for c in zip(*held, strict=True))
            last = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
            yield from whole(tuple(c[:last] for c in rows))
            rest = tuple(c[last:] for c in rows)
            if len(rest[0]) > run_rows:
                long, held, n = rest[0][0], [], 0
            else:
                held, n = [rest], len(rest[0])
        if held:
            yield from whole(tuple(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _in_tables(rows: DataFrame, b: Banding, block_rows: int) -> DataFrame:
    """(lo, hi) of rows(a_key, k, payload) by table keys written out, tables of many rows in blocks of ``block_rows``.

    Every two blocks of a table meet in a task of their own, so a task holds two blocks, whatever the table's size.
    """
    keys = F.transform(F.sequence(F.lit(0), F.lit(b.right - 1)), lambda j: F.xxhash64("a_key", j, F.substring(F.col("payload"), j + 1, F.lit(1))))
    keyed = rows.select("k", F.substring("payload", b.right + 1, b.bits // 8).alias("signs"), F.explode(keys).alias("tab"))
    sizes = keyed.groupBy("tab").agg(F.count("k").alias("n")).where("n > 1")
    sizes = sizes.select("tab", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    dealt = keyed.join(sizes, "tab").withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("tab", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "k", "signs")

    def pair(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        text = pdf["k"].to_numpy()
        signs = np.frombuffer(b"".join(pdf["signs"]), np.uint64).reshape(len(text), -1)
        one = pdf["own"].to_numpy() == key[1]
        first, second = np.flatnonzero(one), np.flatnonzero(one if key[1] == key[2] else ~one)
        step = max(1, 2_000_000 // max(1, len(second)))
        los, his = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(first), step):
            some = first[at : at + step]
            i, j = np.nonzero(_agree(signs[some][:, None, :], signs[second][None, :, :]) >= b.least_bits)
            x, y = text[some[i]], text[second[j]]
            los.append(np.minimum(x, y)[x != y])
            his.append(np.maximum(x, y)[x != y])
        lo, hi = _unique_pairs(np.concatenate(los), np.concatenate(his))
        return pd.DataFrame({"lo": lo, "hi": hi})

    return dealt.groupBy("tab", "x", "y").applyInPandas(pair, "lo bigint, hi bigint")


def candidate_pairs(bands: DataFrame, b: Banding, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(lo, hi) short keys of texts that share a table key and whose signatures agree enough, each pair once."""
    # One exchange serves the pairs, the count of the runs and the rows of long ones. The long runs' keys go through an
    # exchange of their own, so that it is known how few they are (as a rule none) before any row is read for them.
    met = bands.repartition("a_key", "salt")
    pairs = met.sortWithinPartitions("a_key").mapInArrow(_met(b, run_rows, chunk_rows), "lo bigint, hi bigint").distinct()
    # Every branch names all columns and none asks whether a key is null, else each would have an exchange of its own.
    runs = met.groupBy("a_key", "salt").agg(F.greatest(F.count("k"), F.count("payload")).alias("n"))
    long = runs.where((F.col("n") > run_rows) | (F.col("salt") > 0)).select("a_key", "salt").repartition("a_key", "salt")
    rows = met.join(long, ["a_key", "salt"]).select("a_key", "k", "payload")
    return pairs.unionByName(_in_tables(rows, b, block_rows)).distinct()


def _verify(b: Banding):
    def sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for begin, end, raw, offsets in byte_slices(column):
            x, first = shingle_hashes(raw, offsets, b.shingle)
            yield begin, end, x, np.diff(np.r_[first, len(x)])

    def distinct(of: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((x, of))
        of, x = of[order], x[order]
        fresh = np.r_[True, (of[1:] != of[:-1]) | (x[1:] != x[:-1])] if len(of) else np.empty(0, bool)
        return of[fresh], x[fresh]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sides = []
                for name in ("plain_lo", "plain_hi"):
                    of, xs = [], []
                    for begin, end, x, counts in sets(batch.column(name)):
                        of.append(np.repeat(np.arange(begin, end), counts))
                        xs.append(x)
                    sides.append(distinct(np.concatenate(of), np.concatenate(xs)))
                n = batch.num_rows
                sizes = np.bincount(sides[0][0], minlength=n) + np.bincount(sides[1][0], minlength=n)
                of, x = (np.concatenate(c) for c in zip(*sides, strict=True))
                order = np.lexsort((x, of))
                of, x = of[order], x[order]
                both = np.bincount(of[1:][(of[1:] == of[:-1]) & (x[1:] == x[:-1])], minlength=n)
                near = both >= b.threshold * (sizes - both) - 1e-9
                picked = batch.select(["lo", "hi"]).filter(pa.array(near))
                yield picked

    return run


def text_links(records: DataFrame, keyed: DataFrame, b: Banding, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(lo, hi): text keys of different texts at least as similar as the threshold; keyed are the records' texts."""
    texts = distinct_texts(keyed)
    pairs = candidate_pairs(band_rows(texts, b, hot_keys(records, b, run_rows)), b, run_rows, block_rows)
    lo = texts.select(F.col("k").alias("lo_k"), F.col("text_key").alias("lo"), F.col("plain").alias("plain_lo"))
    hi = texts.select(F.col("k").alias("hi_k"), F.col("text_key").alias("hi"), F.col("plain").alias("plain_hi"))
    pairs = pairs.select(F.col("lo").alias("lo_k"), F.col("hi").alias("hi_k"))
    return pairs.join(lo, "lo_k").join(hi, "hi_k").select("lo", "hi", "plain_lo", "plain_hi").mapInArrow(_verify(b), "lo binary, hi binary")


def near_pairs(records: DataFrame, b: Banding = Banding(), block: int = BLOCK_IDS, run_rows: int = RUN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(record_kind, id_a, id_b), id_a < id_b, of records(record_kind, id, text) of one kind that are near duplicates."""
    keyed = text_records(records)
    links = text_links(records, keyed, b, run_rows, block_rows)
    members = keyed.select("record_kind", "text_key", "id").distinct()
    pairs = _expanded(members, links, block)
    return pairs.select("record_kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def _expanded(members: DataFrame, links: DataFrame, block: int) -> DataFrame:
    """(record_kind, x, y): all pairs of members(record_kind, text_key, id) of one text and of linked texts.

    The ids of a text come in blocks of about ``block``, dealt by a hash of the id; every two blocks that meet are one
    row until their pairs are written out, so no task holds more than its share of a text with many copies.
    """
    sizes = members.groupBy("text_key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    hot = sizes.where("blocks > 1")
    parts = (
        members.join(hot, "text_key", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .groupBy("record_kind", "text_key", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
        .agg(F.collect_list("id").alias("ids"))
    )

    def listed(met: DataFrame) -> DataFrame:
        one = met.select("record_kind", F.explode("xs").alias("x"), "ys")
        return one.select("record_kind", "x", F.explode("ys").alias("y"))

    within = listed(parts.where(F.size("ids") > 1).select("record_kind", F.col("ids").alias("xs"), F.col("ids").alias("ys"))).where("x < y")
    later = F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block")
    between = listed(
        parts.where("blocks > block + 1")
        .select("record_kind", "text_key", F.col("ids").alias("xs"), later)
        .join(parts.where("blocks > 1").select("text_key", "block", F.col("ids").alias("ys")), ["text_key", "block"])
    )
    met = links
    for side in ("lo", "hi"):
        met = met.join(hot.select(F.col("text_key").alias(side), F.col("blocks").alias(f"{side}_blocks")), side, "left")
        each = F.sequence(F.lit(0), F.coalesce(f"{side}_blocks", F.lit(1)) - 1)
        met = met.withColumn(f"{side}_block", F.explode(each))
    x = parts.select("record_kind", F.col("text_key").alias("lo"), F.col("block").alias("lo_block"), F.col("ids").alias("xs"))
    y = parts.select(F.col("text_key").alias("hi"), F.col("block").alias("hi_block"), F.col("ids").alias("ys"))
    across = listed(met.join(x, ["lo", "lo_block"]).join(y, ["hi", "hi_block"])).where("x <> y")
    return across.unionByName(within).unionByName(between)


def classes(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(text_key, class_key) of linked texts: the smallest key of each connected component.

    Alternating large-star and small-star steps, each one shuffle of the edges; lineage is cut by a checkpoint. Runs
    until nothing changes; where ``rounds`` is given and doesn't suffice, an error is raised.
    """
    edges = cut(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    before, done = None, 0
    while True:
        if done == rounds:
            raise RuntimeError(f"classes aren't settled after {rounds} rounds")
        done += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u <> v")
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            low.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("text_key"), F.col("v").alias("class_key")).unionByName(
        edges.select(F.col("v").alias("text_key"), F.col("v").alias("class_key")).distinct()
    )


def record_classes(records: DataFrame, b: Banding = Banding()) -> DataFrame:
    """(record_kind, id, class_id, links): one row per record; class_id is the smallest id of its class.

    ``links`` counts the other texts its text is linked to; copies share a class without being expanded. A record
    without words is a class of its own with no links.
    """
    keyed = text_records(records)
    links = cut(text_links(records, keyed, b))
    degree = links.select(F.explode(F.array("lo", "hi")).alias("text_key")).groupBy("text_key").agg(F.count(F.lit(1)).alias("links"))
    members = keyed.select("record_kind", "id", "text_key").distinct()
    placed = members.join(classes(links), "text_key", "left").join(degree, "text_key", "left").withColumn(
        "class_key", F.coalesce("class_key", "text_key")
    )
    heads = placed.groupBy("class_key").agg(F.min("id").alias("class_id"))
    found = placed.join(heads, "class_key").select("record_kind", "id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    ids = records.where(F.col("id").isNotNull()).select("record_kind", "id").distinct()
    lone = ids.join(members.select("record_kind", "id").distinct(), ["record_kind", "id"], "left_anti")
    return found.unionByName(lone.select("record_kind", "id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("links")))
