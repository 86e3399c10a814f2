"""Filling fixed-capacity containers with items by linear grouping.

Documents are dealt by a hash of their key into blocks of a fixed number of documents; each block is packed on its own
(what is lost is at most part of one container per block). Within a block and for each capacity:

1. an item larger than the capacity is cut: its full pieces fill containers of their own, the rest is an ordinary item;
2. large items (over a quarter of the capacity) are sorted and grouped into GROUPS groups of equal cardinality, each
   rounded up to its largest size;
3. over these few sizes the configuration LP is solved by the revised simplex method, configurations being generated
   as they gain; the integral part of the solution fixes how many containers of each configuration are made;
4. actual documents take the places of the rounded ones, the largest of a group first; the last place of a container
   goes to the largest document left that fits the room the others really leave, so that rounding wastes nothing;
5. what is left of the large items, then the small ones, go in by best fit, largest first.

Best fit alone, largest first, is tried beside it on every block, and the packing with fewer containers is taken.

Defined cases: null, empty and blank-to-zero texts have size 0 and are dealt evenly over the block's containers; equal
sizes are ordered by key; repeated rows are separate items; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.session import ship

BLOCK_DOCS = 32_768
GROUPS = 64
LARGE = 4  # an item is large if it exceeds capacity / LARGE, so a container holds fewer than LARGE of them


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The configuration of one to LARGE - 1 = 3 items of greatest value; sizes ascending, each usable repeatedly.

    Every pair is tried with the most valuable item that still fits beside it, found by binary search over sizes.
    """
    k = len(sizes)
    padded = np.r_[0, np.maximum(values, 0)]
    arg = np.maximum.accumulate(np.where(padded >= np.maximum.accumulate(padded), np.arange(k + 1), 0))
    top = padded[arg]
    first, second = np.triu_indices(k + 1)  # index 0 stands for no item
    with_none = np.r_[0, sizes]
    free = capacity - with_none[first] - with_none[second]
    ok = free >= 0
    first, second, free = first[ok], second[ok], free[ok]
    third = arg[np.searchsorted(sizes, free, side="right")]
    total = padded[first] + padded[second] + padded[third]
    b = int(np.argmax(total))
    return float(total[b]), [int(x) - 1 for x in (first[b], second[b], third[b]) if x]


def solve_lp(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(configurations of the basis, one a row of counts; their amounts): the optimal fractional covering of demand.

    Column generation by the revised simplex method, from containers of one size each, until no configuration gains.
    The inverse of the basis is updated at each pivot and computed anew now and then. Pivots are chosen for demands
    moved by tiny different amounts, so that no two tie and the method can't go in circles.
    """
    k = len(sizes)
    basis = np.diag(np.minimum(capacity // sizes, LARGE - 1)).astype(float)
    inverse = np.linalg.inv(basis.T)
    moved = demand + 1e-6 * (1 + np.arange(k) / k)
    for n in count():
        duals = inverse.sum(axis=0)
        gain, items = best_configuration(sizes, duals, capacity)
        if gain <= 1 + 1e-9:
            break
        column = np.bincount(items, minlength=k).astype(float)
        amount, step = np.maximum(inverse @ moved, 0), inverse @ column
        out = int(np.argmin(np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)))
        basis[out] = column
        if n % 64 == 63:
            inverse = np.linalg.inv(basis.T)
        else:
            pivot = inverse[out] / step[out]
            inverse -= np.outer(step, pivot)
            inverse[out] = pivot
    return basis.astype(np.int64), np.maximum(np.linalg.inv(basis.T) @ demand, 0)


class _Open:
    """Open containers by free space, for best fit."""

    def __init__(self):
        self.by_free: dict[int, list[int]] = {}
        self.frees: list[int] = []

    def put(self, container: int, free: int) -> None:
        if free <= 0:
            return
        held = self.by_free.get(free)
        if held is None:
            self.by_free[free] = [container]
            insort(self.frees, free)
        else:
            held.append(container)

    def best(self, size: int) -> tuple[int, int] | None:
        """(container, free space) of the tightest fit; it is taken out."""
        at = bisect_left(self.frees, size)
        if at == len(self.frees):
            return None
        free = self.frees[at]
        held = self.by_free[free]
        container = held.pop()
        if not held:
            del self.by_free[free]
            self.frees.pop(at)
        return container, free


class _Pool:
    """Items not yet placed, by size."""

    def __init__(self, items: np.ndarray, sizes: np.ndarray):
        self.by_size: dict[int, list[int]] = {}
        for item, size in zip(items.tolist(), sizes[items].tolist(), strict=True):
            self.by_size.setdefault(size, []).append(item)
        self.sizes = sorted(self.by_size)

    def take(self, most: int) -> int:
        """The largest item of at most this size, or -1."""
        at = bisect_right(self.sizes, most) - 1
        if at < 0:
            return -1
        held = self.by_size[self.sizes[at]]
        item = held.pop()
        if not held:
            del self.by_size[self.sizes.pop(at)]
        return item

    def items(self) -> list[int]:
        return [i for held in self.by_size.values() for i in held]


def best_fit(sizes: np.ndarray, capacity: int, order: np.ndarray, into: np.ndarray, made: int, open_: _Open) -> int:
    """Put the items of ``order``, one after the other, where they fit tightest; returns the number of containers."""
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        found = open_.best(size)
        if found is None:
            into[item], free = made, capacity
            made += 1
        else:
            into[item], free = found
        open_.put(int(into[item]), free - size)
    return made


def pack(sizes: np.ndarray, capacity: int, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """(container of each item, number of containers) for sizes in 1..capacity: the better of two packings."""
    into, made = by_grouping(sizes, capacity, groups)
    plain = np.full(len(sizes), -1, np.int64)
    fewer = best_fit(sizes, capacity, np.argsort(-sizes, kind="stable"), plain, 0, _Open())
    return (plain, fewer) if fewer < made else (into, made)


def by_grouping(sizes: np.ndarray, capacity: int, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Linear grouping: the configuration LP over rounded sizes, actual documents in their places, then best fit."""
    into = np.full(len(sizes), -1, np.int64)
    made = 0
    open_ = _Open()
    order = np.argsort(-sizes, kind="stable")
    large = order[sizes[order] * LARGE > capacity]
    left: list[int] = []
    if len(large):
        parts = [p for p in np.array_split(large, min(groups, len(large))) if len(p)]
        tops = np.array([sizes[p[0]] for p in parts])
        rounded, which = np.unique(tops, return_inverse=True)  # groups of one size are one
        demand = np.bincount(which, weights=[len(p) for p in parts])
        basis, amounts = solve_lp(rounded, demand, capacity)
        pool = _Pool(large, sizes)
        for row, amount in zip(basis.tolist(), amounts.tolist(), strict=True):
            tops_of = [int(rounded[g]) for g in range(len(row) - 1, -1, -1) for _ in range(row[g])]
            for _ in range(int(amount + 1e-6)):
                free, any_ = capacity, False
                for n, top in enumerate(tops_of):
                    last = n == len(tops_of) - 1 and n > 0
                    item = pool.take(free if last else min(top, free))
                    if item >= 0:
                        into[item] = made
                        free -= int(sizes[item])
                        any_ = True
                if any_:
                    open_.put(made, free)
                    made += 1
        left = pool.items()
    rest = np.concatenate([np.array(left, np.int64), order[sizes[order] * LARGE <= capacity]])
    rest = rest[np.argsort(-sizes[rest], kind="stable")]
    return into, best_fit(sizes, capacity, rest, into, made, open_)


def pack_documents(tokens: np.ndarray, capacity: int) -> pd.DataFrame:
    """(item, piece_no, tokens, container) of documents of any size, zero and over the capacity included."""
    item = np.arange(len(tokens))
    full = tokens // capacity * (tokens > capacity)
    rest = tokens - full * capacity
    cut_item = np.repeat(item, full)
    cut_no = np.arange(len(cut_item)) - np.repeat(np.cumsum(full) - full, full)
    some = np.flatnonzero(rest > 0)
    into, made = pack(rest[some], capacity)
    none = np.flatnonzero(tokens == 0)
    spread = np.arange(len(none)) % max(1, made)
    return pd.DataFrame(
        {
            "item": np.concatenate([cut_item, some, none]),
            "piece_no": np.concatenate([cut_no, full[some], np.zeros(len(none), np.int64)]),
            "tokens": np.concatenate([np.full(len(cut_item), capacity), rest[some], np.zeros(len(none), np.int64)]),
            "container": np.concatenate([made + np.arange(len(cut_item)), into, spread]),
        }
    )


def _packer(key: str, profiles: list[tuple[str, int]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values([key], kind="stable", na_position="last")
        keys, tokens = block[key].to_numpy(), block["tokens"].to_numpy(np.int64)
        base = int(block["block"].iloc[0]) << 32
        out = []
        for name, capacity in profiles:
            got = pack_documents(tokens, capacity)
            out.append(
                pd.DataFrame(
                    {
                        "profile_name": name,
                        "container_id": base + got["container"].to_numpy(),
                        key: keys[got["item"].to_numpy()],
                        "piece_no": got["piece_no"].to_numpy(),
                        "tokens": got["tokens"].to_numpy(),
                    }
                )
            )
        return pd.concat(out) if out else pd.DataFrame(columns=["profile_name", "container_id", key, "piece_no", "tokens"])

    return run


def fill_containers(sized: DataFrame, n_docs: int, profiles: list[tuple[str, int]], key: str = "doc_id", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(profile_name, container_id, key, piece_no, tokens) from sized(key, tokens), one row per piece of a document.

    ``profiles`` holds a few (name, capacity) pairs; ``n_docs`` sets the number of blocks, so that a block stays of
    one size whatever the corpus.
    """
    ship(sized.sparkSession)
    blocks = max(1, -(-n_docs // block_docs))
    kind = sized.schema[key].dataType.simpleString()
    dealt = sized.withColumn("block", F.pmod(F.xxhash64(key, "tokens"), F.lit(blocks)).cast("int"))
    # A block is one task's work: an exchange by number keeps adaptive execution from gathering small blocks in one.
    return dealt.repartition(blocks, "block").groupBy("block").applyInPandas(
        _packer(key, profiles), f"profile_name string, container_id bigint, `{key}` {kind}, piece_no int, tokens int"
    )


def fill_report(containers: DataFrame, profiles: list[tuple[str, int]]) -> DataFrame:
    """(profile_name, containers, tokens, fill): how much of the space is used."""
    capacity = F.element_at(F.create_map(*[F.lit(x) for p in profiles for x in p]), F.col("profile_name"))
    return (
        containers.groupBy("profile_name", "container_id")
        .agg(F.sum("tokens").alias("used"))
        .groupBy("profile_name")
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"))
        .withColumn("fill", F.col("tokens") / (F.col("containers") * capacity))
    )
