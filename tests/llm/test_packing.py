import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalith.llm import packing as K


def _bfd(sizes, capacity):
    open_, made = K._Open(), 0
    for x in sorted(sizes, reverse=True):
        found = open_.best(x)
        if found is None:
            open_.put(made, capacity - x)
            made += 1
        else:
            open_.put(found[0], found[1] - x)
    return made


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 300), max_size=200), st.integers(10, 120))
def test_whole_items_within_capacity(tokens, capacity):
    tokens = np.array(tokens, np.int64)
    got = K.pack_documents(tokens, capacity)
    assert got.groupby("container").tokens.sum().max() <= capacity if len(got) else not len(tokens)
    assert (got.groupby("item").tokens.sum().reindex(range(len(tokens)), fill_value=-1) == tokens).all()
    pieces = got.groupby("item").size()
    for i, t in enumerate(tokens):
        assert pieces[i] == max(1, -(-t // capacity))


def test_lp_is_optimal_on_a_known_case():
    # Sizes 30, 35 and 65 in 100: 65 + 35 is full, three 30s fit.
    sizes, demand = np.array([30, 35, 65]), np.array([30.0, 10.0, 10.0])
    basis, amounts = K.solve_lp(sizes, demand, 100)
    assert abs(amounts.sum() - 20) < 1e-6
    assert np.all(basis.T @ amounts >= demand - 1e-6)


def test_lp_ends_on_degenerate_demands():
    rng = np.random.default_rng(11)
    for _ in range(5):
        sizes = np.unique(rng.integers(251, 1000, 64))
        demand = np.full(len(sizes), 16.0)
        basis, amounts = K.solve_lp(sizes, demand, 1000)
        assert np.all(basis @ sizes <= 1000) and np.all(basis.T @ amounts >= demand - 1e-3)


def test_fills_at_least_as_well_as_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for capacity in (1000, 3000):
        sizes = np.minimum(rng.lognormal(5.9, 0.6, 4000).astype(int) + 1, capacity)
        _, made = K.pack(sizes, capacity)
        assert made <= _bfd(sizes.tolist(), capacity)


def test_blocks_and_report(spark):
    rows = [(i, 40 + i % 50) for i in range(500)] + [(900, 0), (901, 250), (901, 250)]
    sized = spark.createDataFrame(rows, "doc_id bigint, tokens int")
    got = K.fill_containers(sized, 503, [("small", 100), ("large", 1000)], block_docs=200)
    rows_out = got.toPandas()
    for name, capacity in (("small", 100), ("large", 1000)):
        one = rows_out[rows_out.profile_name == name]
        assert one.groupby("container_id").tokens.sum().max() <= capacity
        assert one.tokens.sum() == sum(t for _, t in rows)
    report = {r.profile_name: r for r in K.fill_report(got, [("small", 100), ("large", 1000)]).collect()}
    assert report["large"].fill > 0.9


def test_empty_table(spark):
    sized = spark.createDataFrame([], "doc_id bigint, tokens int")
    assert K.fill_containers(sized, 0, [("a", 10)]).count() == 0
