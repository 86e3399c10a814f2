import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from stratalith.functions import hashing as H
from stratalith.functions import text as X
from stratalith.functions.globs import IgnoreRule, deciding_rule, ignore_regex, parse_ignore, path_glob, sqlite_glob
from stratalith.operators import batch, chunking, context, index, lifecycle, nodes, ranges, ranking, rules, tables
from stratalith.plans import text_jobs

CHUNKS = "chunk_id string, artifact_id string, path string, title string, heading string, body string, status string"


def _chunks(spark, n=40, seed=3):
    rnd = random.Random(seed)
    words = "alpha beta gamma delta data set build café naïve index rollback".split()
    rows = [
        (f"c{i:02}", f"a{i % 7}", f"dir/file-{i % 7}.md", rnd.choice(words).title(), rnd.choice(words), " ".join(rnd.choice(words) for _ in range(rnd.randrange(3, 40))), "active")
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, CHUNKS)


@pytest.fixture(scope="module")
def searchable(spark, tmp_path_factory):
    rows, df = _chunks(spark)
    root = str(tmp_path_factory.mktemp("index"))
    index.SearchIndex.write(df, root)
    return rows, index.SearchIndex(spark, root)


@pytest.mark.parametrize("query", ["alpha", "alpha beta", "data-set cafe", "NAIVE index missing", "alpha alpha beta", "set-build-café data"])
def test_bm25_equals_sqlite(searchable, query):
    rows, found = searchable
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, path, title, heading, body, tokenize = 'unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO f VALUES (?, ?, ?, ?, ?)", [(r[0], r[2], r[3], r[4], r[5]) for r in rows])
    for mode, glue in (("any", " OR "), ("all", " ")):
        match = glue.join(f'"{t}"' for t in query.split())
        want = dict(db.execute("SELECT id, bm25(f, 0, 4, 6, 3, 1) FROM f WHERE f MATCH ?", (match,)).fetchall())
        got = {r.chunk_id: r.bm25 for r in found.bm25(query, mode).collect()}
        assert set(got) == set(want) == {r.chunk_id for r in found.match(query, mode).collect()}
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


@pytest.mark.parametrize("mode", ["any", "all"])
def test_batch_equals_single(spark, searchable, mode):
    _, found = searchable
    asked = [(1, "alpha beta"), (2, "rollback"), (3, "data-set café"), (4, "alpha alpha"), (5, "—"), (6, None), (7, "missing-term beta")]
    got = {(r.query_id, r.chunk_id): r.bm25 for r in found.batch_bm25(spark.createDataFrame(asked, "query_id int, query string"), mode).collect()}
    for k, q in asked:
        one = {r.chunk_id: r.bm25 for r in found.bm25(q or "", mode).collect()}
        assert {c for i, c in got if i == k} == set(one)
        assert all(abs(got[k, c] - v) < 1e-9 for c, v in one.items())


@pytest.mark.parametrize("samples", [1, 3])
def test_best_of_each_equals_the_whole_batch(spark, tmp_path, samples):
    _, df = _chunks(spark, 400, 11)
    df = df.withColumn("title", F.when(F.col("chunk_id") > "c2", F.col("title")))
    asked = [("a", "alpha beta"), ("b", "rollback"), ("c", "data-set café"), ("d", "alpha alpha gamma"), ("e", "—"), ("f", None), (None, "missing-term beta"), ("g", "DIR naïve-index")]
    asked += [(f"q{i}", q) for i, q in enumerate(("md delta", "build set data index", "file-3", "index-rollback gamma gamma", "nowhere"))]
    queries = spark.createDataFrame(asked, "query_id string, query string")
    index.SearchIndex.write(df, str(tmp_path))
    best: dict = {}
    for r in index.SearchIndex(spark, str(tmp_path)).batch_bm25(queries).withColumn("bm25", X.round6(F.col("bm25"))).collect():
        best.setdefault(r.query_id, []).append((r.bm25, r.chunk_id))
    want = {(q, c, s, n) for q, rows in best.items() for n, (s, c) in enumerate(sorted(rows)[:5], 1)}
    named = batch.Queries(queries)
    rows = batch.phrase_rows(df.drop("artifact_id", "status").repartition(3), named.phrases).withColumn("sample", batch.sample_of(samples))
    got = [(r.query_id, r.chunk_id, r.bm25, r.position) for r in batch.best_of_each(rows, named, samples, 5).collect()]
    assert len(got) == len(want) and set(got) == want and {"a", "c", None, "g"} <= {g[0] for g in got}


def test_best_of_each_without_queries_or_chunks(spark):
    _, df = _chunks(spark)
    for asked, chunks in (([("a", "—"), ("b", None)], df), ([("a", "alpha")], df.where("false"))):
        named = batch.Queries(spark.createDataFrame(asked, "query_id string, query string"))
        rows = batch.phrase_rows(chunks.drop("artifact_id", "status"), named.phrases).withColumn("sample", F.lit(0))
        assert batch.best_of_each(rows, named, 1, 5).count() == 0


def test_empty_query_and_corpus(spark, searchable, tmp_path):
    _, df = _chunks(spark)
    assert searchable[1].bm25("—").count() == 0 and searchable[1].match("").count() == 0
    index.SearchIndex.write(df.where("false"), str(tmp_path))
    assert index.SearchIndex(spark, str(tmp_path)).bm25("alpha").count() == 0


CANDIDATES = (
    "query_id string, query string, chunk_id string, artifact_id string, relative_path string, title string, heading_path array<string>, "
    "text string, status string, authority int, estimated_tokens int, bm25 double"
)


def _hit(i, artifact="a", text=None, status="active", authority=50, tokens=100, bm25=-2.0, query="q", title=None):
    words = text or " ".join(f"w{i}x{k}" for k in range(20))
    return (query, "find things", f"c{i:02}", artifact, f"{artifact}.md", title, ["H"], words, status, authority, tokens, bm25 + i * 0.01)


def test_greedy_keeps_a_and_c(spark):
    base = [f"w{i}" for i in range(60)]
    a, b, c = base, base[:58] + ["x", "y"], base[:55] + ["x", "y", "z", "p", "q"]
    rows = [_hit(1, "a", " ".join(a)), _hit(2, "b", " ".join(b)), _hit(3, "c", " ".join(c))]
    got = ranking.greedy_duplicates(ranking.with_visibility(ranking.scored(spark.createDataFrame(rows, CANDIDATES))))
    assert [r.chunk_id for r in got.collect()] == ["c02"]


def test_greedy_knows_no_depth(spark):
    rows = [_hit(i, "a", bm25=-20.0) for i in range(520)]
    rows += [(*_hit(600, "a", rows[k][7], bm25=-20.0)[:2], f"d{k}", *_hit(600, "a", rows[k][7], bm25=-20.0)[3:]) for k in (0, 510)]
    rows += [_hit(i, "a", query="few", text="one two three four five") for i in range(2)]
    got = ranking.greedy_duplicates(ranking.with_visibility(ranking.scored(spark.createDataFrame(rows, CANDIDATES))))
    assert {(r.query_id, r.chunk_id) for r in got.collect()} == {("q", "d0"), ("q", "d510"), ("few", "c01")}


def test_greedy_in_rounds_equals_greedy_in_one_piece(spark):
    rnd = random.Random(5)
    rows = []
    for family in range(4):
        words = [f"f{family}w{k}" for k in range(60)]
        for i in range(12):
            words = list(words)
            words[rnd.randrange(60)] = f"edit{family}x{i}" if i % 4 else words[0]
            rows.append(_hit(family * 12 + i, "a", " ".join(words), query=f"q{family % 2}", bm25=-9 + rnd.random()))
    rows += [_hit(90, "a", "—", query="q0"), _hit(91, "a", "—", query="q0")]
    df = ranking.with_visibility(ranking.scored(spark.createDataFrame(rows, CANDIDATES)))
    whole, rounds = (sorted(tuple(r) for r in ranking.greedy_duplicates(df, most=most).collect()) for most in (500, 3))
    assert whole == rounds and 5 < len(whole) < 45


def test_reasons_and_visibility(spark):
    rows = [_hit(i, "same") for i in range(5)] + [_hit(7, "old", status="archived"), _hit(8, "sup")]
    rows += [_hit(9, "z", query="lone", status="archived")]
    gone = spark.createDataFrame([("sup",)], "artifact_id string")
    got = {(r.query_id, r.chunk_id): (r.position, r.reason) for r in ranking.ranked(spark.createDataFrame(rows, CANDIDATES), 2, gone).collect()}
    assert got["q", "c00"] == (1, None) and got["q", "c02"] == (None, "budget") and got["q", "c04"] == (None, "diversity")
    assert got["q", "c07"] == (None, "archived") and got["q", "c08"] == (None, "superseded") and got["lone", "c09"] == (1, None)


def test_bundle_accounts_for_every_candidate(spark):
    rnd = random.Random(1)
    rows = [_hit(i, f"a{rnd.randrange(12)}", tokens=rnd.randrange(50, 900), status=rnd.choice(["active", "archived", "draft"])) for i in range(60)]
    ranked = ranking.ranked(spark.createDataFrame(rows, CANDIDATES), 500)
    for budget in (500, 4000):
        got = context.bundle(ranked, budget).collect()
        assert sorted(r.chunk_id for r in got) == sorted(r[2] for r in rows)
        used = sum(r.estimated_tokens for r in got if r.bucket in ("overview", "selected"))
        assert used <= budget and sum(r.estimated_tokens for r in got if r.bucket == "overview") <= budget // 10
        assert all((r.reason is None) == (r.bucket != "omitted") for r in got)
    with pytest.raises(ValueError):
        context.resolve_budget("agent", 10)
    assert context.resolve_budget("deep") == 40_000 and context.resolve_budget("agent", 10, True) == 10


NODES = "id string, artifact_id string, parent_id string, kind string, ordinal int, title string, text string, heading_path array<string>, line_start int, line_end int, revision_hash string, seq int"


def _node(i, text, path=("H",), artifact="a", kind="paragraph"):
    return (f"{artifact}#{i}", artifact, None, kind, i, None, text, list(path), i + 1, i + 1, "h", i)


def test_chunks_follow_the_sequential_fold(spark, monkeypatch):
    monkeypatch.setattr(chunking, "BLOCK", 5)
    rnd = random.Random(4)
    rows = []
    for artifact in ("a", "b"):
        path = ("H",)
        for i in range(80):
            if rnd.random() < 0.15:
                path = ("H", rnd.choice("xyz"))
            text = None if rnd.random() < 0.1 else " ".join("word" for _ in range(rnd.choice([1, 20, 200, 2000])))
            rows.append(_node(i, text, path, artifact))
    got = chunking.chunk_nodes(spark.createDataFrame(rows, NODES)).orderBy("artifact_id", "chunk_no").collect()
    want = []
    for artifact in ("a", "b"):
        fold, n, last, run = chunking._Fold(700, 1200, 100, False), 0, None, -1
        out = []
        for r in rows:
            if r[1] != artifact or not r[6]:
                continue
            if r[7] != last:
                run, last = run + 1, r[7]
            node = type("N", (), {"artifact_id": artifact, "run": run, "id": r[0], "heading_path": r[7], "text": r[6], "line_start": r[8], "line_end": r[9]})
            out += list(fold.add(node))
        out += list(fold.flush())
        for x in out:
            want.append((artifact, n, x[3], x[5], x[6]))
            n += 1
    assert [(r.artifact_id, r.chunk_no, r.node_ids, r.text, r.estimated_tokens) for r in got] == want
    assert all(r.estimated_tokens <= 1200 for r in got)


def test_oversized_texts_are_cut_in_utf16_units():
    text = "\U0001f600" * 5_000
    pieces = [text[a:b] for a, b in chunking.cut_places(text, 1_200, 0)]
    assert "".join(pieces) == text and max(X.estimate_tokens_py(p) for p in pieces) == 1_200
    mixed = ("\U0001f600 word\n" * 3_000) + "x" * 9_000
    pieces = [mixed[a:b] for a, b in chunking.cut_places(mixed, 500, 100)]
    assert "".join(pieces) == mixed and max(X.estimate_tokens_py(p) for p in pieces[:20]) <= 500 and pieces[0].endswith("\n")
    shared = list(chunking.cut_places(mixed, 500, 100, real_overlap=True))
    assert all(b > c for (_, b), (c, _) in zip(shared, shared[1:]))


def test_cycles_are_told_and_named(spark):
    edges = spark.createDataFrame([("b", "c"), ("c", "a"), ("a", "b"), ("c", "m"), ("m", "x"), ("x", "y"), ("y", "x"), ("q", "a")], "artifact_id string, superseded_id string")
    assert {r.artifact_id for r in rules.cyclic(edges).collect()} == {"a", "b", "c", "m", "x", "y"}
    assert rules.cycle(edges) == ["a", "b", "c"] and rules.cycle(edges.where("artifact_id <> 'b' and artifact_id <> 'y'")) == []


def test_text_scalars(spark):
    df = spark.createDataFrame([(1, "Ünï—Code 😀😀", "a b c d e"), (2, "", "one two"), (3, None, "")], "i int, t string, s string")
    got = df.select("i", X.normalize(F.col("t")).alias("n"), X.estimate_tokens(F.col("t")).alias("e"), X.shingles(F.col("s")).alias("sh"), X.utf16_length(F.col("t")).alias("u")).orderBy("i").collect()
    assert (got[0].n, got[0].u, got[0].e) == ("ünï code", 13, 4) and got[0].sh == ["a b c d", "b c d e"]
    assert got[1].n == "" and got[1].e == 0 and got[1].sh == ["one two"] and got[2].n is None and got[2].sh == []
    assert X.estimate_tokens_py("a b c d e f g h") == 8


def test_paragraphs(spark):
    df = spark.createDataFrame([("d", "one\r\ntwo\r\n \r\n\r\n  three"), ("e", None), ("f", " \n"), ("g", "x" * 45_000)], "artifact_id string, text string")
    got = sorted((r.artifact_id, r.line_start, r.line_end, len(r.text)) for r in nodes.split_paragraphs(df).collect())
    assert got == [("d", 1, 2, 7), ("d", 5, 5, 5), ("g", 1, 1, 5_000), ("g", 1, 1, 20_000), ("g", 1, 1, 20_000)]


def test_reads(spark):
    df = spark.createDataFrame([_node(i, f"text {i}", ("H", "S") if i > 2 else ("H",)) for i in range(6)], NODES)
    got = ranges.read_ranges(df, from_line=2, to_line=3).first()
    assert got.text == "text 1\n\ntext 2" and not got.truncated
    assert ranges.read_ranges(df, heading=["H", "S"]).first().text.startswith("text 3")
    for block in (1, 2, 100):
        cut = ranges.read_ranges(df, most=10, block=block).first()
        assert cut.text == "text 0\n\nte" and cut.truncated and (cut.line_start, cut.line_end) == (1, 6)


def test_registered_read_has_the_production_depth(spark, tmp_path):
    rows = [("short", "s", 0, "x" * 3_000), ("long1", "l", 0, "y" * 150_000), ("long2", "l", 1, "z" * 150_000)]
    df = spark.createDataFrame(rows, "id string, artifact_id string, seq int, text string").select(
        "*", F.lit("text").alias("kind"), F.array(F.lit("H")).alias("heading_path"), F.lit(1).alias("line_start"), F.lit(9).alias("line_end"),
        F.lit("2026-01-01").cast("timestamp").alias("indexed_at"),
    )
    df.write.parquet(str(tmp_path / "nodes.parquet"))
    got = {r.artifact_id: (r.characters, r.truncated) for r in text_jobs.QUERIES["read_full"](spark, str(tmp_path)).collect()}
    assert got == {"s": (3_000, False), "l": (200_000, True)}


def test_types(spark):
    cells = {
        "int": ["1", "-20", "n/a"], "real": ["1.5", "2", ""], "zero": ["007", "1"], "big": ["9007199254740993", "1"], "bool": ["TRUE", "false"],
        "date": ["2031-02-28", "2031-02-28T10:00"], "bad": ["2031-02-30"], "none": [None, "null"], "plus": ["+1", "2"],
    }
    df = spark.createDataFrame([(k, v) for k, vs in cells.items() for v in vs], "k string, cell string")
    got = {r.k: r.type for r in df.groupBy("k").agg(tables.infer_type().alias("type")).collect()}
    assert got == {"int": "integer", "real": "real", "zero": "text", "big": "text", "bool": "boolean", "date": "date", "bad": "text", "none": "unknown", "plus": "text"}
    assert tables.unify_kinds(["integer", "null", "real"]) == "real" and tables.unify_kinds(["integer", "text"]) == "text" and tables.unify_kinds(["error", "integer"]) == "text"


def test_globs_and_ignores(spark):
    import re

    assert re.match(path_glob("a/**/*.md"), "a/b/c/x.md") and re.match(path_glob("a/**/*.md"), "a/x.md") and not re.match(path_glob("a/*.md"), "a/b/x.md")
    assert re.match(path_glob("*.{md,txt}"), "x.txt") and re.match(sqlite_glob("a*[b-d]?"), "a/x/cz") and not re.match(sqlite_glob("a*"), "A")
    assert re.match(ignore_regex("node_modules/"), "x/node_modules/y.js") and not re.match(ignore_regex("/data/*.csv"), "x/data/a.csv")
    ignore = parse_ignore("# c\n*.log\n!keep.log\nskip/\n!skip/in.txt\n\n", "f")
    paths = spark.createDataFrame([(p,) for p in ("a.log", "keep.log", "skip/in.txt", "b/c.txt")], "p string")
    got = {r.p: r.rule for r in paths.select("p", deciding_rule(F.col("p"), ignore).alias("rule")).collect()}
    assert got == {"a.log": 0, "keep.log": None, "skip/in.txt": 2, "b/c.txt": None}
    report = lifecycle.exclusions(paths.withColumnRenamed("p", "relative_path"), [IgnoreRule("*.log"), IgnoreRule("skip/")]).collect()
    assert {(r.pattern, r.files) for r in report} == {("*.log", 2), ("skip/", 1)}


def test_rules_and_cycles(spark):
    arts = spark.createDataFrame([("s:a/x.md", "a/x.md"), ("s:b/y.md", "b/y.md"), ("s:z.txt", "z.txt")], "artifact_id string, relative_path string")
    declared = [rules.Rule("**/*.md", status="draft", authority=10, supersedes=("z.txt",)), rules.Rule("a/**", authority=90, supersedes=("b/*",), replace=True), rules.Rule("no/**")]
    got = {r.artifact_id: (r.status, r.authority) for r in rules.resolve_scalars(arts, declared).collect()}
    assert got == {"s:a/x.md": ("draft", 90), "s:b/y.md": ("draft", 10), "s:z.txt": ("active", 50)}
    assert {tuple(r) for r in rules.supersessions(arts, declared).collect()} == {("s:a/x.md", "s:b/y.md"), ("s:b/y.md", "s:z.txt")}
    assert [r.match for r in rules.unmatched_rules(arts, declared).collect()] == ["no/**"]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], "artifact_id string, superseded_id string")
    assert {r.artifact_id for r in rules.cyclic(edges).collect()} == {"b", "c"}
    with pytest.raises(ValueError):
        rules.check_rules([rules.Rule("x", status="gone")])


def test_a_chain_is_no_cycle_or_an_error(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(8)], "artifact_id string, superseded_id string")
    with pytest.raises(RuntimeError):
        rules.cyclic(chain, rounds=2)
    assert rules.cyclic(chain).count() == 0


def test_hashing(spark):
    assert H.canonical({"b": [1, True, None], "a": "é"}) == "o2:s1:as1:és1:ba3:i1:1b1n"
    assert H.shortest_prefix("bld_" + "a" * 64, ["bld_" + "a" * 13 + "b" * 51]) == "bld_" + "a" * 14
    assert H.column_sql_name(3, "List Price (EUR)") == "c_3_list_price_eur" and H.table_sql_name("id", "???").startswith("t_")
    df = spark.createDataFrame([("g", H.sha256(str(i))) for i in range(500)], "g string, member_hash string")
    one = H.hash_roots(df, by=["g"]).first().root
    assert one == H.hash_roots(df.repartition(7), by=["g"]).first().root != H.hash_roots(df.limit(499), by=["g"]).first().root
