import json

import pytest

from stratalith import build as B
from stratalith.runtime import Runtime, render_bundle
from stratalith.streaming.watch import Rebuilder, Watch
from stratalith.streaming.windows import windowed_counts


def _project(root):
    src = root / "src"
    (src / "guides").mkdir(parents=True)
    (src / "data").mkdir()
    (src / "guides/rollback.md").write_text("# Rollback guide\n\nTo rollback a release, pick the previous build.\n\n## Steps\n\n- stop\n- switch\n")
    (src / "guides/deploy.md").write_text("# Deploy\n\nA deployment can rollback when it fails.\n")
    (src / "old.txt").write_text("old notes about rollback\n\nsecond para\n")
    (src / "data/pricing.csv").write_text("sku,list_price,discontinued\nA-1,9.99,false\nA-2,,true\n")
    (src / "skip.bin").write_bytes(b"\0")
    return src


def test_build_search_read_query_rollback(spark, tmp_path):
    src = _project(tmp_path)
    state = B.State(tmp_path / "state")
    config = B.Config("demo", {"Main": str(src)}, [B.R.Rule("old.txt", status="archived"), B.R.Rule("guides/rollback.md", authority=90, supersedes=("old.txt",))])
    first = B.build(spark, state, config)
    assert first["counts"]["artifacts"] == 4 and B.build(spark, state, config)["build_id"] == first["build_id"]
    assert B.status(spark, state, config)["state"] == "clean" and all(ok for _, ok, _ in B.doctor(spark, state))
    (src / "guides/deploy.md").write_text("# Deploy\n\nA deployment can rollback when it fails badly.\n")
    assert {r.change: r.files for r in B.plan(spark, state, config).collect()} == {"changed": 1, "unchanged": 3}
    second = B.build(spark, state, config)
    assert second["build_id"] != first["build_id"] and state.active() == second["build_id"]
    fresh = B.build(spark, B.State(tmp_path / "other"), config)
    assert fresh["build_id"] == second["build_id"]  # reuse of unchanged files changes nothing

    rt = Runtime(spark, state)
    hits = rt.search("rollback")["hits"]
    assert hits[0]["locator"]["relative_path"] == "guides/rollback.md" and "old.txt" not in [h["locator"]["relative_path"] for h in hits]
    bundle = rt.context_for_task("how to rollback", budget=4000)
    assert [i["relative_path"] for i in bundle["alternative"]] == ["old.txt"] and "## Alternatives" in render_bundle(bundle)
    assert rt.read_source("guides/rollback.md", heading=["Rollback guide", "Steps"])["text"] == "- stop\n- switch"
    assert rt.read_source("old.txt")["text"].startswith("old notes")
    table = rt.list_tables()["tables"][0]
    assert rt.describe_table("pricing")["sample"] == [["A-1", 9.99, False], ["A-2", None, True]]
    assert rt.query_table(table["table_id"], f"SELECT count(list_price) n FROM {table['sql_name']}")["rows"] == [[1]]
    assert rt.describe_build()["warnings"] == {"unsupported-format": 1}

    assert state.rollback()["build_id"] == first["build_id"]
    one, two = (B.pack(state, first["build_id"], tmp_path / n) for n in ("a.zip", "b.zip"))
    assert one == two and B.verify_archive(tmp_path / "a.zip") == []
    assert B.H.shortest_prefix(first["build_id"], [second["build_id"]]) and state.resolve(first["build_id"][:16]) == first["build_id"]
    found = B.diff(spark, state, first["build_id"], second["build_id"])
    assert [(r["relative_path"], r["change"]) for r in found["artifacts"]] == [("guides/deploy.md", "changed")] and not found["identical"]
    assert set(found["roots"]) == {"artifacts", "nodes", "chunks", "objects"} and found["chunks"] == {"changed": 1} and not found["tables"]
    assert "~ guides/deploy.md" in B.render_diff(found) and "identical" in B.render_diff(B.diff(spark, state, first["build_id"], first["build_id"]))
    view = rt.inspect("artifacts", "old.txt")
    assert [r["status"] for r in view["rows"]] == ["archived"] and rt.inspect("nodes", limit=1)["truncated"]
    assert rt.inspect("supersessions")["rows"][0]["supersedes"] == "main:old.txt"
    with pytest.raises(LookupError):
        rt.inspect("nothing")
    assert state.prune(keep=1)["removed"] == [] and len(state.registry()) == 2
    with pytest.raises(B.BuildError):
        state.rollback()


def test_config_errors(spark, tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"name": "x", "sorces": {}}))
    with pytest.raises(B.BuildError, match="did you mean 'sources'"):
        B.Config.load(p)
    src = _project(tmp_path)
    config = B.Config("demo", {"m": str(src)}, [B.R.Rule("nothing/**")], strict_rules=True)
    with pytest.raises(B.BuildError, match="apply to no file"):
        B.build(spark, B.State(tmp_path / "s"), config)
    assert B.Config.find(tmp_path) if (tmp_path / "project.json").exists() else True
    p.write_text(json.dumps({"name": "x", "sources": {"a": "src", "b": "src"}}))
    with pytest.raises(B.ConfigError, match="same directory"):
        B.Config.load(p)
    for bad in ("/etc", "../up"):
        p.write_text(json.dumps({"name": "x", "sources": {"a": bad}}))
        with pytest.raises(B.ConfigError):
            B.Config.load(p)
    (tmp_path / "project.json").write_text(json.dumps({"name": "x", "sources": {"a": "src"}, "target_tokens": 300}))
    got = B.Config.load(src / "guides", {"STRATALITH_MAXIMUM_TOKENS": "900"}, {"overlap_tokens": 5})
    assert (got.target_tokens, got.maximum_tokens, got.overlap_tokens) == (300, 900, 5) and got.layers["target_tokens"][1] == "project"
    with pytest.raises(B.BuildError, match="more than 2 files"):
        B.discovered(spark, B.Config("demo", {"m": str(src)}, max_files=2))
    assert B.resolve_settings(("default", {"a": 1}), ("flag", {"a": 2}))["a"] == (2, "flag", False)


def test_watch(spark, tmp_path):
    src = _project(tmp_path)
    seen = []
    watch = Watch(spark, str(src), str(tmp_path / "w"), lambda changes, n: seen.append({r.relative_path: r.change for r in changes.collect()}))
    watch.start(once=True).awaitTermination(60)
    assert len(seen) == 1 and set(seen[0].values()) == {"added"}
    (src / "new.md").write_text("# new")
    watch.start(once=True).awaitTermination(60)
    (src / "old.txt").unlink()
    watch.start(once=True).awaitTermination(60)
    assert seen[1:] == [{"new.md": "added"}, {"old.txt": "removed"}]
    (src / "new.md").write_text("# new")
    assert watch.settle(99) == 0
    slow = Watch(spark, str(src), str(tmp_path / "slow"), lambda changes, n: None, debounce=True)
    assert slow.settle(0) == 0 and slow.settle(1) > 0 and slow.settle(2) == 0


def test_rebuilds_that_are_overtaken_stay_inactive(spark, tmp_path):
    src = _project(tmp_path)
    state = B.State(tmp_path / "state")
    again = Rebuilder(spark, state, B.Config("demo", {"main": str(src)}))
    again.latest = 2
    assert again.rebuild(1) is None and state.active() is None
    assert again.run(once=True)["build_id"] == state.active() is not None


def test_projection(spark, tmp_path):
    from stratalith import projection as P

    src = _project(tmp_path)
    state, config = B.State(tmp_path / "state"), B.Config("demo", {"m": str(src)})
    one = B.build(spark, state, config)["build_id"]
    (src / "new.md").write_text("# New\n\nMore about a rollback.\n")
    two = B.build(spark, state, config)["build_id"]
    target = str(tmp_path / "remote")
    for project_id, build in (("p", one), ("p", two), ("q", one), ("p", two)):
        assert P.project(spark, state, build, target, project_id)["verdict"] == "ok"
    for build in (one, two):
        for entity in ("chunks", "artifacts", "cells"):
            assert sorted(map(str, P.remote_read(spark, target, "p", build, entity).collect())) == sorted(map(str, B.read(spark, state, build, entity).collect()))
        near, far = (sorted((r.chunk_id, r.bm25) for r in i.bm25("rollback").collect()) for i in (Runtime(spark, state)._index(build), P.RemoteIndex(spark, target, "p", build)))
        assert near == far and near
    assert P.remote_prune(spark, target, "p", [two]) == [one] and P.projected(spark, target).select("project_id", "build_id").distinct().count() == 2
    with pytest.raises(LookupError):
        P.remote_read(spark, target, "p", one, "chunks")
    assert P.remote_read(spark, target, "q", one, "chunks").count() > 0


def test_freshness_is_told_again_after_a_while(spark, tmp_path):
    src = _project(tmp_path)
    state, config, now = B.State(tmp_path / "state"), B.Config("demo", {"m": str(src)}), [0.0]
    B.build(spark, state, config)
    fresh = B.Freshness(spark, state, config, 10, lambda: now[0])
    assert fresh.get()["state"] == "clean"
    (src / "old.txt").write_text("changed")
    now[0] = 9.0
    assert fresh.get()["state"] == "clean" and fresh.get()["age"] == 9.0
    now[0] = 10.0
    assert fresh.get()["state"] == "dirty"


def test_discovery_prunes_and_reports(spark, tmp_path):
    src = _project(tmp_path)
    (src / ".gitignore").write_text("data/\n*.txt\n!keep.txt\n")
    (src / "node_modules/x").mkdir(parents=True)
    (src / "node_modules/x/y.md").write_text("no")
    (src / "keep.txt").write_text("kept [x]")
    (src / "a[1]*.md").write_text("# glob characters")
    (src / "link.md").symlink_to(src / "old.txt")
    (src / "server.jks").write_text("secret")
    config = B.Config("demo", {"m": str(src)})
    found = {r[2]: (r[8], r[9]) for r in B.discovered(spark, config)}
    assert "node_modules/" in found and "node_modules/x/y.md" not in found and "data/pricing.csv" not in found
    assert found["keep.txt"] == (None, None) and found["old.txt"][0] is not None and found["link.md"] == (None, "symlink-not-followed")
    report = {r["pattern"]: (r["source"], r["files"], r["sample"]) for r in B.exclusions(spark, config)}
    assert report["data/"] == (".gitignore", 1, ["data/"]) and report["*.txt"] == (".gitignore", 1, ["old.txt"]) and "*.jks" in report
    facts = {r.relative_path: r.text_class for r in B.S.facts(spark, B.discovered(spark, config)).collect()}
    assert set(facts) == {"a[1]*.md", "guides/deploy.md", "guides/rollback.md", "keep.txt"}


def test_incremental_builds_heed_versions_and_widened_types(spark, tmp_path, monkeypatch):
    src = tmp_path / "src"
    src.mkdir()
    (src / "n.csv").write_text("k,v\n" + "".join(f"a{i},{i}\n" for i in range(1_200)) + "x,none\n")
    state, config = B.State(tmp_path / "state"), B.Config("demo", {"m": str(src)})
    first = B.build(spark, state, config)
    assert Runtime(spark, state).describe_build()["warnings"] == {"csv-type-widened": 1}
    assert B.plan_report(spark, state, config)["parse"] == 0
    versions = B.lock_versions()
    monkeypatch.setattr(B, "lock_versions", lambda: {**versions, "parser csv": "next", "index": "next"})
    report = B.plan_report(spark, state, config)
    assert report["parse"] == 1 and len(report["lock_changes"]) == 2 and "made anew" in B.render_plan(report)
    assert B.build(spark, state, config)["build_id"] != first["build_id"]


def test_a_declared_cycle_is_named(spark, tmp_path):
    src = _project(tmp_path)
    rules = [B.R.Rule("guides/rollback.md", supersedes=("guides/deploy.md",)), B.R.Rule("guides/deploy.md", supersedes=("guides/rollback.md",))]
    with pytest.raises(B.BuildError, match="m:guides/deploy.md -> m:guides/rollback.md -> m:guides/deploy.md"):
        B.build(spark, B.State(tmp_path / "s"), B.Config("demo", {"m": str(src)}, rules))


def test_a_shared_folder_does_what_a_local_one_does(spark, tmp_path):
    src = _project(tmp_path)
    state = B.State(f"file://{tmp_path}/state", spark)
    state.folder = B.folder_of(f"file://{tmp_path}/shared", spark)
    got = B.build(spark, state, B.Config("demo", {"m": f"file://{src}"}))
    assert state.active() == got["build_id"] and Runtime(spark, state).search("rollback")["hits"]
    assert got["identity"]["roots"] == B.build(spark, B.State(tmp_path / "local"), B.Config("demo", {"m": str(src)}))["identity"]["roots"]


def test_command_line(tmp_path, capsys):
    from stratalith.cli import main

    src = _project(tmp_path)
    assert main([str(tmp_path / "s"), "init", str(src)]) == 0 and main([str(tmp_path / "s"), "init", str(src)]) == 4
    assert main([str(tmp_path / "s"), "config", str(src), "--target-tokens", "400"]) == 0
    assert '"layer": "flag"' in capsys.readouterr().out
    assert main([str(tmp_path / "s"), "builds"]) == 0 and main([str(tmp_path / "s"), "rollback"]) == 1 and main([str(tmp_path / "s"), "activate", "bld_0"]) == 5


def test_windowed_counts(spark, tmp_path):
    rows = [(1, f"2031-01-01 00:0{i}:00", "click", 1.0) for i in range(5)]
    spark.createDataFrame(rows, "event_id int, ts string, event_type string, value double").selectExpr("event_id", "cast(ts AS timestamp) ts", "event_type", "value").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id int, ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.events, r.total) for r in spark.table("counts").collect()] == [(5, 5.0)]


def test_paths():
    from stratalith.functions import paths as P

    assert P.canonical_path("a\\./b/../é.md") == "a/é.md"
    for bad in ("", "/a", "C:/x", "../x", "a/../../x", "con.txt", ".", "//share/x"):
        with pytest.raises(ValueError):
            P.canonical_path(bad)
    assert P.redact("token=abc123 at https://u:p@host") == "token=[redacted] at https://[redacted]@host"
    assert P.line_range(3, 5) == "lines 3-5" and P.line_range(3, 3) == "line 3" and P.line_range(0, 1) == ""
    assert P.searchable_terms("The plan: Rollback rollback of data sets") == ["plan", "rollback", "data"]
