"""Command line: ``python -m stratalith.cli STATE COMMAND ...``; answers are JSON unless text is asked for.

Exit codes: 0 done, 1 a failure, 2 a request that isn't valid, 3 a deadline passed, 4 the project or a setting isn't
valid, 5 what is asked for isn't there.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from stratalith import build as B
from stratalith.functions.paths import redact
from stratalith.plans.sqlsurface import SqlRejected, SqlTimeout
from stratalith.runtime import Runtime, render_bundle
from stratalith.session import local_session

EXITS = ((SqlTimeout, 3), (B.ConfigError, 4), (LookupError, 5), (SqlRejected, 2), (ValueError, 2), (B.BuildError, 1))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratalith")
    p.add_argument("state")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("plan", "build", "status", "config", "exclusions", "dev"):
        one = sub.add_parser(name)
        one.add_argument("config")
        if name in ("plan",):
            one.add_argument("--text", action="store_true")
        if name in ("build", "config"):
            for key in ("target_tokens", "maximum_tokens", "overlap_tokens"):
                one.add_argument(f"--{key.replace('_', '-')}", type=int, dest=key)
        if name == "dev":
            one.add_argument("--once", action="store_true")
    sub.add_parser("init").add_argument("directory")
    for name in ("describe", "doctor", "builds", "rollback", "tables"):
        sub.add_parser(name)
    sub.add_parser("prune").add_argument("--keep", type=int, default=5)
    sub.add_parser("activate").add_argument("build")
    d = sub.add_parser("diff")
    d.add_argument("before")
    d.add_argument("after")
    d.add_argument("--text", action="store_true")
    i = sub.add_parser("inspect")
    i.add_argument("view")
    i.add_argument("--artifact")
    i.add_argument("--limit", type=int, default=100)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--path")
    s.add_argument("--extension")
    s.add_argument("--artifact")
    s.add_argument("--status", action="append", dest="statuses")
    for name in ("context", "export"):
        c = sub.add_parser(name)
        c.add_argument("task")
        c.add_argument("--profile", default="agent")
        c.add_argument("--budget", type=int)
        c.add_argument("--markdown", action="store_true")
        if name == "export":
            c.add_argument("--to", required=True)
    r = sub.add_parser("read")
    r.add_argument("artifact")
    r.add_argument("--from-line", type=int)
    r.add_argument("--to-line", type=int)
    r.add_argument("--heading", action="append")
    sub.add_parser("table").add_argument("table")
    q = sub.add_parser("query")
    q.add_argument("table")
    q.add_argument("sql")
    k = sub.add_parser("pack")
    k.add_argument("build")
    k.add_argument("target")
    sub.add_parser("verify").add_argument("archive")
    j = sub.add_parser("project")
    j.add_argument("build")
    j.add_argument("target")
    j.add_argument("project_id")
    return p


def initialise(directory: str) -> dict:
    """A project file for a directory, its sources being its first-level directories or itself."""
    root = Path(directory)
    target = root / B.PROJECT_FILE
    if target.exists():
        raise B.ConfigError(f"{target.name} exists already")
    found = sorted(p.name for p in root.iterdir() if p.is_dir() and not p.name.startswith("."))
    project = {"name": root.absolute().name, "sources": {n: n for n in found} or {"main": "."}, "rules": []}
    target.write_text(json.dumps(project, indent=1), "utf-8")
    return project


def dispatch(a: argparse.Namespace) -> object:
    if a.command == "init":
        return initialise(a.directory)
    if a.command == "verify":
        return B.verify_archive(a.archive)
    if a.command == "config":
        loaded = B.Config.load(a.config, flags={k: getattr(a, k) for k in ("target_tokens", "maximum_tokens", "overlap_tokens")})
        return {k: {"value": v, "layer": layer, "identity": feeds} for k, (v, layer, feeds) in loaded.layers.items()}
    remote = "://" in a.state
    if a.command in ("builds", "activate", "rollback", "prune", "pack") and not remote:
        state = B.State(a.state)
    else:
        spark = local_session("*")
        state = B.State(a.state, spark)
    if a.command in ("builds", "activate", "rollback", "prune", "pack"):
        return {
            "builds": state.registry, "activate": lambda: state.activate(state.resolve(a.build)), "rollback": state.rollback,
            "prune": lambda: state.prune(a.keep), "pack": lambda: B.pack(state, state.resolve(a.build), a.target),
        }[a.command]()
    if a.command == "project":
        from stratalith.projection import project

        return project(spark, state, state.resolve(a.build), a.target, a.project_id)
    rt = Runtime(spark, state)
    if a.command == "plan":
        report = B.plan_report(spark, state, B.Config.load(a.config))
        return B.render_plan(report) if a.text else report
    if a.command == "build":
        return B.build(spark, state, B.Config.load(a.config, flags={k: getattr(a, k) for k in ("target_tokens", "maximum_tokens", "overlap_tokens")}))
    if a.command == "status":
        return B.status(spark, state, B.Config.load(a.config))
    if a.command == "exclusions":
        return B.exclusions(spark, B.Config.load(a.config))
    if a.command == "dev":
        from stratalith.streaming.watch import Rebuilder

        return Rebuilder(spark, state, B.Config.load(a.config)).run(a.once)
    if a.command == "doctor":
        return B.doctor(spark, state)
    if a.command == "describe":
        return rt.describe_build()
    if a.command == "tables":
        return rt.list_tables()
    if a.command == "table":
        return rt.describe_table(a.table)
    if a.command == "inspect":
        return rt.inspect(a.view, a.artifact, a.limit)
    if a.command == "diff":
        found = B.diff(spark, state, state.resolve(a.before), state.resolve(a.after))
        return B.render_diff(found) if a.text else found
    if a.command == "search":
        return rt.search(a.query, a.limit, path=a.path, extension=a.extension, artifact=a.artifact, statuses=a.statuses)
    if a.command in ("context", "export"):
        got = rt.context_for_task(a.task, a.profile, a.budget)
        if a.command == "export":
            Path(a.to).write_text(render_bundle(got), "utf-8")
            return {"written": a.to, "estimated_tokens": got["estimated_tokens"]}
        return render_bundle(got) if a.markdown else got
    if a.command == "read":
        return rt.read_source(a.artifact, a.from_line, a.to_line, a.heading)
    return rt.query_table(a.table, a.sql)


def main(argv: list[str] | None = None) -> int:
    try:
        got = dispatch(parser().parse_args(argv))
    except tuple(e for e, _ in EXITS) as e:
        print(json.dumps({"error": type(e).__name__, "message": redact(str(e))}), file=sys.stderr)
        return next(code for kind, code in EXITS if isinstance(e, kind))
    print(got if isinstance(got, str) else json.dumps(got, indent=1, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
