"""Repository profiles."""

from pyspark.sql import functions as F

from codesieve.operators import parents, profile
from codesieve.operators.model_io import build_requests


def kind(src, *pairs):
    return profile.profile_repo(src(*pairs)).first()


def test_types(src):
    assert kind(src, ("a.py", "x = 1")).codebase_type == "unknown"
    assert kind(src, ("app.py", "from flask import Flask\n@app.route('/')")).codebase_type == "web_app"
    assert kind(src, ("main.py", "from fastapi import FastAPI\napp = FastAPI()\n@app.get('/')")).codebase_type == "backend_api"
    assert kind(src, ("setup.py", ""), ("c.py", "requests.get(endpoint)")).codebase_type == "client_sdk"
    assert kind(src, ("t.py", "import argparse")).codebase_type == "cli_tool"
    # A tie goes to the earlier type.
    assert kind(src, ("t.py", "import argparse\nmy sdk")).codebase_type == "client_sdk"


def test_flags(src):
    p = kind(src, ("tests/a.py", "requests.get(u).json()"), ("b.py", "@router.x\ncheck_auth()"), ("Spec/c.py", "useState"), ("d.txt", "from django"))
    assert (p.frameworks, p.has_server_routes, p.has_api_client_pattern, p.has_auth_middleware, p.test_directories) == (["react"], True, True, True, ["Spec", "tests"])
    assert p.n_files == 3 and p.check_client_side_auth is (p.codebase_type != "client_sdk")


def test_every_file_counts(src):
    files = [(f"f{i:04d}.py", "from django" if i == 4999 else "@app.route" if i == 4000 else "") for i in range(5000)]
    p = kind(src, *files)
    assert p.frameworks == ["django", "flask"] and p.has_server_routes is True and p.n_files == 5000
    renamed = [(f"z{path}" if text else path, text) for path, text in files]
    assert kind(src, *renamed).codebase_type == p.codebase_type


def test_profile_shuffles_bits_only(src):
    plan = profile.detect_codebase_type(src(("a.py", "")))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1 and "content" not in plan.split("Exchange")[0]


CONTEXTS = [("base_auth.py", "class Base:\n    check_auth()"), ("plain.py", "x"), ("a.py", "class A(lib.Base_Auth, object):\n  pass"), ("b.py", "class B(Plain): pass"), ("c.py", "class C( ): pass\nclass D(A,): pass")]


def contexts(src):
    return profile.file_context(src(*CONTEXTS))


def test_file_context(src):
    c = profile.file_context(src(("tests/mock_x.py", "from a.b import c\nimport os\nclass X(P.Q, R):\n  def get(self): validate(x)\n  Bearer t"))).first()
    assert (c.parent_classes, c.imports) == (["P.Q", "R"], ["a.b", "os"])
    assert (c.has_auth_check, c.has_input_validation, c.is_test_file, c.is_mock, c.exports_api) == (True, True, False, True, True)


def test_inheritance_equals_brute_force(src):
    ctx = {r.path: r for r in contexts(src).collect()}
    want = sorted((p, o) for p, c in ctx.items() for parent in c.parent_classes for o in ctx if parent.split(".")[-1].lower() in o.lower())
    assert sorted((r.path, r.parent_path) for r in parents.inheritance_edges(contexts(src)).collect()) == want
    # An empty parent name is in every path.
    assert ("c.py", "plain.py") in want
    auth = {p for p, o in want if ctx[o].has_auth_check}
    assert {r.path for r in parents.parent_has_auth(contexts(src)).filter("parent_has_auth").collect()} == auth


def test_parents_in_small_shards_and_slices(spark):
    """A repository whose paths all hold one name, overlapping names, letters of two cases and bytes; no part sees it whole."""
    rows = [("big", f"Base/{'ÉTÉ' if i % 3 else 'ete'}/view_{i}.py", [f"x.View_{i % 7}", "Base", "été", "se/"] + ([""] if i == 5 else []), i % 50 == 0) for i in range(300)]
    rows += [(f"r{i}", f"{n}.py", [n.upper(), "none"], n == "ab") for i in range(3) for n in ("a", "ab", "b")] + [(None, "n.py", ["n"], True), ("empty", "e.py", [], False)]
    ctx = spark.createDataFrame(rows, "repo_id string, path string, parent_classes array<string>, has_auth_check boolean")
    names = {(r, p.split(".")[-1].lower()) for r, _, ps, _ in rows for p in ps if r}
    held = sorted((r, b, p) for r, b in names for q, p, _, _ in rows if q == r and b in p.lower())
    assert sorted(map(tuple, parents.parent_files(ctx, shard=3, size=40).collect())) == held
    counted = sorted((r, b, n) for r, b in names if (n := sum(h[:2] == (r, b) for h in held)))
    assert sorted(map(tuple, parents.parent_counts(ctx, shard=3, size=40).collect())) == counted == sorted(map(tuple, parents.parent_counts(ctx).collect()))
    auth = {(r, p) for r, p, _, a in rows if a}
    want = {(r, p) for r, p, ps, _ in rows for x in ps if any(h[:2] == (r, x.split(".")[-1].lower()) and (r, h[2]) in auth for h in held)}
    assert {(r.repo_id, r.path) for r in parents.parent_has_auth(ctx).where("parent_has_auth").collect()} == want
    some = spark.createDataFrame([("big", "view_3"), ("r1", "ab")], "repo_id string, base string")
    assert {(r.repo_id, r.parent_path) for r in parents.inheritance_edges(ctx, some).collect()} == {(r, p) for r, b, p in held if (r, b) in (("big", "view_3"), ("r1", "ab"))}
    assert parents.parent_counts(ctx.where("false")).count() == 0


def test_no_letters_of_paths_are_exploded(src):
    plan = parents.parent_counts(contexts(src))._jdf.queryExecution().optimizedPlan().toString()
    assert "substr" not in plan and "BroadcastNestedLoop" not in plan and "Cartesian" not in plan


def test_lookup_and_requests(src):
    files = src(*CONTEXTS)
    found = profile.lookup_file_context(files.select("repo_id", F.concat(F.lit("./"), "path").alias("path")), contexts(src))
    assert found.filter("file_context is null").count() == 0
    reqs = {r.path: r for r in build_requests(files, contexts(src), profile.profile_repo(files), {"k": 1}).collect()}
    assert "Parent class HAS authentication checks" in reqs["a.py"].system and "HAS" not in reqs["b.py"].system
    assert '"k": 1' in reqs["b.py"].system and "class B(Plain)" in reqs["b.py"].user


def test_edges_of_one_name_are_many_keys(spark):
    """Edges are those of a plain join, with repeated rows; a name that all files share is cut in squares, not made by one key."""
    rows = [("r", f"core/f{i % 90}.py", ["a.Core", "Mixin"] if i % 3 else ["Core", "x.core"]) for i in range(120)] + [("s", "", [""]), ("s", "a.py", None)]
    ctx = spark.createDataFrame(rows, "repo_id string, path string, parent_classes array<string>")
    base = parents.base_names(ctx)
    files = ctx.select("repo_id", ctx.path.alias("parent_path"))
    want = base.join(files, "repo_id").where("contains(lower(parent_path), base)").select("repo_id", "path", "pos", "parent_path")
    want = sorted(map(tuple, want.collect()))
    for square in (7, 1000):
        assert sorted(map(tuple, parents.inheritance_edges(ctx, square=square).collect())) == want
    assert "parent_strip" in parents.inheritance_edges(ctx)._jdf.queryExecution().optimizedPlan().toString()
