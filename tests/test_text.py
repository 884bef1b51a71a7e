"""Pattern helpers, against Python's own regular expressions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codesieve.fixed import noise, profile, vectors, weak_hash, xpath
from codesieve.functions.cwe import parse_cwe, parse_cwe_list
from codesieve.functions.paths import detect_language, is_context_file, is_scanned, is_test_file, norm_path, normalize_language, rel_path
from codesieve.functions.text import java_regex, required_literal, strip

PATTERNS = sorted({r[1] for r in weak_hash.WEAK_HASH_RULES + weak_hash.CONFIG_RULES + xpath.XPATH_RULES}
                  | {p for v in vectors.VECTORS for p in v[5]} | set(noise.NOISE_PATTERNS) | set(weak_hash.SECURITY_CONTEXT)
                  | {p for _, ps in profile.FRAMEWORKS + profile.TYPE_SIGNS for p in ps} | set(profile.AUTH_SIGNS) | set(profile.CLIENT_CALLS))


def test_rule_counts():
    per_language = {}
    for r in weak_hash.WEAK_HASH_RULES:
        per_language[r[0]] = per_language.get(r[0], 0) + 1
    assert per_language == dict(java=24, python=7, javascript=5, go=4, php=4, ruby=4, csharp=5)
    assert len(weak_hash.CONFIG_RULES) == 6 and len(xpath.XPATH_RULES) == 42 and len(noise.NOISE_PATTERNS) == 42
    assert sum(len(v[5]) for v in vectors.VECTORS) == 51 and len(vectors.VECTORS) == 20


def test_all_patterns_compile_on_the_jvm(spark):
    compile_ = spark.sparkContext._jvm.java.util.regex.Pattern.compile
    for p in PATTERNS:
        compile_(java_regex(p))


@pytest.mark.parametrize("pattern,literal", [
    (r"hashlib\.md5\s*\(", "hashlib.md5"), (r"SHA-?1", "sha"), (r"requests\.(get|post)", "requests."), (r"a|b", ""), (r"[abc]", ""),
    (r"AKIA[0-9A-Z]{16}", "akia"), (r"ab{2,}cd", "cd"), (r"use+r", "use"), (r"user.*pass", "user"), (r"f\".*{.*}\"", 'f"')])
def test_required_literal(pattern, literal):
    assert required_literal(pattern) == literal


@settings(max_examples=30, deadline=None)
@given(st.data())
def test_every_match_holds_its_literal(data):
    pattern = data.draw(st.sampled_from(PATTERNS))
    text = data.draw(st.from_regex(re.compile(pattern, re.IGNORECASE | re.ASCII)))
    found = re.search(pattern, text, re.IGNORECASE)
    assert found is None or required_literal(pattern) in text.lower()


def test_patterns_match_as_in_python(spark):
    texts = ['hashlib.md5 (x)', 'f"SELECT {a}"', "sk-" + "a" * 32, "é = ſha1(", 'MessageDigest.getInstance( "md5" , p)', "a\rb.find (", '"//é[@x"', "$xpath->query(", "x = {API_KEY}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", *[F.col("t").rlike(java_regex(p)).alias(str(i)) for i, p in enumerate(PATTERNS)]).collect()
    for row in got:
        for i, p in enumerate(PATTERNS):
            assert row[i + 1] == bool(re.search(p, row["t"], re.IGNORECASE)), (row["t"], p)


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).first()[0]


CWE_CASES = [("89", 89), ("CWE-89", 89), ("CWE-089: SQLi", 89), ("external/cwe/cwe-079", 79), ("none", None), (None, None), ("", None)]


def test_parse_cwe(spark):
    df = spark.createDataFrame(CWE_CASES, "x string, want int").select("x", "want", parse_cwe(F.col("x")).alias("got"))
    assert [r.got for r in df.collect()] == [w for _, w in CWE_CASES]


def test_parse_cwe_list(spark):
    assert one(spark, ["x", "CWE-22: p", "CWE-79"], parse_cwe_list, "array<string>") == 22
    assert one(spark, [], parse_cwe_list, "array<string>") is None


PATH_CASES = [
    ("README.md", False, False, "Unknown"), ("component.spec.ts", True, True, "TypeScript"), ("script.py", True, False, "Python"), ("a/tests/x.py", True, True, "Python"),
    ("node_modules/a.js", False, False, "JavaScript"), ("src/build/x.go", False, False, "Go"), ("Dockerfile", True, False, "Docker"), ("docker-compose", True, False, "Unknown"),
    ("x.PY", True, False, "Unknown"), ("build", False, False, "Unknown"), ("a.jsx", True, False, "React/JSX"), ("x.cs", False, False, "CSharp"), ("a.tfx", False, False, "Unknown")]


def test_paths(spark):
    x = F.col("x")
    df = spark.createDataFrame([(c[0],) for c in PATH_CASES], "x string").select(x, is_scanned(x), is_test_file(x), detect_language(x))
    assert [tuple(r) for r in df.collect()] == PATH_CASES


CONTEXT_CASES = [("a.py", True), (".py", False), ("x/.tox/a.py", False), ("p.egg-info/a.py", False), ("a.xml", False), ("A.PY", False), ("a.b/c", False)]


def test_context_files(spark):
    df = spark.createDataFrame([(c[0],) for c in CONTEXT_CASES], "x string").select("x", is_context_file(F.col("x")))
    assert [tuple(r) for r in df.collect()] == CONTEXT_CASES


@pytest.mark.parametrize("lang,key", [("Python", "python"), ("TypeScript", "javascript"), ("React/JSX", "javascript"), ("CSharp", "csharp"), ("YAML", "yaml")])
def test_rule_keys(spark, lang, key):
    assert one(spark, lang, normalize_language) == key


def test_path_forms(spark):
    assert one(spark, "./.github\\x", norm_path) == "github/x"
    assert one(spark, "/root/a/b.py", lambda c: rel_path(c, "/root/")) == "a/b.py"
    assert one(spark, "/rooted/b.py", lambda c: rel_path(c, "/root")) == "/rooted/b.py"
    assert one(spark, "./a//b/./c.py", lambda c: rel_path(c, None)) == "a/b/c.py"
    assert one(spark, "  a\t\r\n", strip) == "a"
