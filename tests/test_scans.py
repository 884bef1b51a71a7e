"""Rule scans on small files, hand-checked and against a line-by-line brute force."""

import re

from codesieve.fixed import weak_hash
from codesieve.operators.findings import scan_specialized
from codesieve.operators.vectors import find_vectors, scan_vectors
from codesieve.operators.weak_hash import find_weak_hash, hash_findings, scan_weak_hash
from codesieve.operators.xpath import scan_xpath, xpath_findings
from codesieve.sources import files, rules


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


HASH_CASES = [
    ("a.py", "h = hashlib.md5(x)", ["hashlib.md5()"]), ("a.py", "HASHLIB.SHA1 (x)", ["hashlib.sha1()"]), ("a.js", "CryptoJS.MD5(x)", ["CryptoJS.MD5()", "md5()"]),
    ("a.tsx", "md5(x)", ["md5()"]), ("a.cs", "MD5.Create()", ["MD5.Create()"]), ("a.rb", "Digest::SHA1.new", ["Digest::SHA1"]), ("a.go", "sha1.Sum(b)", ["sha1.Sum()"]),
    ("a.php", 'hash("md5", $x)', ['hash("md5", ...)']), ("a.txt", "md5(x)", []), ("a.yml", "hash.algorithm = md5", ["hash.algorithm=MD5"]),
    ("Dockerfile", 'ENV algorithm="sha1"', ['algorithm = "sha1"']), ("a.java", 'MessageDigest.getInstance("SHA-256")', []),
    ("a.java", 'p.getProperty("hashAlg", "md5")', ['getProperty("hashAlg", "MD5/SHA1")', 'getProperty("algorithm", "MD5/SHA1")'])]


def test_hash_rules(src):
    got = rows(find_weak_hash(src(*[(f"{i}/{path}", line) for i, (path, line, _) in enumerate(HASH_CASES)])), "path", "function_name")
    assert got == sorted((f"{i}/{path}", n) for i, (path, _, names) in enumerate(HASH_CASES) for n in names)


USAGE_CASES = [
    ("password", "password_hashing", "CRITICAL", "HIGH"), ("jwt", "token_generation", "HIGH", "HIGH"), ("hmac", "hmac", "HIGH", "HIGH"), ("kdf", "key_derivation", "CRITICAL", "HIGH"),
    ("salt", "security_general", "HIGH", "HIGH"), ("checksum", "non_security", "LOW", "MEDIUM"), ("plain", "unknown", "MEDIUM", "HIGH")]


def test_usage(src):
    hits = scan_weak_hash(src(*[(f"{i}.py", f"# {c[0]}\nh = hashlib.md5(v)") for i, c in enumerate(USAGE_CASES)]))
    assert rows(hits, "path", "usage", "severity", "confidence") == [(f"{i}.py", *c[1:]) for i, c in enumerate(USAGE_CASES)]


def test_strict_mode_keeps_security_uses_only(src):
    files_ = src(("a.py", "hashlib.md5(v)"), ("b.py", "# password\nhashlib.md5(v)"))
    assert rows(scan_weak_hash(files_, aggressive=False), "path") == [("b.py",)]
    assert len(rows(scan_weak_hash(files_), "path")) == 2


def test_context_reaches_five_lines_and_is_clamped(src):
    far = ["x"] * 5
    hit = lambda before, after: scan_weak_hash(src(("a.py", "\n".join([*before, "hashlib.md5(v)", *after])))).first().usage
    assert hit(["password", *far[:4]], []) == "password_hashing"
    assert hit(["password", *far], []) == "unknown"
    assert hit([], [*far[:4], "password"]) == "password_hashing"
    assert hit([], [*far, "password"]) == "unknown"


def test_path_is_part_of_the_context(src):
    assert scan_weak_hash(src(("auth/x.py", "hashlib.md5(v)"))).first().usage == "security_general"


def test_odd_files(src):
    files_ = src(("empty.py", ""), ("blank.py", " \n\t\n"), ("crlf.py", "a\r\nh = hashlib.md5(v)\r\n"), ("last.py", "a\n\nhashlib.md5(v)"), ("two.py", "hashlib.md5(a); hashlib.sha1(b)"))
    assert rows(scan_weak_hash(files_), "path", "line_no", "code_snippet") == [
        ("crlf.py", 2, "h = hashlib.md5(v)"), ("last.py", 3, "hashlib.md5(v)"), ("two.py", 1, "hashlib.md5(a); hashlib.sha1(b)"), ("two.py", 1, "hashlib.md5(a); hashlib.sha1(b)")]
    assert files.explode_lines(src(("a", "x\n\n"))).count() == 3


def test_own_rules_without_plain_text(spark, src):
    own = spark.createDataFrame([("own", 1, "own-1", "*", r"\d{3}", "three digits", "UNKNOWN"), ("own", 2, "own-2", "python", r"a|b", "letters", "UNKNOWN")],
                                "rule_set string, rule_no int, rule_id string, language string, pattern string, function_name string, algorithm_or_library string")
    hits = scan_weak_hash(src(("a.py", "123\nb"), ("a.js", "a 456")), own)
    assert rows(hits, "path", "line_no", "function_name") == [("a.js", 1, "three digits"), ("a.py", 1, "three digits"), ("a.py", 2, "letters")]


def test_hash_scan_equals_brute_force(src):
    import random
    rng = random.Random(7)
    parts = ["hashlib.md5(", "MD5.Create()", "sha1 (", 'createHash("md5")', "crypto.", "x = 1", 'HASH_ALGORITHM = "SHA1"', "Digest::MD5", "md5.New()", "", "password", "// legacy"]
    pairs = [(f"f{i}.{e}", "\n".join(" ".join(rng.choices(parts, k=rng.randint(0, 3))) for _ in range(rng.randint(1, 30))))
             for i, e in enumerate(["py", "js", "go", "php", "rb", "cs", "java", "txt"] * 3)]
    keys = dict(py="python", js="javascript", go="go", php="php", rb="ruby", cs="csharp", java="java", txt="unknown")
    want = sorted((p, n, name) for p, text in pairs for n, line in enumerate(text.split("\n"), 1)
                  for lang, pattern, name, _ in weak_hash.WEAK_HASH_RULES + weak_hash.CONFIG_RULES
                  if lang in ("*", keys[p.split(".")[1]]) and text.strip() and re.search(pattern, line, re.IGNORECASE))
    assert rows(find_weak_hash(src(*pairs)), "path", "line_no", "function_name") == want and want


def xpath(src, text, path="a.py", **kw):
    return sorted((r.line_no, r.phase, r.pattern_type, r.severity, r.confidence, r.user_source) for r in scan_xpath(src((path, text)), **kw).collect())


CALL_CASES = [
    ('r = tree.xpath("a" + name)\nrequest.x', ("concatenation_with_user_input", "CRITICAL", "HIGH", "request.")),
    ('r = tree.xpath("a" + name)\nrequest.x; escape(y)', ("concatenation_with_user_input", "MEDIUM", "MEDIUM", "request.")),
    ('r = tree.xpath("a" + name)', ("concatenation", "HIGH", "MEDIUM", "unknown")),
    ('r = tree.xpath(name)\ncookie', ("unsanitized_input", "HIGH", "MEDIUM", "cookie")),
    ("xpath = tree.xpath('/' + name)", ("dynamic_query_building", "HIGH", "HIGH", "unknown")),
    ("xpath = tree.xpath('/' + name) # validate", ("dynamic_query_building", "MEDIUM", "MEDIUM", "unknown")),
    ("r = tree.xpath(name)", None), ('r = tree.xpath("a" + name) # quote', None), ("r = tree.xpath(name)\ncookie quote", None)]


def test_call_table(src):
    hits = scan_xpath(src(*[(f"{i}.py", text) for i, (text, _) in enumerate(CALL_CASES)])).filter("phase = 1 and rule_no = 9")
    got = rows(hits, "path", "pattern_type", "severity", "confidence", "user_source")
    assert got == [(f"{i}.py", *want) for i, (_, want) in enumerate(CALL_CASES) if want]


def test_user_input_window_ends_five_lines_below(src):
    call = "r = tree.xpath(name)"
    assert xpath(src, call + "\n" * 5 + "cookie")
    assert not xpath(src, call + "\n" * 6 + "cookie")
    assert xpath(src, "cookie" + "\n" * 50 + call)


def test_first_pattern_in_list_order_is_reported(src):
    assert xpath(src, "cookie\nsession.x\nr = tree.xpath(n)\nparams[1]")[0][5] == "params["
    assert xpath(src, "user_data\nr = tree.xpath(userdata)")[0][5] == "userdata"
    assert xpath(src, "user_data\nr = tree.xpath(x)")[0][5] == "user_data"


LAST_CASES = [
    ('bar = "safe";', "", False), ('bar = request.x\nbar = "safe";', "", False), ('bar = "safe";\nbar = request.x', "", True), ('bar = "safe";\nbar = "";', "", False),
    ('bar = other', "", True), ("", 'bar = "late";', False), ("", "\n\n\n\n\n" + 'bar = "late";', True), ('BAR = "safe";', "", False), ('foobar = "safe";', "", True),
    ('bar = "safe";\nbar = new String(x)', "", True), ('bar = "a" + "";', "", True), ("bar = CONST;", "", False)]


def test_last_assignment_decides(src):
    texts = [f"{before}\nr = tree.xpath('//a' + bar + '/b')\n{after}" for before, after, _ in LAST_CASES]
    kept = {r.path for r in scan_xpath(src(*[(f"{i}.py", t) for i, t in enumerate(texts)])).collect()}
    assert kept == {f"{i}.py" for i, c in enumerate(LAST_CASES) if c[2]}


def test_generic_names_are_not_followed(src):
    assert xpath(src, 'query = "safe";\nr = tree.xpath("a" + query + "b")')


def test_strings_only_where_no_call_is_reported(src):
    assert [g[1] for g in xpath(src, "e = '//a' + t\ntree.xpath('//a' + t)")] == [2, 1, 1]
    assert xpath(src, "e = '//a' + t # escape", "a.txt") == [(1, 2, "xpath_query_concatenation_sanitized", "LOW", "LOW", "unknown")]
    assert xpath(src, "e = '//a'", "a.txt") == []
    # A call that is harmless leaves its line to the string rule.
    assert xpath(src, "tree.xpath('//a' , t + 1) # escape") == [(1, 2, "xpath_query_concatenation_sanitized", "LOW", "LOW", "unknown")]


def test_finding_columns(src):
    text = "password\nh = hashlib.md5(x)\nr = tree.xpath('//' + name)"
    found = {r.origin: r for r in scan_specialized(src(("a.py", text))).filter("id like 'CRYPTO%' or line = 3").collect()}
    assert found["crypto"].cwe == "CWE-328" and found["xpath"].cwe == "CWE-643" and found["crypto"].ord < found["xpath"].ord
    assert found["crypto"].description.startswith("Use of weak cryptographic hash algorithm MD5 detected via `hashlib.md5()`. This algorithm is used for password hashing.")
    assert found["xpath"].description.endswith("No input sanitization or parameterization was detected in the surrounding code.")
    assert re.fullmatch("CRYPTO-[0-9A-F]{8}", found["crypto"].id)
    assert hash_findings(scan_weak_hash(src(("a.py", text)))).columns == xpath_findings(scan_xpath(src(("a.py", text)))).columns


def test_vectors(spark, src):
    files_ = src(("a.py", 'eval(x)\nq = f"SELECT {a}"\npassword = "abc"'))
    got = rows(find_vectors(files_, rules.default_vector_rules(spark)), "line_no", "vector_id")
    assert got == [(1, "INJ-003"), (2, "INJ-001"), (3, "CRYPTO-002")]
    assert scan_vectors(files_, rules.default_vector_rules(spark)).filter("cwe = 'CWE-89'").first().severity == "CRITICAL"


def test_no_shuffle_of_text(src):
    plan = scan_weak_hash(src(("a.py", "hashlib.md5(x)")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    plan = scan_xpath(src(("a.py", "hashlib.md5(x)")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_changed_files(spark, src):
    files_ = src(("a.py", "x"), ("b.md", "x"), ("node_modules/c.js", "x"))
    assert rows(files.scan_changed_files(files_, ["a.py", "b.md", "node_modules/c.js"]), "path") == [("a.py",), ("node_modules/c.js",)]
    assert files.scan_changed_files(files_, None).count() == 3 and files.scan_changed_files(files_, []).count() == 3


def test_last_assignment_of_many_hits(spark):
    """The merge of uses and assignments gives what looking through all assignments of a file gives."""
    import random

    from codesieve.operators.xpath import with_last_assignment
    rng, rows = random.Random(5), []
    for f in range(60):
        uses = [(rng.choice(["a", "b", "c", None]), rng.randint(1, 30), i, None) for i in range(rng.randint(0, 25))]
        given = [(v, n, -1, rng.choice(["safe", "other"])) for v, n in {(rng.choice("abd"), rng.randint(1, 30)) for _ in range(rng.randint(0, 25))}]
        rows.append((f, list(range(len(uses))), given or None, uses))
    pair = "array<struct<var:string,upto:int,hit:int,kind:string>>"
    got = {r.f: r.last for r in with_last_assignment(spark.createDataFrame(rows, f"f int, hits array<int>, assignments {pair}, uses {pair}")).collect()}
    for f, _, given, uses in rows:
        want = []
        for var, upto, i, _ in uses:
            earlier = [(n, kind) for v, n, _, kind in given or [] if v == var and n <= upto]
            want.append((i, max(earlier)[1] if earlier else None))
        assert [tuple(r) for r in got[f]] == want
