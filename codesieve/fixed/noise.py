"""Fixed values of file selection and of the false-positive filters."""

# Files read by a scan.
SCAN_SKIP_DIRS = [".git", "node_modules", "venv", "__pycache__", "build", "dist", ".next", "vendor"]
SCAN_SUFFIXES = [".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".rb", ".php", ".yml", ".yaml", ".json", ".xml",
                 ".tf", ".dockerfile", ".sql", ".sh", ".bash", ".sol"]
SCAN_NAMES = ["Dockerfile", "docker-compose"]

# Language by suffix, first match wins (case-sensitive); the last row is our addition.
LANGUAGE_SUFFIXES = [
    (".py", "Python"), (".js", "JavaScript"), (".jsx", "React/JSX"), (".ts", "TypeScript"), (".tsx", "TypeScript/React"),
    (".java", "Java"), (".go", "Go"), (".rb", "Ruby"), (".php", "PHP"), (".yml", "YAML"), (".yaml", "YAML"),
    (".json", "JSON"), (".tf", "Terraform"), (".sql", "SQL"), (".sol", "Solidity"),
    (".cs", "CSharp"),
]

# Rule-set key by lower-cased language; the last two rows are our addition.
LANGUAGE_ALIASES = [
    ("py", "python"), ("python", "python"), ("js", "javascript"), ("javascript", "javascript"), ("ts", "javascript"),
    ("typescript", "javascript"), ("java", "java"), ("go", "go"), ("golang", "go"), ("php", "php"), ("rb", "ruby"),
    ("ruby", "ruby"), ("cs", "csharp"), ("csharp", "csharp"),
    ("react/jsx", "javascript"), ("typescript/react", "javascript"),
]

# What makes a path a test file.
TEST_FILE_SIGNS = ["test_", "_test.", "/tests/", "/test/", "spec.", ".spec."]

# Snippets that are never reported (any, ignore case).
NOISE_PATTERNS = [
    r"\.objects\.filter\(", r"\.objects\.get\(", r"\.objects\.create\(",
    r"session\.query\(", r"session\.execute\(",
    r"render_template\(",
    r"->\s*str:", r"->\s*int:", r"->\s*bool:",
    r"test_", r"_test\.", r"/tests/", r"/test/", r"spec\.", r"\.spec\.",
    r"TEST_PASSWORD", r"DUMMY_PASSWORD", r"EXAMPLE_PASSWORD", r"DEFAULT_PASSWORD", r"PLACEHOLDER",
    r"if __name__ == '__main__':", r"localhost", r"127\.0\.0\.1", r"0\.0\.0\.0",
    r"YOUR_API_KEY_HERE", r"<API_KEY>", r"\{API_KEY\}", r"\$\{API_KEY\}", r"%%API_KEY%%",
    r'"""', r"'''", r"//",
    r": str", r": int", r": bool", r": Optional", r": List", r": Dict",
    r"pass  # noqa",
    r"SECURE_SSL_REDIRECT = True", r"SESSION_COOKIE_SECURE = True", r"CSRF_COOKIE_SECURE = True",
]

# Used when a filter file is named but absent.
NOISE_FALLBACK = [r"# nosec", r"# skipcq", r"# type: ignore", r"# noqa"]

# Word lists of the context filter (all lower case).
MISSING_AUTH_CATEGORIES = ["access control", "authorization", "broken access", "idor", "missing auth"]
DANGEROUS_LOADERS = ["pickle", "yaml.load(", "yaml.unsafe", "eval(", "exec("]
AUTH_CHECK_PATTERNS = ["if not.*authenticated", "raise.*authenticationerror", "raise.*authorizationerror", "check.*auth",
                       "verify.*token"]

# Categories that name the same issue.
SIMILAR_CATEGORIES = [
    ["weak hash", "weak crypto", "md5", "sha-1", "sha1", "cryptographic"],
    ["xpath", "xml injection", "xml query"],
]
