"""Fixed values of the repository profile."""

# Directories never read for profiling, and the extensions that are.
CONTEXT_SKIP_DIRS = [".git", "node_modules", "venv", "__pycache__", "build", "dist", ".next", "vendor", ".tox", "egg-info"]
CONTEXT_EXTENSIONS = [".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".rb", ".php", ".yml", ".yaml", ".json"]

# Framework signs (any, ignore case), in report order.
FRAMEWORKS = [
    ("django", [r"from django", r"import django", r"INSTALLED_APPS", r"manage\.py"]),
    ("flask", [r"from flask", r"Flask\(__name__\)", r"@app\.route"]),
    ("fastapi", [r"from fastapi", r"FastAPI\(\)", r"@app\.(get|post)"]),
    ("express", [r"""require\([\'"]express[\'"]\)""", r"express\(\)", r"app\.use\("]),
    ("react", [r"""from [\'"]react[\'"]""", r"import React", r"ReactDOM", r"useState"]),
    ("vue", [r"""from [\'"]vue[\'"]""", r"Vue\.component", r"createApp"]),
    ("nextjs", [r"next/router", r"getServerSideProps", r"getStaticProps"]),
    ("spring", [r"@SpringBootApplication", r"@RestController", r"@Autowired"]),
    ("rails", [r"class.*<.*ApplicationController", r"Rails\.application"]),
]

# Repository-type signs, one point each (ignore case), in tie order.
TYPE_SIGNS = [
    ("client_sdk", [r"setup\.py", r"pyproject\.toml", r"api_?client", r"sdk", r"rest_?client", r"\.get\s*\(\s*endpoint",
                    r"\.post\s*\(\s*endpoint", r"requests\.(get|post|put|delete)", r"httpx\.(get|post|put|delete)"]),
    ("web_app", [r"@app\.route", r"@router\.(get|post|put|delete)", r"render_template", r"templates/", r"static/", r"\.html",
                 r"views\.py"]),
    ("backend_api", [r"@(api_view|APIView)", r"FastAPI\(\)", r"@app\.(get|post|put|delete)\(", r"endpoints/", r"routes/",
                     r"serializers\.py"]),
    ("cli_tool", [r"argparse", r"click\.", r"@click\.command", r"typer\.", r"""if __name__ == [\'"]__main__[\'"]"""]),
    ("library", []),
]

# Routes and client calls that move the score (case-sensitive).
ROUTE_SIGN = r"@(app\.|router\.)(route|get|post)"
CLIENT_SIGN = r"(requests|httpx|aiohttp)\.(get|post)"
PACKAGING_FILES = ["setup.py", "pyproject.toml"]

# Points added by frameworks, routes and packaging.
FRAMEWORK_BOOSTS = [("web_app", ["django", "flask"], 2), ("backend_api", ["fastapi"], 2), ("web_app", ["react", "vue"], 1)]
CLIENT_BOOSTS = [("client_sdk", 3)]
PACKAGING_BOOSTS = [("client_sdk", 2), ("library", 2)]

# Server routes (case-sensitive, any) and client calls (case-sensitive, two in one file).
SERVER_ROUTES = [r"@app\.route", r"@router\.", r"app\.(get|post|put|delete)\(", r"@api_view"]
CLIENT_CALLS = [r"requests\.(get|post|put|delete)", r"httpx\.", r"aiohttp\.", r"self\.(get|post|put|delete)\s*\(", r"\.json\(\)"]

# Authentication and validation signs (any, ignore case).
AUTH_SIGNS = [r"is_authenticated", r"check_auth", r"verify_token", r"jwt\.", r"authenticate", r"authorization",
              r"@login_required", r"@requires_auth", r"Bearer ", r"api_key", r"api_secret"]
VALIDATION_SIGNS = [r"validate\(", r"sanitize", r"escape\(", r"clean\(", r"Validator", r"Schema\(", r"pydantic", r"marshmallow"]

# How classes, imports and exported calls are read (case-sensitive).
CLASS_PARENTS = r"class\s+\w+\s*\(\s*([^)]+)\s*\)"
IMPORTS = r"(?:from\s+(\S+)\s+import|import\s+(\S+))"
EXPORTED_CALL = r"def (get|post|put|delete|request)\s*\("
TEST_CONTEXT_SIGNS = ["test_", "_test.", "/tests/", "/test/", "spec."]
TEST_DIRECTORIES = ["tests", "test", "spec", "__tests__"]

# Security rules by repository type (default first).
RULE_DEFAULTS = {
    "check_client_side_auth": True,
    "flag_missing_server_auth": True,
    "flag_hardcoded_keys_in_tests": False,
    "flag_mock_without_auth": False,
    "deserialization_strict": True,
}
RULE_OFF = {
    "check_client_side_auth": ["client_sdk"],
    "flag_missing_server_auth": ["client_sdk", "library"],
    "deserialization_strict": ["client_sdk"],
}
