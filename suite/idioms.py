"""Code idioms that the corpus view appends to the texts of the document table, and the names it gives the files."""

DIRECTORIES = ["core", "auth", "api", "tests", "cloud", "admin", "lib"]
SUFFIXES = [".py", ".java", ".js", ".php", ".go", ".rb", ".cs", ".ts", ".jsx", ".yml", ".Dockerfile"]

IDIOMS = [
    'def store(password):\n    digest = hashlib.md5(password.encode()).hexdigest()\n    return digest',
    'MessageDigest md = MessageDigest.getInstance("MD5");\nbyte[] d = md.digest(data);\nHMAC-MD5 verify;',
    'const token = CryptoJS.MD5(userId);\nres.cookie("session", token);',
    '$sum = md5($file); // checksum only\n$etag = sha1($body);',
    'h := md5.New()\nsum := sha1.Sum(data)',
    'Digest::SHA1.hexdigest(value)\nsig = OpenSSL::Digest.new("MD5")',
    'var h = MD5.Create();\nvar s = new SHA1CryptoServiceProvider();',
    'name = request.args["name"]\nusers = tree.xpath("//user[@name=\'" + name + "\']")',
    'bar = request.getParameter("vector");\nbar = "safe_value";\nnodes = doc.selectNodes("//item[@id=\'" + bar + "\']");\nrows = tree.xpath("//item[@id=\'" + bar + "\']")',
    'String bar = "default";\nbar = req.getHeader("x");\nObject r = xpath.evaluate("//a[@b=" + bar + "]", doc);\nvar n = doc.find(bar + suffix);',
    'clean = sanitize(params[0])\nresult = root.find("//node[@key=" + clean + "]")\nother = root.find(clean)',
    'expr = "//book[@title=\'" + title + "\']"\nrun(expr)',
    'from flask import Flask\napp = Flask(__name__)\n@app.route("/login/<user_id>")\ndef login():\n    return render_template("login.html")',
    'class Handler(base.Core, Mixin):\n    def get(self, key):\n        return check_auth(key)',
    'import requests\nclass ApiClient(Auth):\n    def get(self):\n        return requests.get(endpoint + user).json()',
    'import argparse\nimport click\nif __name__ == "__main__":\n    main()',
    'import React from "react";\nconst [s, setS] = useState(0);\nexport default App;',
    'password = "hunter2secret"\nresult = eval(expr)\nos.system("ls " + path)',
    'hash.algorithm=MD5\nalgorithm: "sha1"\nDEBUG = True',
    'data = pickle.loads(blob)\ncfg = yaml.load(stream)\ntoken = str(random.random())',
    '$id = $_GET["id"];\n$r = $xml->xpath("/items/item[@id=\'$id\']");\n$q = $xpath->query("//a" . $id);',
    'const q = "//a[@href=\'" + user_data + "\']";\ndocument.evaluate(q, document, null, XPathResult.ANY_TYPE, null);',
    'class MockServer(Tests):\n    def handler(self, msg):\n        subscribe(msg)\n        validate(msg)',
    '',
]
# CWE a labelled file of each idiom is about, 0 for none.
IDIOM_CWE = [328] * 7 + [643, 643, 643, 643, 643, 79, 306, 918, 79, 79, 798, 328, 502, 643, 643, 79, 0]

SEVERITIES = [("R", "O", "CRITICAL"), ("A", "O", "HIGH"), ("R", "F", "MEDIUM"), ("N", "O", "LOW"), ("N", "F", "INFO")]
CATEGORIES = [
    # part type, category, cwe, owasp
    ("ECONOMY", "SQL Injection", "CWE-89", "A03:2021"),
    ("LARGE", "XSS", "CWE-79", "A03:2021"),
    ("MEDIUM", "authentication_bypass", "CWE-287", "A07:2021"),
    ("PROMO", "idor_data_exposure", "CWE-639", "A01:2021"),
    ("SMALL", "ssrf", "CWE-918", ""),
    ("STANDARD", "Sensitive Data Exposure", None, None),
]
SNIPPETS = [
    "cursor.execute(query + name)", "session.query(User)", "if not user.authenticated: raise AuthenticationError()",
    "key = load_private_key(pem)", "Item.objects.filter(id=1) # django", "def __init__(self, **kwargs)", "sid = uuid4()", "render(template, data)",
    "requests.get(url)", "log.debug(token)", "handler(request)",
]
DESCRIPTIONS = [
    "Endpoint does not check authorization", "Cookie is set without flags", "Hardcoded key in source", "There is no logging of failures",
    "User input reaches the query", "Session id is predictable", "Public api endpoint without auth",
]
HTML_RULES = [
    ("H-1", "Inline script", "CWE-79", "HIGH", r"<script>"),
    ("H-2", "Plain link", "CWE-319", "LOW", r"href=[\"']http://"),
    ("H-3", "Tracking call", "CWE-200", "INFO", r"track\(\d+\)"),
    ("H-4", "Escaped ampersand", "CWE-116", "MEDIUM", r"&amp;|&#\d+;"),
]
RUNS = 3
MODELS = [("view", "claude"), ("click", "gpt4o"), ("error", "gpt4o-mini"), ("purchase", "llama"), ("signup", "house-model")]
TASKS = ["sast", "validation", "Simple_Scan", "architecture", "other"]
