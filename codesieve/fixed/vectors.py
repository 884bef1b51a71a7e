"""Fixed values of the default attack-vector catalogue."""

# Fixed values: (category key, category name, owasp).
VECTOR_CATEGORIES = [
    ("injection", "Injection Attacks", "A03:2021"),
    ("xss", "Cross-Site Scripting", "A03:2021"),
    ("authentication", "Authentication Issues", "A07:2021"),
    ("access_control", "Broken Access Control", "A01:2021"),
    ("cryptography", "Cryptographic Failures", "A02:2021"),
    ("security_misconfiguration", "Security Misconfiguration", "A05:2021"),
    ("ssrf", "Server-Side Request Forgery", "A10:2021"),
    ("xxe", "XML External Entity", "A05:2021"),
    ("deserialization", "Insecure Deserialization", "A08:2021"),
]

# Fixed values: (category key, vector id, name, cwe, severity, detection patterns).
VECTORS = [
    ("injection", "INJ-001", "SQL Injection", "CWE-89", "CRITICAL",
     [r'f".*SELECT.*{.*}"', r'f".*INSERT.*{.*}"', r"""\.execute\(["'].*\+.*["']""", r"""\.execute\(f["'].*\{.*\}.*["']"""]),
    ("injection", "INJ-002", "NoSQL Injection", "CWE-943", "HIGH",
     [r"db\.collection\.find\(\{.*req\.", r"Model\.find\(req\."]),
    ("injection", "INJ-003", "Command Injection", "CWE-78", "CRITICAL",
     [r"os\.system\(", r"subprocess\.call\(.*shell=True", r"exec\(", r"eval\("]),
    ("injection", "INJ-004", "LDAP Injection", "CWE-90", "HIGH", []),
    ("xss", "XSS-001", "Reflected XSS", "CWE-79", "HIGH",
     [r"innerHTML.*user", r"document\.write\(.*\)", r"\$\(.*\)\.html\("]),
    ("xss", "XSS-002", "Stored XSS", "CWE-79", "CRITICAL", []),
    ("xss", "XSS-003", "DOM-based XSS", "CWE-79", "MEDIUM",
     [r"location\.hash", r"location\.search", r"window\.location"]),
    ("authentication", "AUTH-001", "Weak Password Hashing", "CWE-326", "CRITICAL",
     [r"hashlib\.md5\(", r"hashlib\.sha1\(", r"md5\(", r"sha1\("]),
    ("authentication", "AUTH-002", "Predictable Session Token", "CWE-340", "HIGH",
     [r"session_id\s*=\s*str\(time", r"token\s*=\s*str\(random"]),
    ("authentication", "AUTH-003", "Missing Authentication", "CWE-306", "CRITICAL",
     [r"@app\.route.*without.*@login_required", r"def.*admin.*without.*auth"]),
    ("access_control", "AC-001", "IDOR (Insecure Direct Object Reference)", "CWE-639", "HIGH",
     [r"@app\.route.*<.*id>.*", r"get\(id\).*without.*ownership"]),
    ("access_control", "AC-002", "Path Traversal", "CWE-22", "HIGH",
     [r"open\(.*\+.*filename", r"open\(f.*\{filename\}"]),
    ("cryptography", "CRYPTO-001", "Weak Encryption Algorithm", "CWE-327", "HIGH",
     [r"DES\.MODE_ECB", r"Cipher\.DES", r"RC4", r"MD5"]),
    ("cryptography", "CRYPTO-002", "Hardcoded Secrets", "CWE-798", "CRITICAL",
     [r"""password\s*=\s*["'][^"']+["']""", r"""api[_-]?key\s*=\s*["'][^"']+["']""", r"""secret\s*=\s*["'][^"']+["']""",
      r"sk-[a-zA-Z0-9]{32,}", r"AKIA[0-9A-Z]{16}"]),
    ("security_misconfiguration", "CONFIG-001", "Debug Mode Enabled", "CWE-489", "MEDIUM",
     [r"DEBUG\s*=\s*True", r"app\.debug\s*=\s*True"]),
    ("security_misconfiguration", "CONFIG-002", "CORS Misconfiguration", "CWE-942", "MEDIUM",
     [r"Access-Control-Allow-Origin:\s*\*", r"CORS\(.*origins=.*\*"]),
    ("security_misconfiguration", "CONFIG-003", "Missing Security Headers", "CWE-693", "LOW",
     [r"X-Frame-Options", r"Content-Security-Policy", r"Strict-Transport-Security"]),
    ("ssrf", "SSRF-001", "SSRF via User Input", "CWE-918", "HIGH",
     [r"requests\.get\(.*user", r"urllib\.request\.urlopen\(.*user"]),
    ("xxe", "XXE-001", "XXE Injection", "CWE-611", "HIGH",
     [r"lxml\.etree\.parse\(", r"xml\.etree\.ElementTree\.parse\("]),
    ("deserialization", "DESER-001", "Unsafe Pickle", "CWE-502", "CRITICAL",
     [r"pickle\.loads\(", r"yaml\.load\(", r"json\.loads\(.*user"]),
]
