"""Fixed values of the weak-hash rule set."""

# Fixed values: (language, pattern, function name, algorithm), in rule order.
WEAK_HASH_RULES = [
    ("java", r"""MessageDigest\.getInstance\s*\(\s*["\']MD5["\']\s*\)""", 'MessageDigest.getInstance("MD5")', "MD5"),
    ("java", r"""MessageDigest\.getInstance\s*\(\s*["\']SHA-1["\']\s*\)""", 'MessageDigest.getInstance("SHA-1")', "SHA-1"),
    ("java", r"""MessageDigest\.getInstance\s*\(\s*["\']SHA1["\']\s*\)""", 'MessageDigest.getInstance("SHA1")', "SHA-1"),
    ("java", r"""MessageDigest\.getInstance\s*\(\s*["\']MD5["\']\s*,""", 'MessageDigest.getInstance("MD5", provider)', "MD5"),
    ("java", r"""MessageDigest\.getInstance\s*\(\s*["\']SHA-1["\']\s*,""", 'MessageDigest.getInstance("SHA-1", provider)', "SHA-1"),
    ("java", r"""MessageDigest\.getInstance\s*\(\s*["\']SHA1["\']\s*,""", 'MessageDigest.getInstance("SHA1", provider)', "SHA-1"),
    ("java", r"DigestUtils\.md5\s*\(", "DigestUtils.md5()", "MD5"),
    ("java", r"DigestUtils\.md5Hex\s*\(", "DigestUtils.md5Hex()", "MD5"),
    ("java", r"DigestUtils\.sha1\s*\(", "DigestUtils.sha1()", "SHA-1"),
    ("java", r"DigestUtils\.sha1Hex\s*\(", "DigestUtils.sha1Hex()", "SHA-1"),
    ("java", r"DigestUtils\.getSha1Digest\s*\(", "DigestUtils.getSha1Digest()", "SHA-1"),
    ("java", r"DigestUtils\.getMd5Digest\s*\(", "DigestUtils.getMd5Digest()", "MD5"),
    ("java", r"Hashing\.md5\s*\(\s*\)", "Hashing.md5()", "MD5"),
    ("java", r"Hashing\.sha1\s*\(\s*\)", "Hashing.sha1()", "SHA-1"),
    ("java", r"new\s+Md5PasswordEncoder\s*\(", "Md5PasswordEncoder", "MD5"),
    ("java", r"new\s+ShaPasswordEncoder\s*\(", "ShaPasswordEncoder", "SHA-1"),
    ("java", r"""Mac\.getInstance\s*\(\s*["\']HmacMD5["\']\s*\)""", 'Mac.getInstance("HmacMD5")', "MD5"),
    ("java", r"""Mac\.getInstance\s*\(\s*["\']HmacSHA1["\']\s*\)""", 'Mac.getInstance("HmacSHA1")', "SHA-1"),
    ("java", r"""Mac\.getInstance\s*\(\s*["\']HMAC-SHA-1["\']\s*\)""", 'Mac.getInstance("HMAC-SHA-1")', "SHA-1"),
    ("java", r"""Mac\.getInstance\s*\(\s*["\']HMAC-MD5["\']\s*\)""", 'Mac.getInstance("HMAC-MD5")', "MD5"),
    ("java", r"""Mac\.getInstance\s*\(\s*["\']HmacMD5["\']\s*,""", 'Mac.getInstance("HmacMD5", provider)', "MD5"),
    ("java", r"""Mac\.getInstance\s*\(\s*["\']HmacSHA1["\']\s*,""", 'Mac.getInstance("HmacSHA1", provider)', "SHA-1"),
    ("java", r"""\.getProperty\s*\(\s*["\'].*[Hh]ash.*["\']\s*,\s*["\'][^"\']*(?:MD5|SHA-?1)[^"\']*["\']\s*\)""", 'getProperty("hashAlg", "MD5/SHA1")', "MD5"),
    ("java", r"""\.getProperty\s*\(\s*["\'].*[Aa]lg.*["\']\s*,\s*["\'][^"\']*(?:MD5|SHA-?1)[^"\']*["\']\s*\)""", 'getProperty("algorithm", "MD5/SHA1")', "MD5"),
    ("python", r"hashlib\.md5\s*\(", "hashlib.md5()", "MD5"),
    ("python", r"hashlib\.sha1\s*\(", "hashlib.sha1()", "SHA-1"),
    ("python", r"""hashlib\.new\s*\(\s*["\']md5["\']\s*\)""", 'hashlib.new("md5")', "MD5"),
    ("python", r"""hashlib\.new\s*\(\s*["\']sha1["\']\s*\)""", 'hashlib.new("sha1")', "SHA-1"),
    ("python", r"hashes\.MD5\s*\(\s*\)", "hashes.MD5()", "MD5"),
    ("python", r"hashes\.SHA1\s*\(\s*\)", "hashes.SHA1()", "SHA-1"),
    ("python", r"make_password.*md5", "make_password with MD5", "MD5"),
    ("javascript", r"""crypto\.createHash\s*\(\s*["\']md5["\']\s*\)""", 'crypto.createHash("md5")', "MD5"),
    ("javascript", r"""crypto\.createHash\s*\(\s*["\']sha1["\']\s*\)""", 'crypto.createHash("sha1")', "SHA-1"),
    ("javascript", r"CryptoJS\.MD5\s*\(", "CryptoJS.MD5()", "MD5"),
    ("javascript", r"CryptoJS\.SHA1\s*\(", "CryptoJS.SHA1()", "SHA-1"),
    ("javascript", r"md5\s*\(", "md5()", "MD5"),
    ("go", r"md5\.New\s*\(\s*\)", "md5.New()", "MD5"),
    ("go", r"md5\.Sum\s*\(", "md5.Sum()", "MD5"),
    ("go", r"sha1\.New\s*\(\s*\)", "sha1.New()", "SHA-1"),
    ("go", r"sha1\.Sum\s*\(", "sha1.Sum()", "SHA-1"),
    ("php", r"md5\s*\(", "md5()", "MD5"),
    ("php", r"sha1\s*\(", "sha1()", "SHA-1"),
    ("php", r"""hash\s*\(\s*["\']md5["\']\s*,""", 'hash("md5", ...)', "MD5"),
    ("php", r"""hash\s*\(\s*["\']sha1["\']\s*,""", 'hash("sha1", ...)', "SHA-1"),
    ("ruby", r"Digest::MD5", "Digest::MD5", "MD5"),
    ("ruby", r"Digest::SHA1", "Digest::SHA1", "SHA-1"),
    ("ruby", r"""OpenSSL::Digest\.new\s*\(\s*["\']MD5["\']\s*\)""", 'OpenSSL::Digest.new("MD5")', "MD5"),
    ("ruby", r"""OpenSSL::Digest\.new\s*\(\s*["\']SHA1["\']\s*\)""", 'OpenSSL::Digest.new("SHA1")', "SHA-1"),
    ("csharp", r"MD5\.Create\s*\(\s*\)", "MD5.Create()", "MD5"),
    ("csharp", r"SHA1\.Create\s*\(\s*\)", "SHA1.Create()", "SHA-1"),
    ("csharp", r"new\s+MD5CryptoServiceProvider\s*\(", "MD5CryptoServiceProvider", "MD5"),
    ("csharp", r"new\s+SHA1CryptoServiceProvider\s*\(", "SHA1CryptoServiceProvider", "SHA-1"),
    ("csharp", r"""HashAlgorithm\.Create\s*\(\s*["\']MD5["\']\s*\)""", 'HashAlgorithm.Create("MD5")', "MD5"),
]

# Rules applied to every file whatever its language.
CONFIG_RULES = [
    ("*", r"""HASH_ALGORITHM\s*[:=]\s*["\']MD5["\']""", 'HASH_ALGORITHM = "MD5"', "MD5"),
    ("*", r"""HASH_ALGORITHM\s*[:=]\s*["\']SHA-?1["\']""", 'HASH_ALGORITHM = "SHA1"', "SHA-1"),
    ("*", r"""algorithm\s*[:=]\s*["\']md5["\']""", 'algorithm = "md5"', "MD5"),
    ("*", r"""algorithm\s*[:=]\s*["\']sha1["\']""", 'algorithm = "sha1"', "SHA-1"),
    ("*", r"hash\.algorithm\s*=\s*MD5", "hash.algorithm=MD5", "MD5"),
    ("*", r"hash\.algorithm\s*=\s*SHA-?1", "hash.algorithm=SHA1", "SHA-1"),
]

# Words around a hit that make it a security use.
SECURITY_CONTEXT = [
    r"password", r"passwd", r"pwd", r"credential", r"secret", r"auth", r"login", r"user.*pass",
    r"token", r"session", r"jwt", r"cookie", r"api.?key",
    r"hmac", r"signature", r"sign", r"verify", r"mac",
    r"encrypt", r"decrypt", r"cipher", r"key.?derivation", r"kdf", r"pbkdf", r"salt",
]

# The kind of security use, first match wins.
SECURITY_USAGES = [
    ("password_hashing", r"password|passwd|pwd|credential"),
    ("token_generation", r"token|session|jwt|cookie"),
    ("hmac", r"hmac|signature|sign|mac"),
    ("key_derivation", r"encrypt|key|kdf|pbkdf"),
]

# Words around a hit that make it harmless.
NON_SECURITY_CONTEXT = [
    r"checksum", r"etag", r"cache.?key", r"dedup", r"fingerprint", r"content.?hash", r"file.?hash",
    r"#\s*(?:legacy|deprecated|todo|fixme)", r"//\s*(?:legacy|deprecated|todo|fixme)",
]

# Severity by usage inside a security context; any other usage is MEDIUM.
USAGE_SEVERITY = {
    "password_hashing": "CRITICAL",
    "token_generation": "HIGH",
    "hmac": "HIGH",
    "key_derivation": "CRITICAL",
    "security_general": "HIGH",
}
