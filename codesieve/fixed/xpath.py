"""Fixed values of the XPath-injection rule set."""

# Fixed values: (language, pattern, function name, library), in rule order.
XPATH_RULES = [
    ("java", r"xpath\.evaluate\s*\(", "xpath.evaluate", "xpath"),
    ("java", r"xpath\.compile\s*\(", "xpath.compile", "xpath"),
    ("java", r"XPathFactory\..*\.evaluate\s*\(", "XPathFactory.evaluate", "xpath"),
    ("java", r"XPathExpression\.evaluate\s*\(", "XPathExpression.evaluate", "xpath"),
    ("java", r"\.selectNodes\s*\(", "selectNodes", "jdom"),
    ("java", r"\.selectSingleNode\s*\(", "selectSingleNode", "jdom"),
    ("java", r"document\.selectNodes\s*\(", "document.selectNodes", "dom4j"),
    ("java", r"document\.selectSingleNode\s*\(", "document.selectSingleNode", "dom4j"),
    ("python", r"\.xpath\s*\(", ".xpath", "lxml"),
    ("python", r"tree\.xpath\s*\(", "tree.xpath", "lxml"),
    ("python", r"etree\.XPath\s*\(", "etree.XPath", "lxml"),
    ("python", r"\.find\s*\(", ".find", "xml.etree"),
    ("python", r"\.findall\s*\(", ".findall", "xml.etree"),
    ("python", r"\.iterfind\s*\(", ".iterfind", "xml.etree"),
    ("python", r"defusedxml.*\.xpath\s*\(", "defusedxml.xpath", "defusedxml"),
    ("javascript", r"document\.evaluate\s*\(", "document.evaluate", "dom"),
    ("javascript", r"\.evaluate\s*\(.*XPathResult", "evaluate with XPathResult", "dom"),
    ("javascript", r"xpath\.select\s*\(", "xpath.select", "xmldom"),
    ("javascript", r"xpath\.select1\s*\(", "xpath.select1", "xmldom"),
    ("javascript", r"\.find\s*\(", ".find", "libxmljs"),
    ("php", r"->xpath\s*\(", "->xpath", "simplexml"),
    ("php", r"simplexml_load.*->xpath\s*\(", "simplexml->xpath", "simplexml"),
    ("php", r"DOMXPath.*->query\s*\(", "DOMXPath->query", "domxpath"),
    ("php", r"DOMXPath.*->evaluate\s*\(", "DOMXPath->evaluate", "domxpath"),
    ("php", r"\$xpath->query\s*\(", "$xpath->query", "domxpath"),
    ("php", r"\$xpath->evaluate\s*\(", "$xpath->evaluate", "domxpath"),
    ("csharp", r"\.SelectNodes\s*\(", ".SelectNodes", "xpath"),
    ("csharp", r"\.SelectSingleNode\s*\(", ".SelectSingleNode", "xpath"),
    ("csharp", r"\.Evaluate\s*\(", ".Evaluate", "xpath"),
    ("csharp", r"XPathSelectElements\s*\(", "XPathSelectElements", "linq"),
    ("csharp", r"XPathSelectElement\s*\(", "XPathSelectElement", "linq"),
    ("csharp", r"XPathEvaluate\s*\(", "XPathEvaluate", "linq"),
    ("ruby", r"\.xpath\s*\(", ".xpath", "nokogiri"),
    ("ruby", r"\.at_xpath\s*\(", ".at_xpath", "nokogiri"),
    ("ruby", r"Nokogiri.*\.xpath\s*\(", "Nokogiri.xpath", "nokogiri"),
    ("ruby", r"XPath\.first\s*\(", "XPath.first", "rexml"),
    ("ruby", r"XPath\.each\s*\(", "XPath.each", "rexml"),
    ("ruby", r"XPath\.match\s*\(", "XPath.match", "rexml"),
    ("go", r"xmlquery\.Find\s*\(", "xmlquery.Find", "xmlquery"),
    ("go", r"xmlquery\.FindOne\s*\(", "xmlquery.FindOne", "xmlquery"),
    ("go", r"\.Find\s*\(", ".Find", "goquery"),
    ("go", r"xmlpath\.MustCompile\s*\(", "xmlpath.MustCompile", "etree"),
]

# Literals that look like an XPath query (case-sensitive).
QUERY_LITERALS = [r"""["\']//\w+""", r"""["\']\.//\w+""", r"""["\'].*\[@""", r"@\w+\s*="]

# Signs of user input, first match in this order is reported.
USER_INPUT = [
    r"request\.", r"req\.", r"params\[", r"query\[", r"body\[", r"form\[", r"input", r"user_?input",
    r"user_?data", r"param", r"\$_GET", r"\$_POST", r"\$_REQUEST", r"args\[", r"argv\[",
    r"getParameter", r"getAttribute", r"getHeader", r"session\.", r"cookie",
]

# Signs that a string is being built.
CONCATENATION = [
    r"\+\s*[a-zA-Z_]", r"[a-zA-Z_]\s*\+", r"\"\s*\+", r"\'\s*\+", r"\+\s*\"", r"\+\s*\'",
    r"%\s*[a-zA-Z_]", r"%s", r"\$\{", r"""f["\'].*\{""", r"\.format\s*\(", r"sprintf",
    r"String\.format", r"String\.Format", r"concat\s*\(", r"<<", r"\+\s*\w+\s*\+",
]

# Signs of sanitising.
SANITISERS = [
    r"escape", r"sanitize", r"encode", r"validate", r"whitelist", r"allowlist", r"parameterize",
    r"bind", r"prepared", r"quote", r"XPathVariable", r"add_namespace",
]

# Assignments of a constant (case-sensitive).
SAFE_ASSIGNMENTS = [
    r"""=\s*"[^"]*"[;,\)]""", r"""=\s*'[^']*'[;,\)]""", r"""\.get\s*\(\s*"[^"]*"\s*\)""",
    r"""=\s*"safe""", r"""=\s*"fixed""", r"""=\s*"default""", r"=\s*[A-Z_]+[;,\)]",
]

# Assignments that only initialise a variable (case-sensitive).
INITIALISERS = [r"""=\s*""[;,\)]""", r"""=\s*''[;,\)]""", r"=\s*null[;,\)]", r"=\s*0[;,\)]"]

# Calls that usually wrap user input.
INDIRECT_INPUT = [r"new\s+String\s*\(", r"\.getBytes\s*\(", r"decode\s*\(", r"Base64", r"\.toString\s*\("]

# Obvious dynamic query building.
DYNAMIC_QUERY = [
    r'"//\s*\+', r'"/[\w]+\[', r"'//\s*\+", r"'/[\w]+\[", r"xpath\s*=.*\+", r"query\s*=.*\+",
]

# How the concatenated variable is read off a line (case-sensitive).
VARIABLE_BETWEEN = r"\+\s*(\w+)\s*[\+\)]"
VARIABLE_BEFORE = r"""["\'\s](\w+)\s*\+"""

# Variable names too generic to follow.
GENERIC_NAMES = ["expression", "query", "xpath", "result", "i", "j"]
