"""Fixed values of the model request and response tables."""

# Model by task; any other task uses DEFAULT_MODEL.
TASK_MODELS = [
    ("sast", "claude-3.7-sonnet"), ("semantic_analysis", "claude-3.7-sonnet"), ("pattern_matching", "gpt4o"),
    ("validation", "gpt4o-mini"), ("poc_generation", "claude-3.7-sonnet"), ("simple_scan", "gpt4o-mini"),
    ("business_logic", "claude-3.7-sonnet"), ("architecture", "claude-3.7-sonnet"),
]
DEFAULT_MODEL = "claude"

# Model alias -> model id.
MODEL_IDS = [
    ("claude", "anthropic/claude-3.7-sonnet"), ("claude-3.7-sonnet", "anthropic/claude-3.7-sonnet"),
    ("claude-3.5-sonnet", "anthropic/claude-3.5-sonnet"), ("claude-3-sonnet", "anthropic/claude-3-sonnet-20240229"),
    ("claude-opus-4.5", "anthropic/claude-opus-4.5"), ("claude-sonnet-4.5", "anthropic/claude-sonnet-4.5"),
    ("claude-opus-4", "anthropic/claude-opus-4"), ("claude-sonnet-4", "anthropic/claude-sonnet-4"),
    ("gpt-5.6-sol", "openai/gpt-5.6-sol"), ("gpt4", "openai/gpt-4-turbo"), ("gpt4o", "openai/gpt-4o"),
    ("gpt4o-mini", "openai/gpt-4o-mini"), ("llama", "meta-llama/llama-3.1-70b-instruct"),
    ("llama-large", "meta-llama/llama-3.1-405b-instruct"),
]

# Model id, USD per million input tokens, per million output tokens.
PRICES = [
    ("anthropic/claude-3.7-sonnet", 3.00, 15.00), ("anthropic/claude-3.5-sonnet", 3.00, 15.00),
    ("anthropic/claude-3-sonnet-20240229", 3.00, 15.00), ("anthropic/claude-opus-4.5", 15.00, 75.00),
    ("anthropic/claude-sonnet-4.5", 3.00, 15.00), ("anthropic/claude-opus-4", 15.00, 75.00),
    ("anthropic/claude-sonnet-4", 3.00, 15.00), ("openai/gpt-5.6-sol", 5.00, 30.00), ("openai/gpt-4-turbo", 10.00, 30.00),
    ("openai/gpt-4o", 2.50, 10.00), ("openai/gpt-4o-mini", 0.15, 0.60), ("meta-llama/llama-3.1-70b-instruct", 0.88, 0.88),
    ("meta-llama/llama-3.1-405b-instruct", 2.70, 2.70),
]

# Rough cost estimate of a scan.
TOKENS_PER_FILE = 1000
USD_PER_MILLION = 0.15

# Category -> CWE of the labelled Java corpus, and where its sources lie.
CATEGORY_CWE = [
    ("pathtraver", 22), ("hash", 328), ("crypto", 327), ("sqli", 89), ("weakrand", 330), ("xss", 79), ("cmdi", 78),
    ("trustbound", 501), ("securecookie", 614), ("ldapi", 90), ("xpathi", 643),
]
JAVA_CASE_DIR = "src/main/java/org/owasp/benchmark/testcode"
# Id format of the labelled Python corpus, and where its sources lie.
PYTHON_CASE_ID = r"^(CWE-(\d+))_(.+\.py)$"
PYTHON_CASE_DIR = "Testcases_Insecure_Code"
