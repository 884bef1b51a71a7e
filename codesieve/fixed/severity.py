"""Fixed values of severities, scores, efforts and report phases."""

# Severities, most severe first; the rank is the position.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
UNKNOWN_RANK = 5

# Finding categories.
CATEGORIES = [
    "injection_attacks", "authentication_authorization", "data_exposure", "xml_external_entities", "broken_access_control",
    "security_misconfiguration", "cross_site_scripting", "insecure_deserialization", "vulnerable_components",
    "insufficient_logging", "cryptographic_issues", "business_logic_flaws", "api_security", "code_execution",
]

# Score given to a finding that has none.
DEFAULT_CVSS = {"CRITICAL": 9.5, "HIGH": 7.5, "MEDIUM": 5.0, "LOW": 3.0, "INFO": 0.0}
OTHER_CVSS = 5.0

# Base priority, lower comes first, and its reductions.
PRIORITY_BASE = {"CRITICAL": 0, "HIGH": 100, "MEDIUM": 200, "LOW": 300, "INFO": 400}
OTHER_PRIORITY = 500
PRIORITY_CATEGORIES = ["injection", "authentication", "code_execution", "data_exposure", "access_control"]
PRIORITY_CUTS = {"category": 50, "confidence": 25, "production": 100, "pii": 75}

# Repair hours per finding in the summary.
EFFORT_HOURS = {"CRITICAL": 8.0, "HIGH": 4.0, "MEDIUM": 2.0, "LOW": 1.0, "INFO": 0.5}
OTHER_EFFORT = 2.0
HOURS_PER_WEEK = 40
SUMMARY_PHASES = 4

# Fixed values: (phase, timeframe, severities, effort text, hours per finding) of the roadmap.
ROADMAP = [
    ("phase_1_immediate", "0-1 week", ["CRITICAL"], "4-8 hours", 6.0),
    ("phase_2_short_term", "1-3 weeks", ["HIGH"], "2-4 hours", 3.0),
    ("phase_3_medium_term", "1-2 months", ["MEDIUM"], "1-2 hours", 1.5),
    ("phase_4_long_term", "2-6 months", ["LOW", "INFO"], "1 hour", 1.0),
]

# Bar of the risk matrix.
BAR_CHAR = "█"
BAR_LENGTH = 50

# Score vector printed in the appendix.
CVSS_VECTOR = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
