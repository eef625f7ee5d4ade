"""Fixed values of the audit: lists, limits, labels and report wording.

Every value here must stay as it is for results to agree with existing audit
reports.  All of them are defaults of function arguments, so a caller replaces a
list or a limit by passing another one.
"""

# --- fixed values: repository ingestion -------------------------------------
ALLOWED_EXTENSIONS = [
    ".py", ".pyx", ".pyi", ".txt", ".md", ".yml", ".yaml", ".json", ".toml", ".cfg", ".ini",
]
EXCLUDED_DIRS = [".git", "__pycache__", ".pytest_cache", "node_modules", ".venv", "venv", "env"]
REQUIREMENTS_FILES = ["requirements.txt", "requirements-dev.txt", "requirements-test.txt"]
DEPENDENCY_FILES = REQUIREMENTS_FILES + ["pyproject.toml", "setup.py", "Pipfile"]
README_FILES = ["README.md", "README.txt", "README.rst", "README"]
LICENSE_FILES = ["LICENSE", "LICENSE.txt", "LICENSE.md", "COPYING"]
MAX_REPO_SIZE_MB = 500
PIPELINE_TIMEOUT_SECONDS = 1800
MAX_FILE_SIZE_KB = 100
README_CHARS = 5000
LICENSE_CHARS = 1000
UNKNOWN_REPO_NAME = "unknown_repo"

# --- fixed values: static analysis ------------------------------------------
DANGEROUS_FUNCTIONS = [
    "eval", "exec", "compile", "open", "input", "raw_input",
    "subprocess.call", "subprocess.run", "subprocess.Popen",
    "os.system", "os.popen", "os.execv", "os.execve",
    "pickle.loads", "pickle.load", "yaml.load", "yaml.unsafe_load",
]
SUSPICIOUS_PATTERNS = [
    r"password\s*=\s*['\"][^'\"]+['\"]",
    r"api_key\s*=\s*['\"][^'\"]+['\"]",
    r"secret\s*=\s*['\"][^'\"]+['\"]",
    r"SELECT\s+.*\s+FROM\s+.*\s*\+",
    r"\.format\s*\([^)]*\)",
    r"f['\"].*\{.*\}.*['\"]",
]
RISKY_IMPORT_PARTS = ["pickle", "subprocess", "os", "eval", "exec"]

# --- fixed values: model responses ------------------------------------------
CONTEXT_LENGTH = 32768
CHARS_PER_TOKEN = 3
PROMPT_DEPENDENCIES = 10
CONFIDENCE_THRESHOLD = 0.7
METHOD_FACTORS = {"llm_analysis": 0.8, "static_analysis": 0.9, "pattern_matching": 0.6}
SEVERITY_FACTORS = {"critical": 0.9, "high": 0.8, "medium": 0.7}
OTHER_SEVERITY_FACTOR = 0.5
FALLBACK_WORDS = ["vulnerability", "injection"]
FALLBACK_CHARS = 200
FALLBACK_PREFIX = "Potential vulnerability detected in text analysis: "

# --- fixed values: findings and risk ----------------------------------------
SEVERITIES = ["critical", "high", "medium", "low"]
SEVERITY_WEIGHTS = {"critical": 10, "high": 7, "medium": 4, "low": 1}
CALL_DESCRIPTION = "Potentially dangerous function call: "
PATTERN_DESCRIPTION = "Suspicious code pattern detected: "
PATTERN_CHARS = 100
SNIPPET_CHARS = 500
RISK_BANDS = [(70, "Critical"), (50, "High"), (30, "Medium")]
HIGH_CONFIDENCE = 0.8
LIKELIHOOD_INDICATOR = 0.5
URGENT_RECOMMENDATIONS = [
    "🚨 URGENT: Address critical and high-severity vulnerabilities immediately",
    "🔒 Implement additional security controls and monitoring",
    "🧪 Conduct thorough security testing before deployment",
]
TYPE_RECOMMENDATIONS = [
    ("sql_injection", "🛡️ Use parameterized queries and prepared statements to prevent SQL injection"),
    ("command_injection", "⚡ Validate and sanitize all user inputs before executing system commands"),
    ("hardcoded_credentials", "🔑 Remove hardcoded credentials and use secure credential management"),
    ("dangerous_function_call", "⚠️ Review and secure usage of potentially dangerous functions"),
]
LIKELIHOOD_RECOMMENDATION = "🔍 Investigate potential zero-day vulnerabilities with security experts"
GENERAL_RECOMMENDATIONS = [
    "📚 Conduct regular security code reviews",
    "🔄 Keep dependencies updated to latest secure versions",
    "🧪 Implement automated security testing in CI/CD pipeline",
    "📊 Monitor application for suspicious activities",
    "🎓 Provide security training for development team",
]

# --- fixed values: commit history and runs ----------------------------------
CONTRIBUTOR_COMMITS = 100
FILE_HISTORY_COMMITS = 10

# --- our own labels ----------------------------------------------------------
MODEL_SOURCE = "Model Analysis"
STATIC_SOURCE = "Static Analysis"
REPORT_FORMATS = ["json", "html", "txt"]

# Literals that every match of a default pattern must contain, folded to lower
# case.  Only lines holding all of them are given to the pattern itself.
SUSPICIOUS_PATTERN_LITERALS = [
    ["password", "="],
    ["api_key", "="],
    ["secret", "="],
    ["select", "from", "+"],
    [".format", "(", ")"],
    ["f", "{", "}"],
]
