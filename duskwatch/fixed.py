"""Word lists, limits, formats and patterns that define the results."""

# --- Source files ---------------------------------------------------------------
SOURCE_EXTENSIONS = ("js", "mjs", "cjs", "jsx", "ts", "mts", "cts", "tsx", "py", "go", "rb")
JS_EXTENSIONS = ("js", "mjs", "cjs", "jsx", "ts", "mts", "cts", "tsx")
DEPENDENCY_DIRS = (
    "node_modules", ".next", "dist", "build", "out", "coverage",
    ".venv", "venv", "env", "site-packages", "__pycache__",
    "vendor", "target", ".git",
)
IGNORE_FILE = ".duskignore"
DEFAULT_IGNORE_GLOBS = (
    "**/*.md", "**/*.mdx", "**/*.txt", "**/deprecations.json",
    f"**/{IGNORE_FILE}", "**/dusk.config.*",
)
TEST_DIRS = ("tests", "test", "__tests__", "spec")
TEST_BASENAME = r"^conftest\.py$|^test_.*\.py$|_test\.py$|\.(test|spec)\.(c|m)?[jt]sx?$"
SUPPRESS_TOKEN = "dusk-ignore"

# --- Limits ---------------------------------------------------------------------
CITED_CHARS = 120  # of a matched text, in the printed report only
REPORT_EVIDENCE_LINES = 12
DEFAULT_WITHIN_DAYS = 30
SNAPSHOT_TTL_SECONDS = 24 * 60 * 60

# --- Registry -------------------------------------------------------------------
SEVERITIES = ("high", "medium", "low")
MATCH_MODES = ("pattern", "sdk", "version")
STATUSES = ("deprecated", "scheduled", "retired")
CONFIDENCES = ("confirmed", "reported", "inferred")
EXTENSION_TOKEN = r"^(\*|[a-z0-9]+)$"
FAR_FUTURE = "9999-12-31"

# --- Manifests ------------------------------------------------------------------
PACKAGE_JSON = "package.json"
REQUIREMENTS = "requirements.txt"
GO_MOD = "go.mod"
PACKAGE_JSON_FIELDS = (
    "dependencies", "devDependencies", "peerDependencies", "optionalDependencies",
)
MANIFEST_ECOSYSTEMS = {
    PACKAGE_JSON: ("js", "ts", "jsx", "tsx", "mjs", "cjs"),
    REQUIREMENTS: ("py",),
    GO_MOD: ("go",),
}
REQUIREMENT_LINE = (
    r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*"
    r"((?:==|===|>=|<=|~=|!=|<|>)\s*[^\s;#]+)?"
)
VERSION_NUMBER = r"(\d+(?:\.\d+)*)"
VERSION_RANGE = r"^\s*(<=|>=|<|>|={1,3})?\s*v?(\d+(?:\.\d+)*)\s*\z"

# --- CI coverage ----------------------------------------------------------------
WORKFLOW_DIR = ".github/workflows"
STANDARD_WORKFLOW = f"{WORKFLOW_DIR}/duskwatch.yml"
WORKFLOW_MARKER = "duskwatch"

# --- Text -----------------------------------------------------------------------
# White space as JavaScript's \s sees it, for use inside a character class.
JS_SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# JavaScript's \b and \B: only ASCII letters, digits and the underscore are word characters.
JS_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
JS_NOT_BOUNDARY = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
# Noncharacters, reserved for use inside a process: they fence matches in a text.
OPEN_MARK, CLOSE_MARK = "\ufdd0", "\ufdd1"
