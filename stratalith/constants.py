"""Weights, limits, lists and formats that results depend on."""

from __future__ import annotations

#: Weights of the indexed columns in BM25, and its two parameters.
COLUMN_WEIGHTS = {"path": 4.0, "title": 6.0, "heading": 3.0, "body": 1.0}
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6

#: Score of a hit.
SATURATION = 6.0
BOOST_PATH, BOOST_TITLE, BOOST_HEADING, BOOST_ALL_TERMS = 0.25, 0.35, 0.15, 0.08
STATUS_FACTORS = {"active": 1.0, "draft": 0.6, "archived": 0.4}
AUTHORITY_MINIMUM, AUTHORITY_MAXIMUM, AUTHORITY_NEUTRAL = 0.75, 1.25, 50
SUPERSEDED_FACTOR = 0.5
MAX_CHUNKS_PER_ARTIFACT = 3
NEAR_DUPLICATE_OVERLAP = 0.85
SHINGLE_WORDS = 4
CANDIDATE_MULTIPLIER, CANDIDATE_MINIMUM, CANDIDATE_MAXIMUM = 8, 60, 500

#: Context bundles.
PROFILE_BUDGETS = {"agent": 12_000, "coding": 16_000, "chat": 24_000, "deep": 40_000}
DEFAULT_PROFILE = "agent"
BUDGET_RANGE = (4_000, 40_000)
ORIENTATION_SHARE = 0.1
MAX_ITEMS_PER_ARTIFACT = 4
MAX_ALTERNATIVES = 5

#: Text sizes and chunks.
UNITS_PER_TOKEN = 3.6
TARGET_TOKENS, MAXIMUM_TOKENS, OVERLAP_TOKENS = 700, 1200, 100

#: Limits.
MAX_SOURCE_FILES, MAX_TOTAL_BYTES, MAX_ARTIFACT_BYTES = 2_500, 1024**3, 64 * 1024**2
MAX_TABLE_ROWS, MAX_TABLE_COLUMNS = 500_000, 100
READ_CHARACTERS = 200_000
SQL_DEFAULT_ROWS, SQL_MAX_ROWS, SQL_MAX_BYTES, SQL_MAX_CHARACTERS, SQL_DEADLINE_S = 100, 10_000, 1_000_000, 100_000, 5.0
DISTINCT_LIMIT = 10_000
SAFE_INTEGER = 2**53 - 1
INFERENCE_SAMPLE = 1_000
KEEP_BUILDS = 5
PROJECTION_WARN_BYTES, PROJECTION_MAX_BYTES = 400 * 1024**2, 500 * 1024**2
REVALIDATE_S = 30.0
EXCLUSION_SAMPLE = 5

NULL_TOKENS = ("", "null", "n/a", "na")
DEFAULT_STATUS, DEFAULT_AUTHORITY = "active", 50

#: File formats: parser id, media type, extensions, whole file names.
FORMATS = (
    ("markdown", "text/markdown", (".md", ".markdown", ".mdx"), ()),
    ("text", "text/plain", (".txt", ".text", ".rst", ".adoc"), ("readme", "license")),
    (
        "code",
        "text/plain",
        (
            ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".java", ".kt", ".rb",
            ".php", ".cs", ".swift", ".c", ".h", ".cc", ".cpp", ".hpp", ".sh", ".bash", ".zsh", ".sql", ".json", ".jsonc",
            ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".gradle", ".tf", ".dockerfile", ".graphql", ".proto",
        ),
        ("dockerfile", "makefile"),
    ),
    ("html", "text/html", (".html", ".htm"), ()),
    ("pdf-text", "application/pdf", (".pdf",), ()),
    ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", (".docx",), ()),
    ("csv", "text/csv", (".csv", ".tsv"), ()),
    ("xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", (".xlsx",), ()),
)
BYTE_PARSERS = ("pdf-text", "docx", "xlsx")

#: Paths that are never indexed, and those that look like credentials.
ALWAYS_EXCLUDE = (
    ".gitignore", ".gitattributes", ".git/", "node_modules/", "dist/", "build/", "coverage/",
    ".env", ".env.*", "*.pem", "*.key", "id_rsa*", "id_ed25519*", "*.p12", "*.pfx", ".DS_Store", "Thumbs.db",
)
SECRET_SHAPED = (
    ".env", ".env.*", "*.pem", "*.key", "id_rsa*", "id_ed25519*", "*.p12", "*.pfx", "*.jks", "*credentials*.json",
)

#: HTML elements dropped with their content, page chrome, and regions in which chrome is content.
HTML_DROPPED = (
    "script", "style", "noscript", "template", "svg", "canvas", "iframe", "object", "embed", "audio", "video", "map",
    "form", "input", "select", "textarea", "button",
)
HTML_CHROME = ("nav", "header", "footer", "aside")
HTML_LANDMARKS = ("article", "main")
HTML_NOISE_SHARE = 0.5
