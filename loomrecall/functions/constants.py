"""Word lists, lookup tables, weights and patterns that results must agree on. They are data, not logic."""

# Ranking weights.
BM25_K1 = 1.2
BM25_B = 0.75
RRF_K = 60
SATURATION_DECAY = 0.5
COHERENCE_BOOST = 0.2
DEFINITION_BOOST = 3.0
EMBEDDED_BOOST_SCALE = 0.5
STEM_BOOST = 1.0
STEM_MIN_RATIO = 0.10
SYMBOL_ALPHA = 0.3
DEFAULT_ALPHA = 0.5
MEMORY_MIN_COSINE = 0.35

# Chunk windows.
CHUNK_LINES = 50
CHUNK_OVERLAP = 5
BOUNDARY_LOOKBACK = 12

# Text limits.
EMBEDDING_MAX_CHARS = 4000
EMBEDDING_MARKER = " …[truncated for embedding]… "
ROLLUP_MAX_CHARS = 1600
FLUSH_TURNS = 3
LARGE_TURN_CHARS = 4096

# Scan limits.
MAX_FILE_BYTES = 16 * 1024 * 1024
BINARY_SAMPLE = 4096
BINARY_RATIO = 0.3
EXCLUDED_EXTENSIONS = (".db", ".sqlite", ".sqlite3")
IGNORED_DIRS = (
    ".cache", ".git", ".hg", ".mypy_cache", ".next", ".nuxt", ".pytest_cache", ".ruff_cache", ".svn", ".turbo",
    ".venv", "__pycache__", "build", "coverage", "dist", "node_modules", "third_party", "vendor", "venv",
)
SENSITIVE_FIELDS = ("thinkingSignature", "textSignature", "encrypted_content", "encryptedContent")

# Words without weight in a question.
STOPWORDS = tuple("a an and are as at be by do does for from has have how if in is it not of on or the to was what when where which who why with".split())

# Words that introduce a definition.
DEFINITION_KEYWORDS = (
    "class", "module", "defmodule", "def", "interface", "struct", "enum", "trait", "type", "func", "function", "object",
    "abstract class", "data class", "fn", "fun", "package", "namespace", "protocol", "record", "typedef",
)
SQL_DEFINITION_KEYWORDS = ("CREATE TABLE", "CREATE VIEW", "CREATE PROCEDURE", "CREATE FUNCTION")

# Language by extension.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift",
    ".rb": "ruby", ".php": "php", ".cs": "csharp", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp",
    ".h": "c", ".c": "c", ".scala": "scala", ".sql": "sql", ".sh": "bash", ".bash": "bash", ".ps1": "powershell", ".lua": "lua",
}
PLAIN_EXTENSIONS = (".txt", ".md", ".markdown", ".json", ".yaml", ".yml", ".toml", ".csv", ".tsv", ".log", ".ini")

# Path patterns of the search penalties.
TEST_FILE = r"(?:^|/)(?:test_[^/]*\.py|[^/]*_test\.py|[^/]*_test\.go|[^/]*Tests?\.java|[^/]*Test\.php|[^/]*_spec\.rb|[^/]*_test\.rb|[^/]*\.test\.[jt]sx?|[^/]*\.spec\.[jt]sx?|[^/]*Tests?\.kt|[^/]*Spec\.kt|[^/]*Tests?\.swift|[^/]*Spec\.swift|[^/]*Tests?\.cs|test_[^/]*\.cpp|[^/]*_test\.cpp|test_[^/]*\.c|[^/]*_test\.c|[^/]*Spec\.scala|[^/]*Suite\.scala|[^/]*Test\.scala|[^/]*_test\.dart|test_[^/]*\.dart|[^/]*_spec\.lua|[^/]*_test\.lua|test_[^/]*\.lua|test_helpers?[^/]*\.\w+)$"
TEST_DIR = r"(?:^|/)(?:tests?|__tests__|spec|testing)(?:/|$)"
COMPAT_DIR = r"(?:^|/)(?:compat|_compat|legacy)(?:/|$)"
EXAMPLES_DIR = r"(?:^|/)(?:_?examples?|docs?_src)(?:/|$)"
TYPE_DEFS = r"\.d\.ts$"
REEXPORT_FILE = r"(?:^|/)(?:__init__\.py|package-info\.java)$"

# What a symbol query looks like, and a symbol inside a sentence.
SYMBOL_QUERY = r"^(?:[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\\|->|\.)[A-Za-z_][A-Za-z0-9_]*)+|_[A-Za-z0-9_]*|[A-Za-z][A-Za-z0-9]*[A-Z_][A-Za-z0-9_]*|[A-Z][A-Za-z0-9]*)$"
EMBEDDED_SYMBOL = r"\b(?:[A-Z][a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]+)\b"

# Tokens.
WORD = r"[A-Za-z_][A-Za-z0-9_]*"
WIDE_WORD = r"[\p{L}\p{N}_-]+"
HUMP = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
