"""Results depend on each of these, so they are stated in one place."""

# --- Lexical scoring -------------------------------------------------------
TOKEN_PATTERN = "[a-z0-9]+"
BM25_K1 = 1.5
BM25_B = 0.75
LIBRARY_IDF_FLOOR = 0.25

# --- Retrieval -------------------------------------------------------------
CANDIDATES = 50
TOP_K = 5
RRF_K = 60
RERANK_DEPTH = 25
RERANK_MAX_LENGTH = 512
RERANK_BY_DEFAULT = True
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
ENCODER_BATCH = 2
ENCODER_THREADS = 1
EMBEDDING_MAX_LENGTH = 512
EMBEDDING_DIMENSIONS = 384

# --- Text preparation ------------------------------------------------------
MAX_CHARS = 1200
OVERLAP_SENTENCES = 1
MIN_PARAGRAPH_CHARS = 200
DEFAULT_SECTION = "Abstract"
STOP_TITLE_PREFIXES = ("references", "bibliography", "acknowledg")

# --- Ingestion -------------------------------------------------------------
FEED_PAGE_SIZE = 100
FEED_LIMIT = 300
REQUEST_DELAY_SECONDS = 3.0
DOWNLOAD_ATTEMPTS = 3

# --- Answering -------------------------------------------------------------
CONTEXT_PASSAGES = 6
COMPARISON_PATTERN = (
    r"\b(compare|comparison|versus|vs\.?|difference between|differ from|"
    r"better than|trade-?offs? between)\b"
)
SIDE_PATTERN = r"\b(?:versus|vs\.?|and|between)\b"
MIN_SIDE_WORDS = 3
MARKER_PATTERN = r"\[(\d+)\]"
REFUSAL = "The passages do not answer this question"
CACHE_SIMILARITY = 0.90
CACHE_CAPACITY = 256
MODEL_ATTEMPTS = 3
QUESTION_MIN_CHARS = 3
TOP_K_MAX = 20

# --- Evaluation ------------------------------------------------------------
METRIC_CUTOFF = 10

# Characters a Unicode-aware `\s` accepts. Java's default `\s` and RE2's are
# ASCII only, so both engines are given the class spelled out.
WHITESPACE = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
