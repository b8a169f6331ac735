"""Limits, word lists, patterns and texts that decide results.

Nothing here is tunable behaviour; changing a value changes identifiers,
routes, scores or answers.
"""

from __future__ import annotations

import datetime as dt

# --- identity ---------------------------------------------------------------
VERSION_NAMESPACE = "cd10c605-4ca0-41bc-8854-1db63c49cdef"
HASH_BYTES = 32
UUID_BYTES = 16

# --- chunker ----------------------------------------------------------------
CHUNKER_NAME = "paragraph-window"
CHUNKER_VERSION = "1.0.0"
CHUNKER_TOKENIZER = "unicode-codepoint"
CHUNKER_NORMALIZATION = "nfkc-whitespace-v1"
CHUNKER_SEPARATORS = ("\n\n", "\n", ". ", " ")
CHUNK_SIZE = 900
CHUNK_OVERLAP = 120
MIN_CHUNK_SIZE = 64

# --- request bounds ---------------------------------------------------------
MAX_TITLE = 255
MAX_URI = 2048
MAX_LABEL = 120
MAX_CONTENT = 2_000_000
MAX_CHUNK_SIZE = 8000
MAX_CHUNK_OVERLAP = 2000
MAX_ACTOR = 255
MAX_PRINCIPALS = 100
MIN_QUERY = 2
MAX_QUERY = 4000
DEFAULT_AUTHORITY = 0.85
DEFAULT_QUALITY = 0.9
PARSER_NAME = "plain-text"
PARSER_VERSION = "1.0.0"
TEXT_API_PARSER = "text-api-v1"

# --- embeddings -------------------------------------------------------------
EMBEDDING_DIMENSION = 1024
EMBEDDING_DECIMALS = 8

# --- retrieval --------------------------------------------------------------
CANDIDATE_LIMIT = 120
CANDIDATE_LIMIT_RANGE = (20, 500)
RERANK_TOP_K = 40
RERANK_TOP_K_RANGE = (30, 50)
RANK_CONSTANT = 60
CONFIDENCE_THRESHOLD = 0.58
FALLBACK_CLAIM_THRESHOLD = 0.7
CONFLICT_GAP = 0.08
MISSING_METADATA_QUALITY = 0.85
UNKNOWN_FRESHNESS = 0.5
EVIDENCE_CHUNKS = 4
NUMERIC_CHUNKS = 3
CITED_CHUNKS = 2

# --- patterns ---------------------------------------------------------------
TOKEN_PATTERN = "[a-z0-9]+"
# Words of lexical search keep accents and every script.
WORD_PATTERN = r"[\p{L}\p{N}]+"
NUMBER_PATTERN = r"-?\d+(?:\.\d+)?"
DAYS_BETWEEN_PATTERN = r"(?i)days between (\d{4}-\d{2}-\d{2}) and (\d{4}-\d{2}-\d{2})"
SUM_PATTERN = r"(?i)\b(sum|total)\b"
MEAN_PATTERN = r"(?i)\b(mean|average)\b"
COMPUTE_HINTS = ("worksheet", "spreadsheet", "table", "values")

# --- word lists -------------------------------------------------------------
NOISE_WORDS = ("a", "an", "are", "for", "how", "our", "rules", "the", "what")
SPELLING_LEXICON = (
    "retention",
    "authority",
    "freshness",
    "access",
    "authorized",
    "citation",
    "citations",
    "pipeline",
    "promotion",
    "compute",
    "sum",
    "average",
    "difference",
    "enterprise",
)
SPELLING_CUTOFF = 0.82
MIN_SPELLED_LENGTH = 5
MIN_FOCUS_LENGTH = 5
FOCUS_TERMS = 3
# The public English stop-word list used by common full-text configurations.
ENGLISH_STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he
    him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be
    been being have has had having do does did doing a an the and but if or
    because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under
    again further then once here there when where why how all any both each few
    more most other some such no nor not only own same so than too very s t can
    will just don should now
    """.split()
)

# --- English word forms -------------------------------------------------------
# The suffixes, regions and exceptions of the published Porter2
# algorithm. Rules: suffix, replacement, region it must lie in, letters before it.
STEM_VOWEL = "[aeiouy]"
STEM_PREFIX = "^(gener|commun|arsen)"
STEM_REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
STEM_SHORT = "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
STEM_DOUBLE = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
STEM_VERB = "^(.*?)(ingly|edly|ing|ed)$"
STEM_STEP_2 = (
    ("tional", "tion", 1, ""),
    ("enci", "ence", 1, ""),
    ("anci", "ance", 1, ""),
    ("abli", "able", 1, ""),
    ("entli", "ent", 1, ""),
    ("izer", "ize", 1, ""),
    ("ization", "ize", 1, ""),
    ("ational", "ate", 1, ""),
    ("ation", "ate", 1, ""),
    ("ator", "ate", 1, ""),
    ("alism", "al", 1, ""),
    ("aliti", "al", 1, ""),
    ("alli", "al", 1, ""),
    ("fulness", "ful", 1, ""),
    ("ousli", "ous", 1, ""),
    ("ousness", "ous", 1, ""),
    ("iveness", "ive", 1, ""),
    ("iviti", "ive", 1, ""),
    ("biliti", "ble", 1, ""),
    ("bli", "ble", 1, ""),
    ("ogi", "og", 1, "l"),
    ("fulli", "ful", 1, ""),
    ("lessli", "less", 1, ""),
    ("li", "", 1, "cdeghkmnrt"),
)
STEM_STEP_3 = (
    ("tional", "tion", 1, ""),
    ("ational", "ate", 1, ""),
    ("alize", "al", 1, ""),
    ("icate", "ic", 1, ""),
    ("iciti", "ic", 1, ""),
    ("ical", "ic", 1, ""),
    ("ful", "", 1, ""),
    ("ness", "", 1, ""),
    ("ative", "", 2, ""),
)
STEM_STEP_4 = tuple(
    (suffix, "", 2, "")
    for suffix in "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()
) + (("ion", "", 2, "st"),)
STEM_EXCEPTIONS = (
    ("skis", "ski"),
    ("skies", "sky"),
    ("dying", "die"),
    ("lying", "lie"),
    ("tying", "tie"),
    ("idly", "idl"),
    ("gently", "gentl"),
    ("ugly", "ugli"),
    ("early", "earli"),
    ("only", "onli"),
    ("singly", "singl"),
    ("sky", "sky"),
    ("news", "news"),
    ("howe", "howe"),
    ("atlas", "atlas"),
    ("cosmos", "cosmos"),
    ("bias", "bias"),
    ("andes", "andes"),
)
# Words that are complete once a plural ending is off.
STEM_COMPLETE = tuple("inning outing canning herring earring proceed exceed succeed".split())

# --- answers ----------------------------------------------------------------
TEXT_NO_NUMBERS = (
    "I found authorized evidence but not enough structured values to compute a result."
)
TEXT_CONFLICT = "I found conflicting authorized evidence and cannot answer confidently."
TEXT_INSUFFICIENT = "I could not find enough authorized evidence to answer that question."

# --- traces, audit, retention -----------------------------------------------
RAW_CONTENT_DAYS = 30
TRACE_DAYS = 90
AUDIT_DAYS = 365
EXPIRED_TEXT = "[expired]"
AUDIT_ACTION = "query.answer"
PIPELINE_VERSION = 3
GENERATOR_MODEL = "qwen3:14b"
EMBEDDING_MODEL = "qwen3-embedding:0.6b"
INGEST_JOB_TYPE = "ingestion.text"
JOB_TYPES = ("ingestion.text", "retention.redact", "retention.purge")
MAX_ERROR_TEXT = 4000

# --- definitions ------------------------------------------------------------
MANDATORY_CAPABILITIES = ("audit", "authorization", "claim-validation", "provenance")
CAPABILITIES = (
    "authorization",
    "provenance",
    "audit",
    "claim-validation",
    "ingestion",
    "retrieval",
    "reranking",
    "generation",
)
NAME_LENGTH = 160
# Most characters of a node's fields; None: no upper bound. All need one or more.
NODE_FIELD_LENGTHS = {
    "node_id": 80,
    "component_type": 120,
    "component_version": 80,
    "input_schema": None,
    "output_schema": None,
}

# --- promotion gates --------------------------------------------------------
GATE_RECALL_AT_10 = 0.90
GATE_CITATION_PRECISION = 0.98
GATE_CITATION_COMPLETENESS = 0.95
GATE_UNSUPPORTED_RATE = 0.01
GATE_ABSTENTION_RECALL = 0.95

# --- evaluation clock used by the registered queries and the tests ------------
AS_OF = dt.datetime(2026, 6, 30, tzinfo=dt.timezone.utc)
