"""They must equal the studied tool's for equal results."""

# Retrieval of similar pairs.
MIN_LINES = 8
MIN_JACCARD = 0.45
MIN_SIZE_RATIO = 0.5
MAX_CANDIDATES = 2000
MAX_COMPARISONS = 500_000
LOW_OVERLAP_CAP = 50
MIN_SCORE = 0.6
MIN_SURFACE = 3
MAX_DOCUMENT_FREQUENCY = 250
SHINGLE_WIDTH = 5
CASE_WIDTH = 3
CASE_NEAR_DUPLICATE = 0.9
COVERAGE_WIDTH = 10
COVERAGE_WIDTH_WIDE = 50

# Words that carry no meaning in a name.
NAME_STOPWORDS = (
    "the and for with from into that this then than get set has have are was use used make made create new "
    "add all any not out off its per via run handle on of to in is it as at by do to if or an a can has own "
    "one two index item items data value values result results default props prop state args arg params "
    "param options option opts config ctx context"
).split()

# Text shaped like a credential.
SECRET_PATTERNS = (
    r"(?i)-----BEGIN (?:[A-Z ]*PRIVATE KEY)-----",
    r"""(?i)(?:api[_-]?key|password|secret|token)['"`]?\s*[:=]\s*['"`][^'"`\s]{12,}['"`]""",
    r"(?i)\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9_-]{20,}|AKIA[A-Z0-9]{16})\b",
    r"\b[sr]k_live_[A-Za-z0-9]{16,}",
    r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"""(?i)\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@'"`${}<>]+:(?!(?:pass|password|secret|changeme)@)[^\s:/@'"`${}<>]{3,}@[^\s'"`/]+""",
)

# Questions, their unit kinds, presence option, status, cut and floor.
SIGNALS = (
    ("clone_same_policy", ["clone_pair"], "same_policy", "default", 0.70, 0.50, False),
    ("function_should_split", ["function"], "split_candidate", "default", 0.50, 0.35, False),
    ("magic_policy_literal", ["function", "function_chunk"], "unexplained_policy_literal", "experimental", 0.70, 0.50, False),
    ("internal_duplication", ["function", "function_chunk"], "duplicated_blocks", "experimental", 0.70, 0.50, False),
    ("function_multiple_responsibilities", ["function"], "multiple", "default", 0.70, 0.50, False),
    ("unused_local_or_parameter", ["function", "function_chunk"], "unused", "experimental", 0.70, 0.50, False),
    ("deep_nesting", ["function", "function_chunk"], "deeply_nested", "experimental", 0.70, 0.50, False),
    ("unreachable_code", ["function", "function_chunk"], "unreachable", "experimental", 0.70, 0.50, False),
    ("name_vs_behavior", ["function"], "name_mismatch", "opt_in", 0.50, 0.20, True),
)
DEFAULT_CUT = 0.70
DEFAULT_FLOOR = 0.50

# Answer checks.
SUM_TOLERANCE = 0.02
WINNER_EPSILON = 1e-9
WINNER_TOLERANCE = 0.01
DELTA_EPSILON = 1e-9

# Tariff, token cap, byte caps and limits.
USD_PER_MILLION = 0.042
MAX_INPUT_TOKENS = 65_536
RESERVATION_USD = MAX_INPUT_TOKENS * USD_PER_MILLION / 1e6
MAX_REQUEST_BYTES = 24_000
MAX_HARD_REQUEST_BYTES = 64_000
MAX_FILE_BYTES = 512 * 1024
MAX_TOTAL_BYTES = 16 * 1024 * 1024
MAX_FILES = 500
MAX_UNITS = 2000
MIN_WINDOW_LINES = 5
CONTEXT_LINES = 15
MAX_CALLERS, MAX_IMPORTS, MAX_TESTS = 3, 8, 2

# Evaluation rules.
WILSON_Z = 1.96
BOOTSTRAP_RESAMPLES = 2000
BOOTSTRAP_SEED = 20260930
GATE = dict(min_reviewed=8, min_projects=2, actionable=0.5, low_precision=0.3, stable_at=4, pivot_at=2)
CALIBRATION = dict(min_clear=20, target=0.9)
VARIANCE = dict(threshold=0.05, rule=0.2)
CUT_GRID = (50, 55, 60, 65, 70)
FLOOR_GRID = (5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70)
CUT_RULE = dict(cut_primary=0.05, cut_hardened=0.10, floor_primary=0.10, cut_real=0.3, floor_real=0.3)
MIN_CLASS = 15
STRATA = ((5, 9), (10, 19), (20, 39), (40, 100))
STRATUM_SIZE, STRATUM_PER_FILE, STRATUM_NEAR = 25, 3, 0.8

# Directories and names that a snapshot never reads.
EXCLUDED_DIRECTORIES = ["node_modules", "vendor", "vendors", "dist", "build", "coverage", "generated", "__generated__", "out", "target"]

# The marker of generated files, among so many first characters, and the names of source and test files.
GENERATED_MARKER, GENERATED_WITHIN = r"(?i)(?:^|\n)\s*(?://|/\*|\*)[^\n]*(?:@generated|auto.generated|do not edit)", 4096
SOURCE_PATH = r"\.(?:[cm]?[jt]s|[jt]sx)$"
DECLARATION_PATH = r"\.d\.[cm]?ts$"
TEST_PATH = r"(?:^|/)(?:tests?|__tests__)(?:/|$)|\.(?:test|spec)\.[cm]?[jt]sx?$"
