"""Text to tokens, shingles, name words, lines and path facts, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom import constants as K

SEPARATOR = "\u001f"


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of ``[a-z0-9]``."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def case_tokens(text: Column) -> Column:
    """Runs of word characters with their case, the tokens of the case audit."""
    return F.filter(F.split(text, "[^A-Za-z0-9_]+"), lambda x: x != "")


def kgrams(tokens: Column, k: int, separator: str = " ") -> Column:
    """Every window of ``k`` tokens, in order and with repeats; empty below ``k`` tokens.

    Windows are read by position: ``slice`` inside ``transform`` would copy the whole array per window.
    ``tokens`` should be a column, not an expression, or it is evaluated again for every window.
    """
    window = lambda i: F.concat_ws(separator, *[F.get(tokens, i + d) for d in range(k)])
    return F.when(F.size(tokens) >= k, F.transform(F.sequence(F.lit(0), F.size(tokens) - k), window)).otherwise(
        F.array().cast("array<string>")
    )


def shingles(tokens: Column, k: int = K.SHINGLE_WIDTH, separator: str = " ") -> Column:
    return F.array_distinct(kgrams(tokens, k, separator))


def shingle_hashes(tokens: Column, k: int = K.SHINGLE_WIDTH) -> Column:
    """The shingle set as 64-bit hashes, an eighth of the text; two of n shingles collide at about n^2 / 2^65."""
    window = lambda i: F.xxhash64(*[F.get(tokens, i + d) for d in range(k)])
    return F.when(
        F.size(tokens) >= k, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(tokens) - k), window))
    ).otherwise(F.array().cast("array<bigint>"))


def token_hashes(tokens: Column) -> Column:
    """Each token as a 64-bit hash, in order and with repeats."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def normalised_token(label: Column, value: Column) -> Column:
    """Names, strings and numbers collapse to one placeholder each; other tokens stay."""
    return (
        F.when(label.isin("name", "private_name", "jsx_name"), F.lit("ID"))
        .when(label.isin("string", "template", "jsx_text"), F.lit("STR"))
        .when(label.isin("num", "bigint"), F.lit("NUM"))
        .otherwise(value)
    )


def split_words(text: Column) -> Column:
    """Camel-case words of at least three letters, singular, without stop words, repeats kept."""
    spaced = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    singular = F.transform(
        words,
        lambda w: F.when((F.length(w) > 4) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y")))
        .when((F.length(w) > 3) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1))
        .otherwise(w),
    )
    return F.filter(singular, lambda w: ~w.isin(K.NAME_STOPWORDS))


def name_words(name: Column) -> Column:
    return F.array_sort(F.array_distinct(split_words(name)))


def name_cue_absent(words: Column, body_words: Column) -> Column:
    """True only when the name has words and none of them occurs in the body."""
    return (F.size(words) > 0) & ~F.arrays_overlap(words, body_words)


def applies_to_unit(has_filter: Column, absent: Column) -> Column:
    """A filtered question is skipped only when the cue is known to be false."""
    return ~has_filter | F.coalesce(absent, F.lit(True))


def missing_share(words: Column, body_words: Column) -> Column:
    return F.when(
        F.size(words) > 0, F.size(F.array_except(words, body_words)).cast("double") / F.size(words)
    ).otherwise(F.lit(0.0))


def overlap_share(words: Column, body_words: Column) -> Column:
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, body_words)).cast("double") / F.size(words))


def secret_kinds(text: Column) -> Column:
    """Numbers of the credential patterns that match, 1-based; the last one is the URL form."""
    # A pattern runs only on texts that hold a literal without which it cannot match.
    low = F.lower(text)
    holds = lambda source, *parts: reduce(lambda a, b: a | b, (F.contains(source, F.lit(p)) for p in parts))
    may = [
        holds(low, "-----begin"),
        holds(low, "key", "password", "secret", "token"),
        holds(low, "gh", "sk-", "akia"),
        holds(text, "k_live_"),
        holds(text, "xox"),
        holds(text, "eyJ"),
        holds(text, "://"),
    ]
    hits = [F.when(m & text.rlike(p), F.lit(i)) for i, (m, p) in enumerate(zip(may, K.SECRET_PATTERNS), 1)]
    return F.array_compact(F.array(*hits))


def is_generated(text: Column) -> Column:
    """A comment line among the first 4096 characters says the file is generated."""
    return F.substring(text, 1, K.GENERATED_WITHIN).rlike(K.GENERATED_MARKER)


def is_source_path(path: Column) -> Column:
    return path.rlike(K.SOURCE_PATH) & ~path.rlike(K.DECLARATION_PATH)


def is_test_path(path: Column) -> Column:
    return path.rlike(K.TEST_PATH)


def is_safe_relative(path: Column) -> Column:
    segments = F.split(path, "/")
    return (
        path.isNotNull()
        & (F.length(path) > 0)
        & ~F.contains(path, F.lit("\\"))
        & ~path.startswith("/")
        & ~F.exists(segments, lambda s: (s == "") | s.startswith("."))
    )


def under_any(path: Column, prefixes: list[str]) -> Column:
    """Equal to a listed path or below it."""
    tests = [(path == p) | path.startswith(p + "/") for p in prefixes]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def is_admissible(path: Column, excluded: list[str]) -> Column:
    return (
        is_safe_relative(path)
        & ~under_any(path, excluded)
        & ~F.exists(F.split(path, "/"), lambda s: s.isin(K.EXCLUDED_DIRECTORIES))
        & ~path.rlike(r"(?i)(?:secret|credential|\.min\.|\.generated\.)")
    )


def directory_key(path: Column, depth: int) -> Column:
    """The first ``depth`` directories of a path, ``.`` at the top."""
    folders = F.split(path, "/")
    cut = F.slice(folders, 1, F.least(F.lit(depth), F.size(folders) - 1))
    return F.when(F.size(folders) > 1, F.array_join(cut, "/")).otherwise(F.lit("."))


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def safe_display(value: Column) -> Column:
    """Text without the characters that would break a Markdown line."""
    return F.regexp_replace(value, "[`<>\\r\\n  ]", " ")


def unit_hash(*parts: Column) -> Column:
    """A uniform number in [0, 1) from the first 32 bits of SHA-256 over ``|``-joined parts."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)


def two_decimals(value: Column) -> Column:
    return F.floor(value * 100 + F.lit(0.5)).cast("double") / F.lit(100.0)
