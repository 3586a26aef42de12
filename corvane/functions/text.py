"""Text functions as Column expressions; Python only where Spark has no built-in (NFKC, casefold)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Unicode white space, and the word class that equals Python's \w.
SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same for the JVM, where one property is much cheaper to test than many ranges.
BLANK = r"[\p{IsWhite_Space}\x1C-\x1F]"
WORD = r"[\p{L}\p{N}_]+"
#: Characters that NFKC may change or compose lie outside these ranges.
UNSTABLE = r"[^\x{00}-\x{9F}\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}]"
SALT = "corvane-split"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t.casefold(), na_action="ignore")


def ascii_only(text: Column) -> Column:
    """As many bytes as characters; far cheaper than a pattern."""
    return F.octet_length(text) == F.char_length(text)


def nfkc(text: Column) -> Column:
    """NFKC; only texts with characters that it may change are sent to Python."""
    return F.coalesce(_nfkc(F.when(~ascii_only(text) & text.rlike(UNSTABLE), text)), text)


def casefold(text: Column) -> Column:
    """Full case folding; lower case is enough where no character folds otherwise."""
    simple = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    odd = ~ascii_only(text) & text.rlike(r"[^\x{00}-\x{B4}\x{B6}-\x{12F}\x{131}-\x{148}\x{14A}-\x{17E}]")
    return F.coalesce(_casefold(F.when(odd, text)), simple)


def collapse(text: Column) -> Column:
    """Runs of Unicode white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, BLANK + "+", " "))


def strip(text: Column) -> Column:
    """No Unicode white space at the ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def normal(text: Column) -> Column:
    return collapse(nfkc(text))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the normalised text; case counts."""
    return F.sha2(normal(text), 256)


def prompt_normal(text: Column) -> Column:
    return collapse(casefold(nfkc(text)))


def answer_normal(text: Column) -> Column:
    return F.regexp_replace(prompt_normal(text), r"[.!?]+$", "")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def bucket(key: Column, salt: str = SALT, buckets: int = 10_000) -> Column:
    """The first 64 bits of the salted SHA-256, unsigned, modulo ``buckets``."""
    head = F.substring(F.sha2(F.concat(F.lit(salt + ":"), key), 256), 1, 16)
    return (F.conv(head, 16, 10).cast("decimal(20,0)") % buckets).cast("long")


def n_chars(text: Column) -> Column:
    return F.char_length(text).cast("long")


def n_letters(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"\P{L}+", "")).cast("long")


def n_visible(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, BLANK + "+", "")).cast("long")


def alpha_ratio(text: Column) -> Column:
    return F.when(n_visible(text) > 0, n_letters(text) / n_visible(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)


def pieces(text: Column) -> Column:
    """Tokens of the default tokenizer: runs of non-blank characters."""
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


def n_pieces(text: Column) -> Column:
    return F.size(pieces(text)).cast("long")


def grams(items: Column, n: int, join: str | None = " ") -> Column:
    """All n-grams in order; none for shorter arrays."""
    def make(xs):
        found = F.transform(F.sequence(F.lit(1), F.size(xs) - (n - 1)), lambda i: F.array_join(F.slice(xs, i, n), join))
        return F.when(F.size(xs) >= n, found).otherwise(F.array().cast("array<string>"))

    # one-element array: the items are computed once
    return F.get(F.transform(F.array(items), make), F.lit(0))


def shingles(items: Column, n: int = 3) -> Column:
    return F.array_distinct(grams(items, n))


def repeated_fraction(items: Column, n: int = 4) -> Column:
    """1 - distinct / all n-grams; 0 without any."""
    return F.get(F.transform(F.array(grams(items, n)), lambda g: F.when(F.size(g) > 0, 1 - F.size(F.array_distinct(g)) / F.size(g)).otherwise(0.0)), F.lit(0))


def token_f1(predicted: Column, reference: Column) -> Column:
    """Multiset overlap of words; 1.0 only when both are empty."""

    def score(pair):
        p, r = pair["p"], pair["r"]
        shared = F.aggregate(F.array_distinct(p), F.lit(0), lambda a, w: a + F.least(F.size(F.filter(p, lambda x: x == w)), F.size(F.filter(r, lambda x: x == w))))
        empty = (F.size(p) == 0) | (F.size(r) == 0)
        return F.when(empty, ((F.size(p) == 0) & (F.size(r) == 0)).cast("double")).otherwise(2 * shared / (F.size(p) + F.size(r)))

    return F.get(F.transform(F.array(F.struct(words(predicted).alias("p"), words(reference).alias("r"))), score), F.lit(0))
