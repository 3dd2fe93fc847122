"""Redaction, text measures and prompt texts as column expressions."""

from __future__ import annotations

import gzip
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# a word border that counts only ASCII letters, digits and _, in every regex dialect
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
# fixed values
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?){2}\d{4}"
EMAIL_RULE, PHONE_RULE = f"{_EDGE}{EMAIL}{_EDGE}", f"{_EDGE}{PHONE}{_EDGE}"
MIN_LENGTH, MIN_ENTROPY = 12, 4.5


def redact_email(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL_RULE, "[redacted email]")


def redact_phone(c: Column) -> Column:
    return F.regexp_replace(c, PHONE_RULE, "[redacted phone]")


def entropy(word: Column) -> Column:
    """Shannon entropy of a word in bits per character; 0 of the empty word."""
    chars = F.filter(F.split(word, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


@F.pandas_udf(ArrayType(DoubleType()))
def word_entropies(texts: pd.Series) -> pd.Series:
    """``entropy`` of every word of a text in its order, 6 decimals; null of null.  Each word of
    a batch is measured once."""
    known: dict[str, float] = {}

    def bits(w: str) -> float:
        if w not in known:
            known[w] = round(-sum(n / len(w) * math.log2(n / len(w)) for n in Counter(w).values()), 6) + 0.0
        return known[w]

    return texts.map(lambda t: None if t is None else [bits(w) for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w])


def is_secret(word: Column) -> Column:
    """At least 12 characters and over 4.5 bits each: such a word has 23 symbols or more."""
    return F.when(F.length(word) >= max(MIN_LENGTH, 23), entropy(word) > MIN_ENTROPY).otherwise(False)


def redact_secrets(c: Column) -> Column:
    """Replace random-looking words; white space collapses only where one is found."""
    words = F.split(c, r"[ \t\n\x0b\f\r]+")
    hidden = F.transform(words, lambda w: F.when(is_secret(w), "[redacted high entropy]").otherwise(w))
    return F.when(F.exists(words, is_secret), F.array_join(hidden, " ")).otherwise(c)


def redact(c: Column) -> Column:
    """E-mails, then phones, then secrets."""
    return redact_secrets(redact_phone(redact_email(c)))


def redaction_counts(c: Column) -> list[Column]:
    mail = F.size(F.regexp_extract_all(c, F.lit(f"({EMAIL_RULE})"), 1))
    phone = F.size(F.regexp_extract_all(redact_email(c), F.lit(f"({PHONE_RULE})"), 1))
    return [mail.cast("long").alias("n_email"), phone.cast("long").alias("n_phone")]


def redactions(c: Column) -> Column:
    """What is redacted in a text: array of struct(kind, content), e-mails, phones, then secrets."""
    clean = redact_phone(redact_email(c))
    words = F.filter(F.split(clean, r"[ \t\n\x0b\f\r]+"), is_secret)
    found = (("email", F.regexp_extract_all(c, F.lit(f"({EMAIL_RULE})"), 1)), ("phone", F.regexp_extract_all(redact_email(c), F.lit(f"({PHONE_RULE})"), 1)), ("secret", words))

    def named(kind: str):
        return lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("content"))

    return F.concat(*[F.transform(x, named(kind)) for kind, x in found])


@F.pandas_udf(DoubleType())
def compression_ratio(texts: pd.Series) -> pd.Series:
    """Bytes of the text in gzip form over its own bytes; null of null and empty texts."""
    return texts.map(lambda t: len(gzip.compress(t.encode())) / len(t.encode()) if t else None).astype(float)


def conversation_id(url: Column, pattern: str = r"chatgpt\.com/c/([a-zA-Z0-9_-]+)") -> Column:
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def exchange_text(date: str = "date", time: str = "time", question: str = "question", answer: str = "answer") -> Column:
    """One exchange as text; null if any part is null."""
    return F.concat(F.col(date), F.lit(" at "), F.col(time), F.lit("\n QUESTION: "), F.col(question), F.lit("\n ANSWER: "), F.col(answer))


def empty_to_null(c: Column, na_tokens: tuple[str, ...] = ()) -> Column:
    return F.when(c.isin("", *na_tokens), None).otherwise(c)


def username_ok(c: Column) -> Column:
    return F.coalesce(c.rlike("^[A-Za-z0-9_]{3,20}$"), F.lit(False))


def json_object(c: Column) -> Column:
    """The outermost braces of a completion, without fences or text around them."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def typed_field(c: Column, field: str, kind: str) -> Column:
    """A field of a JSON completion if it has the JSON type ``kind``, else null."""
    v = F.try_variant_get(F.try_parse_json(json_object(c)), f"$.{field}", "variant")
    return F.when(F.schema_of_variant(v) == {"string": "STRING", "boolean": "BOOLEAN", "int": "BIGINT"}[kind], F.try_variant_get(F.try_parse_json(json_object(c)), f"$.{field}", kind))
