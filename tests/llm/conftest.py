from __future__ import annotations

import pytest

ODD_SCHEMA = (
    "doc_id bigint, text string, n_tokens string, score string, block string, part string, "
    "failed string, copies string, lang string, spans string, set_id string, row string"
)


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that are easy to get wrong, with extra columns of clashing names."""
    texts = [
        (1, "The house of the rising sun is in New Orleans."),
        (2, None),
        (3, ""),
        (4, " \t\n \x0b\x0c\r "),
        (5, "word " * 60_000),
        (6, "a\x1cb ΑΣ ΣΑΣ ﬁ é <|endoftext|>x<|startoftext|> İ ß   12 ½"),
        (6, "a\x1cb ΑΣ ΣΑΣ ﬁ é <|endoftext|>x<|startoftext|> İ ß   12 ½"),
        (7, "The house of the rising sun is in New Orleans."),
        (7, "Another text under the same id."),
        (None, "A text without an id."),
        (None, None),
        (8, "\U0001f469‍\U0001f469 日本語 текст\nline\nline\n\nline"),
        (9, "x"),
    ]
    return spark.createDataFrame(
        [(i, t, *["clash"] * 10) for i, t in texts], ODD_SCHEMA
    ).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sample(duck):
    """Documents of the smallest tables as (doc_id, text, lang)."""
    return duck.sql("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()
