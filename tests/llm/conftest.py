import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
LONG = "the long road of words 12 " * 20_000
TEXTS = [
    None, "", " ", "\t\n", "one", "One", "a b", "a  b", "a\tb\n", "a b ", "x\n\n y", "  lead", "trail  ", "é ß ñ Ünïcode ŒUVRE", "日本語 テキスト", "🙂 emoji 🙂", "<|endoftext|> a", "a  <|endoftext|>  b\n\n", "a  <|endoftext|>b", "a \n<|endoftext|>b", " nbsp em\x85nel \x1c fs",
    "MIT License and the mit  license; Apache-License General Public License", "licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: MIT", "under the terms of the GNU General Public License v3.0", "smit license", "mit licensed",
    LONG, LONG + "end", "they're we'll IT'S I'D", "1234567 12,5 a1b2", "same text here", "same text here", "same  text here", "퟿ edge",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, repeated rows, ties, and columns whose names operators use inside."""
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None if i % 3 else i, i, "k", 1) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)] + rows[4:7]
    schema = "doc_id long, text string, lang string, source string, n_chars int, row long, digest string, lane int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return SF
