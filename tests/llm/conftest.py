import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# texts that any operator must take: null, empty, blank, one word, odd white space, one very long word
ODD_TEXTS = [None, "", " \n\t ", "word", "a\x0bb\x0cc\r\nd", "ß" * 300 + " end", "x" * 5000]


@pytest.fixture
def frame(spark):
    """Documents with the columns of the table, plus one that clashes with a working name."""
    def make(texts, ids=None):
        ids = ids or range(len(texts))
        rows = [(i, t, "en", "s", None if t is None else len(t), 7) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long")
    return make
