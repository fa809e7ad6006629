import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture()
def docs(spark):
    """Rows as documents, with columns whose names clash with the operators' own."""
    def make(rows):
        full = [(i, t, lang, src, len(t) if t is not None else None, "x", "y", 1.5)
                for i, t, lang, src in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, "
                                           "_row string, _h string, score double")
    return make


#: null, empty, blank, signs only, repeated rows, null ids
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (4, "... !!", "fr", None),
       (5, "same words here for all", "en", "a"), (5, "same words here for all", "en", "a"), (None, "no id", None, "b")]
