"""Labels to train a token model on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The label of pieces that training leaves out (fixed value).
IGNORED = -100


def changed_labels(raw: str = "raw", norm: str = "norm") -> Column:
    """1 for each token that has another norm, else 0; as many as the shorter array has."""
    both = F.zip_with(F.col(raw), F.col(norm), lambda r, n: F.when(r.eqNullSafe(n), 0).otherwise(1))
    return F.slice(both, F.lit(1), F.least(F.size(raw), F.size(norm)))


def piece_labels(labels: str = "labels", words: str = "word_ids") -> Column:
    """A label a piece: its word's for a word's first piece, ``IGNORED`` for the others and for pieces of no word."""
    before = lambda i: F.get(F.col(words), i - 1)
    return F.transform(words, lambda w, i: F.when(w.isNull() | ((i > 0) & w.eqNullSafe(before(i))), IGNORED).otherwise(F.get(F.col(labels), w)))
