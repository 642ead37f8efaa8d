"""Named methods over documents: how spans are found, and how texts are protected."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ensemble as N
from . import extract as E
from . import privacy as P
from . import spans as S

Extractor = Callable[[DataFrame], DataFrame]


def default_extractors() -> dict[str, Extractor]:
    return {"rule_based": E.rule_spans, "dictionary": E.dictionary_spans}


def extract(docs: DataFrame, method: str = "union", extractors: Mapping[str, Extractor] | None = None) -> DataFrame:
    """Spans by the named extractor, by the first of each text and type of all (first), or by a vote of all (majority, weighted, union, consensus)."""
    known = dict(extractors or default_extractors())
    if method in known:
        return known[method](docs)
    both = S.union_all([f(docs).select("doc_id", "text", "pii_type", "confidence", "start_pos", "end_pos", "context", "extractor") for f in known.values()])
    return S.first_of_each(both) if method == "first" else N.vote(N.group_similar(both), method)


def protect(docs: DataFrame, spans: DataFrame, mode: str, secret: str = "") -> DataFrame:
    """Texts as they are (none), redacted (redaction), with tokens (tokenization) or both by type (mixed)."""
    return {"none": lambda: docs, "redaction": lambda: P.redact(docs, spans), "tokenization": lambda: P.tokenize(docs, spans, secret), "mixed": lambda: P.mixed(docs, spans, secret)}[mode]()


def cross_evaluate(predicted: DataFrame, truth: DataFrame, counts: Callable[..., DataFrame]) -> DataFrame:
    """Counts of each document, one row for a document and type; predicted may hold several models, told apart by extractor."""
    keys = ["doc_id", "extractor"]
    models = predicted.select("extractor").distinct()  # each is held against all truth
    every = truth.drop("extractor").crossJoin(models)
    return counts(predicted, every, keys, keys).withColumnRenamed("extractor", "model")
