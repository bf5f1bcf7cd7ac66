"""All queries of the subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from plumbline.llm import (
    cap_filters,
    chat,
    merkle,
    mixing,
    ngram_join,
    pieces,
    privacy,
    quality,
    repair,
    secrets,
    suffix_dedup,
    toxicity,
    warc,
)
from plumbline.llm.common import Query

QUERIES = {
    **quality.QUERIES,
    **ngram_join.QUERIES,
    **suffix_dedup.QUERIES,
    **cap_filters.QUERIES,
    **warc.QUERIES,
    **toxicity.QUERIES,
    **secrets.QUERIES,
    **pieces.QUERIES,
    **chat.QUERIES,
    **mixing.QUERIES,
    **merkle.QUERIES,
    **repair.QUERIES,
    **privacy.QUERIES,
    "pipeline": Query(corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
