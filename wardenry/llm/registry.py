"""The queries of this folder's operators, and the pipeline's."""

from __future__ import annotations

from . import chat, decontaminate, language_id, lexical, media, near_dedup, packing, quality, secrets, sharding, token_files, url_filter, vector_codes

MODULES = (language_id, secrets, chat, decontaminate, url_filter, near_dedup, packing, sharding, token_files, media, quality, lexical, vector_codes)


def queries() -> dict:
    import corpus_pipeline

    return {k: f for m in MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {k: q for m in MODULES for k, q in m.ORACLE.items()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
