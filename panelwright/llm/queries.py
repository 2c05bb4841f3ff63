"""All queries of the numbered operators with their SQL twins."""

from panelwright.llm import decontaminate, importance_sampling, jaccard_join, jump_shards, kneser_ney, length_packing, license_scan, merkle, token_counts, token_planes, toxicity, url_filter, vp_search
from panelwright.session import prepare_text_jobs

_MODULES = [license_scan, token_planes, jaccard_join, jump_shards, vp_search, url_filter, length_packing, kneser_ney, decontaminate, toxicity, importance_sampling, merkle, token_counts]


def _prepared(fn):
    def run(spark, sf_dir):
        prepare_text_jobs(spark)
        return fn(spark, sf_dir)

    return run


QUERIES = {name: _prepared(fn) for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
