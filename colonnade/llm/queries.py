"""The queries of this folder and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from colonnade.llm import oracles
from colonnade.llm.decontamination import op2_benchmark_passages
from colonnade.llm.language import op5_hyperdimensional_language
from colonnade.llm.licenses import op4_patience_licenses
from colonnade.llm.line_rules import op9_line_frequency_rules
from colonnade.llm.packing import op8_conflict_best_fit
from colonnade.llm.periodic_runs import op12_periodic_runs
from colonnade.llm.quality import op3_random_indexing_quality
from colonnade.llm.sharding import op10_jump_shards
from colonnade.llm.simhash import op6_simhash_components
from colonnade.llm.suffix_dedup import op1_repeated_strings
from colonnade.llm.tool_calls import op7_linked_tool_calls
from colonnade.llm.url_filters import op13_redirect_equivalence
from colonnade.llm.whitening import op11_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_repeated_strings,
        op2_benchmark_passages,
        op3_random_indexing_quality,
        op4_patience_licenses,
        op5_hyperdimensional_language,
        op6_simhash_components,
        op7_linked_tool_calls,
        op8_conflict_best_fit,
        op9_line_frequency_rules,
        op10_jump_shards,
        op11_embedding_whitening,
        op12_periodic_runs,
        op13_redirect_equivalence,
    )
}
ORACLES = {
    op1_repeated_strings.__name__: oracles.REPEATED_STRINGS,
    op9_line_frequency_rules.__name__: oracles.LINE_RULES,
    op10_jump_shards.__name__: oracles.JUMP_SHARDS,
    op13_redirect_equivalence.__name__: oracles.URL_VERDICTS,
}
