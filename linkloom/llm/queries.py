"""The queries of this package and their SQL checks."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm.conversations import CONVERSATION_SQL, op11_conversation_repair
from linkloom.llm.divergence import DIVERGENCE_SQL, op13_source_divergence
from linkloom.llm.histogram_packing import op12_shortest_pack_first
from linkloom.llm.line_dedup import op7_line_dedup
from linkloom.llm.mixing import MIXING_SQL, op3_source_mixing
from linkloom.llm.neighbours import op5_nearest_neighbours
from linkloom.llm.packing import op6_best_fit_packing
from linkloom.llm.quality import QUALITY_SQL, op4_quality_rules
from linkloom.llm.sharding import op9_sharding
from linkloom.llm.simhash import op1_simhash_near_dup
from linkloom.llm.substrings import op8_substring_dedup
from linkloom.llm.toxicity import op10_toxicity
from linkloom.llm.url_filter import URL_FILTER_SQL, op2_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dup": op1_simhash_near_dup,
    "op2_url_filter": op2_url_filter,
    "op3_source_mixing": op3_source_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_shortest_pack_first": op12_shortest_pack_first,
    "op13_source_divergence": op13_source_divergence,
}

SQL: dict[str, str] = {
    "op2_url_filter": URL_FILTER_SQL,
    "op3_source_mixing": MIXING_SQL,
    "op4_quality_rules": QUALITY_SQL,
    "op11_conversation_repair": CONVERSATION_SQL,
    "op13_source_divergence": DIVERGENCE_SQL,
}
