"""The queries of the training-data operators, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from strandlog.llm.language import op10_language_bigru
from strandlog.llm.packing import op6_pack_bounded
from strandlog.llm.pagetext import op8_pages_consensus
from strandlog.llm.pieces import op7_sentencepiece
from strandlog.llm.repetition import op4_repetition_suffix
from strandlog.llm.similar import OP9_SQL, op9_similar_rtree
from strandlog.llm.toxicity import op3_toxicity_channel
from strandlog.llm.topk import OP1_SQL, op1_topk_histogram
from strandlog.llm.substrings import OP2_SQL, op2_substring_superkmer
from strandlog.llm.sharding import op5_shard_histogram_sort


def queries() -> dict:
    return {
        "op1_topk_histogram": op1_topk_histogram,
        "op2_substring_superkmer": op2_substring_superkmer,
        "op4_repetition_suffix": op4_repetition_suffix,
        "op3_toxicity_channel": op3_toxicity_channel,
        "op5_shard_histogram_sort": op5_shard_histogram_sort,
        "op6_pack_bounded": op6_pack_bounded,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_pages_consensus": op8_pages_consensus,
        "op9_similar_rtree": op9_similar_rtree,
        "op10_language_bigru": op10_language_bigru,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_histogram": OP1_SQL, "op2_substring_superkmer": OP2_SQL, "op9_similar_rtree": OP9_SQL}
