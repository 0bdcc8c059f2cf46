"""Queries of this subpackage and their SQL, by name; a query without SQL here is one that SQL cannot express."""

from sparkfold.llm.line_quality import op3_line_quality
from sparkfold.llm.main_text import OP11_SQL, op11_main_text
from sparkfold.llm.merkle import OP13_SQL, op13_merkle_manifest
from sparkfold.llm.minhash_dedup import OP7_SQL, op7_minhash_dedup
from sparkfold.llm.packing import op5_packing
from sparkfold.llm.prefix_counts import op4_token_counts
from sparkfold.llm.substring_dedup import OP10_SQL, op10_substring_dedup
from sparkfold.llm.suffix_dedup import op8_suffix_dedup
from sparkfold.llm.token_files import op1_token_files
from sparkfold.llm.topk import OP6_SQL, op6_exact_topk
from sparkfold.llm.toxicity import op9_toxicity
from sparkfold.llm.vector_codes import OP12_SQL, op12_vector_codes
from sparkfold.llm.viterbi_pieces import op2_sentencepiece

_ALL = (op1_token_files, op2_sentencepiece, op3_line_quality, op4_token_counts, op5_packing, op6_exact_topk, op7_minhash_dedup, op8_suffix_dedup, op9_toxicity, op10_substring_dedup, op11_main_text, op12_vector_codes, op13_merkle_manifest)
QUERIES = {f.__name__: f for f in _ALL}

ORACLES: dict[str, str] = {"op6_exact_topk": OP6_SQL, "op7_minhash_dedup": OP7_SQL, "op10_substring_dedup": OP10_SQL, "op11_main_text": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
