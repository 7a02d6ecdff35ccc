"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from .decontamination import OP8_SQL, op8_decontamination
from .exact import OP3_SQL, op3_exact_dedup
from .jaccard import OP2_SQL, op2_jaccard_join
from .lm_score import OP1_SQL, op1_lm_score
from .mixing import OP6_SQL, op6_mixing
from .pieces import op11_sentencepiece
from .ranked import OP12_SQL, op12_ranked_search
from .repeats import OP9_SQL, op9_repeats
from .sharding import OP10_SQL, op10_sharding
from .token_files import op7_token_files
from .toxicity import op5_toxicity
from .warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_token_files": op7_token_files,
    "op8_decontamination": op8_decontamination,
    "op9_repeats": op9_repeats,
    "op10_sharding": op10_sharding,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_ranked_search": op12_ranked_search,
}

SQL = {"op1_lm_score": OP1_SQL, "op2_jaccard_join": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op4_warc": OP4_SQL, "op6_mixing": OP6_SQL, "op8_decontamination": OP8_SQL, "op9_repeats": OP9_SQL, "op10_sharding": OP10_SQL, "op12_ranked_search": OP12_SQL}
