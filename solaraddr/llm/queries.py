"""The registered queries of the operators, and SQL for those that SQL can express."""

from .ann import op7
from .chat import OP10_SQL, op10
from .html import op9
from .jaccard import OP8_SQL, op8
from .leaks import op4
from .merkle import OP13_SQL, op13
from .mixing import OP1_SQL, op1
from .prefixes import OP12_SQL, op12
from .secrets import op11
from .substrings import OP6_SQL, op6
from .suffixes import op2
from .toxicity import op5
from .urls import op3

QUERIES = {
    "op1_mix_sources": op1,
    "op2_byte_dedup": op2,
    "op3_url_filter": op3,
    "op4_decontaminate": op4,
    "op5_toxicity": op5,
    "op6_substring_dedup": op6,
    "op7_nearest_neighbours": op7,
    "op8_jaccard_join": op8,
    "op9_html_text": op9,
    "op10_chat_format": op10,
    "op11_secret_scan": op11,
    "op12_prefix_trie": op12,
    "op13_merkle_manifest": op13,
}
ORACLES = {"op1_mix_sources": OP1_SQL, "op6_substring_dedup": OP6_SQL, "op8_jaccard_join": OP8_SQL, "op10_chat_format": OP10_SQL, "op12_prefix_trie": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
