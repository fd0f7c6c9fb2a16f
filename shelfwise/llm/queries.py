"""Queries of this subpackage by name, and DuckDB SQL where SQL can express one."""

from .decontaminate import OP6_SQL, op6_decontamination
from .fim import OP12_SQL, op12_fill_in_middle
from .knn import OP10_SQL, op10_topk
from .licenses import OP5_SQL, op5_license_scan
from .lines import OP3_SQL, op3_line_dedup
from .mixing import op4_mixing
from .neardup import OP2_SQL, op2_near_duplicates
from .pii import op9_pii
from .quality import op8_quality
from .substrings import op7_substring_dedup
from .tokens import op1_token_output
from .trie import OP11_SQL, op11_prefix_trie
from .warc import OP13_SQL, op13_warc

QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_license_scan": op5_license_scan,
    "op6_decontamination": op6_decontamination,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality": op8_quality,
    "op9_pii": op9_pii,
    "op10_topk": op10_topk,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_warc": op13_warc,
}

ORACLES: dict[str, str] = {
    "op2_near_duplicates": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op5_license_scan": OP5_SQL,
    "op6_decontamination": OP6_SQL,
    "op10_topk": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_warc": OP13_SQL,
}
