"""Name -> query and name -> DuckDB oracle for the operators of this subpackage."""

from __future__ import annotations

from .decontaminate import OP5_SQL, op5_decontaminate
from .jaccard_join import OP6_SQL, op6_jaccard_join
from .mixing import op7_mixing
from .packing import op4_token_packing
from .quality_classifier import op2_quality_classifier
from .quality_rules import OP10_SQL, op10_quality_rules
from .secret_scan import op3_secret_scan
from .suffix_dedup import OP9_SQL, op9_suffix_dedup
from .url_filter import op8_url_filter
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_packing": op4_token_packing,
    "op5_decontaminate": op5_decontaminate,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_mixing": op7_mixing,
    "op8_url_filter": op8_url_filter,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality_rules": op10_quality_rules,
}
ORACLES: dict[str, str] = {"op1_warc": OP1_SQL, "op5_decontaminate": OP5_SQL, "op6_jaccard_join": OP6_SQL, "op9_suffix_dedup": OP9_SQL, "op10_quality_rules": OP10_SQL}
