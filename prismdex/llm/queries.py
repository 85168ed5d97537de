"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from prismdex.llm.classifier import op13_classifier
from prismdex.llm.conversations import OP11_SQL, op11_conversations
from prismdex.llm.decontaminate import OP7_SQL, op7_decontaminate
from prismdex.llm.fill_middle import OP12_SQL, op12_fill_middle
from prismdex.llm.licenses import OP9_SQL, op9_licenses
from prismdex.llm.line_dedup import OP5_SQL, op5_line_dedup
from prismdex.llm.mixing import op6_mixing
from prismdex.llm.quality_rules import op3_quality_rules
from prismdex.llm.simhash import op1_simhash
from prismdex.llm.suffix_dedup import op10_suffix_dedup
from prismdex.llm.token_files import op2_token_files
from prismdex.llm.url_filters import OP4_SQL, op4_url_filters
from prismdex.llm.warc_audit import OP8_SQL, op8_warc_audit

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_files": op2_token_files,
    "op3_quality_rules": op3_quality_rules,
    "op4_url_filters": op4_url_filters,
    "op5_line_dedup": op5_line_dedup,
    "op6_mixing": op6_mixing,
    "op7_decontaminate": op7_decontaminate,
    "op8_warc_audit": op8_warc_audit,
    "op9_licenses": op9_licenses,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_conversations": op11_conversations,
    "op12_fill_middle": op12_fill_middle,
    "op13_classifier": op13_classifier,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op4_url_filters": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op7_decontaminate": OP7_SQL,
    "op8_warc_audit": OP8_SQL,
    "op9_licenses": OP9_SQL,
    "op11_conversations": OP11_SQL,
    "op12_fill_middle": OP12_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
