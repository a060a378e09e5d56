"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from airsleuth.llm.decontaminate import OP1_SQL, op1_decontamination
from airsleuth.llm.fill_in_middle import OP13_SQL, op13_fill_in_middle
from airsleuth.llm.filter_audit import OP12_SQL, op12_filter_audit
from airsleuth.llm.fingerprints import op7_fingerprints
from airsleuth.llm.language_model import op4_language_model
from airsleuth.llm.licenses import op2_license_scan
from airsleuth.llm.line_dedup import OP8_SQL, op8_line_dedup
from airsleuth.llm.near_dedup import op3_near_dedup
from airsleuth.llm.packing import op6_packing
from airsleuth.llm.quality import op5_quality
from airsleuth.llm.secret_scan import op11_secret_scan
from airsleuth.llm.tables import Query
from airsleuth.llm.token_files import op9_token_files
from airsleuth.llm.url_filter import OP10_SQL, op10_url_filter

QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_license_scan": op2_license_scan,
    "op3_near_dedup": op3_near_dedup,
    "op4_language_model": op4_language_model,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_fingerprints": op7_fingerprints,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_files": op9_token_files,
    "op10_url_filter": op10_url_filter,
    "op11_secret_scan": op11_secret_scan,
    "op12_filter_audit": op12_filter_audit,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op8_line_dedup": OP8_SQL,
    "op10_url_filter": OP10_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
