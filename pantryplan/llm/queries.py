"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pantryplan.llm.bpe import op4_bpe_round_trip
from pantryplan.llm.secrets import op7_secret_scan
from pantryplan.llm.warc import OP2_SQL, op2_warc_revisits
from pantryplan.llm.decontaminate import op3_decontaminate
from pantryplan.llm.licenses import op6_license_scan
from pantryplan.llm.linededup import op10_line_dedup
from pantryplan.llm.neardup import OP1_SQL, op1_near_duplicates
from pantryplan.llm.rules import op9_quality_rules
from pantryplan.llm.classifier import op8_quality_classifier
from pantryplan.llm.dac import op5_token_files
from pantryplan.llm.sharding import op11_shards
from pantryplan.llm.spelling import op12_spelling_variants
from pantryplan.llm.whitening import op13_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_duplicates": op1_near_duplicates,
        "op2_warc_revisits": op2_warc_revisits,
        "op3_decontaminate": op3_decontaminate,
        "op4_bpe_round_trip": op4_bpe_round_trip,
        "op5_token_files": op5_token_files,
        "op6_license_scan": op6_license_scan,
        "op7_secret_scan": op7_secret_scan,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_quality_rules": op9_quality_rules,
        "op10_line_dedup": op10_line_dedup,
        "op11_shards": op11_shards,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_near_duplicates": OP1_SQL, "op2_warc_revisits": OP2_SQL}
