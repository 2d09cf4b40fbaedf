"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridspark.llm._common import ready
from gridspark.llm.decontamination import op10_decontamination
from gridspark.llm.doc_fingerprints import op8_doc_fingerprints
from gridspark.llm.line_dedup import OP3_SQL, op3_line_dedup
from gridspark.llm.mixing import op5_mixing
from gridspark.llm.pii import op9_pii
from gridspark.llm.secret_scan import op4_secret_scan
from gridspark.llm.simhash import op6_simhash
from gridspark.llm.token_counts import op1_token_counts
from gridspark.llm.token_output import op7_token_output
from gridspark.llm.toxicity import op2_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_token_counts": op1_token_counts,
        "op2_toxicity": op2_toxicity,
        "op3_line_dedup": op3_line_dedup,
        "op4_secret_scan": op4_secret_scan,
        "op5_mixing": op5_mixing,
        "op6_simhash": op6_simhash,
        "op7_token_output": op7_token_output,
        "op8_doc_fingerprints": op8_doc_fingerprints,
        "op9_pii": op9_pii,
        "op10_decontamination": op10_decontamination,
    }
    return {name: lambda spark, sf_dir, query=query: query(ready(spark), sf_dir) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL}
