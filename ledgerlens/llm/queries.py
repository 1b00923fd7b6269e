"""Registered queries of this subpackage, and the SQL that they are held against."""

from __future__ import annotations

from . import decontaminate, exact_dedup, license_scan, line_dedup, mixing, pfp_dedup, secret_scan, sharding, simhash, simhash_sql, toxicity

QUERIES = {
    "op1_suffix_array_dedup": pfp_dedup.op1_suffix_array_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_simhash": simhash.op5_simhash,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_sharding": sharding.op8_sharding,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE = {
    "op1_suffix_array_dedup": pfp_dedup.OP1_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op5_simhash": simhash_sql.OP5_SQL,
    "op8_sharding": sharding.OP8_SQL,
    "op9_license_scan": license_scan.OP9_SQL,
}

#: These read the table benchmark beside documents.
ORACLE_WITH_BENCHMARK = {"op7_decontamination": decontaminate.OP7_SQL}
