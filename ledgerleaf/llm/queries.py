"""The subpackage's registered queries and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, jaccard, licenses, linededup, packing, pii, quality, secrets, sharding, urlfilter

QUERIES = {
    f.__name__: f
    for f in (
        jaccard.op1_jaccard_join,
        secrets.op2_secret_scan,
        pii.op3_personal_data,
        licenses.op4_license_scan,
        linededup.op5_line_dedup,
        quality.op6_quality_rules,
        decontaminate.op7_decontaminate,
        sharding.op8_shard_lookup,
        packing.op9_harmonic_packing,
        urlfilter.op10_url_filter,
    )
}

ORACLES = {
    "op1_jaccard_join": jaccard.OP1_SQL,
    "op2_secret_scan": secrets.OP2_SQL,
    "op6_quality_rules": quality.OP6_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op10_url_filter": urlfilter.OP10_SQL,
}
