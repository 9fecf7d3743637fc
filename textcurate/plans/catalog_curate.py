"""PIP-01 flagship: curate end to end."""

from __future__ import annotations

from textcurate.plans import curate as C
from textcurate.plans import sqlparts as S
from textcurate.plans.registry import register


@register("curate_e2e", f"""WITH {S.VERDICTS},
cur AS (SELECT *, row_number() OVER (ORDER BY pos) AS pid FROM curated),
cur2 AS (SELECT *, pid - 1 AS lid, coalesce(sentiment, 'unlabelled') AS stratum FROM cur),
{S.stratified('cur2', label='stratum', idc='lid')}
SELECT lid AS id, pid AS original_id, pos AS doc_id, clean_text, sentiment, domain, split FROM split_rows""")
def curate_e2e(spark, sf):
    """Clean -> length filter -> exact + near dedup (global) -> renumber ->
    local id -> stratified 70/15/15 split."""
    return C.curate(spark, sf)
