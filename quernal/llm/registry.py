"""The operator queries and their SQL."""

from __future__ import annotations

from quernal.llm import annforest, decontam, hardneg, htmlmain, langid, licences, linedup, mixing, neardup, quality, secrets, toxicity, whitening

QUERIES = {
    "op1_linedup": linedup.query,
    "op2_licences": licences.query,
    "op3_htmlmain": htmlmain.query,
    "op4_quality": quality.query,
    "quality_ablations": quality.ablation_query,
    "op5_langid": langid.query,
    "op6_mixing": mixing.query,
    "op7_toxicity": toxicity.query,
    "op8_neardup": neardup.query,
    "op9_secrets": secrets.query,
    "op10_decontam": decontam.query,
    "op11_whitening": whitening.query,
    "op12_annforest": annforest.query,
    "op13_hardneg": hardneg.query,
}
#: Operators that SQL can express; the others are tested against brute force or held-out rows.
ORACLES = {
    "op2_licences": licences.ORACLE,
    "op4_quality": quality.ORACLE,
    "quality_ablations": quality.ABLATION_ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op9_secrets": secrets.ORACLE,
    "op10_decontam": decontam.ORACLE,
    "op13_hardneg": hardneg.ORACLE,
}
