"""The queries of this subpackage and the SQL that must give the same rows, where SQL can."""

from __future__ import annotations

from gaugework.llm import filter_audit, fingerprints, lexical, quality_rules, substrings, suffixes
from gaugework.llm.filter_audit import op13_filter_audit
from gaugework.llm.fingerprints import op5_fingerprints
from gaugework.llm.lexical import op11_lexical
from gaugework.llm.packing import op10_packing
from gaugework.llm.pieces import op3_pieces
from gaugework.llm.quality_model import op9_quality_model
from gaugework.llm.quality_rules import op4_quality_rules
from gaugework.llm.simhash import op8_simhash
from gaugework.llm.substrings import op7_substrings
from gaugework.llm.suffixes import op12_suffixes
from gaugework.llm.surrogates import op2_surrogates
from gaugework.llm.tokens import op6_token_counts
from gaugework.llm.toxicity import op1_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_surrogates,
        op3_pieces,
        op4_quality_rules,
        op5_fingerprints,
        op6_token_counts,
        op7_substrings,
        op8_simhash,
        op9_quality_model,
        op10_packing,
        op11_lexical,
        op12_suffixes,
        op13_filter_audit,
    )
}

ORACLES = {
    "op4_quality_rules": quality_rules.SQL,
    "op5_fingerprints": fingerprints.SQL,
    "op7_substrings": substrings.SQL,
    "op11_lexical": lexical.SQL,
    "op12_suffixes": suffixes.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
