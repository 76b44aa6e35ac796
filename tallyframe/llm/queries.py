"""The registered queries of this subpackage, and DuckDB SQL for those that one statement can say."""

from __future__ import annotations

from tallyframe.llm.bpe import op6_bpe
from tallyframe.llm.collocations import ORACLE as COLLOCATIONS_SQL, op13_collocations
from tallyframe.llm.decontamination import op4_decontamination
from tallyframe.llm.fingerprints import op8_fingerprints
from tallyframe.llm.language import op5_language
from tallyframe.llm.licenses import op10_licenses
from tallyframe.llm.lm_scoring import op11_lm_scoring
from tallyframe.llm.quality import op3_quality
from tallyframe.llm.sharding import op7_sharding
from tallyframe.llm.simhash import op1_simhash
from tallyframe.llm.spelling import op12_spelling
from tallyframe.llm.token_counts import op2_token_counts
from tallyframe.llm.warc import op9_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_token_counts, op3_quality, op4_decontamination, op5_language, op6_bpe, op7_sharding,
        op8_fingerprints, op9_warc, op10_licenses, op11_lm_scoring, op12_spelling, op13_collocations,
    )
}
ORACLES: dict[str, str] = {"op13_collocations": COLLOCATIONS_SQL}
