"""The queries of this subpackage and the SQL of those that SQL can express."""

from inkquarry.llm import exact_dedup
from inkquarry.llm.align import op13_token_alignment
from inkquarry.llm.ann import op3_permutation_index
from inkquarry.llm.bpe import op2_bpe
from inkquarry.llm.exact_dedup import op5_exact_dedup
from inkquarry.llm.minhash import op7_minhash_near_dedup
from inkquarry.llm.packing import op8_best_fit_packing
from inkquarry.llm.periodic import op12_periodic_runs
from inkquarry.llm.secrets import op9_secrets
from inkquarry.llm.suffix_dedup import op1_suffix_dedup
from inkquarry.llm.token_store import op6_token_store
from inkquarry.llm.toxicity import op4_toxicity
from inkquarry.llm.url_filter import op10_url_filter
from inkquarry.llm.windows import op11_substring_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_bpe, op3_permutation_index, op4_toxicity, op5_exact_dedup, op6_token_store, op7_minhash_near_dedup, op8_best_fit_packing, op9_secrets, op10_url_filter,
        op11_substring_dedup, op12_periodic_runs, op13_token_alignment,
    )
}
ORACLES = {"op5_exact_dedup": exact_dedup.ORACLE_SQL}
