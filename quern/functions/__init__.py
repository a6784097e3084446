"""Column functions in one place, re-exported from the operators that own them."""

from quern.operators.bandit import posterior_sd, regime
from quern.operators.bars import bucket
from quern.operators.cleaning import lookup, normalise_text
from quern.operators.features import bp_per_sd, cyclical, log_ratio, ratio, signed_log1p, target_class
from quern.operators.kv import sort_key

__all__ = ["bp_per_sd", "bucket", "cyclical", "log_ratio", "lookup", "normalise_text", "posterior_sd", "ratio", "regime", "signed_log1p", "sort_key", "target_class"]
