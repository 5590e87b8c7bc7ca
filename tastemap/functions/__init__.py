from tastemap.functions.scalar import (  # noqa: F401
    behaviour_weight, blend_score, cosine, dot, in_zone, jaccard, l2_norm,
    merge_mean, normalise, pad, parse_log_time, time_bucket, unscale,
)
from tastemap.functions.text import (  # noqa: F401
    tokens_regex_gap, tokens_regex_match, tokens_ws,
)
