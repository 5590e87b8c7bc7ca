"""Parameters and the fixed values the results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the original system's for equal results).
# Time-of-day buckets, in clock order, with their inclusive HH:mm:ss ranges.
BUCKETS = (
    ("凌晨", "00:00:00", "05:59:59"),
    ("上午", "06:00:00", "11:59:59"),
    ("下午", "12:00:00", "17:59:59"),
    ("晚上", "18:00:00", "23:59:59"),
)
# Behaviour codes: 1 read, 2 comment, 3 forward, 4 store, and their weights.
BEHAVIOUR_WEIGHTS = {1: 0.2, 2: 0.2, 3: 0.3, 4: 0.3}
# Custom stop words shipped with the original system (one per line there).
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such "
    "that the their then there these they this to was will with"
).split()
# Spark's default English stop words (the default of the vocabulary), pinned here so
# that results do not change with the Spark version.
DEFAULT_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more
most other some such no nor not only own same so than too very s t can will just don
should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm
you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't
haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's
why's would
""".split()
# Timestamp layout of the text behaviour log.
LOG_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
# ---------------------------------------------------------------------------

MORNING = BUCKETS[1][0]


@dataclass(frozen=True)
class Params:
    """Tunable parameters. The original read these from a properties file
    that is not shipped, so the numeric defaults marked 'ours' are choices."""

    behaviour_weights: dict = field(default_factory=lambda: dict(BEHAVIOUR_WEIGHTS))
    n_topics: int = 10                # ours
    vocab_multiplier: int = 100       # ours; vocabulary = n_topics * multiplier
    min_similarity: float = 0.2       # ours; strict '>' threshold
    topic_weight: float = 0.7         # ours; sigma in the combined score
    keyword_weight: float = 0.3       # ours; beta in the combined score
    keyword_floor: float = 0.0        # ours; see similarity.hybrid_join
    cf_blend_ratio: float = 0.2       # ours
    keywords_per_doc: int = 10
    keywords_per_update: int = 10
    cf_items: int = 2
    als_rank: int = 5
    als_iterations: int = 5
    als_reg: float = 0.1
    lda_iterations: int = 20
    # Hot-key protection: number of salt buckets for joins on a low-cardinality
    # key (vector dimension, frequent term).
    salt_buckets: int = 8
    # Recommendation profile bucket; the original always used the morning one.
    profile_bucket: str = MORNING
    # Keyword merge modes: 'add' | 'keep' and 'median' | 'max'.
    keyword_existing: str = "add"
    keyword_threshold: str = "median"

    @property
    def vocab_size(self) -> int:
        return self.n_topics * self.vocab_multiplier


DEFAULT_PARAMS = Params()
