from playlens.functions.aggregates import GROUP_AGGREGATES, group_aggregate
from playlens.functions.columns import (log1p_weight, log_weight, percent,
                                        round_doubles, seeded_key)
from playlens.functions.numbering import global_index, rank_within

__all__ = ["GROUP_AGGREGATES", "group_aggregate", "log1p_weight", "log_weight",
           "percent", "round_doubles", "seeded_key", "global_index", "rank_within"]
