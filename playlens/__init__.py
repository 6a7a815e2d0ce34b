"""playlens: play-count analytics and recommendation on Spark DataFrames.

Every operator takes and returns DataFrames. Work stays on the executors;
the driver only sees scalars, bounded top-n lists and score rows.

Layout:
    sources/    readers of play tables, statistics, ID lists, stored groups,
                the derived test fixtures, and text sinks
    functions/  column expressions and shared skew-safe numbering helpers
    operators/  the operators: statistics, subsets, preference, indexing,
                splitting, groups, similarity, recommenders, metrics, tuning,
                coverage, song catalogue
    plans/      named queries (spark, sf_dir) -> DataFrame and DuckDB checks
    streaming/  the play statistics kept up to date over arriving files
"""

from playlens.session import ensure_checkpoint_dir, get_session, scratch_path

__all__ = ["ensure_checkpoint_dir", "get_session", "scratch_path"]
