"""sparkscout: automatic data discovery as Spark DataFrame jobs.

Read a table, prepare it (clean, impute, encode, profile), mine it for
correlations, segments, association rules, lead/lag relations, outliers,
dominant categories and skewed or variable measures, then score, narrate and
rank the findings - every step a DataFrame/SQL/ML job.
"""

from .operators.prepare import prepare
from .plans.discovery import discover, diverse_top, rank
from .sources.tables import insight_table, read_table, write_csv, write_insights

__all__ = ["read_table", "write_csv", "insight_table", "write_insights", "prepare", "discover",
           "rank", "diverse_top"]
