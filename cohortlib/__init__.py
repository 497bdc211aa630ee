"""Episode-of-care cohort analytics on Spark DataFrames."""

from cohortlib.spec import ADULT, CHILD, Bands, Rule, RunSpec

__all__ = ["ADULT", "CHILD", "Bands", "Rule", "RunSpec"]
