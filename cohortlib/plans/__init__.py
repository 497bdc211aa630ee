from cohortlib.plans.report import short_report
from cohortlib.plans.study import Study, study

__all__ = ["Study", "short_report", "study"]
