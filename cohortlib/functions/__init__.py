from cohortlib.functions.columns import *  # noqa: F401,F403
from cohortlib.functions.nulls import *  # noqa: F401,F403
