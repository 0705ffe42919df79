"""Column cleaning on Spark DataFrames: small transforms, recipes of them, and frame-level helpers."""

import logging

from scrubwell.functions.addresses import *  # noqa: F403
from scrubwell.functions.dates import *  # noqa: F403
from scrubwell.functions.names import *  # noqa: F403
from scrubwell.functions.numbers import *  # noqa: F403
from scrubwell.functions.stats import *  # noqa: F403
from scrubwell.functions.tables import *  # noqa: F403
from scrubwell.functions.text import *  # noqa: F403
from scrubwell.functions.values import *  # noqa: F403
from scrubwell.operators.canonicalize import *  # noqa: F403
from scrubwell.operators.combine import *  # noqa: F403
from scrubwell.operators.filters import *  # noqa: F403
from scrubwell.operators.group import *  # noqa: F403
from scrubwell.operators.schema import *  # noqa: F403
from scrubwell.operators.validate import *  # noqa: F403
from scrubwell.plans.compose import *  # noqa: F403
from scrubwell.streaming.clean import *  # noqa: F403
from scrubwell.plans.recipes import *  # noqa: F403
from scrubwell.plans.recipes import ALL as RECIPES
from scrubwell.types import ColumnTransform  # noqa: F401

logging.getLogger(__name__).addHandler(logging.NullHandler())
__version__ = "0.1.0"
