"""Operators on series: sampling, algebra, baskets and sequential folds."""

from .algebra import *  # noqa: F403
from .baskets import *  # noqa: F403
from .dynamics import *  # noqa: F403
from .folds import *  # noqa: F403
