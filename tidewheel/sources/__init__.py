"""Sources and sinks of series."""

from .files import *  # noqa: F403
from .generators import *  # noqa: F403
from .sinks import *  # noqa: F403
