"""Column-level functions."""
from hazeframe.functions.scalars import *  # noqa: F401,F403
from hazeframe.functions import scalars  # noqa: F401
