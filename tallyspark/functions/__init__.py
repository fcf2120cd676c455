"""Scalar rules (Column -> Column) and the fixed values they use."""

from . import fixed
from .expr import *  # noqa: F401,F403
