"""Column functions."""

from .text import *  # noqa: F403
