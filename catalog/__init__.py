"""The registered queries, their inputs and their SQL oracles."""

from . import jobs  # noqa: F401 - registers the whole jobs next to the single operators
