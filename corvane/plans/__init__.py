"""All core queries."""

from corvane.plans import evidence, exchange, intelligence, more, sources, texts  # noqa: F401
