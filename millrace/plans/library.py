"""Imports every module that registers queries."""

from millrace.plans import answers, frames, groups, relational, roundtrips, sources, streams, texts, tokens, training  # noqa: F401
