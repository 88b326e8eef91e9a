"""Registered queries; importing the modules fills the registry."""

from . import job_checks, memory_checks, mining_checks, review_checks, text_checks  # noqa: F401
from . import stream_checks  # noqa: F401 (after job_checks, whose SQL it shares)
from .registry import ORACLES, QUERIES  # noqa: F401
