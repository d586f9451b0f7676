"""Shared start-up of the batch jobs."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from modalframe.session import get_spark  # noqa: E402,F401
