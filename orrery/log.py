"""The library's logger: its level and the form of its lines."""

from __future__ import annotations

import logging

logger = logging.getLogger("orrery")
FORMAT = "%(asctime)s %(levelname)s %(message)s"


def set_format(text: str = FORMAT) -> None:
    """Lines of this form go to the standard error output; a second call replaces the first one's handler."""
    for h in [h for h in logger.handlers if getattr(h, "own", False)]:
        logger.removeHandler(h)
    handler = logging.StreamHandler()
    handler.own = True
    handler.setFormatter(logging.Formatter(text))
    logger.addHandler(handler)


def set_level(level: int | str) -> None:
    logger.setLevel(level.upper() if isinstance(level, str) else level)
    if not logger.handlers:
        set_format()
