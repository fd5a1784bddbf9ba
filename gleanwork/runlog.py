"""The log of a run: `run_<UTC>.log`, and the console."""

from __future__ import annotations

import logging
import time
from datetime import datetime
from pathlib import Path


def setup_logging(folder: str, now: datetime, level: int = logging.INFO) -> logging.Logger:
    """The package's logger, writing `time | level | logger | message` in UTC."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    log = logging.getLogger("gleanwork")
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    form = logging.Formatter("%(asctime)s | %(levelname)s | %(name)s | %(message)s", "%Y-%m-%dT%H:%M:%SZ")
    form.converter = time.gmtime
    for handler in (logging.StreamHandler(), logging.FileHandler(Path(folder, now.strftime("run_%Y%m%d_%H%M%S.log")), encoding="utf-8")):
        handler.setFormatter(form)
        log.addHandler(handler)
    log.setLevel(level)
    return log
