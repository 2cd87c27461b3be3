"""Launcher: spark-submit orderloom_job.py <step> --data-dir DIR --location DIR"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from orderloom.__main__ import main  # noqa: E402

if __name__ == "__main__":
    sys.exit(main())
