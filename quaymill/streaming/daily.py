"""What a scheduler starts once a day: steps in order, each logged, none stopping the others."""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import traceback
from collections.abc import Callable
from pathlib import Path

#: A log larger than this is cut to its last lines.
LOG_BYTES, LOG_LINES = 2 << 20, 2000


def run_steps(steps: dict[str, Callable[[], object]], log: str | Path, now: dt.datetime | None = None, most: int = LOG_BYTES, lines: int = LOG_LINES) -> dict[str, str]:
    """Runs ``steps`` in order and appends to the log when each began, what it printed and how it ended: 'done', or the error. A step that
    fails doesn't keep the next from running, so that one source that is down costs that source only. The log is the driver's own
    file; it is cut to its last ``lines`` once it is larger than ``most`` bytes. Returns how each step ended."""
    path = Path(log)
    path.parent.mkdir(parents=True, exist_ok=True)
    ended = {}
    with path.open("a", encoding="utf-8") as out:
        out.write(f"\n===== {now or dt.datetime.now():%Y-%m-%d %H:%M:%S} =====\n")
        for name, step in steps.items():
            said = io.StringIO()
            try:
                with contextlib.redirect_stdout(said):
                    step()
                ended[name] = "done"
            except Exception as e:  # noqa: BLE001
                ended[name] = f"{type(e).__name__}: {e}"
                said.write(traceback.format_exc())
            out.write(f"--- {name} ---\n{said.getvalue().rstrip()}\n{ended[name]}\n")
            out.flush()
    if path.stat().st_size > most:
        kept = path.read_text(encoding="utf-8").splitlines()[-lines:]
        path.write_text("\n".join(kept) + "\n", encoding="utf-8")
    return ended
