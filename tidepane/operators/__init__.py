from tidepane.operators.panes import build_panes
from tidepane.operators.progress import accepted, dropped, with_progress
from tidepane.operators.windows import current_windows, final_windows, window_versions

__all__ = [
    "accepted", "build_panes", "current_windows", "dropped", "final_windows",
    "window_versions", "with_progress",
]
