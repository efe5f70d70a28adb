from tidepane.streaming.exact import ExactStream
from tidepane.streaming.upsert import latest, pane_feed, start_upsert_feed, upsert_feed, windows_of_panes

__all__ = ["ExactStream", "latest", "pane_feed", "start_upsert_feed", "upsert_feed", "windows_of_panes"]
