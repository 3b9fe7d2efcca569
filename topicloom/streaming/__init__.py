from .live import STORE, late_rows, latest_bins, record_late_rows, run_available, stream_tail, stream_topic_weights

__all__ = ["STORE", "late_rows", "latest_bins", "record_late_rows", "run_available", "stream_tail", "stream_topic_weights"]
