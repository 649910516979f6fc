from rowferry.streaming.load import loaded_rows, progress_rows, stream_load

__all__ = ["loaded_rows", "progress_rows", "stream_load"]
