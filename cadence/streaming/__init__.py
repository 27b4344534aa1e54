from cadence.streaming.panel_stream import daily_panel_stream, run_daily_panel

__all__ = ["daily_panel_stream", "run_daily_panel"]
