from cellscope.streaming.rolling import stream_soc_range
from cellscope.streaming.scoring import start_assessment, stream_assess

__all__ = ["stream_assess", "start_assessment", "stream_soc_range"]
