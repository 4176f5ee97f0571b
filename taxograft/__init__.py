"""taxograft: place new concepts into an existing taxonomy with Spark DataFrames."""

from taxograft.model import Sentinels, Settings

__all__ = ["Sentinels", "Settings"]
