"""cashtide: payment charges in, monthly revenue series and forecasts out, as Spark plans."""

from cashtide.settings import Settings

__all__ = ["Settings"]
