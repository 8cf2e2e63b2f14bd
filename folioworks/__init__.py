"""Document analytics on Spark: DataFrame-to-DataFrame operators for text, speech and nested records."""

from folioworks.session import get_session

__all__ = ["get_session"]
