"""remedia: Spark DataFrame operators for complaint and application-risk analytics."""

from remedia.session import checkpoint_root, get_session

__all__ = ["checkpoint_root", "get_session"]
