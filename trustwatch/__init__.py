"""trustwatch: data trust and anomaly analytics for ordered, grouped signal tables on Spark."""

from trustwatch.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
