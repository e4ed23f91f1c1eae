"""Feature marts and similarity search as Spark jobs."""

from vectormart.session import make_session, work_folder

__all__ = ["make_session", "work_folder"]
