"""Credit-risk analytics as Spark DataFrame operators."""

from tallyrisk.session import build_session, settle, shared_dir, tune

__all__ = ["build_session", "settle", "shared_dir", "tune"]
