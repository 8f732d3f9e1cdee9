"""A lock that one instance holds for as long as it runs."""

from __future__ import annotations

import fcntl
import os
from pathlib import Path


class InstanceLock:
    """Use as a context manager; raises RuntimeError if another process holds the lock."""

    def __init__(self, path: str | Path):
        self.path, self.fd = Path(path), None

    def __enter__(self) -> InstanceLock:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        fd = os.open(self.path, os.O_RDWR | os.O_CREAT, 0o600)
        try:
            fcntl.flock(fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            os.close(fd)
            raise RuntimeError(f"another instance holds {self.path}") from e
        self.fd = fd
        return self

    def __exit__(self, *exc) -> None:
        os.close(self.fd)
        self.fd = None
