"""One document of a repository that is read and replaced: contained, locked, and only if it is still what was read."""

from __future__ import annotations

import contextlib
import fcntl
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from spandrel.functions import paths

_FOLDER = os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW | os.O_CLOEXEC


@dataclass(frozen=True)
class Identity:
    """What tells one state of a file from another; None stands for no file."""

    device: int
    inode: int
    modified: int
    size: int


def _identity(name: str, folder: int) -> Identity | None:
    try:
        held = os.stat(name, dir_fd=folder, follow_symlinks=False)
    except FileNotFoundError:
        return None
    if not os.path.stat.S_ISREG(held.st_mode):
        raise ValueError("the target is a link or no file")
    return Identity(held.st_dev, held.st_ino, held.st_mtime_ns, held.st_size)


@contextlib.contextmanager
def _folder_of(root: str, path: str) -> Iterator[tuple[int, str]]:
    """(descriptor of the folder that holds path, name): opened part by part, so that no link leads out of root."""
    if paths.normalize(path) is None:
        raise ValueError("the target leaves the repository")
    *folders, name = paths.normalize(path).split("/")
    held = os.open(root, os.O_RDONLY | os.O_DIRECTORY | os.O_CLOEXEC)
    try:
        for part in folders:
            try:
                below = os.open(part, _FOLDER, dir_fd=held)
            except OSError as error:
                raise ValueError("the target is below a link or no folder") from error
            os.close(held)
            held = below
        yield held, name
    finally:
        os.close(held)


def read(root: str, path: str) -> tuple[str | None, Identity | None]:
    """(text, identity) of a document; (None, None) where there is none. A file that changes meanwhile is an error."""
    with _folder_of(root, path) as (folder, name):
        before = _identity(name, folder)
        if before is None:
            return None, None
        with os.fdopen(os.open(name, os.O_RDONLY | os.O_NOFOLLOW | os.O_CLOEXEC, dir_fd=folder), encoding="utf-8", errors="replace") as f:
            text = f.read()
        if _identity(name, folder) != before:
            raise ValueError("the target changed meanwhile")
        return text, before


def replace(root: str, path: str, content: str, expected: Identity | None) -> Identity:
    """Put content in the place of the document that had the expected identity, in one step; None: there was none.

    Writers of one folder wait for each other. On an error the document is as it was and nothing is left beside it.
    """
    with _folder_of(root, path) as (folder, name):
        fcntl.flock(folder, fcntl.LOCK_EX)
        if _identity(name, folder) != expected:
            raise ValueError("the target changed meanwhile")
        mode = 0o644 if expected is None else os.stat(name, dir_fd=folder).st_mode & 0o777
        draft = f".{uuid.uuid4().hex}.tmp"
        try:
            with os.fdopen(os.open(draft, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_CLOEXEC, mode, dir_fd=folder), "w", encoding="utf-8") as f:
                f.write(content)
                f.flush()
                os.fsync(f.fileno())
            if _identity(name, folder) != expected:
                raise ValueError("the target changed meanwhile")
            os.replace(draft, name, src_dir_fd=folder, dst_dir_fd=folder)
        except BaseException:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(draft, dir_fd=folder)
            raise
        os.fsync(folder)
        return _identity(name, folder)
