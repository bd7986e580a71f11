"""Backup and restore of a data folder, sizes on disk, and the folder scaffold."""

from __future__ import annotations

import os
import shutil
import tarfile
import uuid

#: Folders of a data root, and those that backups and sizes leave out.
FOLDERS = ("procedural", "sessions", "episodic", "cold", "semantic", "semantic/oplog", "models", "logs", "checkpoints", "exports", "run")
LEFT_OUT = ("models", "logs")


def scaffold(root: str) -> None:
    for name in FOLDERS:
        os.makedirs(os.path.join(root, name), exist_ok=True)


def disk_bytes(root: str) -> int:
    total = 0
    for folder, names, files in os.walk(root):
        if folder == root:
            names[:] = [n for n in names if n not in LEFT_OUT]
        total += sum(os.path.getsize(os.path.join(folder, f)) for f in files)
    return total


def backup(root: str, target: str) -> None:
    with tarfile.open(target, "w:gz") as tar:
        for name in sorted(os.listdir(root)):
            if name not in (*LEFT_OUT, "lock"):
                tar.add(os.path.join(root, name), arcname=name)


def restore(archive: str, root: str, force: bool = False) -> None:
    """Unpack beside the root and swap; refuses paths outside the root, and existing data without `force`."""
    if os.path.isdir(root) and os.listdir(root) and not force:
        raise FileExistsError(f"{root} isn't empty")
    beside = f"{root.rstrip('/')}.restore-{uuid.uuid4().hex}"
    os.makedirs(beside)
    try:
        with tarfile.open(archive, "r:gz") as tar:
            for member in tar.getmembers():
                where = os.path.normpath(member.name)
                if where.startswith(("/", "..")) or member.issym() or member.islnk():
                    raise ValueError(f"unsafe path {member.name!r}")
            tar.extractall(beside, filter="data")
        if os.path.isdir(root):
            shutil.rmtree(root)
        os.replace(beside, root)
    finally:
        shutil.rmtree(beside, ignore_errors=True)
