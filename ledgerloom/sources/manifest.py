"""Manifests of directory trees: what a candidate's source binding hashes."""

from __future__ import annotations

import hashlib
import os
import stat
from dataclasses import dataclass

from ledgerloom.functions.canonical import canonical_hash, sha256


@dataclass(frozen=True)
class Entry:
    """A path with its mode and the hash of its content."""

    path: str
    mode: str
    sha256: str

    @classmethod
    def file(cls, path: str, content: bytes, executable: bool = False) -> Entry:
        return cls(path, "100755" if executable else "100644", sha256(content).hex())

    @classmethod
    def symlink(cls, path: str, target: bytes) -> Entry:
        return cls(path, "120000", sha256(target).hex())

    @classmethod
    def gitlink(cls, path: str, oid: str) -> Entry:
        """A commit of another repository, by its object name in hex."""
        if len(oid) not in (40, 64) or set(oid) - set("0123456789abcdef"):
            raise ValueError("not an object name")
        return cls(path, "160000", sha256(oid.encode()).hex())


def manifest_hash(entries: list[Entry]) -> bytes | None:
    """Hash of the manifest; nothing if two entries have one path."""
    table = {e.path: {"mode": e.mode, "sha256": e.sha256} for e in entries}
    return canonical_hash(table) if len(table) == len(entries) else None


def scan(root: str, gitlinks: dict[str, str] | None = None) -> list[Entry]:
    """Entries of a tree, without ``.git``; links are not followed.

    ``gitlinks`` maps paths of other repositories to their commits; each is an
    entry whether or not its folder is there, and the folder is not walked.  A
    path that is a file or a link as well is an error, and so is a name that is
    not UTF-8.  Only files, links and folders count (no pipes or devices).
    Files are read a mebibyte at a time.
    """
    gitlinks = gitlinks or {}
    found: dict[str, Entry] = {}
    todo = [""]
    while todo:
        at = todo.pop()
        for item in os.scandir(os.path.join(root, at)):
            name = os.fsencode(item.name).decode("utf-8")
            path = f"{at}/{name}" if at else name
            if item.is_symlink():
                found[path] = Entry.symlink(path, os.fsencode(os.readlink(item.path)))
            elif item.is_dir():
                if name != ".git" and path not in gitlinks:
                    todo.append(path)
            elif item.is_file():
                digest = hashlib.sha256()
                with open(item.path, "rb") as f:
                    while block := f.read(1 << 20):
                        digest.update(block)
                mode = "100755" if item.stat().st_mode & stat.S_IXUSR else "100644"
                found[path] = Entry(path, mode, digest.hexdigest())
    both = gitlinks.keys() & found.keys()
    if both:
        raise ValueError(f"{min(both)} is a commit's path and a file's")
    found |= {path: Entry.gitlink(path, oid) for path, oid in gitlinks.items()}
    return sorted(found.values(), key=lambda e: e.path)
