"""Changes of single notes in a folder, guarded by the hash of what they replace.

These are transactions on one small file each; nothing of them is distributed.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import uuid
from pathlib import Path

from trellis.sources.files import EXCLUDED, front_matter

_LINK = re.compile(r"!?\[\[([^\[\]#^|]+)(?:[#^][^\[\]|]*)?(?:\|[^\[\]]*)?\]\]")
_HEAD = re.compile(r"^(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$")


class Conflict(RuntimeError):
    """The file is not what the caller has seen."""


def digest(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode("utf-8")).hexdigest()


def replace_file(path: Path, text: str) -> None:
    """Write beside the file, then put it in its place."""
    path.parent.mkdir(parents=True, exist_ok=True)
    tmp = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    try:
        tmp.write_text(text, encoding="utf-8")
        os.replace(tmp, path)
    finally:
        tmp.unlink(missing_ok=True)


def split_front(text: str) -> tuple[dict, str]:
    m = re.match(r"^---[ \t]*\n([\s\S]*?)\n---[ \t]*(?:\n|$)", text)
    return (front_matter(m[1]), text[m.end() :]) if m else ({}, text)


def join_front(front: dict, body: str) -> str:
    if not front:
        return body
    lines = []
    for k, v in front.items():
        if isinstance(v, list):
            lines.append(f"{k}: [{', '.join(_plain(x) for x in v)}]")
        elif isinstance(v, dict):
            lines.append(f"{k}:")
            for s, w in v.items():
                lines.append(f"  {s}: [{', '.join(_plain(x) for x in w)}]" if isinstance(w, list) else f"  {s}: {_plain(w)}")
        else:
            lines.append(f"{k}: {_plain(v)}")
    return "---\n" + "\n".join(lines) + "\n---\n" + body


def _plain(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    s = str(v)
    return s if not isinstance(v, str) or re.fullmatch(r"[\w./-][\w ./-]*", s) and not re.fullmatch(r"(?i)null|true|false|[\d.-]+", s) else "'" + s + "'"


class Vault:
    """A folder of notes; paths are relative and stay inside of it."""

    def __init__(self, root: str | Path, audit: str | Path | None = None):
        self.root = Path(root).resolve()
        self.audit = Path(audit) if audit else None

    def resolve(self, path: str) -> Path:
        at = (self.root / path).resolve()
        if not at.is_relative_to(self.root) or any(p in EXCLUDED for p in at.relative_to(self.root).parts):
            raise PermissionError(f"{path} lies outside of the notes")
        return at

    def log(self, tool: str, target: str, status: str, before: str = "", after: str = "") -> None:
        """A line in the audit log; a log that cannot be written stops nothing."""
        if self.audit is None:
            return
        try:
            with open(self.audit, "a", encoding="utf-8") as f:
                f.write(json.dumps({"ts": time.time(), "tool": tool, "target": target, "status": status, "before": before, "after": after}) + "\n")
        except OSError:
            pass

    def read(self, path: str) -> dict:
        at = self.resolve(path)
        text = at.read_text(encoding="utf-8")
        front, body = split_front(text)
        return {"path": path, "content": text, "front": front, "body": body, "hash": digest(text), "mtime_ms": int(at.stat().st_mtime * 1000)}

    def list(self, folder: str = "", pattern: str = "*.md", recursive: bool = True) -> list[str]:
        at = self.resolve(folder) if folder else self.root
        found = at.rglob(pattern) if recursive else at.glob(pattern)
        return sorted(str(p.relative_to(self.root)) for p in found if p.is_file() and not any(x in EXCLUDED for x in p.relative_to(self.root).parts))

    def write(self, path: str, text: str, expected: str = "") -> str:
        """Create a note, or replace the one whose hash is ``expected``; returns the new hash."""
        at = self.resolve(path)
        if at.exists():
            now = digest(at.read_text(encoding="utf-8"))
            if not expected:
                self.log("write", path, "ALREADY_EXISTS", now)
                raise FileExistsError(path)
            if now != expected:
                self.log("write", path, "CONFLICT", now)
                raise Conflict(path)
        elif expected:
            raise Conflict(f"{path} is gone")
        replace_file(at, text)
        self.log("write", path, "ok", expected, digest(text))
        return digest(text)

    def patch(self, path: str, heading: str, body: str, expected: str) -> str:
        """Replace the text of one section, its heading and its neighbours stay; the first heading that fits counts."""
        lines = self.read(path)["content"].split("\n")
        fence = False
        heads = []
        for i, line in enumerate(lines):
            if re.match(r"^ {0,3}(```|~~~)", line):
                fence = not fence
            elif not fence and (m := _HEAD.match(line)):
                heads.append((i, len(m[1]), m[2], line.strip()))
        hit = next((h for h in heads if heading.strip() in (h[2], h[3])), None)
        if hit is None:
            raise KeyError(heading)
        end = next((h[0] for h in heads if h[0] > hit[0] and h[1] <= hit[1]), len(lines))
        new = [*lines[: hit[0] + 1], "", *body.strip("\n").split("\n"), "", *lines[end:]]
        return self.write(path, "\n".join(new), expected)

    def update_front(self, path: str, updates: dict, expected: str = "") -> str:
        """Merge keys into the front matter; a null removes a key."""
        note = self.read(path)
        front = {k: v for k, v in {**note["front"], **updates}.items() if v is not None}
        return self.write(path, join_front(front, note["body"]), expected or note["hash"])

    def tags(self, path: str, add: tuple[str, ...] = (), remove: tuple[str, ...] = (), expected: str = "") -> list[str]:
        """Add tags, then remove tags; order is kept, each once, without a leading #."""
        now = self.read(path)["front"].get("tags") or []
        now = [now] if isinstance(now, str) else now
        gone = {t.lstrip("#") for t in remove}
        tags = [t for t in dict.fromkeys(str(t).lstrip("#") for t in [*now, *add]) if t not in gone]
        self.update_front(path, {"tags": tags}, expected)
        return tags

    def move(self, source: str, target: str, expected: str = "") -> None:
        a, b = self.resolve(source), self.resolve(target)
        if b.exists():
            raise FileExistsError(target)
        if expected and self.read(source)["hash"] != expected:
            raise Conflict(source)
        b.parent.mkdir(parents=True, exist_ok=True)
        os.replace(a, b)
        self.log("move", f"{source} -> {target}", "ok")

    def delete(self, path: str, expected: str = "") -> str:
        """Move a note to the trash, under a name with the time if its own is taken there."""
        at = self.resolve(path)
        if expected and self.read(path)["hash"] != expected:
            raise Conflict(path)
        trash = self.root / ".trash" / path
        if trash.exists():
            trash = trash.with_name(f"{trash.stem}-{time.time_ns()}{trash.suffix}")
        trash.parent.mkdir(parents=True, exist_ok=True)
        os.replace(at, trash)
        self.log("delete", path, "ok")
        return str(trash.relative_to(self.root))

    def links(self, path: str) -> dict[str, list[str]]:
        """Targets of a note's links in order, and the notes that link to it by name or path."""
        out = [t.strip() for t in _LINK.findall(self.read(path)["content"])]
        names = {Path(path).stem.lower(), str(Path(path).with_suffix("")).lower()}
        into = [p for p in self.list() if p != path and any(t.strip().lower() in names for t in _LINK.findall((self.root / p).read_text(encoding="utf-8")))]
        return {"outgoing": out, "incoming": into}
