"""Openers of shards: a table of schemes, secure by default, with an optional file cache."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import sys
import tempfile
import time
import urllib.request
from collections.abc import Callable
from typing import IO

from shardloom.functions.naming import cache_name, parse_rewrites, rewrite


class Policy:
    """What may be opened: in secure mode neither commands nor rewriting; ``local`` allows files of this machine."""

    def __init__(self, secure: bool = True, local: bool = True, rewrites: str = ""):
        if secure and rewrites:
            raise PermissionError("rewriting is off in secure mode")
        self.secure, self.local, self.rewrites = secure, local, parse_rewrites(rewrites)


def _file(path: str, mode: str, policy: Policy) -> IO[bytes]:
    if not policy.local:
        raise PermissionError("local files are off")
    path = re.sub(r"^file:(//)?", "", path)
    if mode == "wb":
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    return open(path, mode)


def _pipe(url: str, mode: str, policy: Policy) -> IO[bytes]:
    if policy.secure:
        raise PermissionError("commands are off in secure mode")
    return Pipe(url.removeprefix("pipe:"), mode)  # type: ignore[return-value]


def _http(url: str, mode: str, policy: Policy) -> IO[bytes]:
    if mode != "rb":
        raise ValueError("http is read only")
    return urllib.request.urlopen(url, timeout=60)


def _unknown(url: str, mode: str, policy: Policy) -> IO[bytes]:
    raise ValueError(f"no opener for {url}: read it by Spark's file systems or register one")


class Pipe:
    """A command as a stream; its exit status is checked when it is closed or read to its end."""

    def __init__(self, command: str, mode: str, ignored: tuple[int, ...] = (0, 141)):
        self.ignored, self.command = ignored, command
        stdio = {"stdout": subprocess.PIPE} if mode == "rb" else {"stdin": subprocess.PIPE}
        self.process = subprocess.Popen(command, shell=True, **stdio)
        self.stream = self.process.stdout if mode == "rb" else self.process.stdin

    def _check(self, status: int | None) -> None:
        if status is not None and status not in self.ignored:
            raise OSError(f"{self.command}: exit status {status}")

    def read(self, n: int = -1) -> bytes:
        data = self.stream.read(n)
        if not data and n:
            self._check(self.process.wait())
        return data

    def write(self, data: bytes) -> int:
        return self.stream.write(data)

    def close(self) -> None:
        self.stream.close()
        self._check(self.process.wait())

    def __enter__(self) -> Pipe:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


Opener = Callable[[str, str, Policy], IO[bytes]]
SCHEMES: dict[str, Opener] = {"": _file, "file": _file, "pipe": _pipe, "http": _http, "https": _http}


def register(scheme: str, opener: Opener) -> None:
    """Add or replace the opener of a scheme."""
    SCHEMES[scheme] = opener


def open_url(url: str, mode: str = "rb", policy: Policy | None = None) -> IO[bytes]:
    """A byte stream of an address; ``-`` is standard input or output."""
    policy = policy or Policy()
    if mode not in ("rb", "wb"):
        raise ValueError("streams are read (rb) or written (wb)")
    if url == "-":
        return sys.stdin.buffer if mode == "rb" else sys.stdout.buffer
    url = rewrite(url, policy.rewrites)
    scheme = m[1].lower() if (m := re.match(r"^([A-Za-z][A-Za-z0-9+.-]+):", url)) else ""
    return SCHEMES.get(scheme, _unknown)(url, mode, policy)


def is_local(url: str) -> bool:
    """Whether an address is a file of this machine."""
    return url.startswith("file:") or not re.match(r"^[A-Za-z][A-Za-z0-9+.-]+:", url)


def file_kind(path: str) -> str | None:
    """``gzip`` or ``tar`` by the file's first bytes, None for neither."""
    with open(path, "rb") as f:
        head = f.read(512)
    return "gzip" if head[:2] == b"\x1f\x8b" else "tar" if head[257:262] == b"ustar" else None


def is_archive(path: str) -> bool:
    return file_kind(path) is not None


class FileCache:
    """Shards kept in a directory of one executor: fetched once, checked, oldest removed beyond ``max_bytes``.

    A file is fetched under a name of its own and renamed, so that tasks of one
    machine never see half of it.
    """

    def __init__(self, directory: str, max_bytes: int = -1, interval: float = 30, tries: int = 3, check: Callable[[str], bool] = is_archive, name: Callable[[str], str] = cache_name):
        self.directory, self.max_bytes, self.interval, self.tries, self.check, self.name = directory, max_bytes, interval, tries, check, name
        self._cleaned = 0.0
        os.makedirs(directory, exist_ok=True)

    def path(self, url: str, policy: Policy | None = None) -> str:
        """The local file of an address."""
        if is_local(url):
            return re.sub(r"^file:(//)?", "", url)
        target = os.path.join(self.directory, self.name(url))
        if not os.path.exists(target):
            os.makedirs(os.path.dirname(target), exist_ok=True)
            self._fetch(url, target, policy)
            self.clean()
        return target

    def _fetch(self, url: str, target: str, policy: Policy | None) -> None:
        for attempt in range(self.tries):
            handle, part = tempfile.mkstemp(dir=os.path.dirname(target))
            try:
                with os.fdopen(handle, "wb") as out, open_url(url, "rb", policy) as source:
                    shutil.copyfileobj(source, out, 1 << 20)
                if not self.check(part):
                    raise OSError(f"{url} is not an archive")
                os.replace(part, target)
                return
            except OSError:
                if attempt + 1 == self.tries:
                    raise
                time.sleep(0.2 * 1.5**attempt)
            finally:
                if os.path.exists(part):
                    os.unlink(part)

    def clean(self, force: bool = False) -> list[str]:
        """Remove the files changed longest ago until the rest fit; returns their names."""
        if self.max_bytes < 0 or (not force and time.time() - self._cleaned < self.interval):
            return []
        self._cleaned = time.time()
        files = [os.path.join(d, f) for d, _, fs in os.walk(self.directory) for f in fs]
        known = sorted((os.stat(f).st_ctime, f, os.stat(f).st_size) for f in files)
        total, gone = sum(s for _, _, s in known), []
        for _, f, s in known:
            if total <= self.max_bytes:
                break
            os.unlink(f)
            total -= s
            gone.append(f)
        return gone
