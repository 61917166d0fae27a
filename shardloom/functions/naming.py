"""Names: shard lists, file keys, globs, cache names and rewrites, as driver-side helpers and as columns."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Mapping
from urllib.parse import quote, urlparse

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Key: up to the first dot of the base name; extension: the rest.
KEY_EXT = r"^((?:.*/|)[^.]+)[.]([^/]*)$"


def split_name(path: str) -> tuple[str, str] | None:
    """``(key, extension)`` of a file name, None if it has no extension."""
    m = re.match(KEY_EXT, path)
    return (m[1], m[2]) if m else None


def key_of(path: Column) -> Column:
    """The key of a file name, null if it has none."""
    return F.when(path.rlike(KEY_EXT), F.regexp_extract(path, KEY_EXT, 1))


def ext_of(path: Column, lower: bool = True) -> Column:
    """The extension of a file name, null if it has none."""
    ext = F.regexp_extract(path, KEY_EXT, 2)
    return F.when(path.rlike(KEY_EXT), F.lower(ext) if lower else ext)


def _close(text: str, start: int) -> int:
    depth = 0
    for k in range(start, len(text)):
        depth += {"{": 1, "}": -1}.get(text[k], 0)
        if depth == 0:
            return k
    return -1


def _choices(body: str) -> list[str] | None:
    span = re.fullmatch(r"(-?\d+)\.\.(-?\d+)(?:\.\.(-?\d+))?", body)
    if span:
        low, high = int(span[1]), int(span[2])
        step = abs(int(span[3] or 1)) or 1
        width = max(len(span[1]), len(span[2])) if any(re.match(r"-?0\d", span[k]) for k in (1, 2)) else 0
        return [str(n).zfill(width) for n in range(low, high + (1 if high >= low else -1), step if high >= low else -step)]
    letters = re.fullmatch(r"([A-Za-z])\.\.([A-Za-z])", body)
    if letters:
        a, b = ord(letters[1]), ord(letters[2])
        return [chr(n) for n in range(a, b + (1 if b >= a else -1), 1 if b >= a else -1)]
    parts, depth, begin = [], 0, 0
    for k, c in enumerate(body):
        depth += {"{": 1, "}": -1}.get(c, 0)
        if c == "," and depth == 0:
            parts.append(body[begin:k])
            begin = k + 1
    return [x for p in [*parts, body[begin:]] for x in expand_braces(p)] if parts else None


def expand_braces(text: str) -> list[str]:
    """All strings that ``{a,b}`` and ``{000..099}`` in ``text`` stand for, in order; other braces stay."""
    at = text.find("{")
    while at >= 0:
        end = _close(text, at)
        choices = _choices(text[at + 1 : end]) if end > 0 else None
        if choices is not None:
            tails = expand_braces(text[end + 1 :])
            return [text[:at] + c + t for c in choices for t in tails]
        at = text.find("{", at + 1)
    return [text]


def lookup(name: str, env: Mapping[str, str] | None = None, prefix: str = "SHARDS_") -> str:
    """A variable by its prefixed name; an unknown one is an error."""
    values = os.environ if env is None else env
    if prefix + name not in values:
        raise KeyError(f"{prefix}{name} is not set")
    return values[prefix + name]


def substitute(text: str, env: Mapping[str, str] | None = None, prefix: str = "SHARDS_", rounds: int = 10) -> str:
    """``${X}`` replaced by its variable, again in what comes out, ``rounds`` times at most."""
    for _ in range(rounds):
        new = re.sub(r"\$\{(\w+)\}", lambda m: lookup(m[1], env, prefix), text)
        if new == text:
            break
        text = new
    return text


def expand_path(text: str) -> str:
    """``~`` and ``$VAR`` in a path."""
    return os.path.expanduser(os.path.expandvars(text))


def expand_urls(urls: str | Iterable[str], env: Mapping[str, str] | None = None) -> list[str]:
    """A list of shards from one string (parts between ``::``) or several, variables and braces expanded."""
    parts = [p for u in ([urls] if isinstance(urls, str) else urls) for p in u.split("::")]
    return [x for p in parts for x in expand_braces(substitute(p, env))]


def expand_source(source: str | Iterable[str], most: int = 1_000_000_000) -> list[str]:
    """The shards of a string, or of an iterable that is taken as it is, ``most`` at most."""
    if isinstance(source, str):
        return expand_urls(source)[:most]
    out = []
    for url in source:
        if len(out) >= most:
            break
        out.append(url)
    return out


def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression for a glob with ``* ? [..]`` and braces; it means the same in Java, RE2 and Python."""
    def one(glob: str) -> str:
        out, k = "", 0
        while k < len(glob):
            c = glob[k]
            end = glob.find("]", k + 2) if c == "[" else -1
            if c == "*":
                out += ".*"
            elif c == "?":
                out += "."
            elif end > 0:
                body = glob[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
                out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
                k = end
            else:
                out += re.sub(r"([^A-Za-z0-9_/])", r"\\\1", c)
            k += 1
        return out

    return "^(?s:" + "|".join(one(p) for p in expand_braces(pattern)) + ")$"


def matches_glob(name: Column, pattern: str) -> Column:
    """Whether a name matches a glob, or one of several between semicolons."""
    tests = [name.rlike(glob_to_regex(p)) for p in pattern.split(";")]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def cache_name(url: str, ndir: int = 0) -> str:
    """File name under which a shard is cached: the end of its path, or of the quoted address for commands."""
    if re.match(r"^(https?|hdfs|gs|ais|s3|s3a|ftp|sftp|file|[a-z0-9]+):", url, re.I) and not url.startswith("pipe:"):
        parts = [quote(p, safe="._-=+,~%") for p in urlparse(url).path.strip("/").split("/")]
        return "/".join(parts[-1 - ndir :]) if parts[-1] else quote(url, safe="_+{}*,-")[-128:]
    if url.startswith("pipe:") or re.search(r"[\s|;]", url):
        return quote(url, safe="_+{}*,-")[-128:]
    return "/".join(url.strip("/").split("/")[-1 - ndir :])


def cache_name_column(url: Column) -> Column:
    """The last part of an address's path without query and fragment; the host for an empty path."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z0-9+.-]+://", "")
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def parse_rewrites(spec: str) -> list[tuple[str, str]]:
    """``regex=replacement;...`` as pairs."""
    return [tuple(p.split("=", 1)) for p in spec.split(";") if "=" in p]  # type: ignore[misc]


def rewrite(url: str, rules: list[tuple[str, str]]) -> str:
    """The address with the first rule that matches its beginning applied once."""
    for pattern, new in rules:
        out, times = re.subn(f"^(?:{pattern})", new, url, count=1)
        if times:
            return out
    return url


def rewrite_column(url: Column, rules: list[tuple[str, str]]) -> Column:
    """``rewrite`` as a column; replacements are literal."""
    out = url
    for pattern, new in reversed(rules):
        anchored = f"^(?:{pattern})"
        out = F.when(url.rlike(anchored), F.regexp_replace(url, anchored, new.replace("\\", "\\\\").replace("$", "\\$"))).otherwise(out)
    return out
