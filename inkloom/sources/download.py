"""Fetching of a dump over HTTP into a folder, taken up where it stopped; on the driver, since it is one file."""

from __future__ import annotations

import os
import re
import urllib.error
import urllib.request

CHUNK = 1 << 20


def _size(url: str, timeout: float) -> int | None:
    """The file's size by a HEAD request, None where the server doesn't say."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as r:
            return int(r.headers["Content-Length"]) if r.headers["Content-Length"] else None
    except (urllib.error.HTTPError, ValueError):
        return None


def fetch(url: str, folder: str, name: str | None = None, timeout: float = 60, report=None) -> str:
    """The path of the file in the folder, which is fetched unless it is there in full.

    What has come so far is in ``name.part``; the next call asks for the rest, and starts anew where the server sends
    something else than the rest. Only a complete file gets its name. ``report`` is called with bytes so far and in all
    (None where that isn't known). A file of another length than announced is an error, and stays as a part.
    """
    name = name or url.rsplit("/", 1)[-1]
    os.makedirs(folder, exist_ok=True)
    target, part = os.path.join(folder, name), os.path.join(folder, f"{name}.part")
    total = _size(url, timeout)
    if os.path.exists(target) and (total is None or os.path.getsize(target) == total):
        return target
    have = os.path.getsize(part) if os.path.exists(part) else 0
    if total is not None and have > total:
        have = 0
    if total is None or have < total:
        request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
        with urllib.request.urlopen(request, timeout=timeout) as r:
            came = re.match(r"bytes (\d+)-\d+/(\d+|\*)", r.headers.get("Content-Range", ""))
            if have and not (r.status == 206 and came and int(came[1]) == have):
                have = 0  # the whole file comes
            if came and came[2] != "*":
                total = int(came[2])
            with open(part, "r+b" if have else "wb") as out:
                out.seek(have)
                out.truncate()
                while block := r.read(CHUNK):
                    out.write(block)
                    have += len(block)
                    if report:
                        report(have, total)
    if total is not None and have != total:
        raise OSError(f"{url}: {have} of {total} bytes")
    os.replace(part, target)
    return target
