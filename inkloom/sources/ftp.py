"""Files of an FTP server as rows: the driver lists the tree, executors fetch contents, with one connection for each
partition."""

from __future__ import annotations

import ftplib
import io
from urllib.parse import quote, unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from inkloom.sources.files import format_of_name


def connect(url: str, timeout: float = 60) -> ftplib.FTP:
    """A connection to the host of ``ftp://user:password@host:port/path``, anonymous where no user is named."""
    u = urlsplit(url)
    ftp = ftplib.FTP(timeout=timeout, encoding="utf-8")
    ftp.connect(u.hostname or "", u.port or ftplib.FTP_PORT)
    ftp.login(unquote(u.username or ""), unquote(u.password or ""))
    return ftp


def list_tree(url: str, timeout: float = 60):
    """(path, size) of all files below a URL, folder by folder in the order of names; links aren't followed."""
    ftp = connect(url, timeout)
    try:
        folders = [unquote(urlsplit(url).path).rstrip("/")]
        while folders:
            folder = folders.pop(0)
            for name, facts in sorted(ftp.mlsd(folder or "/", ["type", "size"])):
                if facts.get("type") == "dir":
                    folders.append(f"{folder}/{name}")
                elif facts.get("type") == "file":
                    yield f"{folder}/{name}", int(facts.get("size", -1))
    finally:
        ftp.close()


def walk(spark: SparkSession, url: str, content: bool = False, partitions: int = 8, timeout: float = 60) -> DataFrame:
    """path (a URL without user and password), length, format, and with ``content`` content and error, of the files of
    known formats below a URL. A file that can't be fetched is a row with its error; an empty tree gives no rows."""
    u = urlsplit(url)
    base = f"ftp://{u.hostname}" + (f":{u.port}" if u.port else "")
    found = [(base + quote(p), n, format_of_name(p)) for p, n in list_tree(url, timeout) if format_of_name(p)]
    rows = spark.createDataFrame(found, "path string, length long, format string").repartition(max(1, min(partitions, len(found))))
    if not content:
        return rows

    def fetch(batches):
        ftp = None
        for batch in batches:
            for path, length, fmt in batch.itertuples(index=False):
                data, error = None, None
                for last in (False, True):  # a connection may have timed out since the last file
                    try:
                        ftp = ftp or connect(url, timeout)
                        held = io.BytesIO()
                        ftp.retrbinary(f"RETR {unquote(urlsplit(path).path)}", held.write)
                        data, error = held.getvalue(), None
                        break
                    except ftplib.error_perm as e:
                        error = f"{type(e).__name__}: {e}"
                        break
                    except (ftplib.Error, OSError, EOFError) as e:
                        ftp, error = None, f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"path": [path], "length": [length], "format": [fmt], "content": [data], "error": [error]})
        if ftp is not None:
            ftp.close()

    return rows.mapInPandas(fetch, "path string, length long, format string, content binary, error string")
