"""Extract files: the index of regions that publishes them, ranged downloads with checksums, and files at hand.

These run on the driver: they fetch files and keep the catalog.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import catalog
from ..scratch import discard, written
from ..workspace import Workspace

#: The published index of regions; any address of the same form serves.
INDEX = "https://download.geofabrik.de/index-v1.json"
PIECE = 1 << 20


def parse_index(text: str) -> list[tuple[str, str, str | None, str]]:
    """(region, name, parent, address) of an index document; a region without a file has '-' for an address."""
    out = []
    for feature in json.loads(text)["features"]:
        p = feature["properties"]
        out.append((p["id"], p["name"], p.get("parent"), (p.get("urls") or {}).get("pbf") or catalog.NO_URL))
    return out


def fetch(url: str) -> str:
    with urllib.request.urlopen(url, timeout=60) as r:
        return r.read().decode()


def _stored(ws: Workspace, files: DataFrame) -> DataFrame:
    new = written(files)
    out = ws.put("pbf_files", new)
    discard(new)
    return out


def list_regions(ws: Workspace, fresh: bool = False, url: str = INDEX, get=fetch) -> DataFrame:
    """The indexed regions; the index is fetched where none is stored, or when asked for."""
    files = ws.table("pbf_files")
    if fresh or not files.where("region_id IS NOT NULL").take(1):
        items = ws.spark.createDataFrame(parse_index(get(url)), "region_id string, region_name string, region_parent string, url string")
        files = _stored(ws, catalog.region_index(files, items, int(time.time())))
    return catalog.regions(files)


def region_url(ws: Workspace, region: str, url: str = INDEX, get=fetch) -> str | None:
    """A region's address, from the catalog first, then from the index."""
    found = catalog.url_of(ws.table("pbf_files"), region)
    if found is None:
        list_regions(ws, url=url, get=get)
        found = catalog.url_of(ws.table("pbf_files"), region)
    return found


def local_files(folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the `.pbf` files of a folder, by path; a folder that isn't there has none."""
    try:
        with os.scandir(folder) as entries:
            return sorted((e.path, e.stat().st_size) for e in entries if e.name.endswith(".pbf"))
    except (FileNotFoundError, NotADirectoryError):
        return []


def find_file(ws: Workspace, wanted: str, folder: str) -> str | None:
    """An extract by its path, its name in the data folder, or its region or id in the catalog."""
    for path in (wanted, os.path.join(folder, wanted)):
        if os.path.exists(path):
            return path
    return catalog.path_of(ws.table("pbf_files"), wanted)


def md5_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "md5").hexdigest()


def check_md5(url: str, actual: str, get=fetch) -> str:
    """ok, mismatch, or unavailable where the address has no checksum beside it."""
    try:
        words = get(f"{url}.md5").split()
    except (urllib.error.URLError, OSError):
        return "unavailable"
    return "unavailable" if not words else "ok" if words[0] == actual else "mismatch"


@dataclass(frozen=True)
class Download:
    path: str
    size: int
    md5: str
    verdict: str
    reused: bool


def _length(url: str) -> int:
    with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=60) as r:
        return int(r.headers["Content-Length"])


def _range(url: str, first: int, last: int, path: str) -> None:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Range": f"bytes={first}-{last}"}), timeout=600) as r, open(path, "wb") as out:
        while piece := r.read(PIECE):
            out.write(piece)


def download(url: str, folder: str, threads: int = 4, length=_length, get_range=_range, get=fetch) -> Download:
    """The file of an address, fetched in as many ranges as threads and put together; a file that is there is kept.  Its
    checksum is compared with the published one."""
    path = os.path.join(folder, url.rsplit("/", 1)[-1] or "download.osm.pbf")
    reused = os.path.exists(path)
    if not reused:
        os.makedirs(folder, exist_ok=True)
        total = length(url)
        step = -(-total // threads)
        spans = [(a, min(a + step, total) - 1) for a in range(0, total, step)] if total else []
        names = [f"{path}.part{i}" for i in range(len(spans))]
        with ThreadPoolExecutor(threads) as pool:
            list(pool.map(lambda x: get_range(url, *x[0], x[1]), zip(spans, names)))
        whole = f"{path}.whole"
        with open(whole, "wb") as out:
            for name in names:
                with open(name, "rb") as part:
                    while piece := part.read(PIECE):
                        out.write(piece)
        for name in names:
            os.remove(name)
        os.replace(whole, path)
    md5 = md5_of(path)
    return Download(path, os.path.getsize(path), md5, check_md5(url, md5, get), reused)


def download_region(ws: Workspace, wanted: str, folder: str, threads: int = 4, **by) -> Download:
    """A region's or an address's file, noted in the catalog."""
    url = wanted if "://" in wanted else region_url(ws, wanted)
    if url is None:
        raise ValueError(f"no file is known for {wanted!r}")
    got = download(url, folder, threads, **by)
    _stored(ws, catalog.downloaded(ws.table("pbf_files"), url, got.path, got.size, got.md5, int(time.time())))
    return got
