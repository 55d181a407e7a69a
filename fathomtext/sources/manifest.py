"""Tables whose current state one small file names: it is swapped when all else is written.

A table is a folder with data folders that are never changed and manifest-N.json files; the one with the
largest N counts. A writer makes new data folders first and the next manifest last, by one rename, so
readers see the old state or the new one, and a writer that dies leaves the old one. One writer
at a time: a second one finds its number taken and fails.
"""

from __future__ import annotations

import json
import re
import uuid

from pyarrow import fs


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def versions(folder: str) -> list[int]:
    store, root = opened(folder)
    if store.get_file_info(root).type != fs.FileType.Directory:
        return []
    return sorted(int(m[1]) for x in store.get_file_info(fs.FileSelector(root)) if (m := re.fullmatch(r"manifest-(\d+)\.json", x.base_name)))


def read(folder: str, version: int | None = None) -> tuple[int, dict]:
    """The number and the content of a version, the newest if none is named; (0, {}) of a table that is not there."""
    version = (versions(folder) or [0])[-1] if version is None else version
    if not version:
        return 0, {}
    store, root = opened(folder)
    with store.open_input_stream(f"{root}/manifest-{version}.json") as f:
        return version, json.loads(f.read())


def swap(folder: str, version: int, content: dict) -> int:
    """Make content the version after the given one; fails if another writer has been there."""
    store, root = opened(folder)
    store.create_dir(root, recursive=True)
    if (versions(folder) or [0])[-1] != version:
        raise RuntimeError(f"{folder} has changed since version {version} was read")
    held = f"{root}/.manifest-{uuid.uuid4().hex}"
    with store.open_output_stream(held) as f:
        f.write(json.dumps(content).encode())
    store.move(held, f"{root}/manifest-{version + 1}.json")
    return version + 1


def fresh(folder: str, name: str) -> str:
    """The URI of a new data folder below the table's."""
    return f"{folder.rstrip('/')}/data/{name}-{uuid.uuid4().hex}"


def vacuum(folder: str, used: set[str], keep: int = 1) -> int:
    """Delete all manifests but the newest keep, and the data folders whose URIs are not in use; returns how many folders went."""
    store, root = opened(folder)
    for v in versions(folder)[:-keep]:
        store.delete_file(f"{root}/manifest-{v}.json")
    names = {u.rstrip("/").rpartition("/")[2] for u in used}
    gone = 0
    if store.get_file_info(f"{root}/data").type == fs.FileType.Directory:
        for x in store.get_file_info(fs.FileSelector(f"{root}/data")):
            if x.type == fs.FileType.Directory and x.base_name not in names:
                store.delete_dir(x.path)
                gone += 1
    return gone
