"""Reading and writing whole files from tasks, in any store that pyarrow opens by address."""

from __future__ import annotations

import re

from pyarrow import fs


def opened(address: str):
    if re.match(r"[a-z][a-z0-9+.-]*:", address) and not address.startswith("file:"):
        return fs.FileSystem.from_uri(address)
    return fs.LocalFileSystem(), re.sub(r"^file:(//)?", "", address)


def create(address: str):
    """Output stream; its folder is made if need be."""
    store, path = opened(address)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def publish(written: str, address: str) -> None:
    """Give a finished file its final name; the first of several attempts wins."""
    (store, path), (_, source) = opened(address), opened(written)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        store.move(source, path)
    else:
        store.delete_file(source)


def random_access(address: str):
    store, path = opened(address)
    return store.open_input_file(path)
