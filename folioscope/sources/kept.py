"""What a slow host has sent, kept in a shared folder the moment it arrives.

Requests to such a host are made one after the other and are dear; whoever takes over from a lost task or a lost driver
looks here first. A name appears with its whole content or not at all. The folder is a path or an address that
`pyarrow.fs` can open, on storage that every executor reaches.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from pyarrow import fs


class Kept:
    def __init__(self, folder: str):
        self.system, self.folder = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)

    def _path(self, name: str) -> str:
        return f"{self.folder}/{quote(name, safe='')}"

    def names(self) -> list[str]:
        found = self.system.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        return sorted(unquote(f.base_name) for f in found if f.type == fs.FileType.File and not f.base_name.startswith("_"))

    def get(self, name: str) -> bytes | None:
        try:
            with self.system.open_input_stream(self._path(name)) as file:
                return file.read()
        except FileNotFoundError:
            return None

    def put(self, name: str, content: bytes) -> None:
        self.system.create_dir(self.folder, recursive=True)
        part = f"{self.folder}/_{uuid.uuid4().hex}"
        with self.system.open_output_stream(part) as file:
            file.write(content)
        self.system.move(part, self._path(name))
